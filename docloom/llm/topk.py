"""Exact nearest rows by inner product, with distances to pivots as bounds.

For a query q and a candidate c, q.c = (|q|^2 + |c|^2 - |q - c|^2) / 2, and by the triangle inequality
|q - c| is at least | |q - p| - |c - p| | for every pivot p. Each block of candidates holds a table of
its distances to all pivots; the largest of a candidate's lower bounds gives an upper bound of its
score. Candidates are evaluated exactly, in integers, in the order of these bounds, until the next
bound is below the score of the worst row still wanted; equal scores may still win by their id, so the
search goes on while bounds are equal.

Rows are dealt to blocks of at most some BLOCK rows (less on small tables, so that all cores work), and
every query goes to every block: what moves is each candidate once and the queries once a block. A
sample of SAMPLE rows gives the pivots (farthest-first) and each query's first threshold, the score of
the k-th best row of the sample. Being of the table themselves these rows make a threshold that cuts
no result, so the sample decides what is saved and never what is found. A block returns at most k + 1
rows a query, none below the threshold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import partitions
from .integers import floors, usable

SCALE = 1024
TOP = 10
EVERY = 100
PIVOTS = 32
SAMPLE = 1024
BLOCK = 16384
BLOCK_BYTES = 32 << 20
#: Added to bounds, as a share of the squared norms they come from. A distance errs by some 1e-8 of the norms at most.
MARGIN = 1e-6
#: Candidates evaluated at once; doubled from step to step.
STEP = 64
NONE = int(np.iinfo(np.int64).min)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    fx, fp = x.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((fx * fx).sum(1)[:, None] + (fp * fp).sum(1)[None, :] - 2 * fx @ fp.T, 0))


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n different rows of x, each as far from the ones before it as any."""
    chosen = [0]
    far = distances(x, x[:1])[:, 0]
    while len(chosen) < n:
        far[chosen] = 0
        if not far.max() > 0:
            break
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]


def pivots_of(sample: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    return {size: spread(x, PIVOTS) for size, x in sample.items()}


class Block:
    """Candidates of one size, with their distances to the pivots."""

    def __init__(self, ids: list, x: np.ndarray, pivots: np.ndarray | None):
        self.ids, self.x = ids, x
        self.pivots = np.zeros((0, x.shape[1]), np.int64) if pivots is None else pivots
        self.table = distances(x, self.pivots)
        self.squares = (x.astype(np.float64) ** 2).sum(1)
        self.largest = float(self.squares.max(initial=0))
        self.place = np.empty(len(ids), np.int64)  # in the order of ids, nulls last
        self.place[sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))] = np.arange(len(ids))
        self.evaluated = 0

    def best(self, q: np.ndarray, k: int, least: int) -> list[tuple]:
        """The k best (id, score) of at least ``least``, equal scores by the smaller id."""
        square = float((q.astype(np.float64) ** 2).sum())
        near = np.abs(self.table - distances(q[None, :], self.pivots)).max(1, initial=0)
        bound = (square + self.squares - near * near) / 2 + MARGIN * (square + self.largest)
        order = np.flatnonzero(bound >= least)
        order = order[np.argsort(-bound[order], kind="stable")]
        rows, scores, at, step = np.empty(0, np.int64), np.empty(0, np.int64), 0, max(STEP, k)
        while at < len(order) and (len(scores) < k or bound[order[at]] >= scores[-1]):
            more = order[at : at + step]
            rows, scores = np.append(rows, more), np.append(scores, self.x[more] @ q)
            kept = np.lexsort((self.place[rows], -scores))[:k]
            rows, scores = rows[kept], scores[kept]
            at, step = at + len(more), step * 2
            self.evaluated += len(more)
        return [(self.ids[r], s) for r, s in zip(rows.tolist(), scores.tolist(), strict=True) if s >= least]


def _whole(batches):
    """Vectors as integers: vec_id, size, raw."""
    for batch in batches:
        rows, size, raw = [], [], []
        for width, (places, x) in floors(batch.column("embedding"), SCALE).items():
            rows += places.tolist()
            size += [width] * len(places)
            raw += [r.tobytes() for r in x]
        ids = batch.column("vec_id").take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int32()), pa.array(raw, pa.binary())], ["vec_id", "size", "raw"])


def _thresholds(sample: dict[int, np.ndarray], k: int):
    """For each query the score of its k-th best row in the sample, and its own score with itself."""

    def run(batches):
        for batch in batches:
            least, own = [], []
            for raw, size in zip(batch.column("raw").to_pylist(), batch.column("size").to_pylist(), strict=True):
                q, x = np.frombuffer(raw, np.int64), sample.get(size)
                own.append(int(q @ q))
                least.append(NONE if x is None or len(x) < k else int(np.partition(x @ q, len(x) - k)[len(x) - k]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64()), pa.array(own, pa.int64())], [*batch.schema.names, "least", "own"])

    return run


def _search(pivots: dict[int, np.ndarray], k: int):
    """Over rows sorted by block, candidates before queries."""

    def run(batches):
        now, held, blocks = None, [], None
        for batch in batches:
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("block", "query", "vec_id", "size", "raw", "least", "own", "copies")]
            for block, query, vec_id, size, raw, least, own, copies in zip(*columns, strict=True):
                if block != now:
                    now, held, blocks = block, [], None
                if not query:
                    held.append((size, vec_id, raw))
                    continue
                if blocks is None:
                    blocks = {}
                    for s in {h[0] for h in held}:
                        x = np.frombuffer(b"".join(h[2] for h in held if h[0] == s), np.int64).reshape(-1, s) if s else np.zeros((len(held), 0), np.int64)[: sum(h[0] == s for h in held)]
                        blocks[s] = Block([h[1] for h in held if h[0] == s], x, pivots.get(s))
                    held = []
                if size in blocks:
                    out += [(vec_id, raw, copies, own, i, s) for i, s in blocks[size].best(np.frombuffer(raw, np.int64), k, least)]
            made = list(zip(*out, strict=True)) or [()] * 6
            kinds = (batch.schema.field("vec_id").type, pa.binary(), pa.int64(), pa.int64(), batch.schema.field("vec_id").type, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds, strict=True)], ["query_id", "raw", "copies", "own", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: Column, k: int = TOP, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """For each row of ``vectors`` (vec_id integer, embedding; other columns are ignored) that meets
    ``queries``, a condition on vec_id, the k other rows of the highest inner product of
    floor(1024 * x): query_id, rank (from 1), vec_id, score.

    Equal scores go by the smaller vec_id, null ids last; fewer than k other rows give as many. Vectors
    that are null or hold a null or non-finite component neither ask nor answer, and vectors of unlike
    sizes don't meet. A null vec_id is no query. Rows that share a vec_id, repeated rows too, are rows
    of their own: each asks, and each is a candidate of the others. Components are bounded by a squared
    norm of 2^60 after scaling (see floors). An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["vec_id"]
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    drawn = rows.where(usable(F.col("embedding"))).orderBy(F.xxhash64("vec_id", "embedding")).limit(sample).select("embedding").toArrow()
    known = {size: x for size, (_, x) in floors(drawn.column("embedding").combine_chunks(), SCALE).items()} if len(drawn) else {}
    widest = max(known, default=1)
    fit = max(256, min(block, BLOCK_BYTES // (8 * max(1, widest))))
    blocks = max(partitions(spark), -(-rows.count() // fit))

    whole = f"vec_id {kind}, size int, raw binary"
    candidates = rows.mapInArrow(_whole, whole).withColumn("block", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
    asked = rows.where(queries).mapInArrow(_whole, whole).groupBy("vec_id", "size", "raw").agg(F.count("*").alias("copies"))
    asked = asked.mapInArrow(_thresholds(known, k + 1), f"{whole}, copies long, least long, own long").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = candidates.withColumn("query", F.lit(False)).unionByName(asked.withColumn("query", F.lit(True)), allowMissingColumns=True)
    dealt = both.repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "query")
    met = dealt.mapInArrow(_search(pivots_of(known), k + 1), f"query_id {kind}, raw binary, copies long, own long, vec_id {kind}, score long")

    best = met.withColumn("asks", F.md5("raw")).drop("raw")
    order = Window.partitionBy("query_id", "asks").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    # The query's own row is the first with its id and its score with itself; where it isn't among these, the first k stand.
    itself = F.min(F.when((F.col("vec_id") == F.col("query_id")) & (F.col("score") == F.col("own")), F.col("place"))).over(Window.partitionBy("query_id", "asks"))
    best = best.withColumn("itself", F.coalesce(itself, F.lit(k + 1))).where("place <> itself")
    best = best.withColumn("rank", F.col("place") - (F.col("place") > F.col("itself")).cast("int"))
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("query_id", "rank", "vec_id", "score")


def every(n: int = EVERY) -> Column:
    """The stated query set: rows whose id is divisible by n."""
    return F.col("vec_id") % n == 0


# The same by all scores of all queries.
ORACLE = f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.r <> b.r AND len(a.q) = len(b.q)),
k AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM k WHERE rank <= {TOP}
"""
