"""Near-duplicate embeddings: sign hashing by random hyperplanes, exact cosine, connected components.

Equal vectors are one before anything is compared. Each of TABLES tables deals the vectors of a
label into 2^BITS buckets by the signs of their products with random planes. A vector pair is
compared in the first table in which it meets, so nothing is counted twice. Buckets over BLOCK
vectors are cut into blocks, and pairs of blocks are compared apart; what leaves a block pair is one
row per vector (its links there, and the smallest vector reachable there), never the pairs.

At cosine 0.93 a plane parts two vectors with probability 0.12, a pair misses all tables with
probability (1 - 0.88^12)^24, 0.3 %; nearer pairs far less often.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, partitions

COSINE = 0.93
TABLES = 24
BITS = 12
BLOCK = 1024
SEED = 5


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that their squares neither overflow nor vanish; exact."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1))[1][:, None])


def signatures(x: np.ndarray, tables: int, bits: int) -> np.ndarray:
    planes = np.random.default_rng([SEED, x.shape[1]]).standard_normal((x.shape[1], tables * bits))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(2).astype(np.uint16)


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n by the links i - j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _sign_rows(tables: int, bits: int):
    def run(batches):
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            sig: list = [None] * len(vectors)
            by_size: dict[int, list[int]] = {}
            for k, v in enumerate(vectors):
                by_size.setdefault(len(v), []).append(k)
            for rows in by_size.values():
                x = scaled(np.array([vectors[k] for k in rows], np.float64))
                for k, s in zip(rows, signatures(x, tables, bits), strict=True):
                    sig[k] = s.tolist()
            raw = [np.asarray(v, np.float32 if single else np.float64).tobytes() for v, single in zip(vectors, batch.column("single").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("copies"), batch.column("single"), pa.array([len(v) for v in vectors], pa.int32()), pa.array(sig, pa.list_(pa.int32())), pa.array(raw, pa.binary())], ["id", "label", "copies", "single", "size", "sig", "raw"])

    return run


def _compare(threshold: float):
    """Over rows sorted by block pair: per vector its links and the smallest vector reachable."""

    def run(batches):
        held: list[tuple] = []
        out: list[tuple] = []

        def settle():
            if len(held) < 2:
                held.clear()
                return
            table, one, two = held[0][0][1], held[0][0][3], held[0][0][4]
            ids = np.array([r[1] for r in held], np.int64)
            copies = np.array([r[2] for r in held], np.int64)
            block = np.array([r[3] for r in held])
            sig = np.array([r[4] for r in held], np.int32)
            kind = np.float32 if held[0][5] else np.float64
            x = scaled(np.stack([np.frombuffer(r[6], kind) for r in held]).astype(np.float64))
            held.clear()
            x /= np.sqrt((x * x).sum(1))[:, None]
            rows = np.flatnonzero(block == one)
            cols = np.flatnonzero(block == two)
            near = x[rows] @ x[cols].T >= threshold
            if one == two:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            i, j = rows[i], cols[j]
            new = np.ones(len(i), bool)
            for t in range(table):
                new &= sig[i, t] != sig[j, t]
            i, j = i[new], j[new]
            if not len(i):
                return
            order = np.argsort(ids)
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
            root = ids[order][_roots(len(ids), rank[i], rank[j])][rank]
            hit = np.flatnonzero(links)
            out.extend(zip(ids[hit].tolist(), links[hit].astype(np.int64).tolist(), root[hit].tolist(), strict=True))

        def batch_of():
            b = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else ([], [], []))], ["id", "links", "root"])
            out.clear()
            return b

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "t", "size", "one", "two")), strict=True))
            rest = [batch.column(c).to_pylist() for c in ("id", "copies", "block", "sig", "single", "raw")]
            for key, row in zip(keys, zip(*rest, strict=True), strict=True):
                if held and held[0][0] != key:
                    settle()
                held.append((key, *row))
            if len(out) > 10_000:
                yield batch_of()
        settle()
        yield batch_of()

    return run


def near_vectors(vectors: DataFrame, threshold: float = COSINE, tables: int = TABLES, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Links and components of ``vectors`` (vec_id, embedding, label; other columns are ignored).

    Returns vec_id, n_links, component_id, kept, one row per input row. Vectors that are null, empty,
    zero or hold a null or non-finite component, and rows with a null label or vec_id, link with
    nothing (component_id = vec_id, kept). Vectors of different sizes don't link. Rows that share a
    vec_id, in one label or several, are vectors of their own. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    single = "float" in vectors.schema["embedding"].dataType.simpleString()
    e = F.col("embedding")
    fine = e.isNotNull() & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), F.col("label")).alias("label"), "embedding")
    rows = rows.withColumn("embedding", F.when(F.col("label").isNotNull(), e))
    classes = rows.where("label is not null").groupBy("label", "embedding").agg(F.min(F.col("vec_id").cast("long")).alias("least"), F.count("*").alias("copies"))
    classes = cut(cut(classes).withColumn("id", F.monotonically_increasing_id()))  # a number of its own for each vector: ids may be shared
    signed = cut(classes.select("id", F.col("label").cast("string").alias("label"), "copies", F.lit(single).alias("single"), "embedding").mapInArrow(_sign_rows(tables, bits), "id long, label string, copies long, single boolean, size int, sig array<int>, raw binary"))

    light = signed.select("id", "label", "size", F.posexplode("sig").alias("t", "bucket"))
    hashes = [F.bit_xor(F.xxhash64("id", F.lit(k))).alias(f"x{k}") for k in (1, 2)]
    sizes = light.groupBy("label", "size", "t", "bucket").agg(F.count("*").alias("n"), *hashes).where("n > 1")
    # Of buckets with the same members the one of the first table is compared: there all its pairs have met.
    sizes = sizes.groupBy("label", "size", "n", "x1", "x2").agg(F.min(F.struct("t", "bucket")).alias("first")).select("label", "size", "n", "first.t", "first.bucket")
    dealt = light.join(sizes, ["label", "size", "t", "bucket"]).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("block", F.pmod(F.hash("id"), F.col("blocks")))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("one"), F.greatest(k, F.col("block")).alias("two")))
    dealt = dealt.withColumn("meet", F.explode(meets)).select("id", "size", "t", F.concat_ws("/", "label", "bucket").alias("bucket"), "block", "meet.one", "meet.two")
    full = dealt.join(signed.select("id", "copies", "single", "sig", "raw"), "id")
    keys = ["bucket", "t", "size", "one", "two"]
    met = cut(full.repartition(partitions(spark), *keys).sortWithinPartitions(*keys).mapInArrow(_compare(threshold), "id long, links long, root long"))

    links = met.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(met.select(F.col("id").alias("a"), F.col("root").alias("b")))
    known = classes.join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("group", F.coalesce("root", "id"))
    several = known.where("root is not null").groupBy("group").agg(F.min("least").alias("smallest"))
    known = known.join(several, "group", "left").select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("smallest", "least").alias("root"))
    kind = vectors.schema["vec_id"].dataType
    alone = rows.where("label is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    met = rows.where("label is not null").join(known, ["label", "embedding"]).select("vec_id", F.col("n_links").cast("long"), F.col("root").cast(kind).alias("component_id"), F.col("root").eqNullSafe(F.col("vec_id").cast("long")).alias("kept"))
    return met.unionByName(alone)


def expected_recall(cosine: float = COSINE, tables: int = TABLES, bits: int = BITS) -> float:
    """Probability that two vectors of this cosine meet in some table."""
    same = 1 - math.acos(cosine) / math.pi
    return 1 - (1 - same**bits) ** tables


# The same by brute force: all pairs of a label.
ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a), m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id, vec_id <= coalesce(m.least, vec_id) AS kept
FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN m ON m.a = vec_id
"""
