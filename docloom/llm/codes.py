"""Compression of vectors to codes: eight parts, each named by the nearest of sixteen codebook entries.

The entry nearest to a part is found by lower bounds, coarse to fine. A part x and an entry c are cut
into the same segments; with a segment's length n, means a and b, and residual norms r and s, its share
of the squared distance is at least n (a - b)^2 + (r - s)^2. The whole part is the first segment, then
come halves, quarters and so on. Entries whose bound exceeds the exact distance of the entry with the
least first bound are out; a margin far above the rounding error keeps the filter conservative. The
survivors get exact integer distances, so codes equal those of a full scan.

Every round is one pass over the table with the codebooks in the closure: a task returns a count and
sums for each of its 8 x 16 entries, Spark adds them up, and 128 rows reach the driver whatever the
size of the table. Nothing is written between rounds, so a lost executor costs its own tasks only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .integers import floors, usable

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Share of the operands' squared norms that a bound is lowered by; float64 errs by some 1e-15 of them.
MARGIN = 1e-11


def _cuts(size: int) -> list[np.ndarray]:
    """Segment starts by level: one segment, two, four ... while segments hold two components or more."""
    out, n = [], 1
    while n * 2 <= max(size, 2):
        out.append(np.unique(np.arange(n) * size // n))
        n *= 2
    return out


def _segments(x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, means and residual norms of the segments of each row."""
    lengths = np.diff(np.append(starts, x.shape[1]))
    means = np.add.reduceat(x, starts, axis=1) / lengths
    rest = x - np.repeat(means, lengths, axis=1)
    return lengths, means, np.sqrt(np.add.reduceat(rest * rest, starts, axis=1))


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Index of the nearest of ``entries`` to each row of ``x`` (int64 both; ties to the lower index), its
    squared distance, and how many pairs were left after each level of bounds."""
    n, k = len(x), len(entries)
    if not n or not x.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), []
    fx, fe = x.astype(np.float64), entries.astype(np.float64)
    slack = MARGIN * ((fx * fx).sum(1)[:, None] + (fe * fe).sum(1)[None, :])
    cuts = _cuts(x.shape[1])
    lengths, mx, rx = _segments(fx, cuts[0])
    _, me, re = _segments(fe, cuts[0])
    bound = lengths[0] * (mx - me.T) ** 2 + (rx - re.T) ** 2 - slack
    guess = bound.argmin(1)
    best = ((x - entries[guess]) ** 2).sum(1)
    i, j = np.nonzero(bound <= best[:, None])
    left = [len(i)]
    for starts in cuts[1:]:
        lengths, mx, rx = _segments(fx, starts)
        _, me, re = _segments(fe, starts)
        bound = (lengths * (mx[i] - me[j]) ** 2 + (rx[i] - re[j]) ** 2).sum(1) - slack[i, j]
        stay = bound <= best[i]
        i, j = i[stay], j[stay]
        left.append(len(i))
    exact = np.full((n, k), np.iinfo(np.int64).max)
    exact[i, j] = ((x[i] - entries[j]) ** 2).sum(1)
    code = exact.argmin(1)
    return code, exact[np.arange(n), code], left


def _parts(x: np.ndarray, p: int) -> np.ndarray:
    width = x.shape[1] // PARTS
    return x[:, p * width : (p + 1) * width]


def _totals(size: int, books: np.ndarray):
    """Per task and entry: how many parts it is nearest to, and their sums."""

    def run(batches):
        counts = np.zeros(books.shape[:2], np.int64)
        sums = np.zeros(books.shape, np.int64)
        for batch in batches:
            found = floors(batch.column("embedding"), SCALE).get(size)
            if found:
                for p in range(PARTS):
                    part = _parts(found[1], p)
                    code = nearest(part, books[p])[0]
                    counts[p] += np.bincount(code, minlength=len(counts[p]))
                    np.add.at(sums[p], code, part)
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _encoder(size: int | None, books: np.ndarray | None):
    def run(batches):
        for batch in batches:
            code: list = [None] * len(batch)
            error: list = [None] * len(batch)
            kept = []
            for width, (rows, x) in floors(batch.column("embedding"), SCALE).items():
                kept += rows.tolist()
                if width == size:
                    found = [nearest(_parts(x, p), books[p])[:2] for p in range(PARTS)]
                    total = np.sum([e for _, e in found], axis=0)
                    for row, c, e in zip(rows.tolist(), np.stack([c for c, _ in found], 1).astype(np.uint8), total.tolist(), strict=True):
                        code[row], error[row] = c.tobytes().hex(), e
            out = pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])
            yield out.take(pa.array(sorted(kept), pa.int64()))

    return run


def _rows(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


def codebooks(vectors: DataFrame, rounds: int = ROUNDS) -> np.ndarray | None:
    """Final codebooks (part, entry, position), None if no vector can be coded. They start as the parts of the
    vectors with the smallest ids (equal ids by the integers of the vector, null ids last)."""
    rows = _rows(vectors)
    fit = rows.where(usable(F.col("embedding")) & (F.size("embedding") >= PARTS) & (F.size("embedding") % PARTS == 0))
    whole = fit.select("vec_id", F.transform("embedding", lambda v: F.floor(v * SCALE)).alias("q"), "embedding")
    first = whole.orderBy(F.asc_nulls_last("vec_id"), "q").limit(1).select(F.size("embedding").alias("size")).collect()
    if not first:
        return None
    size = first[0].size
    start = whole.where(F.size("embedding") == size).orderBy(F.asc_nulls_last("vec_id"), "q").limit(ENTRIES).select("embedding").toArrow()
    _, x = floors(start.column("embedding").combine_chunks(), SCALE)[size]
    books = np.stack([_parts(x, p) for p in range(PARTS)])
    for _ in range(rounds):
        met = rows.select("embedding").mapInArrow(_totals(size, books), "part int, entry int, n long, sums array<long>")
        added = met.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(size // PARTS)])
        books = books.copy()
        for part, entry, n, *sums in added.collect():
            books[part, entry] = np.array(sums, np.int64) // n
    return books


def digest(books: np.ndarray | None) -> str:
    return hashlib.sha256(b"" if books is None else ",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Codes of ``vectors`` (vec_id, embedding, label; other columns are ignored): vec_id, code, error,
    label_error, codebooks_sha256, one row per row whose vector is kept.

    Dropped are vectors that are null or hold a null or non-finite component. All vectors are meant to
    have one size, a multiple of eight: that of the kept vector with the smallest id whose size is one.
    A kept vector of another size has no code and no error (null) and counts in no codebook and no
    label's error; a label of such vectors alone has the error null. Fewer than sixteen vectors give as
    many entries. Repeated rows count each by themselves; null labels are one label. Components are
    bounded by a squared norm of 2^60 after scaling (see floors). An empty table gives an empty result.
    """
    books = codebooks(vectors, rounds)
    size = None if books is None else books.shape[2] * PARTS
    kinds = dict(vectors.dtypes)
    coded = _rows(vectors).mapInArrow(_encoder(size, books), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _oracle(rounds: int = ROUNDS) -> str:
    """The same by full scans, a pair of steps for each round."""
    steps = [
        f"""v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT r, p, list_slice(q, p * (len(q) // {PARTS}) + 1, (p + 1) * (len(q) // {PARTS})) AS x FROM v, (SELECT unnest(range({PARTS})) AS p)),
b0 AS (SELECT p, r - 1 AS e, x AS c FROM p WHERE r <= {ENTRIES})"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS (SELECT r, a.p, e, x, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p a JOIN b{k} b ON a.p = b.p),
n{k} AS (SELECT r, p, e, x, d FROM (SELECT *, row_number() OVER (PARTITION BY r, p ORDER BY d, e) AS k FROM d{k}) WHERE k = 1)""")
        if k < rounds:
            steps.append(f"""s{k} AS (SELECT p, e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM n{k}) GROUP BY p, e, i),
m{k} AS (SELECT p, e, list(CAST(CASE WHEN s < 0 THEN -((-s + n - 1) // n) ELSE s // n END AS BIGINT) ORDER BY i) AS c FROM s{k} GROUP BY p, e),
b{k + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON b.p = m.p AND b.e = m.e)""")
    steps.append(f"""t AS (SELECT sha256(coalesce(string_agg(array_to_string(c, ','), ',' ORDER BY p, e), '')) AS h FROM b{rounds}),
o AS (SELECT r, string_agg(format('{{:02x}}', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n{rounds} GROUP BY r),
l AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM o JOIN v ON o.r = v.r GROUP BY label)""")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, label_error, h AS codebooks_sha256 FROM v JOIN o ON v.r = o.r JOIN l ON v.label IS NOT DISTINCT FROM l.label, t"


ORACLE = _oracle()
