"""Near-duplicate documents by Order MinHash and banded alignment.

A text becomes the sequence of its shingles of five words, each labelled by how often it occurred
before. A sketch takes the few shingles with the smallest hashes and hashes them in the order they
have in the text, so it tells texts apart that hold the same shingles in another order. Texts with a
sketch in common are candidates. A candidate pair is verified by aligning the two sequences within a
band as wide as the similarity allows: matches / (length a + length b - matches) >= 0.8, the
Jaccard similarity of the labelled shingles with their order kept.

Sketches of several minima miss pairs of few shingles, so those have an exact path: sequences of at
most ``SHORT`` shingles meet by every subsequence that is long enough to be what a pair has in common.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import linked_classes
from .common import cut, drop, written

WORDS = 5
SIMILARITY = 0.8
SKETCHES = 24
MINIMA = 5
SHORT = 10
SEED = 4
_KEPT = 1_000_000
_U = np.uint64


class WordHashes(dict):
    """64-bit hashes of words, kept."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode())
        return h


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


def shingles(text: str, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """Hashes of the shingles in order; a text of fewer words is one shingle, one without words none."""
    found = text.split()
    w = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    if not len(w):
        return w
    width = min(words, len(w))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        h = h * _U(0x9E3779B97F4A7C15) + w[k : len(w) - width + 1 + k]
    return _mix(h)


def labelled(h: np.ndarray) -> np.ndarray:
    """Mix in how often each value occurred before."""
    order = np.argsort(h, kind="stable")
    s = h[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
    start = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
    seen = np.empty(len(h), np.uint64)
    seen[order] = np.arange(len(s)) - start
    return _mix(h + seen * _U(0xA24BAED4963EE407))


_SALTS = np.random.default_rng(SEED).integers(0, 1 << 63, 256, dtype=np.uint64)


def sketches(h: np.ndarray, count: int = SKETCHES, minima: int = MINIMA) -> list[int]:
    """Order MinHash sketches of a labelled sequence."""
    if not len(h):
        return []
    out = []
    each = max(1, 500_000 // len(h))
    for start in range(0, count, each):
        salts = _SALTS[start : min(start + each, count)]
        v = _mix(h[None, :] ^ salts[:, None])
        least = np.argpartition(v, minima - 1, axis=1)[:, :minima] if len(h) > minima else np.broadcast_to(np.arange(len(h)), (len(salts), len(h)))
        picked = h[np.sort(least, axis=1)]
        s = salts.copy()
        for k in range(picked.shape[1]):
            s = _mix(s * _U(0x9E3779B97F4A7C15) + picked[:, k])
        out.append(s)
    return np.concatenate(out).view(np.int64).tolist()


def short_keys(h: np.ndarray, similarity: float) -> list[int]:
    """Hashes of the subsequences that may be all that a sequence and a similar one have in common."""
    out = []
    for less in range(int(len(h) * (1 - similarity) + 1e-9) + 1):
        picked = h[np.array(list(combinations(range(len(h)), len(h) - less)))]
        s = np.full(len(picked), _SALTS[-1])
        for k in range(picked.shape[1]):
            s = _mix(s * _U(0x9E3779B97F4A7C15) + picked[:, k])
        out.append(s)
    return np.unique(np.concatenate(out)).view(np.int64).tolist()


def candidate_keys(h: np.ndarray, count: int, minima: int, similarity: float) -> list[int]:
    """The buckets of a sequence of shingles: its sketches, and the keys of the exact path for a short
    one; those alone if whatever is similar must be short too."""
    short = short_keys(h, similarity) if 0 < len(h) <= SHORT else []
    return short if short and len(h) <= SHORT * similarity + 1e-9 else short + sketches(labelled(h), count, minima)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY, counted: bool = False) -> bool:
    """Whether an alignment of the sequences matches enough: m / (len a + len b - m) >= similarity.

    Such an alignment leaves at most D = (len a + len b) (1 - s) / (1 + s) elements unmatched, so
    it stays within D of the diagonal. The rows of the band are bits of one integer: a zero marks a
    position up to which one more element is matched. ``counted``: it is known that they have enough
    elements in common.
    """
    n, m = len(a), len(b)
    if not n or not m:
        return False
    need = similarity * (n + m) / (1 + similarity) - 1e-9
    if min(n, m) < need:
        return False
    x, y = a.tolist(), b.tolist()
    if not counted and sum((Counter(x) & Counter(y)).values()) < need:
        return False
    start = 0
    while start < min(n, m) and x[start] == y[start]:
        start += 1
    end = 0
    while end < min(n, m) - start and x[n - 1 - end] == y[m - 1 - end]:
        end += 1
    x, y = x[start : n - end], y[start : m - end]
    matches = start + end
    band = int(n + m - 2 * need) + 1
    places: dict[int, list[int]] = {}
    for i, c in enumerate(x):
        places.setdefault(c, []).append(i)
    width = 2 * band + 1
    full = (1 << width) - 1
    v, base = full, -band  # bit k stands for position base + k of x
    for j, c in enumerate(y):
        if j:
            matches += not v & 1
            v = v >> 1 | 1 << (width - 1)
            base += 1
        hit = 0
        for i in places.get(c, ()):
            if 0 <= i - base < width:
                hit |= 1 << (i - base)
        u = v & hit
        v = ((v + u) | (v - u)) & full
    matches += width - v.bit_count()
    return matches >= need


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share, above the diagonal of a square matrix."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[: len(values)])
    size = np.diff(np.append(first, len(values)))
    each = np.repeat(size, size)
    rare, rare_end = owner[each <= _RARE], np.repeat(first + size, size)[each <= _RARE]
    at = np.flatnonzero(each <= _RARE)
    out = np.zeros(n * n, np.int64)
    for step in range(1, _RARE):  # values of few sets: pairs of their owners
        near = np.flatnonzero(at + step < rare_end)
        if not len(near):
            break
        out += np.bincount(rare[near] * n + owner[at[near] + step], minlength=n * n)
    out = out.reshape(n, n)
    often = np.flatnonzero(size > _RARE)
    for k in range(0, len(often), 2048):  # the others: products of columns of ones
        part = often[k : k + 2048]
        has = np.zeros((n, len(part)), np.float32)
        for c, g in enumerate(part):
            has[owner[first[g] : first[g] + size[g]], c] = 1
        out += np.rint(has @ has.T).astype(np.int64)
    return out


_RARE = 32


def _compare(similarity: float):
    def make():
        hashes = WordHashes()

        def compare(payloads):
            seqs = [shingles(t, hashes) for (t,) in payloads]
            size = np.array([len(s) for s in seqs])
            need = similarity * (size[:, None] + size[None, :]) / (1 + similarity) - 1e-9
            may = (common_counts([labelled(s) for s in seqs]) >= need) & (need > 0)
            return may, lambda i, j: aligned(seqs[i], seqs[j], similarity, counted=True)

        return compare

    return make


def _sketch_rows(count: int, minima: int, similarity: float):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            got = [None if t is None else candidate_keys(shingles(t, hashes), count, minima, similarity) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("d"), batch.column("h"), batch.column("size"), pa.array(got, pa.list_(pa.int64()))], ["d", "h", "size", "sketches"])

    return run


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("d"), F.md5("text").alias("h"), F.octet_length("text").cast("long").alias("size"), "text")


_MADE = "d long, h string, size long, sketches array<long>"


def _text_classes(docs: DataFrame, made: DataFrame, similarity: float) -> DataFrame:
    """Classes of the texts in ``made`` (d, h, sketches) that have copies or near copies: (h, class_d,
    class_h), the latter of the text with the smallest d, null last."""
    spark = docs.sparkSession
    nodes, at_nodes = written(made.groupBy("h").agg(F.min("d").alias("rep"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("sketches").alias("sketches")).withColumn("node", F.monotonically_increasing_id()))
    members = nodes.select("node", "size", F.explode(F.array_distinct("sketches")).alias("bucket"))
    several = members.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket")
    members = cut(members.join(several, "bucket", "left_semi").select("bucket", "node", "size"))
    wanted = nodes.join(members.select("node").distinct(), "node", "left_semi").select("node", F.col("h").alias("node_h"), "rep")
    plain = _hashed(docs)
    here = (plain["h"] == wanted["node_h"]) & plain["d"].eqNullSafe(wanted["rep"])
    texts, at_texts = written(plain.join(wanted, here).select("node", "h", "d", "text").dropDuplicates(["h", "d"]).select("node", "text"))
    drop(spark)
    roots = linked_classes(members, texts, _compare(similarity))
    drop(spark, at_texts)
    rooted = nodes.select("node", "h", "rep", "n").join(roots, "node", "left").select("h", "rep", "n", "root", F.coalesce("root", "node").alias("at"))
    rooted = rooted.where("root is not null or n > 1")
    least = rooted.groupBy("at").agg(F.min(F.struct(F.col("rep").isNull().alias("last"), "rep", "h")).alias("least"))
    out = cut(rooted.join(least, "at").select("h", F.col("least.rep").alias("class_d"), F.col("least.h").alias("class_h")))
    drop(spark, at_nodes)
    return out


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, count: int = SKETCHES, minima: int = MINIMA) -> DataFrame:
    """Classes of near duplicates among ``docs`` (doc_id integer, text; other columns are ignored).

    Returns doc_id, class_id (the smallest doc_id of the class), kept (whether it is that one), one
    row per input row; of repeated rows with the kept doc_id each says kept. Equal texts are one
    class, empty ones included; texts without words equal nothing else; a null text or a null
    doc_id is in no class (class_id = doc_id, kept). Rows that share a doc_id are judged by their
    own texts. An empty table gives an empty result.
    """
    made, _ = written(_hashed(docs).mapInArrow(_sketch_rows(count, minima, similarity), _MADE))
    classes = _text_classes(docs, made.where("d is not null and h is not null"), similarity)
    kind = docs.schema["doc_id"].dataType
    alone = made.where("d is null or h is null").select("d", F.col("d").alias("class_d"))
    met = made.where("d is not null and h is not null").select("d", "h").join(classes, "h", "left").select("d", F.coalesce("class_d", "d").alias("class_d"))
    return met.union(alone).select(F.col("d").cast(kind).alias("doc_id"), F.col("class_d").cast(kind).alias("class_id"), F.col("d").eqNullSafe(F.col("class_d")).alias("kept"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, count: int = SKETCHES, minima: int = MINIMA) -> DataFrame:
    """One row of each class of near duplicates of ``docs`` (doc_id, text), with all its columns.

    Rows are judged by their own text, so rows that share a doc_id or have none are told apart: the
    smallest doc_id of the class stays, null last, then the smallest hash; of equal rows one. Rows with
    a null text all stay.
    """
    made, at_made = written(_hashed(docs).where("text is not null").mapInArrow(_sketch_rows(count, minima, similarity), _MADE))
    classes = _text_classes(docs, made, similarity)
    met = made.select("d", "h").join(classes, "h").withColumn("stays", (F.col("h") == F.col("class_h")) & F.col("d").eqNullSafe(F.col("class_d")))
    met = cut(met.groupBy("d", "h", "stays").agg(F.count("*").alias("n")))
    drop(docs.sparkSession, at_made)
    lost = met.where("not stays").select(F.col("d").alias("lost_d"), F.col("h").alias("lost_h"))
    own = F.struct("*")
    keyed = docs.select(own.alias("row"), F.md5("text").alias("h"), F.col("doc_id").cast("long").alias("d"))
    left = keyed.join(lost, (F.col("h") == F.col("lost_h")) & F.col("d").eqNullSafe(F.col("lost_d")), "left_anti")
    if not met.where("stays and n > 1").isEmpty():
        left = left.where("h is null").unionByName(left.where("h is not null").dropDuplicates(["d", "h"]))
    return left.select("row.*")
