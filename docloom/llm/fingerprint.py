"""Document fingerprints by a randomised embedding of edit distance into Hamming distance.

All texts share one random bit for each pair of a step and a character. A walk reads the text: at
each step it writes out the character it stands on and moves on if that step's bit for the character
is one. Two walks that an edit has parted meet again after a number of steps that depends on the
edits between them, so the Hamming distance of what they wrote follows the edit distance of the texts.

The fingerprint keeps sampled bits of the written string: ``BITS`` at random steps of each octave
[2^k, 2^(k+1)), up to the octave in which the text ends, so texts of any length have one and the same
sampling. The likeness of two fingerprints weighs octaves by their lengths.

Near copies anywhere in the table meet by bands: each of ``BANDS`` band keys joins ``BAND`` sampled
bits, dealt over the octaves by their lengths. Keys take only steps before a length of a grid of half
octaves, the last that the walk reaches, and also the one before where a walk shorter by what
``NEAR`` allows would end below. Fingerprints that share a key are verified as a whole; see alike().
"""

from __future__ import annotations

import hashlib
import math
import random
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import linked_classes
from .common import cut, drop, partitions, written

BITS = 64
PERIOD = 8192  # the shared bits repeat after so many steps
CLASSES = 256
FIRST = 4  # octaves below 2^FIRST are one
SEED = 20
SIDE_BY_SIDE = 40  # texts for which it pays to walk together
TOGETHER = 2_000_000  # characters walked together
NEAR = 0.9
BANDS = 16
BAND = 28  # bits a band, 32 at most


def _bits() -> np.ndarray:
    """Shared bits by character class and step."""
    return np.random.default_rng(SEED).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)


class Walker:
    def __init__(self) -> None:
        bits = _bits()
        bits[:, -1] = 1  # no walk stands still for longer than a period
        step = np.arange(PERIOD)
        ahead = np.where(bits == 1, step, PERIOD)
        stay = np.minimum.accumulate(ahead[:, ::-1], axis=1)[:, ::-1]
        spent = stay + 1 - step  # steps spent on the character
        self.next = spent.tolist()
        self.spent = spent.astype(np.uint16).ravel()
        self.samples: list[np.ndarray] = []
        self.signs: list[np.ndarray] = []
        self.upto: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def ends(self, codes: list[int], start: int = 0) -> list[int]:
        """The step after each character's last."""
        table = self.next
        return list(accumulate(codes, lambda j, c: j + table[c][j % PERIOD], initial=start))[1:]

    def ends_of_many(self, codes: list[np.ndarray], starts: list[int]) -> list[np.ndarray]:
        """ends() of many texts, which walk side by side as long as enough of them go on."""
        size = np.array([len(c) for c in codes], np.int64)
        order = np.argsort(-size, kind="stable")
        flat = np.concatenate([np.zeros(0, np.uint8), *codes]).astype(np.int64) * PERIOD
        first = np.cumsum(size) - size
        out = np.empty(len(flat), np.int64)
        going = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), side="left")  # how many have a character at each place
        at, j = first[order], np.array(starts, np.int64)[order]
        place = 0
        while place < len(going) and (k := going[place]) >= SIDE_BY_SIDE:
            here = at[:k] + place
            j[:k] += self.spent[flat[here] + (j[:k] & (PERIOD - 1))]
            out[here] = j[:k]
            place += 1
        for k in range(going[place] if place < len(going) else 0):
            rest = at[k] + place, at[k] + size[order[k]]
            out[rest[0] : rest[1]] = self.ends((flat[rest[0] : rest[1]] // PERIOD).tolist(), int(j[k]))
        return np.split(out, first[1:])

    def octave(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.samples) <= k:
            low = 0 if not self.samples else 1 << (FIRST + len(self.samples) - 1)
            high = 1 << (FIRST + len(self.samples))
            rng = np.random.default_rng([SEED, len(self.samples)])
            self.samples.append(np.sort(rng.integers(low, high, BITS)))
            self.signs.append(rng.integers(1, 1 << 62, BITS, dtype=np.int64) | 1)
        return self.samples[k], self.signs[k]

    def octaves(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n not in self.upto:
            self.upto[n] = tuple(np.concatenate(x) for x in zip(*map(self.octave, range(n)), strict=True))
        return self.upto[n]

    def digest(self, points: np.ndarray, ends: np.ndarray) -> str:
        """points: code points; ends: as from ends()."""
        steps = int(ends[-1]) if len(ends) else 0
        at, sign = self.octaves(max(0, math.ceil(math.log2(max(steps, 1))) - FIRST) + 1)
        char = np.append(points, -1)[np.searchsorted(ends, at, side="right")]
        mixed = (char.astype(np.int64) + 2) * sign
        bit = (mixed ^ (mixed >> 31)) >> 17 & 1
        return np.packbits(bit.astype(np.uint8)).tobytes().hex()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def classes(points: np.ndarray) -> np.ndarray:
    return ((points.astype(np.int64) * 0x9E3779B1 >> 7) % CLASSES).astype(np.uint8)


def likeness(a: str, b: str) -> float:
    """1 minus the estimated share of steps whose characters differ; between 0 and 1, 1 if equal."""
    if a == b:
        return 1.0
    width = BITS // 4
    n = max(len(a), len(b)) // width
    total = agreed = 0.0
    for k in range(n):
        span = (1 << FIRST) if k == 0 else (1 << (FIRST + k - 1))
        x, y = a[k * width : (k + 1) * width], b[k * width : (k + 1) * width]
        total += span
        if x and y:
            same = 1 - (int(x, 16) ^ int(y, 16)).bit_count() / BITS
            agreed += span * max(0.0, 2 * same - 1)  # unequal characters agree in half the bits
    return agreed / total


class Bands:
    """Band keys and whole comparison of fingerprints with the lengths of their walks."""

    def __init__(self) -> None:
        self.walker = Walker()
        self.chosen: dict[int, np.ndarray] = {}
        self.ends: list[int] = []

    def bits(self, level: int) -> np.ndarray:
        """The places in a fingerprint of the bits of each band, all at steps before 2^(level / 2)."""
        if level not in self.chosen:
            length = 2 ** (level / 2)
            rng = np.random.default_rng([SEED, BANDS, level])
            octaves = max(0, math.ceil(level / 2) - FIRST) + 1
            edges = [0, *[1 << (FIRST + k) for k in range(octaves)]]
            share = np.array([min(high, length) - low for low, high in zip(edges, edges[1:], strict=False)]) / length
            counts = [max(1, int(np.searchsorted(self.walker.octave(k)[0], length))) for k in range(octaves)]
            rows = []
            for _ in range(BANDS):
                dealt = np.bincount(rng.choice(octaves, BAND, p=share), minlength=octaves)
                rows.append(np.concatenate([k * BITS + rng.choice(m, n, replace=n > m) for k, (m, n) in enumerate(zip(counts, dealt, strict=True))]))
            self.chosen[level] = np.array(rows)
        return self.chosen[level]

    def keys(self, marks: list[str], steps: list[int]) -> list[list[int]]:
        """Band keys of each fingerprint; a walk without steps has none."""
        out: list[list[int]] = [[] for _ in marks]
        wanted: dict[int, list[int]] = {}
        for i, n in enumerate(steps):
            if n:
                level = math.floor(2 * math.log2(n))
                wanted.setdefault(level, []).append(i)
                if level and NEAR * n < 2 ** (level / 2):
                    wanted.setdefault(level - 1, []).append(i)
        value = 1 << np.arange(BAND, dtype=np.int64)
        for level, rows in wanted.items():
            at = self.bits(level)
            width = (int(at.max()) // BITS + 1) * BITS // 4
            raw = np.frombuffer(bytes.fromhex("".join(marks[i][:width] for i in rows)), np.uint8).reshape(len(rows), -1)
            found = np.unpackbits(raw, axis=1)[:, at] @ value + (np.arange(BANDS, dtype=np.int64) << 32) + (level << 40)
            for i, got in zip(rows, found.tolist(), strict=True):
                out[i] += got
        return out

    def end(self, k: int) -> int:
        """The bits of an octave that lies behind the end of a text."""
        while len(self.ends) <= k:
            _, sign = self.walker.octave(len(self.ends))
            bit = (sign ^ (sign >> 31)) >> 17 & 1
            self.ends.append(int.from_bytes(np.packbits(bit.astype(np.uint8)).tobytes()))
        return self.ends[k]

    def alike(self, a: str, a_steps: int, b: str, b_steps: int) -> bool:
        """Whether the walks agree in a share NEAR of the steps of the longer one, by all sampled bits before its end."""
        if a == b and a_steps == b_steps:
            return True
        least, most = sorted((a_steps, b_steps))
        if least < NEAR * most:
            return False
        width = BITS // 4
        total = agreed = 0.0
        for k in range(max(len(a), len(b)) // width):
            low = 0 if k == 0 else 1 << (FIRST + k - 1)
            high = 1 << (FIRST + k)
            n = BITS if most >= high else int(np.searchsorted(self.walker.octave(k)[0], most))
            if n:
                x, y = (int(m, 16) if (m := t[k * width : (k + 1) * width]) else self.end(k) for t in (a, b))
                same = 1 - ((x ^ y) >> (BITS - n)).bit_count() / n
                span = min(high, most) - low
                total += span
                agreed += span * max(0.0, 2 * same - 1)
        return agreed >= NEAR * total - 1e-9 and total > 0


def _compare():
    bands = Bands()
    walker = bands.walker
    width = BITS // 4

    def compare(payloads):
        """alike() for all pairs at once: of each pair the longer walk sets how many bits of an octave count."""
        marks, steps = [p[0] for p in payloads], np.array([p[1] for p in payloads], np.int64)
        agreed = np.zeros((len(marks), len(marks)))
        total = np.zeros(len(marks))
        for k in range(max(map(len, marks)) // width):
            low, high = 0 if k == 0 else 1 << (FIRST + k - 1), 1 << (FIRST + k)
            raw = b"".join(bytes.fromhex(m[k * width : (k + 1) * width]) or bands.end(k).to_bytes(BITS // 8) for m in marks)
            bit = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(marks), -1), axis=1).astype(np.float32) * 2 - 1
            n = np.where(steps >= high, BITS, np.searchsorted(walker.octave(k)[0], steps))
            span = np.where(n > 0, np.minimum(high, steps) - low, 0)
            same = (bit * (np.arange(BITS) < n[:, None])) @ bit.T / np.maximum(n, 1)[:, None]
            agreed += span[:, None] * np.maximum(same, 0)
            total += span
        fine = (agreed >= NEAR * total[:, None] - 1e-9) & (total > 0)[:, None]
        longer = steps[:, None] >= steps[None, :]
        may = np.where(longer, fine, fine.T) & (np.minimum(steps[:, None], steps[None, :]) >= NEAR * np.maximum(steps[:, None], steps[None, :]))
        return may, lambda i, j: True

    return compare


def near_classes(made: DataFrame) -> DataFrame:
    """Rows (mark, class_id) for the marks of ``made`` (doc_id, fingerprint, steps, mark, keys) that links join: the smallest doc_id of the class."""
    nodes, at_nodes = written(made.groupBy("mark").agg(F.min("doc_id").alias("least"), F.first("fingerprint").alias("fingerprint"), F.first("steps").alias("steps"), F.first("keys").alias("keys")))
    buckets = nodes.select("mark", F.explode(F.array_distinct("keys")).alias("bucket"))
    several = buckets.groupBy("bucket").agg(F.min("mark").alias("lo"), F.max("mark").alias("hi")).where("lo <> hi").select("bucket")
    members = cut(buckets.join(several, "bucket", "left_semi").select("bucket", F.col("mark").alias("node"), F.lit(1).alias("size")))
    payload = nodes.select(F.col("mark").alias("node"), "fingerprint", "steps").join(members.select("node").distinct(), "node", "left_semi")
    roots = linked_classes(members, cut(payload), _compare)
    rooted = nodes.select("mark", "least").join(roots.withColumnRenamed("node", "mark"), "mark", "left").select("mark", "least", F.coalesce("root", "mark").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("class_id"))
    out = cut(rooted.join(least, "root").select("mark", "class_id"))
    drop(made.sparkSession, at_nodes)
    return out


def edited(text: str, following: str) -> str:
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


def ordered_with_next(docs: DataFrame, n: int | None = None) -> DataFrame:
    """Rows dealt by descending doc_id into (part), each part with a copy of the first row of the next.

    Only ids are looked at to cut the order: quantiles to a bounded number of parts, then one id for
    each part. Rows with equal or null doc_id (which come last) are ordered by their text.
    """
    spark = docs.sparkSession
    n = n or max(partitions(spark), 1)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []), reverse=True)
    grid = F.array(*[F.lit(float(b)) for b in bounds]) if bounds else F.array().cast("array<double>")
    steps = F.array(*[F.lit(1 << k) for k in range(len(bounds).bit_length() - 1, -1, -1)]) if bounds else F.array().cast("array<int>")
    part = F.aggregate(steps, F.lit(0), lambda at, d: F.when((at + d <= len(bounds)) & (F.get(grid, at + d - 1) >= F.col("doc_id")), at + d).otherwise(at))  # binary search
    docs = docs.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(part).cast("int"))
    key = F.struct(F.col("doc_id").isNull().alias("last"), (-F.col("doc_id").cast("decimal(20,0)")).alias("o"), F.xxhash64("text").alias("x"))
    docs = docs.withColumn("key", key)
    firsts = docs.groupBy("part").agg(F.min("key").alias("key")).collect()  # one row a part
    parts = sorted(r["part"] for r in firsts)
    keys = {r["part"]: r["key"] for r in firsts}
    before = {p: parts[i - 1] for i, p in enumerate(parts)}  # the first follows the last
    rows = docs.withColumn("copy", F.lit(0))
    if parts:
        wanted = spark.createDataFrame([(p, keys[p]["o"], keys[p]["x"], before[p]) for p in parts], "p int, o decimal(21,0), x long, target int")
        copies = docs.join(F.broadcast(wanted), (F.col("part") == F.col("p")) & F.col("key.o").eqNullSafe(F.col("o")) & (F.col("key.x") == F.col("x")))
        rows = rows.unionByName(copies.dropDuplicates(["p"]).select("doc_id", "text", F.col("target").alias("part"), "key", F.lit(1).alias("copy")))
    return rows.repartitionById(max(len(bounds) + 1, 1), F.col("part")).sortWithinPartitions("part", "copy", "key", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprint each row of ``docs`` (doc_id integer, text; other columns are ignored) and its edited text.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_id.
    The next document is the one of the next lower doc_id; after the last comes the first; a single
    document follows itself. Null text counts as empty. Rows with equal or no doc_id follow each
    other by a hash of their text, null ids after all others. An empty table gives an empty result.

    class_id is the smallest doc_id of the rows that links of near copies join, wherever they stand:
    fingerprints that share a band key and are alike(). It is null if no row of the class has a doc_id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        bands = Bands()
        w = bands.walker
        held: tuple | None = None  # the last document, which waits for its next

        def mark_of(mark: str, steps: int) -> int:
            return int.from_bytes(hashlib.blake2b(f"{steps} {mark}".encode(), digest_size=8).digest(), signed=True)

        def pieces(batch):
            """Rows of a batch in portions of some characters."""
            part, size = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "copy")), strict=True):
                part.append(row)
                size += len(row[1])
                if size > TOGETHER:
                    yield part
                    part, size = [], 0
            if part:
                yield part

        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "steps", "mark"]
        for batch in batches:
            for part in pieces(batch):
                points = [code_points(t) for _, t, _ in part]
                ends = w.ends_of_many([classes(x) for x in points], [0] * len(part))
                walked = [(d, t, copy, x, e, w.digest(x, e)) for (d, t, copy), x, e in zip(part, points, ends, strict=True)]
                chain = ([held] if held is not None else []) + walked
                pairs = [(now, after) for now, after in zip(chain, chain[1:], strict=False) if not now[2]]
                held = None if walked[-1][2] else walked[-1]
                keep = [len(now[1]) - len(now[1]) // 3 for now, _ in pairs]
                tails = [after[3][: len(now[1]) // 3] for now, after in pairs]
                tail_ends = w.ends_of_many([classes(x) for x in tails], [int(now[4][k - 1]) if k else 0 for (now, _), k in zip(pairs, keep, strict=True)])
                out = []
                for (now, after), k, tail, tail_end in zip(pairs, keep, tails, tail_ends, strict=True):
                    doc_id, text, _, x, e, mark = now
                    changed = edited(text, after[1])
                    other = mark if changed == text else w.digest(np.concatenate([x[:k], tail]), np.concatenate([e[:k], tail_end]))
                    steps = int(e[-1]) if len(e) else 0
                    out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), mark, other, likeness(mark, other), likeness(mark, after[5]), steps, mark_of(mark, steps)))
                columns = list(zip(*out, strict=True)) or [()] * len(names)
                kinds = (batch.schema.field("doc_id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64())
                keys = pa.array(bands.keys(columns[3], columns[7]), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, kinds, strict=True)), keys], [*names, "keys"])

    made, _ = written(ordered_with_next(docs).mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, steps long, mark long, keys array<long>"))
    drop(docs.sparkSession)
    return made.join(near_classes(made), "mark").drop("mark", "steps", "keys")
