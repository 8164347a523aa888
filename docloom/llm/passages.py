"""Passages that several documents share, by words: runs of a number of words, whatever white space is between them.

Every run of ``words`` words has an anchor, the leftmost of its grams of GRAM words with the smallest
hash; runs next to each other with one anchor make a stretch. Equal runs have equal anchors, so only
the runs of stretches whose gram occurs more than once are looked at: each is known by 128 bits of
its words and counted once a document. Counting starts in the tasks, so no run gathers its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

GRAM = 16  # words, a power of two
ROWS = 1 << 16  # runs in a batch that goes back to Spark, or one text's if it has more

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = np.random.default_rng(11).integers(0, 1 << 63, (32, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_hashes(raw: bytes) -> np.ndarray:
    """Two 64-bit hashes of each word, as rows."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, raw.split())), np.uint64).reshape(-1, 2)


def places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which the words start and end."""
    space = np.concatenate([[True], _SPACE[np.frombuffer(raw, np.uint8)], [True]])
    return np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])


def run_hashes(h: np.ndarray, words: int) -> np.ndarray:
    """Hashes of all runs of so many words, put together from runs of 1, 2, 4, ... words."""
    out, done, m, k = None, 0, 1, 0
    n = len(h) - words + 1
    while True:
        if words & m:
            part = h[done : done + n]
            out, done = part if out is None else out * _STEP[-1 - k] + part, done + m
        if 2 * m > words:
            return out
        h = h[:-m] * _STEP[k] + h[m:]
        m, k = 2 * m, k + 1


def stretches(h: np.ndarray, words: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays (first run, last run, gram hash) of the stretches of a text of at least ``words`` words."""
    v = run_hashes(h, gram)[:, 0].copy()
    v ^= v >> np.uint64(29)
    v *= np.uint64(0x9E3779B97F4A7C15)
    at = np.lib.stride_tricks.sliding_window_view(v, words - gram + 1).argmin(1)
    at += np.arange(len(at))
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return first, np.append(first[1:], len(at)) - 1, v[at[first]].view(np.int64)


def _stretch_rows(words: int, gram: int):
    names = ["d", "x", "y", "lo", "hi", "key"]

    def run(batches):
        for batch in batches:
            parts = [[np.zeros(0, np.int64)] * 6]
            for d, x, y, text in zip(*(batch.column(c).to_pylist() for c in ("d", "x", "y", "text")), strict=True):
                h = word_hashes(text.encode())
                if len(h) >= words:
                    lo, hi, key = stretches(h, words, gram)
                    parts.append([*(np.full(len(lo), v) for v in (d, x, y)), lo, hi, key])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names)

    return run


def _run_rows(words: int):
    """The runs of the stretches of each text; ``one`` is 1 at the first of equal ones."""
    names = ["d", "x", "y", "span", "u", "v", "one"]

    def batch(parts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)], names)

    def run(batches):
        for rows in batches:
            parts, size = [[np.zeros(0, np.int64)] * 7], 0
            for d, x, y, text, near in zip(*(rows.column(c).to_pylist() for c in ("d", "x", "y", "text", "near")), strict=True):
                raw = text.encode()
                starts, ends = places(raw)
                at = np.unique(np.concatenate([np.arange(k >> 32, (k & 0xFFFFFFFF) + 1) for k in near]))
                h = run_hashes(word_hashes(raw), words)[at]
                order = np.lexsort((h[:, 1], h[:, 0]))
                one = np.ones(len(at), np.int64)
                one[order[1:]] = (h[order[1:]] != h[order[:-1]]).any(1)
                h = h.view(np.int64)
                parts.append([*(np.full(len(at), v) for v in (d, x, y)), starts[at] << 32 | ends[at + words - 1], h[:, 0], h[:, 1], one])
                size += len(at)
                if size >= ROWS:
                    yield batch(parts)
                    parts, size = parts[:1], 0
            yield batch(parts)

    return run


def shared_runs(texts: DataFrame, words: int, gram: int = GRAM) -> tuple[DataFrame, str]:
    """Of texts (d, x, y, text), known by d, x and y, the runs of ``words`` words that another row has too: written
    rows (d, x, y, span), span being where a run starts, shifted by 32 bits, and where it ends, in bytes; with their path."""
    gram = min(gram, 1 << words.bit_length() - 1)
    found, at_found = written(texts.mapInArrow(_stretch_rows(words, gram), "d long, x long, y long, lo long, hi long, key long"))
    twice = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    near = found.join(twice, "key", "left_semi").groupBy("d", "x", "y").agg(F.collect_set(F.shiftleft("lo", 32).bitwiseOR(F.col("hi"))).alias("near"))
    runs, at_runs = written(texts.join(near, ["d", "x", "y"]).mapInArrow(_run_rows(words), "d long, x long, y long, span long, u long, v long, one long"))
    drop(texts.sparkSession, at_found)
    shared = runs.groupBy("u", "v").agg(F.sum("one").alias("n")).where("n > 1").select("u", "v")
    out, at_out = written(runs.join(shared, ["u", "v"], "left_semi").select("d", "x", "y", "span"))
    drop(texts.sparkSession, at_runs)
    return out, at_out
