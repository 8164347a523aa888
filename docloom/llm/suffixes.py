"""Distributed merge sort of suffixes with common-prefix-aware exchange and merging.

Sorted runs travel front-coded: each string as the length of the prefix it shares with the string
before it, and the rest. Ranges are cut at splitters drawn from a bounded sample, so equal or
nearly equal strings in any number are spread over tasks. A task merges the runs of its range with a
loser tree that keeps, for every waiting string, the length of its common prefix with the last
string put out: strings are compared from that length on, and not at all if the lengths differ.
"""

from __future__ import annotations

import struct
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

RUN_BYTES = 64 << 20  # strings sorted at once in a map task
BLOCK_BYTES = 1 << 20
RANGE_BYTES = 32 << 20  # strings merged in one reduce task
SAMPLE_BYTES = 32 << 20  # most that splitters and the sample they come from take
HEAD = struct.Struct("<IIIIq16s")  # shared prefix, rest, length of the suffix proper, spare, copies, class

Item = tuple[bytes, int, bytes, int]  # string, length of its first part, class, copies


def common_prefix(a: bytes, b: bytes, start: int = 0) -> int:
    """Length of the common prefix, of which the first `start` bytes are known to be equal."""
    n = min(len(a), len(b))
    at = start
    while at < n:
        x, y = a[at : min(at + 64, n)], b[at : min(at + 64, n)]
        if x == y:
            at += len(x)
            continue
        diff = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
        return at + len(x) - 1 - (diff.bit_length() - 1) // 8
    return n


def front_code(items: list[Item]) -> Iterator[bytes]:
    """Blocks of a sorted run; each block starts anew."""
    out, size, last = [], 0, b""
    for string, first, cls, n in items:
        shared = common_prefix(last, string)
        out.append(HEAD.pack(shared, len(string) - shared, first, 0, n, cls) + string[shared:])
        size += len(out[-1])
        last = string
        if size >= BLOCK_BYTES:
            yield b"".join(out)
            out, size, last = [], 0, b""
    if out:
        yield b"".join(out)


def decode(blocks: list[bytes]) -> Iterator[tuple[int, Item]]:
    """(prefix shared with the string before, item), over the blocks of one run in order."""
    last = b""
    for block in blocks:
        at, previous, fresh = 0, b"", True
        while at < len(block):
            shared, rest, first, _, n, cls = HEAD.unpack_from(block, at)
            at += HEAD.size
            string = previous[:shared] + block[at : at + rest]
            at += rest
            yield (common_prefix(last, string) if fresh else shared), (string, first, cls, n)
            previous = last = string
            fresh = False


class LoserTree:
    """Merge sorted runs given as iterators of (prefix shared with the string before, item)."""

    def __init__(self, runs: list[Iterator[tuple[int, Item]]]):
        self.runs = runs
        self.k = 1
        while self.k < max(len(runs), 1):
            self.k *= 2
        self.now: list[Item | None] = [None] * self.k
        self.shared = [0] * self.k  # with the last string put out
        for i, run in enumerate(runs):
            first = next(run, None)
            self.now[i] = first[1] if first else None
        self.losers = [0] * self.k
        self.winner = self._build(1)

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared prefix becomes the one with the winner."""
        x, y = self.now[a], self.now[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        p, q = self.shared[a], self.shared[b]
        if p > q:
            return a, b
        if q > p:
            return b, a
        s, t = x[0], y[0]
        p = common_prefix(s, t, p)
        if p == len(s) or (p < len(t) and s[p] < t[p]):
            self.shared[b] = p
            return a, b
        self.shared[a] = p
        return b, a

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        win, lose = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, Item]]:
        while (item := self.now[self.winner]) is not None:
            w = self.winner
            yield self.shared[w], item
            following = next(self.runs[w], None)
            if following is None:
                self.now[w] = None
            else:
                self.shared[w], self.now[w] = following
            node = (w + self.k) // 2
            while node >= 1:
                w, self.losers[node] = self._play(w, self.losers[node])
                node //= 2
            self.winner = w


def sorted_ranges(strings: DataFrame, total_bytes: int, count: int, visit, schema: str) -> DataFrame:
    """Sort rows (s binary, first int, cls binary of 16 bytes, n long) and apply `visit` to each range.

    ``visit`` takes an iterator of (prefix shared with the string before, item) in order and yields
    record batches. The order of equal strings is open.
    """
    spark = strings.sparkSession
    ranges = max(partitions(spark), -(-total_bytes // RANGE_BYTES), 1)
    mean = max(total_bytes // max(count, 1), 1)
    want = min(40 * ranges, SAMPLE_BYTES // mean)
    sample = strings.select("s").where(F.pmod(F.xxhash64("cls"), F.lit(1 << 30)) < F.lit(int(min(1.0, want / max(count, 1)) * (1 << 30)))).collect()
    drawn = sorted(bytes(r["s"]) for r in sample)
    splitters = [drawn[i * len(drawn) // ranges] for i in range(1, ranges)] if drawn else []
    shared = spark.sparkContext.broadcast(splitters)  # bounded by SAMPLE_BYTES

    def runs(batches):
        cuts = shared.value
        held: list[Item] = []
        size = 0

        def flush():
            held.sort()
            ends = [bisect_left(held, (c,)) for c in cuts] + [len(held)]
            start = 0
            for target, end in enumerate(ends):
                if end > start:
                    blocks = list(front_code(held[start:end]))
                    name = held[start][2]
                    yield pa.RecordBatch.from_arrays([pa.array([target] * len(blocks), pa.int32()), pa.array([name] * len(blocks), pa.binary()), pa.array(range(len(blocks)), pa.int32()), pa.array(blocks, pa.binary())], ["target", "run", "seq", "block"])
                start = max(start, end)
            held.clear()

        for batch in batches:
            for item in zip(*(batch.column(c).to_pylist() for c in ("s", "first", "cls", "n")), strict=True):
                held.append(item)
                size += len(item[0])
                if size >= RUN_BYTES:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    def merge(batches):
        blocks: dict[bytes, list[tuple[int, bytes]]] = {}
        for batch in batches:
            for run, seq, block in zip(*(batch.column(c).to_pylist() for c in ("run", "seq", "block")), strict=True):
                blocks.setdefault(run, []).append((seq, block))
        streams = [decode([b for _, b in sorted(x)]) for x in blocks.values()]
        blocks.clear()
        if streams:
            yield from visit(iter(LoserTree(streams)))

    exchanged = strings.select("s", "first", "cls", "n").mapInArrow(runs, "target int, run binary, seq int, block binary")
    return exchanged.repartitionById(ranges, F.col("target")).mapInArrow(merge, schema)
