"""Join to the nearest row by position, each candidate used once.

Asking rows are served in their order; each takes the nearest candidate of its key that is still free and not
farther than `within`, of two equally near ones the one that comes first. What a row takes depends on all rows
before it, so the work is dealt by ranges of (key, position), and parts settle what crosses their borders:

* A part serves its own asking rows. It sees its own candidates, those of later parts that are near enough to
  its last rows (ahead), and what the part before hands on: candidates left free near the border, and which
  candidates behind the border are taken.
* All parts run at once, first as if nothing were handed on. Parts to which something else is handed than they
  ran with run again, until none is left. The first part is right from the start, and a part is right once the
  one before it is, so the result is that of one pass in order.
* How far a change goes depends on the rows: where about as many ask as there are candidates, over many times
  `within`. So parts are as large as a task can hold (ROWS_A_PART), however many partitions a shuffle has, and where
  changes go on, neighbouring parts run one after the other in a task, at most CHAIN of them, one held at a time.

Within a part, free candidates are found by pointers that skip taken ones, so time grows with the rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import checkpointed
from .ranges import in_ranges, micros

ROWS = "part int, what int, key string, at double, seq long"
OWN, AHEAD, FREE, TAKEN = 0, 1, 2, 3  # what a row is to a part; own rows that ask are ASKS
ASKS = 4
ROWS_A_PART = 1 << 16
CHAIN = 16


class Free:
    """Candidates by place; equal places are one stop with its candidates in order."""

    def __init__(self, candidates: list[tuple[float, int]], taken: set[int]):
        self.stops: list[float] = []
        self.queues: list[list[int]] = []
        for at, seq in sorted(candidates):
            if not self.stops or self.stops[-1] != at:
                self.stops.append(at)
                self.queues.append([])
            if seq not in taken:
                self.queues[-1].append(seq)
        n = len(self.stops)
        self.used = [0] * n
        self.left, self.right = list(range(n + 1)), list(range(n + 1))  # next stop with a free candidate; left counts from 1, 0 is none
        for k in range(n):
            if not self.queues[k]:
                self._close(k)

    def _close(self, k: int) -> None:
        self.left[k + 1], self.right[k] = k, k + 1

    @staticmethod
    def _find(next_: list[int], k: int) -> int:
        end = k
        while next_[end] != end:
            end = next_[end]
        while next_[k] != end:
            next_[k], k = end, next_[k]
        return end

    def take(self, at: float, within: float) -> int | None:
        k = bisect_right(self.stops, at)
        before, after = self._find(self.left, k) - 1, self._find(self.right, bisect_left(self.stops, at))
        best = None
        for stop in (before, after):
            if 0 <= stop < len(self.stops):
                far = abs(self.stops[stop] - at)
                if far <= within and (best is None or far < best[0]):
                    best = far, stop
        if best is None:
            return None
        stop = best[1]
        seq = self.queues[stop][self.used[stop]]
        self.used[stop] += 1
        if self.used[stop] == len(self.queues[stop]):
            self._close(stop)
        return seq


def serve(rows: list[tuple[int, str, float, int]], within: float) -> tuple[list[tuple[int, int]], list[tuple[int, str, float, int]]]:
    """One part: rows (what, key, at, seq) to pairs (asking seq, candidate seq), and what it hands on as rows FREE and TAKEN."""
    own = [r for r in rows if r[0] in (OWN, ASKS)]
    if not own:
        return [], []
    _, last_key, last_at, last_seq = max(own, key=lambda r: r[3])
    by_key: dict[str, list[tuple[int, float, int]]] = {}
    for what, key, at, seq in rows:
        by_key.setdefault(key, []).append((what, at, seq))
    pairs: list[tuple[int, int]] = []
    handed: list[tuple[int, str, float, int]] = []
    for key, found in by_key.items():
        gone = {s for w, _, s in found if w == TAKEN}
        candidates = [(at, s) for w, at, s in found if w in (OWN, AHEAD, FREE)]
        free = Free(candidates, gone)
        new = []
        for at, seq in sorted((at, s) for w, at, s in found if w == ASKS):
            got = free.take(at, within)
            if got is not None:
                new.append((seq, got))
        pairs += new
        if key == last_key:
            gone |= {s for _, s in new}
            places = dict((s, at) for at, s in candidates)
            handed += [(FREE, key, at, s) for at, s in candidates if s <= last_seq and s not in gone and at >= last_at - within]
            handed += [(TAKEN, key, places.get(s, last_at), s) for s in gone if s > last_seq]
    return pairs, sorted(handed, key=lambda r: r[3])


def _server(within: float, hand_on: bool, chain: int = 1, goes_on: frozenset[int] = frozenset()):
    """Over rows sorted by part: what each part hands to the next one, or the pairs that it finds. Of ``chain`` parts that are
    numbered together, each gets what the one before has just found."""

    def run(batches):
        part, rows = None, []
        last, before = None, []

        def settle():
            nonlocal last, before
            if last is not None and last + 1 == part and part % chain and part in goes_on:
                rows.extend(before)
            pairs, handed = serve(rows, within)
            last, before = part, handed
            if hand_on:
                made = [(part + 1, *h) for h in handed]
                return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*made, strict=True)) or [()] * 5, (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int64()), strict=True)], ["part", "what", "key", "at", "seq"])
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in list(zip(*pairs, strict=True)) or [()] * 2], ["ask", "got"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "what", "key", "at", "seq")]
            for p, *row in zip(*columns, strict=True):
                if p != part:
                    if part is not None:
                        yield settle()
                    part, rows = p, []
                rows.append(tuple(row))
        if part is not None:
            yield settle()

    return run


def _chained(head: int, chain: int) -> range:
    return range(head, (head // chain + 1) * chain)


def nearest_free(asking: DataFrame, candidates: DataFrame, keys: list[str], at: str, tie: list[str], within: float, parts: int | None = None) -> DataFrame:
    """The rows of ``asking`` (all columns) with ``candidate``, a struct of the columns of ``candidates``, and ``distance``.

    Both have ``keys``, ``at`` (a number, or a time with ``within`` and distances in seconds) and ``tie``, of equal types, which
    puts rows of one place in order. Asking rows are served by (at, tie); candidate and distance are null where none is left within reach,
    and for rows with a null key or place. Repeated rows are rows of their own. A key may hold all rows. What
    crosses a border is the rows within ``within`` of it. Empty tables: no rows, or none with a candidate.
    """
    kind = dict(asking.dtypes)[at]
    reach = within * 1_000_000 if kind.startswith("timestamp") else within
    scale = 1_000_000 if kind.startswith("timestamp") else 1
    ready = [F.col(c).isNotNull() for c in (*keys, at)]
    usable = ready[0]
    for c in ready[1:]:
        usable = usable & c
    slim = lambda x, asks: x.where(usable).select(F.to_json(F.struct(*keys)).alias("key"), micros(F.col(at), kind).cast("double").alias("at"), *[F.col(c).alias(f"tie{k}") for k, c in enumerate(tie)], F.lit(asks).alias("asks"), F.struct(*x.columns).alias("row"))
    both = slim(asking, True).withColumn("given", F.lit(None).cast(slim(candidates, False).schema["row"].dataType)).unionByName(slim(candidates, False).withColumnRenamed("row", "given"), allowMissingColumns=True)
    parts = parts or max(1, -(-both.count() // ROWS_A_PART))
    rows = in_ranges(both, ["key", "at", *[f"tie{k}" for k in range(len(tie))], "asks"], parts)
    borders = rows.groupBy("part").agg(F.min(F.struct("key", "at")).alias("first"), F.max(F.struct("key", "at")).alias("last")).orderBy("part").collect()  # a row a part
    index = {b.part: k for k, b in enumerate(borders)}  # parts without rows are passed over
    ahead = max([sum(c.first.key == b.last.key and c.first.at <= b.last.at + reach for c in borders[k + 1 :]) for k, b in enumerate(borders)], default=0)

    spark = rows.sparkSession
    edges = spark.createDataFrame([(k, b.last.key, b.last.at) for k, b in enumerate(borders)], "part int, last_key string, last_at double")
    at_part = F.create_map(*[F.lit(x) for pair in index.items() for x in pair]) if index else F.create_map(F.lit(0), F.lit(0))
    own = rows.select(F.try_element_at(at_part, F.col("part")).alias("part"), F.when(F.col("asks"), ASKS).otherwise(OWN).alias("what"), "key", "at", "seq")
    seen = own
    if ahead:
        near = own.where(F.col("what") == OWN).withColumn("part", F.explode(F.sequence(F.col("part") - ahead, F.col("part") - 1)))
        near = near.join(F.broadcast(edges), "part").where((F.col("key") == F.col("last_key")) & (F.col("at") <= F.col("last_at") + reach))
        seen = own.unionByName(near.select("part", F.lit(AHEAD).alias("what"), "key", "at", "seq"))
    seen = checkpointed(seen)

    goes_on = frozenset(k + 1 for k, b in enumerate(borders[:-1]) if borders[k + 1].first.key == b.last.key)  # a part hands to the next only where the key goes on

    def run(handed: DataFrame | None, heads: list[int] | None, chain: int = 1) -> DataFrame:
        """Pairs of all parts, or what is handed on by the parts from each of ``heads`` to the end of its chain."""
        todo = seen if heads is None else seen.where(F.col("part").isin([k for h in heads for k in _chained(h, chain)]))
        if handed is not None:
            todo = todo.unionByName(handed if heads is None else handed.where(F.col("part").isin(heads)))
        n = max(1, min(2 * len(borders if heads is None else heads), int(spark.conf.get("spark.sql.shuffle.partitions"))))
        dealt = todo.repartition(n, F.floor(F.col("part") / chain)).sortWithinPartitions("part")
        return dealt.mapInArrow(_server(reach, heads is not None, chain, goes_on), ROWS if heads is not None else "ask long, got long")

    digest = lambda x: {r.part: (r.n, r.h) for r in x.groupBy("part").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("what", "seq")).alias("h")).collect()}
    handed, known, dirty, chain, rounds = None, {}, [k - 1 for k in sorted(goes_on)], 1, 0
    while dirty:
        heads = list({k // chain: k for k in reversed(dirty)}.values())  # the first of each chain
        ran = {k for h in heads for k in _chained(h, chain)}
        new = run(handed, heads, chain).where(F.col("part").isin([k + 1 for k in sorted(ran) if k + 1 in goes_on]))
        handed = checkpointed(new if handed is None else handed.where(~F.col("part").isin([k + 1 for k in ran])).unionByName(new))
        now, follow = digest(handed), ran.difference(heads)  # those had what is handed on now
        dirty = [k for k in sorted(goes_on) if now.get(k) != known.get(k) and k + 1 in goes_on and k not in follow]
        known, rounds = now, rounds + 1
        chain = min(CHAIN, 2 * chain) if rounds > 1 else 1
    pairs = run(handed, None)

    shape = rows.schema["given"].dataType.simpleString()
    candidate = F.col("given").cast(shape).alias("candidate")
    offers = rows.where("not asks").select(F.col("seq").alias("got"), F.col("at").alias("place"), candidate)
    answered = rows.where("asks").select("row", "seq", "at").join(pairs, F.col("seq") == F.col("ask"), "left").join(offers, "got", "left")
    answered = answered.select("row.*", "candidate", (F.abs(F.col("at") - F.col("place")) / scale).alias("distance"))
    lost = asking.where(~F.coalesce(usable, F.lit(False))).withColumns({"candidate": F.lit(None).cast(shape), "distance": F.lit(None).cast("double")})
    return answered.unionByName(lost)
