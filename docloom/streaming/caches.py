"""Results that are remembered between requests: a cache of each key in the state of a stream.

A cache holds up to `capacity` items, the least recently used going first, and forgets an item that hasn't been
used for `idle` seconds of event time. State is kept by Spark's state store and comes back with
the checkpoint, so a restarted stream goes on where it was, and it is bounded by the capacity a key. A timer clears what has been idle, so
keys that never come back leave no state.

Over a table the same caches run by ranges of (key, time), so that a key may hold most rows: what a cache holds is the last
`capacity` items used, so the last items of each part are all that later parts have to know.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.ranges import in_ranges

CAPACITY = 50
IDLE = 3600.0
ROWS = "key string, at timestamp, tie long, item string, outcome string, evicted string, held int"
NAMES = ["key", "at", "tie", "item", "outcome", "evicted", "held"]
#: Spark keeps this kind of state in this store only.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Cache:
    """Items by their last use, in microseconds, the least recent first."""

    def __init__(self, capacity: int, idle: int, held: list[tuple[str, int]] = ()):
        self.capacity, self.idle, self.held = capacity, idle, OrderedDict(held)

    def forget(self, now: int) -> list[tuple[str, int]]:
        """Items idle for longer than allowed, with their last use; they are in order of it."""
        gone = []
        while self.held and now - next(iter(self.held.values())) > self.idle:
            gone.append(self.held.popitem(last=False))
        return gone

    def use(self, item: str, now: int) -> tuple[bool, str | None]:
        """Whether the item was there, and what had to go for it."""
        if item in self.held:
            self.held[item] = now
            self.held.move_to_end(item)
            return True, None
        evicted = self.held.popitem(last=False)[0] if len(self.held) >= self.capacity else None
        self.held[item] = now
        return False, evicted


def serve(cache: Cache, key: str, requests: Iterator[tuple[int, int, str]]) -> Iterator[tuple]:
    """Rows for requests (time in microseconds, tie, item) of one key, in their order."""
    for now, tie, item in requests:
        yield from idle_rows(cache, key, now)
        hit, evicted = cache.use(item, now)
        yield key, now, tie, item, "hit" if hit else "miss", evicted, len(cache.held)


def idle_rows(cache: Cache, key: str, now: int) -> list[tuple]:
    return [(key, use + cache.idle, None, item, "idle", item, None) for item, use in cache.forget(now)]


class CacheProcessor(StatefulProcessor):
    def __init__(self, capacity: int, idle: float):
        self.capacity, self.idle = capacity, round(idle * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cache", "items array<string>, uses array<bigint>, timer bigint")

    def _load(self) -> tuple[Cache, int | None]:
        if not self.state.exists():
            return Cache(self.capacity, self.idle), None
        items, uses, timer = self.state.get()
        return Cache(self.capacity, self.idle, list(zip(items, map(int, uses), strict=True))), timer

    def _save(self, cache: Cache, timer: int | None, timed: bool) -> None:
        if timer is not None:
            self.handle.deleteTimer(timer)
        if not cache.held:
            self.state.clear()
            return
        due = (next(iter(cache.held.values())) + cache.idle) // 1000 + 1 if timed else None
        if due is not None:
            self.handle.registerTimer(due)
        self.state.update((list(cache.held), list(cache.held.values()), due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cache, timer = self._load()
        met = pd.concat(list(rows)).sort_values(["at", "tie"], kind="stable")
        times = met["at"].astype("datetime64[us]").astype("int64")
        out = list(serve(cache, key[0], zip(times.tolist(), met["tie"].tolist(), met["item"].tolist(), strict=True)))
        self._save(cache, timer, timerValues.getCurrentWatermarkInMs() >= 0)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cache, _ = self._load()
        gone = idle_rows(cache, key[0], expiredTimerInfo.getExpiryTimeInMs() * 1000)
        self._save(cache, None, True)
        yield _frame(gone)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=NAMES)
    return df.astype({"at": "datetime64[us]", "tie": "Int64", "held": "Int32", "key": object, "item": object, "outcome": object, "evicted": object})


def _last_uses(capacity: int):
    """Over sorted parts: the last items used of the last key of each part, the most recent first."""

    def run(batches):
        part = key = None
        uses: dict[str, int] = {}
        for batch in batches:
            for p, k, at, item in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "at", "item")), strict=True):
                if p != part and part is not None:
                    yield _use_rows(part, key, uses, capacity)
                if (p, k) != (part, key):
                    part, key, uses = p, k, {}
                uses.pop(item, None)
                uses[item] = at
                if len(uses) > 4 * capacity:
                    uses = dict(list(uses.items())[-capacity:])
        if part is not None:
            yield _use_rows(part, key, uses, capacity)

    return run


def _use_rows(part: int, key: str, uses: dict[str, int], capacity: int) -> pa.RecordBatch:
    last = list(uses.items())[-capacity:]
    return pa.RecordBatch.from_pydict({"part": pa.array([part] * len(last), pa.int32()), "key": pa.array([key] * len(last), pa.string()), "item": pa.array([i for i, _ in last], pa.string()), "at": pa.array([a for _, a in last], pa.int64())})


def _served(capacity: int, idle: int, given: dict[int, tuple[str, list[tuple[str, int]]]]):
    """Over sorted parts: rows of all requests; ``given`` has what the cache of a part's first key holds."""

    def run(batches):
        part = key = cache = None
        for batch in batches:
            out: list[tuple] = []
            for p, k, at, tie, item in zip(*(batch.column(c).to_pylist() for c in ("part", "key", "at", "tie", "item")), strict=True):
                if (p, k) != (part, key):
                    held = given.get(p, (None, []))
                    cache = Cache(capacity, idle, held[1] if p != part and held[0] == k else ())
                    part, key = p, k
                out += serve(cache, k, [(at, tie, item)])
            made = list(zip(*out, strict=True)) or [()] * len(NAMES)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(made, kinds, strict=True)], NAMES)

    return run


def _over_table(rows: DataFrame, capacity: int, idle: int) -> DataFrame:
    sorted_ = in_ranges(rows.withColumn("at", F.unix_micros("at")), ["key", "at", "tie"])
    found: dict[int, tuple[str, list[tuple[str, int]]]] = {}
    for r in sorted_.mapInArrow(_last_uses(capacity), "part int, key string, item string, at long").collect():  # at most `capacity` a part
        found.setdefault(r.part, (r.key, []))[1].append((r.item, r["at"]))
    given, key, held = {}, None, []
    for part in sorted(found):
        given[part] = key, held
        mine, last = found[part]
        known = dict(held) if mine == key else {}
        for item, use in last:
            known.pop(item, None)
            known[item] = use
        newest = last[-1][1]
        key, held = mine, [(i, u) for i, u in list(known.items())[-capacity:] if newest - u <= idle]
    out = sorted_.mapInArrow(_served(capacity, idle, given), ROWS.replace("at timestamp", "at long"))
    return out.withColumn("at", F.timestamp_micros("at"))


def cached(requests: DataFrame, key: str, at: str, tie: str, item: str, capacity: int = CAPACITY, idle: float = IDLE, late: str = "0 seconds") -> DataFrame:
    """Requests, a table or a stream, through the cache of their key: key, at, tie, item, outcome (hit, miss, or idle for an item that was
    forgotten, at the time it was), evicted (what had to go), held (items after the request).

    Requests of a key are served by (at, tie), in a stream within a batch; ``late`` is what a stream waits for those that come late. An item is
    reported idle with the next request of its key, or when a stream's watermark passes its time; those still held when a table ends are not.
    Rows with a null in key, at or item take no part. A stream's session has to have the state store STORE, and a key's requests
    of one batch are in one task's memory. Over a table they are spread by ranges. An empty table gives an empty result.
    """
    rows = requests.select(F.col(key).cast("string").alias("key"), F.col(at).cast("timestamp").alias("at"), F.col(tie).cast("long").alias("tie"), F.col(item).cast("string").alias("item")).dropna(subset=["key", "at", "item"])
    if not requests.isStreaming:
        return _over_table(rows, capacity, round(idle * 1_000_000))
    return rows.withWatermark("at", late).groupBy("key").transformWithStateInPandas(CacheProcessor(capacity, idle), ROWS, "Append", "EventTime")
