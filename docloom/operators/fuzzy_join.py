"""Joins of two tables on texts that name the same thing: first match, and rows without any.

Two texts (in capitals) match if they have the same core key, or if neither has one and one contains the
other, or if their ratio is at least LEAST (`same_subject` is the same rule for two texts at hand). Nothing
pairs all rows with all rows:

* Equal texts are one text, with the first row that has it, before anything is compared.
* Core keys and contained texts of up to GRAM letters meet in an aggregate by key: the first row of a key
  is all that is asked for, so a key of any size is one row when it is joined.
* A longer contained text is looked up by its rarest gram among all grams of the other side.
* Texts of a high ratio are looked up by pairs of their rarest letters (a prefix filter of a set-similarity
  join, see functions/fuzzy.py), which no such pair can miss; length and letter bounds come next, the ratio
  itself is computed for what is left, once a pair.

Each of these ways gives the smallest first row that it finds, the result the smallest of all.

Where one side has no more than MOST distinct texts, which is counted first, they travel to the tasks, and the texts of the
other are looked up there in the same ways without a shuffle.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import fuzzy as fz
from ..plans.stages import checkpointed
from .people import core_key
from .sheets import CORE

LEAST = 0.75
GRAM = 3
MOST = 20_000


def _letter_counts(batches):
    for batch in batches:
        seen = Counter(t for text in batch.column("text").to_pylist() for t in fz.letters(text))
        yield pa.RecordBatch.from_pydict({"token": pa.array(seen.keys(), pa.string()), "n": pa.array(seen.values(), pa.int64())})


def letter_places(texts: DataFrame) -> dict[str, int]:
    """Places of the most frequent letters of distinct texts, the rarest first; at most COMMON of them reach the driver."""
    counted = texts.select("text").mapInArrow(_letter_counts, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(fz.COMMON).collect()
    return {r.token: len(top) - k for k, r in enumerate(top)}


def _keyed(least: float, places: dict[str, int], columns: T.StructType):
    """Texts with their core key and the keys of each way."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            cores = [core_key(t) for t in texts]
            free = [c not in CORE for c in cores]
            made = {
                "core": pa.array(cores, pa.string()),
                "rare": pa.array([fz.rarest_gram(t, GRAM, places) if f and len(t) > GRAM else None for t, f in zip(texts, free, strict=True)], pa.string()),
                "holds": pa.array([sorted(set().union(*(fz.grams(t, k) for k in range(1, GRAM + 1)))) if f else None for t, f in zip(texts, free, strict=True)], pa.list_(pa.string())),
                "letters": pa.array([fz.pair_keys(t, least, places) for t in texts], pa.list_(pa.string())),
                "free": pa.array(free, pa.bool_()),
            }
            yield pa.RecordBatch.from_arrays([*batch.columns, *made.values()], [*batch.schema.names, *made])

    return run


def _alike(least: float, left_first: bool):
    """Pairs (text, other) whose ratio is high enough; the ratio is that of the left text with the right one."""

    def run(batches):
        for batch in batches:
            pairs = zip(batch.column("text").to_pylist(), batch.column("other").to_pylist(), strict=True)
            yield batch.filter(pa.array([fz.alike(a, b, least) if left_first else fz.alike(b, a, least) for a, b in pairs], pa.bool_()))

    return run


class Lookup:
    """Texts in the order of their first rows, by group; finds the first one that matches a text."""

    def __init__(self, texts: list[tuple[str, str]], least: float, places: dict[str, int], left_first: bool):
        self.least, self.places, self.left_first = least, places, left_first
        self.texts = [t for _, t in texts]
        self.core: dict[tuple[str, str], int] = {}
        self.short: dict[tuple[str, str], int] = {}
        self.held: dict[tuple[str, str], int] = {}
        self.holding: dict[tuple[str, str], list[int]] = defaultdict(list)
        self.rare: dict[tuple[str, str], list[int]] = defaultdict(list)
        self.pairs: dict[tuple[str, str], list[int]] = defaultdict(list)
        for k, (group, text) in enumerate(texts):
            core = core_key(text)
            self.core.setdefault((group, core), k)
            for key in fz.pair_keys(text, least, places):
                self.pairs[group, key].append(k)
            if core in CORE:
                continue
            for size in range(1, GRAM + 1):
                for gram in fz.grams(text, size):
                    self.held.setdefault((group, gram), k)
            if len(text) <= GRAM:
                self.short.setdefault((group, text), k)
            else:
                self.rare[group, fz.rarest_gram(text, GRAM, places)].append(k)
                for gram in fz.grams(text, GRAM):
                    self.holding[group, gram].append(k)

    def first(self, group: str, text: str) -> int | None:
        """Place of the first text that matches, in the order of all."""
        none = len(self.texts)
        core = core_key(text)
        best = self.core.get((group, core), none)
        if core not in CORE:
            best = min([best, *(self.short.get((group, g), none) for size in range(1, GRAM + 1) for g in fz.grams(text, size))])
            if len(text) <= GRAM:
                best = min(best, self.held.get((group, text), none))
            else:
                best = min([best, *(k for k in self.holding.get((group, fz.rarest_gram(text, GRAM, self.places)), ()) if k < best and text in self.texts[k])])
                best = min([best, *(k for g in fz.grams(text, GRAM) for k in self.rare.get((group, g), ()) if k < best and self.texts[k] in text)])
        near = {k for key in fz.pair_keys(text, self.least, self.places) for k in self.pairs.get((group, key), ()) if k < best}
        for k in sorted(near):
            if fz.alike(text, self.texts[k], self.least) if self.left_first else fz.alike(self.texts[k], text, self.least):
                return k
        return best if best < none else None


def _look_up(texts: list[tuple[str, str]], least: float, places: dict[str, int], left_first: bool, columns: list[str]):
    def run(batches):
        lookup = Lookup(texts, least, places, left_first)
        for batch in batches:
            found = [lookup.first(g, t) for g, t in zip(batch.column("group").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in columns], pa.array(found, pa.int64())], [*columns, "place"])

    return run


def _in_tasks(near: DataFrame, far: DataFrame, by: list[str], least: float, left_first: bool) -> DataFrame:
    """As _nearest, with the texts of ``far``, few as they are, in every task."""
    group = F.to_json(F.struct(*by)) if by else F.lit("")
    known = [F.col(c).isNotNull() for c in by]
    known = reduce(Column.__and__, known, F.lit(True))
    placed = checkpointed(far.where(known).withColumn("place", (F.row_number().over(Window.orderBy("first")) - 1).cast("long")))
    texts = [(r.group, r.text) for r in placed.orderBy("place").select(group.alias("group"), "text").collect()]
    wide = near.where(known).select(*by, "text", group.alias("group"))
    columns = [*by, "text"]
    schema = T.StructType([*[f for f in wide.schema.fields if f.name in columns], T.StructField("place", T.LongType())])
    found = wide.mapInArrow(_look_up(texts, least, letter_places(far), left_first, columns), schema)
    return found.join(F.broadcast(placed.select("place", "first")), "place").select(*columns, "first")


def _distinct(rows: DataFrame, by: list[str], text: str, first: Column) -> DataFrame:
    """by, text (in capitals), first: the distinct texts with their first row; null and empty texts are left out."""
    texts = rows.select(*by, F.upper(F.col(text).cast("string")).alias("text"), first.alias("first")).where("text <> ''")
    return texts.groupBy(*by, "text").agg(F.min("first").alias("first"))


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows over all tasks: what follows costs far more than its bytes tell."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _nearest(near: DataFrame, far: DataFrame, by: list[str], least: float, left_first: bool) -> DataFrame:
    """by, text of ``near`` and the smallest ``first`` of a text of ``far`` that matches it; texts without one are left out."""
    f, near = F.col, near.drop("first")
    on = lambda *names: [*by, *names]
    best = F.min("first").alias("first")
    core = near.select(*on("text", "core")).join(far.groupBy(*on("core")).agg(best), on("core"))
    held = far.where("free").select(*by, F.explode("holds").alias("gram"), "first")
    short = near.where(f("free") & (F.length("text") <= GRAM)).join(held.groupBy(*on("gram")).agg(best).withColumnRenamed("gram", "text"), on("text"))
    holding = near.where("free").select(*by, "text", F.explode("holds").alias("gram"))
    shorts = holding.join(far.where(f("free") & (F.length("text") <= GRAM)).select(*by, f("text").alias("gram"), "first"), on("gram"))
    long_in = near.where("rare is not null").select(*by, "text", f("rare").alias("gram")).join(far.where(f("free") & (F.length("text") > GRAM)).select(*by, f("text").alias("other"), F.explode("holds").alias("gram"), "first").where(F.length("gram") == GRAM), on("gram"))
    long_of = holding.where(F.length("gram") == GRAM).join(far.where("rare is not null").select(*by, f("text").alias("other"), f("rare").alias("gram"), "first"), on("gram"))
    within = long_in.where(F.contains("other", "text")).select(*on("text", "first")).union(long_of.where(F.contains("text", "other")).select(*on("text", "first")))
    keys = lambda x, name, *more: x.select(*by, f("text").alias(name), *more, F.explode("letters").alias("key"))
    met = keys(near, "text").join(keys(far, "other", "first"), on("key"))
    fits = 2 * F.least(F.length("text"), F.length("other")) >= least * (F.length("text") + F.length("other")) - fz.TINY
    pairs = _dealt(met.where(fits).select(*on("text", "other", "first")).distinct())
    similar = pairs.mapInArrow(_alike(least, left_first), pairs.schema).select(*on("text", "first"))
    ways = [x.select(*on("text", "first")) for x in (core, short, shorts, within, similar)]
    return reduce(DataFrame.union, ways).groupBy(*on("text")).agg(best)


def _matches(wanting: DataFrame, giving: DataFrame, by: list[str], text: str, at: Column, least: float, left_first: bool, most: int) -> DataFrame:
    """by, text, first: the distinct texts of ``wanting`` that match one of ``giving``, with the smallest ``at`` of those."""
    near, far = (checkpointed(_dealt(x)) for x in (_distinct(wanting, by, text, F.lit(0)), _distinct(giving, by, text, at)))
    if far.limit(most + 1).count() <= most:
        return _in_tasks(near, far, by, least, left_first)
    places = letter_places(far)
    add = T.StructType.fromDDL("core string, rare string, holds array<string>, letters array<string>, free boolean")
    keyed = lambda x: checkpointed(x.mapInArrow(_keyed(least, places, x.schema), T.StructType([*x.schema.fields, *add.fields])))
    return _nearest(keyed(near), keyed(far), by, least, left_first)


def first_match(left: DataFrame, right: DataFrame, text: str, order: list[str], value: list[str] = (), by: list[str] = (), least: float = LEAST, most: int = MOST) -> DataFrame:
    """Left join: the rows of ``left`` with ``match``, a struct (order, text, value) of the first row of ``right``,
    by its columns ``order``, whose ``text`` matches theirs within equal ``by``; null if there is none.

    Null and empty texts match nothing, nor do rows with a null in ``by``. Texts are compared in capitals and as
    wholes, and come out as they were. Rows of ``left`` are kept as they are, repeats too. Keys grow with the square of a
    text's length, so names and lines are what this is for. Empty tables: no rows, or no matches.
    """
    by, value = list(by), list(value)
    at = F.struct(*order, *[c for c in (text, *value) if c not in order])
    found = _matches(left, right, by, text, at, least, True, most).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("text").alias("__text"), F.col("first").alias("match"))
    same = [F.col(c) == F.col(f"__{c}") for c in by] + [F.upper(F.col(text).cast("string")) == F.col("__text")]
    return left.join(found, reduce(Column.__and__, same), "left").drop("__text", *[f"__{c}" for c in by])


def without_match(left: DataFrame, right: DataFrame, text: str, by: list[str] = (), least: float = LEAST, most: int = MOST) -> DataFrame:
    """Anti-join: the rows of ``right`` whose ``text`` isn't null or empty and matches no row of ``left`` within equal ``by``."""
    by = list(by)
    found = _matches(right, left, by, text, F.lit(0), least, False, most).select(*[F.col(c).alias(f"__{c}") for c in by], F.col("text").alias("__text"))
    same = [F.col(c) == F.col(f"__{c}") for c in by] + [F.upper(F.col(text).cast("string")) == F.col("__text")]
    return right.where(F.col(text).cast("string") != "").join(found, reduce(Column.__and__, same), "left_anti")
