"""Set semantics over tables: bag intersection, keys by containment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import checkpointed
from .ranges import on_keys, ranked
from .sheets import CORE

MOST = 1 << 16  # rows of a value that one task ranks
FEW = 1 << 16  # values that are sent to all tasks


def ordered_intersection(a: DataFrame, b: DataFrame, keys: list[str], value: str, pos: str) -> DataFrame:
    """Rows of a whose value b has too, each row of b used once, in a's order."""
    numbered = lambda x: x.withColumn("nth", F.row_number().over(Window.partitionBy(*keys, value).orderBy(pos)))
    return numbered(a).join(numbered(b).select(*keys, value, "nth"), [*keys, value, "nth"], "left_semi").drop("nth")


def ordered_difference(a: DataFrame, b: DataFrame, keys: list[str], value: str, order: list[str], most: int = MOST, few: int = FEW) -> DataFrame:
    """Rows of a without one row of b of the same value for each, the first ones of a going; nulls are values. A value may have
    any number of rows.

    Values are counted by 128 bits of keys and value, so only hashes move for that. Rows whose value b doesn't have stay where they
    are, and those of which b has as many go unread; what is left is ranked, a value of more than ``most`` rows over range parts. Up to
    ``few`` values that meet are sent to all tasks; beyond that rows of a move once. a and b are read more than once.
    """
    columns = [*keys, value]
    kinds = a.select(*columns).unionByName(b.select(*columns)).schema  # of unequal types the wider
    same = ["__one", "__two"]
    known = [F.xxhash64(F.lit(k), *[F.col(c).isNull() for c in columns], *[F.col(c).cast(kinds[c].dataType) for c in columns]).alias(n) for k, n in enumerate(same)]
    both = a.select(*known, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(*known, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    counts = both.groupBy(*same).agg(F.sum("__a").alias("__a"), F.sum("__b").alias("__b"))
    counts = checkpointed(counts.where(((F.col("__a") > 0) & (F.col("__b") > 0)) | (F.col("__a") > most)))
    n, n_large = counts.agg(F.count("*"), F.count_if(F.col("__a") > most)).first()
    large, small = F.broadcast(counts.where(F.col("__a") > most)), counts.where(F.col("__a") <= most)
    if n <= few:
        small = F.broadcast(small)
    goes_on = (F.col("__b") > 0) & (F.col("__a") > F.col("__b"))
    rows = a.select("*", *known)
    plain = rows.join(large, same, "left_anti") if n_large else rows
    nth = F.row_number().over(Window.partitionBy(*same).orderBy(*order))
    parts = [plain.join(small, same, "left_anti"), plain.join(small.where(goes_on), same).withColumn("__nth", nth).where("__nth > __b")]
    if n_large:
        many = rows.join(large, same)
        parts += [many.where("__b = 0"), ranked(many.where(goes_on), same, order, "__nth").where("__nth > __b")]
    return reduce(DataFrame.unionByName, [p.select(*a.columns) for p in parts])


def zip_by_rank(a: DataFrame, b: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of a with ``other``, a struct of the row of b that has the same rank by ``order`` within equal ``keys``, null where b has
    fewer. A key may hold all rows."""
    renamed, same = on_keys([*keys, "__rank"], "__b_")
    other = ranked(b, keys, order, "__rank").withColumn("other", F.struct(*b.columns)).select(*renamed, "other")
    return ranked(a, keys, order, "__rank").join(other, same, "left").select(*a.columns, "other")


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each value of ``keys``, the first by ``order``, of equals by all columns: one candidate a key and task is what moves."""
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("first"))
    return first.select(*[F.col(c) if c in keys else F.col(f"first.{c}").alias(c) for c in rows.columns])


def core_key(name: Column) -> Column:
    """The longest core subject in a name, else the name in capitals."""
    up = F.upper(name)
    hits = F.filter(F.array(*[F.struct(F.lit(-len(c)).alias("n"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(CORE)]), lambda c: F.contains(up, c["c"]))
    return F.coalesce(F.get(F.array_sort(hits), F.lit(0))["c"], up)
