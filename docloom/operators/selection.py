"""Exact order statistics of groups of any size, by refining histograms.

A group of up to FEW values is sorted. For a larger one, the range of its values is cut into BINS equal bins, counted
where the values are; the bin that holds the wanted rank becomes the range of the next round, by the smallest and
largest value in it, until it holds FEW values or one. A round moves at most BINS counts a group and task, never
the values, so a key with most of the rows costs what any other does.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import checkpointed
from .ranges import on_keys

BINS = 1024
FEW = 4096


def _bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Bins grow with x: the ends of the range are in the first and the last; what is beyond all numbers is in one of its own."""
    inner = F.least(F.floor((x / 2 - low / 2) / (high / 2 - low / 2) * bins), F.lit(bins - 1))
    return F.when(F.isnan(x), bins + 1).when(x == float("inf"), bins).when(x == float("-inf"), -1).when(high <= low, 0).otherwise(inner).cast("int")


def kth_values(rows: DataFrame, keys: list[str], value: str, rank: Column, few: int = FEW, bins: int = BINS) -> DataFrame:
    """keys, n (values that aren't null), kth: the value whose place among the sorted ones is ``rank``, an expression of n, from 0.

    Values are numbers and come back as doubles, so integers beyond 2^53 aren't told apart; NaN counts as the
    largest. Null keys are a group. Groups without values, and ranks outside of a group, are left out. An empty table gives an empty result.
    """
    x = rows.select(*keys, F.col(value).cast("double").alias("__x")).where("__x is not null")
    finite = F.when(~F.isnan("__x") & (F.abs("__x") < float("inf")), F.col("__x"))
    sizes = x.groupBy(*keys).agg(F.count("*").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high"))
    wanted = sizes.withColumn("place", rank.cast("long")).where("place >= 0 and place < n").withColumns({"held": F.col("n"), "kth": F.lit(None).cast("double")})
    renamed, same = on_keys(keys)
    done = []
    todo = checkpointed(wanted)
    columns = [*keys, "n", "place", "held", "low", "high"]
    inside = lambda: F.col("__x").eqNullSafe(F.col("low")) | F.col("__x").between(F.col("low"), F.col("high"))
    first = True
    while True:
        small = todo.where(F.col("held") <= few).select(*renamed, *columns[len(keys):])
        there = x.join(small, same) if first else x.join(small, same).where(inside())
        order = Window.partitionBy(*keys).orderBy("__x")
        done.append(there.withColumn("at", F.row_number().over(order) - 1).where("at = place").select(*keys, "n", F.col("__x").alias("kth")))
        todo = todo.where(F.col("held") > few)
        if todo.isEmpty():
            break
        met = x.join(todo.select(*renamed, *columns[len(keys):]), same)
        met = met if first else met.where(inside())
        counts = met.withColumn("bin", _bin(F.col("__x"), F.col("low"), F.col("high"), bins)).groupBy(*keys, "n", "place", "bin").agg(F.count("*").alias("held"), F.min("__x").alias("low"), F.max("__x").alias("high"))
        running = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("held").over(running), F.lit(0))).where("place >= before and place < before + held")
        counts = checkpointed(counts.select(*keys, "n", (F.col("place") - F.col("before")).alias("place"), "held", "low", "high"))
        single = F.col("low").eqNullSafe(F.col("high"))
        done.append(counts.where(single).select(*keys, "n", F.col("low").alias("kth")))
        todo, first = counts.where(~single), False
    return reduce(DataFrame.union, done)


def upper_medians(rows: DataFrame, keys: list[str], value: str, few: int = FEW, bins: int = BINS) -> DataFrame:
    """keys, n, kth: the upper median of each group, the value at place n div 2 of the sorted ones."""
    return kth_values(rows, keys, value, F.floor(F.col("n") / 2), few, bins)


def best_rows(rows: DataFrame, keys: list[str], score: str, tie: list[str], value: list[str]) -> DataFrame:
    """keys, score, value: the row of each group with the highest score, of equals the first by ``tie``. Scores are
    numbers; null and NaN are none, and a group without one is left out. One candidate a group and task is what moves."""
    at = F.struct(*tie, *[c for c in value if c not in tie])
    scored = rows.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    best = scored.groupBy(*keys).agg(F.min(F.struct((-F.col(score)).alias("low"), at.alias("at"))).alias("best"))
    return best.select(*keys, (-F.col("best.low")).alias(score), *[F.col(f"best.at.{c}").alias(c) for c in value])
