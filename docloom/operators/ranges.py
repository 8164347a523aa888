"""Order over whole tables: rows are dealt to ranges of the order, so that a key with most of the rows is spread.

Sorting puts the rows of a key into consecutive parts. What a window over the key would carry from row to row
is carried within a part, and one row a part and key carries it from part to part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stages import checkpointed


def in_ranges(rows: DataFrame, order: list, parts: int | None = None) -> DataFrame:
    """``rows`` with ``part`` and ``seq``: sorted within parts, which follow each other in the order; seq grows along it.

    The numbering is cut by a checkpoint, as the ranges are drawn from a sample and mustn't change. Rows that are
    equal in ``order`` are in one part.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    return checkpointed(dealt.withColumn("part", F.shiftright("seq", 33).cast("int")))


def on_keys(keys: list[str], suffix: str = "__") -> tuple[list[Column], Column]:
    """Renamed keys for one side of a join, and the condition that they are equal, nulls too."""
    return [F.col(k).alias(f"{suffix}{k}") for k in keys], reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{suffix}{k}")) for k in keys], F.lit(True))


def numbered(rows: DataFrame, order: list, name: str = "place", parts: int | None = None) -> DataFrame:
    """``rows`` with their place in the order, from 0, without gaps; one count a part is what parts have to know of each other."""
    ranged = in_ranges(rows, order, parts)
    counts = {r.part: r.n for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()}
    before, starts = 0, []
    for part in sorted(counts):
        starts.append((part, before))
        before += counts[part]
    first = F.create_map(*[F.lit(x) for pair in starts for x in pair]) if starts else F.create_map(F.lit(0), F.lit(0))
    # seq is the part and a number that counts its rows from 0.
    place = F.try_element_at(first, F.col("part")) + F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.withColumn(name, place.cast("long")).drop("part", "seq")


def ranked(rows: DataFrame, keys: list[str], order: list, name: str = "rank", parts: int | None = None) -> DataFrame:
    """``rows`` with their rank, from 1, within equal ``keys`` (nulls are equal) by ``order``; rows equal in it are ranked in any order.
    A key may hold all rows: a part hands on how many rows of a key it has."""
    ranged = in_ranges(rows, [*keys, *order], parts)
    spans = ranged.groupBy(*keys, "part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    renamed, same = on_keys([*keys, "part"], "__of_")
    inner = F.row_number().over(Window.partitionBy(*keys, "part").orderBy("seq"))
    out = ranged.withColumn("__inner", inner).join(spans.withColumn("__before", before).select(*renamed, "__before"), same)
    return out.withColumn(name, F.col("__before") + F.col("__inner")).select(*rows.columns, name)


def micros(time: Column, kind: str) -> Column:
    """A time column as microseconds, times without a zone as they stand; numbers pass through."""
    if kind == "timestamp_ntz":
        day = F.datediff(time, F.lit("1970-01-01")).cast("long") * 86_400_000_000
        seconds = F.extract(F.lit("SECONDS"), time)
        return day + F.hour(time).cast("long") * 3_600_000_000 + F.minute(time).cast("long") * 60_000_000 + (seconds * 1_000_000).cast("long")
    return F.unix_micros(time) if kind == "timestamp" else time


def islands(rows: DataFrame, keys: list[str], at: str, gap, tie: list[str] = (), name: str = "island", parts: int | None = None) -> DataFrame:
    """``rows`` with the number, from 1, of their island: within equal ``keys`` (nulls are equal) a new one begins
    where ``at`` lies more than ``gap`` behind the row before. Only neighbours are compared, so islands chain.

    ``at`` is a number, or a time with ``gap`` in seconds. Rows whose ``at`` is null are in no island (null). A key
    may hold all rows: its rows are spread over parts, and a part hands on its last place and how many islands it
    has. An empty table gives an empty result.
    """
    kind = dict(rows.dtypes)[at]
    timed = kind.startswith("timestamp")
    place, wide = ("__at", gap * 1_000_000) if timed else (at, gap)
    known = rows.where(F.col(at).isNotNull())
    if timed:
        known = known.withColumn("__at", micros(F.col(at), kind))
    ranged = in_ranges(known, [*keys, place, *tie], parts)
    inner = Window.partitionBy(*keys, "part").orderBy("seq")
    broken = lambda a, b: (a - b > wide).cast("long")
    marked = ranged.withColumn("__new", F.coalesce(broken(F.col(place), F.lag(place).over(inner)), F.lit(0)))
    spans = marked.groupBy(*keys, "part").agg(F.min(place).alias("__first"), F.max(place).alias("__last"), F.sum("__new").alias("__breaks"))
    outer = Window.partitionBy(*keys).orderBy("part")
    spans = spans.withColumn("__opens", F.coalesce(broken(F.col("__first"), F.lag("__last").over(outer)), F.lit(1)))
    spans = spans.withColumn("__before", F.sum(F.col("__opens") + F.col("__breaks")).over(outer) - F.col("__breaks"))
    renamed, same = on_keys([*keys, "part"], "__of_")
    out = marked.join(spans.select(*renamed, "__before"), same).withColumn(name, F.col("__before") + F.sum("__new").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return out.select(*rows.columns, name).unionByName(rows.where(F.col(at).isNull()).withColumn(name, F.lit(None).cast("long")))
