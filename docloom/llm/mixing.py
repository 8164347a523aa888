"""Mixing sources to target weights by weighted fair queueing (DataFrame functions only).

Every document, in an order shuffled by the hash of its id, gets the virtual finish time
``(words of its source up to and including it) / (target of its source)``. The queue is sorted by
that time over all sources and cut at the total budget, the sum of all sizes. A source whose target
exceeds its size is queued again, at most three times over, its words counted onwards.

Prefix sums run in two levels. Documents are dealt by (source, leading digits of the hash), so a
source holding any share of the rows is spread over ``16 ** digits`` groups; the totals of the groups
are added up apart and joined back. The sorted queue is dealt by ranges of virtual time likewise.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
MAX_PASSES = 3
ROWS_A_RANGE = 1000  # about so many documents finish in a range of virtual time
MAX_RANGES = 1 << 20
BROADCAST_SOURCES = 50_000  # a larger table of sources is joined by shuffling


def source_targets(sizes: DataFrame, passes: int = MAX_PASSES) -> DataFrame:
    """(source, sid, source_size, target) from rows (source, size).

    Sources by code point, null last, weigh 1, 2, 3, repeating. Targets stop at ``passes`` times the
    source's size and the rest is shared anew by weight: in order of cap to weight, source k is
    capped if its cap is at most its share of what the sources before it leave.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", (F.col("sid") - 1) % 3 + 1).withColumn("cap", F.lit(passes) * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "sid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    return (
        ranked.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("level", F.col("left").cast("double") / F.sum("w").over(onward))
        .withColumn("capped", F.col("cap") <= F.col("w") * F.col("level"))
        .withColumn("k", F.row_number().over(order))
        .withColumn("rest", F.min(F.when(~F.col("capped"), F.struct("k", "level"))).over(whole)["level"])
        .select("source", "sid", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("w") * F.col("rest")).alias("target"))
    )


def mix(docs: DataFrame, seed: str = "mix", with_source: bool = False) -> DataFrame:
    """Words taken of each row of ``docs`` (doc_id, text, source; other columns are ignored).

    Returns doc_id, size, source_size, target, taken (and source, if asked for), one row per input row. Null or blank text has
    size 0 and is never taken; null is a source of its own, last in order; rows repeated or without
    doc_id are queued like any others (their order among themselves is by size); an empty table
    gives an empty result. The last copy to fit the budget is taken in part.
    """
    sizes = docs.select(F.col("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = cut(sizes)
    n = sizes.count()
    digits = min(5, max(2, math.ceil(math.log(max(n, 1) / 1000 + 1, 16))))
    ranges = min(MAX_RANGES, max(64, n // ROWS_A_RANGE))  # of virtual time between 0 and 1
    targets = cut(source_targets(sizes))
    small = targets.count() <= BROADCAST_SOURCES
    joined = sizes.withColumnRenamed("source", "of").join(F.broadcast(targets) if small else targets, F.col("of").eqNullSafe(F.col("source")))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f"#{seed}")))
    keyed = joined.withColumn("h", key).withColumn("cell", F.substring("h", 1, digits))

    inside = Window.partitionBy("sid", "cell").orderBy("h", "doc_id", "size")
    summed = keyed.withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rn", F.row_number().over(inside))
    cells = keyed.groupBy("sid", "cell").agg(F.sum("size").alias("n")).withColumn("base", F.sum("n").over(Window.partitionBy("sid").orderBy("cell")) - F.col("n"))
    queued = summed.join(cells.select("sid", "cell", "base"), ["sid", "cell"]).withColumn("upto", F.col("upto") + F.col("base"))

    copies = queued.withColumn("copy", F.explode(F.array(*[F.lit(i) for i in range(MAX_PASSES)])))
    copies = copies.withColumn("finish", F.when(F.col("target") > 0, (F.col("copy") * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")))
    copies = copies.withColumn("range", F.least(F.floor(F.coalesce("finish", F.lit(2.0)) * ranges), F.lit(2 * ranges)))
    spread = F.when(F.col("range") == 2 * ranges, F.substring("h", 1, digits)).otherwise(F.lit(""))  # far beyond the cut, order no longer matters
    copies = copies.withColumn("spread", spread).withColumn("budget_size", F.when(F.col("range") < 2 * ranges, F.col("size")).otherwise(F.lit(0)))
    copies = cut(copies.select("doc_id", "source", "size", "source_size", "target", "sid", "cell", "rn", "h", "copy", "finish", "range", "spread", "budget_size"))
    totals = copies.groupBy("range").agg(F.sum("budget_size").alias("n"))
    ahead = totals.withColumn("ahead", F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("range")) - F.col("n")).select("range", "ahead")
    budget = targets.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("budget"))
    queue = Window.partitionBy("range", "spread").orderBy("finish", "h", "doc_id", "size", "copy").rowsBetween(Window.unboundedPreceding, 0)
    cum = copies.withColumn("within", F.sum("size").over(queue) - F.col("size"))
    cum = cum.join(F.broadcast(ahead) if ranges <= BROADCAST_SOURCES else ahead, "range").join(F.broadcast(budget))  # 2 * ranges + 1 rows, and one
    got = F.when(F.col("range") < 2 * ranges, F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("ahead") - F.col("within")))).otherwise(F.lit(0))
    out = cum.groupBy("sid", "cell", "rn", "doc_id", "source", "size", "source_size", "target").agg(F.sum(got).cast("long").alias("taken"))
    return out.select("doc_id", "size", "source_size", "target", "taken", *(["source"] if with_source else []))


def copies_taken(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: each in as many copies as needed, at most three.

    The one copy at the end of the budget keeps the words taken, joined by spaces; rows that the budget
    doesn't reach go. Rows that share doc_id, source and size are matched to the mix by their rank, in
    order of text. All columns of ``docs`` are kept; n_chars, if there, is counted again.
    """
    mine = ["doc_id", "source", "size"]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rank = F.row_number().over(Window.partitionBy(*mine).orderBy("text"))
    sized = docs.select(F.struct("*").alias("row"), "doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), "text").withColumn("rank", rank)
    taken = mix(docs, with_source=True).select(*[F.col(c).alias(f"{c}_taken") for c in mine], "taken")
    taken = taken.withColumn("rank_taken", F.row_number().over(Window.partitionBy(*[f"{c}_taken" for c in mine]).orderBy("taken")))
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_taken")) & F.col("source").eqNullSafe(F.col("source_taken")) & (F.col("size") == F.col("size_taken"))
    same &= (F.col("rank") <= F.col("rank_taken")) & (F.col("rank") >= F.col("rank_taken"))  # not a key, so that both windows' shuffles serve the join
    both = sized.join(taken, same).where("taken > 0")
    copy = F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int")))
    both = both.withColumn("copy", copy).withColumn("words", F.least(F.col("size"), F.col("taken") - (F.col("copy") - 1) * F.col("size")))
    head = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col("words").cast("int")), " ")
    text = F.when(F.col("words") < F.col("size"), head).otherwise(F.col("text"))
    made = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return both.select(*[made[c].alias(c) if c in made else F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid FROM src),
weighed AS (SELECT *, (sid - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM ranked),
levels AS (SELECT *, row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / w, sid) AS k,
  CAST((SELECT sum(source_size) FROM src) - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / CAST(sum(w) OVER (ORDER BY CAST(cap AS DOUBLE) / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM weighed),
tg AS (SELECT source, sid, source_size, CASE WHEN cap <= w * level THEN CAST(cap AS DOUBLE)
  ELSE w * (SELECT level FROM levels x WHERE NOT x.cap <= x.w * x.level ORDER BY k LIMIT 1) END AS target FROM levels),
q AS (SELECT s.doc_id, s.size, tg.sid, tg.source_size, tg.target, md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '#mix') AS h FROM s JOIN tg ON s.source IS NOT DISTINCT FROM tg.source),
c AS (SELECT *, row_number() OVER (ORDER BY sid, h, doc_id, size) AS rid, sum(size) OVER (PARTITION BY sid ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM q),
x AS (SELECT c.*, e.copy, CAST(e.copy * source_size + upto AS DOUBLE) / target AS finish FROM c, (VALUES (0), (1), (2)) e(copy) WHERE target > 0),
g AS (SELECT rid, greatest(0, least(size, (SELECT sum(source_size) FROM src) - (sum(size) OVER (ORDER BY finish, h, doc_id, size, copy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size))) AS got FROM x WHERE finish < 2)
SELECT doc_id, size, source_size, target, CAST(coalesce((SELECT sum(got) FROM g WHERE g.rid = c.rid), 0) AS BIGINT) AS taken FROM c
"""
