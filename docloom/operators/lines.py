"""Text lines from the boxes of recognised tokens: gaps and islands, first down the page, then along a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def y_threshold(height: Column) -> Column:
    return F.when(height > 0, F.greatest(F.lit(4), F.floor(height * 0.01))).otherwise(15)


def x_threshold(width: Column) -> Column:
    return F.when(width > 0, F.greatest(F.lit(50), F.floor(width * 0.20))).otherwise(1000)


def group_lines(tokens: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Lines of tokens (keys, pos, text, x, y, x_end, height, width): keys, line_no, line.

    A row ends where the next token lies lower than the one before by more than a hundredth of the
    page; a line in a row ends at a gap wider than a fifth of the page. Equal places keep the order of
    pos. One shuffle by document serves all three windows; a document's tokens are one page's.
    """
    down = Window.partitionBy(*keys).orderBy("y", "pos")
    rows = tokens.withColumn("new_row", F.coalesce((F.col("y") - F.lag("y").over(down) > y_threshold(F.col("height"))).cast("int"), F.lit(1)))
    rows = rows.withColumn("row", F.sum("new_row").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy(*keys).orderBy("row", "x", "y", "pos")
    same_row = F.lag("row").over(along) == F.col("row")
    near = F.col("x") - F.lag("x_end").over(along) <= x_threshold(F.col("width"))
    lined = rows.withColumn("new_line", F.when(F.coalesce(same_row & near, F.lit(False)), 0).otherwise(1)).withColumn("at", F.row_number().over(along))
    lined = lined.withColumn("line_no", F.sum("new_line").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda t: t["text"])
    return lined.groupBy(*keys, "line_no").agg(F.upper(F.array_join(words, " ")).alias("line"))


def lines_of(tokens: Column, height: Column, width: Column) -> Column:
    """The same lines as an array, from the tokens of a document in one column, without a shuffle."""
    placed = F.transform(tokens, lambda t: F.struct(F.get(F.get(t["box"], F.lit(0)), F.lit(1)).alias("y"), t["pos"].alias("pos"), F.get(F.get(t["box"], F.lit(0)), F.lit(0)).alias("x"), F.get(F.get(t["box"], F.lit(1)), F.lit(0)).alias("x_end"), t["text"].alias("text")))
    down = F.array_sort(placed)
    numbered = F.aggregate(
        down,
        F.struct(F.lit(0).alias("row"), F.lit(None).cast("double").alias("y"), F.array().cast("array<struct<row:int,x:double,y:double,pos:int,x_end:double,text:string>>").alias("out")),
        lambda s, t: _next_row(s, t, y_threshold(height)),
        lambda s: F.array_sort(s["out"]),
    )
    return F.aggregate(
        numbered,
        F.struct(F.lit(None).cast("int").alias("row"), F.lit(None).cast("double").alias("x_end"), F.array().cast("array<string>").alias("out")),
        lambda s, t: _next_token(s, t, x_threshold(width)),
        lambda s: F.transform(s["out"], lambda x: F.upper(x)),
    )


def _next_row(s: Column, t: Column, most: Column) -> Column:
    row = s["row"] + F.when(F.coalesce(t["y"] - s["y"] > most, F.lit(True)), 1).otherwise(0)
    return F.struct(row.alias("row"), t["y"].alias("y"), F.array_append(s["out"], F.struct(row.alias("row"), t["x"].alias("x"), t["y"].alias("y"), t["pos"].alias("pos"), t["x_end"].alias("x_end"), t["text"].alias("text"))).alias("out"))


def _next_token(s: Column, t: Column, most: Column) -> Column:
    joins = F.coalesce((s["row"] == t["row"]) & (t["x"] - s["x_end"] <= most), F.lit(False))
    n = F.size(s["out"])
    longer = F.concat(F.slice(s["out"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat_ws(" ", F.try_element_at(s["out"], F.lit(-1)), t["text"])))
    return F.struct(t["row"].alias("row"), t["x_end"].alias("x_end"), F.when(joins, longer).otherwise(F.array_append(s["out"], t["text"])).alias("out"))


def unscale_boxes(tokens: Column, factor: Column) -> Column:
    """Boxes in the pixels of the original page; a broken point becomes (0, 0), a broken box four of them."""
    zero = F.array(F.lit(0.0), F.lit(0.0))
    point = lambda p: F.when(F.size(p) >= 2, F.array(p[0] / factor, p[1] / factor)).otherwise(zero)
    return F.transform(tokens, lambda t: t.withField("box", F.when(F.size(t["box"]) == 4, F.transform(t["box"], point)).otherwise(F.array(zero, zero, zero, zero))).withField("conf", F.coalesce(t["conf"], F.lit(0.5))))
