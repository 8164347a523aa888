"""Pieces that several corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder, by a path that only Spark needs to be able to read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small: rows here may be whole documents of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. Where none is named, a local session gets a temporary one; a cluster has to name it."""
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="docloom-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint, which outlives any executor."""
    shared_dir(df.sparkSession)
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.constraintPropagation.enabled")
    conf.set("spark.sql.constraintPropagation.enabled", "false")  # a checkpoint keeps the constraints, and loops multiply them
    try:
        return df.checkpoint(eager=True)
    finally:
        conf.set("spark.sql.constraintPropagation.enabled", before)


def cut_plain(df: DataFrame) -> DataFrame:
    """cut() that also forgets how the rows are dealt and sorted: under joins in a loop these multiply, and planning with them."""
    spark, made = df.sparkSession, cut(df)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(made.queryExecution().toRdd(), made.schema(), False), spark)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the edges (a, b), both long: rows (node, root), root the smallest node.

    Each round points every node at its smallest neighbour, follows the pointers, and contracts the
    edges, which mostly leaves less than half of them; where it doesn't, as on a long path in order,
    the next round follows the pointers until they rest. Minima are aggregated map-side; joins meet at
    most one row per key on one side, so that a hub's rows can be split. Edges with a null end and
    loops are ignored; an empty table gives an empty result.
    """
    edges = cut_plain(edges.where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels: DataFrame | None = None
    size, chase = edges.count(), False
    while size:
        both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        step = cut_plain(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("to")))
        while True:
            onward = step.where("node <> to").select(F.col("node").alias("to"), F.col("to").alias("then"))
            step = cut_plain(step.join(onward, "to", "left").select("node", F.coalesce("then", "to").alias("to"), F.col("then").isNotNull().alias("moved")))
            moved = chase and not step.where("moved").isEmpty()
            step = step.drop("moved")
            if not moved:
                break
        if labels is None:
            labels = step.withColumnRenamed("to", "root")
        else:
            labels = cut_plain(labels.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        for end in ("a", "b"):
            edges = edges.join(step.withColumnRenamed("node", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = cut_plain(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        before, size = size, edges.count()
        chase = size > before / 2
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


#: Written intermediates that are still there.
_WRITTEN: set[str] = set()


def written(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder and read it again; with the path, for drop()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    _WRITTEN.add(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete written intermediates and let Spark clear the shuffle files nobody refers to any more."""
    for path in paths:
        _WRITTEN.discard(path)
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    gc.collect()
    spark.range(1).collect()  # the listener bus holds the last query's plan until another has ended
    time.sleep(1.1)  # Py4J tells the JVM once a second what Python has let go
    spark._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Delete all written intermediates of this driver, once the results that read them have been saved."""
    drop(spark, *list(_WRITTEN))
