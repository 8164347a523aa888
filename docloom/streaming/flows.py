"""The same plans over files that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import windowed_metrics
from ..plans.extract import extract
from ..schema import DOCUMENT, REQUEST
from ..sources.records import for_sink


def document_stream(spark: SparkSession, path: str, kind: str = "json", files: int = 100) -> DataFrame:
    """Recognised documents from a folder, each content once: repeated records within an hour are dropped."""
    rows = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files).format(kind).load(path)
    return rows.withColumn("seen", F.current_timestamp()).withColumn("digest", F.sha2(F.to_json("tokens"), 256)).withWatermark("seen", "1 hour").dropDuplicatesWithinWatermark(["doc_id", "digest"]).drop("seen", "digest")


def extract_stream(spark: SparkSession, path: str, out: str, checkpoint: str, kind: str = "json"):
    """Start extracting documents as they arrive; each batch is written once, identifiers masked and without lines."""

    def write(batch: DataFrame, epoch: int) -> None:
        for_sink(extract(batch)).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return document_stream(spark, path, kind).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def metrics_stream(spark: SparkSession, path: str, kind: str = "json", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    rows = spark.readStream.schema(REQUEST).format(kind).load(path)
    return windowed_metrics(rows.withColumn("ts", F.col("ts").cast("timestamp")), width, late)


def session_stream(events: DataFrame, keys: list[str], at: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Islands of a stream: keys, began, ended (the last event), n. A session ends where nothing follows within ``gap``, and comes out
    when the watermark has passed that; the store holds open sessions only. Over a table, operators/ranges.islands spreads a key."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    out = rows.groupBy(*keys, F.session_window(at, gap).alias("session")).agg(F.max(at).alias("ended"), F.count("*").alias("n"))
    return out.select(*keys, F.col("session.start").alias("began"), "ended", "n")
