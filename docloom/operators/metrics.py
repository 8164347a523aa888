"""Request counts and latency, over a table or a stream of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_metrics(requests: DataFrame) -> DataFrame:
    """One row over (ok, latency_ms): counts, and the mean latency. The sum is of good requests alone, the
    divisor all, as services report it; ``mean_ok_latency_ms`` divides by the good ones."""
    good = F.when(F.col("ok"), F.col("latency_ms"))
    return requests.agg(
        F.count("*").alias("requests_total"), F.coalesce(F.sum((~F.col("ok")).cast("long")), F.lit(0)).alias("requests_error"),
        F.coalesce(F.sum(good) / F.count("*"), F.lit(0.0)).alias("avg_latency_ms"), F.coalesce(F.avg(good), F.lit(0.0)).alias("mean_ok_latency_ms"),
    )


def windowed_metrics(requests: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same by window of ts, on a table or a stream; a stream gives up windows older than ``late``."""
    rows = requests.withWatermark("ts", late) if requests.isStreaming else requests
    good = F.when(F.col("ok"), F.col("latency_ms"))
    out = rows.groupBy(F.window("ts", width)).agg(F.count("*").alias("requests_total"), F.sum((~F.col("ok")).cast("long")).alias("requests_error"), F.coalesce(F.sum(good) / F.count("*"), F.lit(0.0)).alias("avg_latency_ms"))
    return out.select(F.col("window.start").alias("start"), "requests_total", "requests_error", "avg_latency_ms")
