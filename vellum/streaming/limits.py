"""Sliding-window counts of failures, on tables and on streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def failures(events: DataFrame, least: int = 5, size: str = "10 minutes", slide: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """user_id, window_start, failures: users with ``least`` errors or more in a window. On a stream, the watermark
    bounds how long windows are kept."""
    own = events.filter(F.col("event_type") == "error").select("user_id", "ts")
    if own.isStreaming:
        own = own.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = own.groupBy("user_id", F.window("ts", size, slide).alias("w")).agg(F.count(F.lit(1)).alias("failures"))
    begin = F.col("w.start").cast(events.schema["ts"].dataType)
    return out.filter(F.col("failures") >= least).select("user_id", begin.alias("window_start"), "failures")
