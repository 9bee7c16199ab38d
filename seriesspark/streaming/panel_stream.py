"""Structured Streaming form of the 10-minute panel.

The reference has no streaming; this module only re-expresses the 10-minute
bucketing of ``sources.bindings.ten_minute_panel`` for an unbounded event
source: an event-time window with a watermark, so late events within the
allowed delay update their bucket and state older than the watermark is
dropped. Output rows are ``(unique_id, ds, y, n)`` with the exact decimal mean.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ten_minute_stream(events: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """Watermarked 10-minute mean per event type over a streaming events frame."""
    ts = F.col("ts").cast("timestamp")
    return (events.withColumn("_ts", ts).withWatermark("_ts", delay)
            .groupBy(F.col("event_type").alias("unique_id"), F.window("_ts", "10 minutes").alias("_w"))
            .agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("_s"), F.count("value").alias("n"))
            .select("unique_id", F.col("_w.start").cast("timestamp_ntz").alias("ds"),
                    (F.col("_s") / F.col("n")).cast("decimal(18,4)").cast("double").alias("y"), "n"))
