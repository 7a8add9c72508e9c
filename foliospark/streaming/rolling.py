"""Rolling operational metrics; the same plan runs on a table or on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events and summed value per type and hour. On a stream, rows later than ``late`` are dropped."""
    timed = events
    if events.isStreaming:
        # Watermarks need a zoned timestamp; the session time zone is pinned to UTC.
        timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return (
        timed.groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("hour"), "event_type", "n", "total")
    )
