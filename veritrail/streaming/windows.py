"""Windowed aggregates of events, the same for tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hourly(events: DataFrame, lateness: str | None = None) -> DataFrame:
    """(event_type, hour, n, mean_value); a stream needs its lateness, after which an hour is closed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness) if lateness else events
    out = timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return out.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n", "mean_value")
