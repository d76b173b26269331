"""Windows over the event table, batch or streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(events: DataFrame, delay: str) -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming else events


def tumbling_windows(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    g = _late(events, delay).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("window.start").alias("begin"), "event_type", "n", "total")


def sliding_windows(events: DataFrame, width: str = "1 hour", slide: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    g = _late(events, delay).groupBy(F.window("ts", width, slide), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("window.start").alias("begin"), "event_type", "n")


def session_windows(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    g = _late(events, delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))
    return g.select("user_id", F.col("session_window.start").alias("begin"), "last", "n")
