"""Windowed aggregates over an event stream; the same plan runs on a table or on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """(start, event_type, n, total) of (ts, event_type, value); ``late`` sets the watermark of a stream."""
    own = events.withWatermark("ts", late) if late else events
    return own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n): bursts of a user's events with less than ``gap`` between."""
    return events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
