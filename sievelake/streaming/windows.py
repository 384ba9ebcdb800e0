"""Forms of the same operators over batches and streams: event-time windows and dedup with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    """With a watermark if ``late`` is given; watermarks take instants only, so ``ts`` becomes one."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else events


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events and their value per window and type; ``late`` sets a watermark for streams."""
    e = _timed(events, late)
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Events per user session; a session ends after ``gap`` without an event."""
    e = _timed(events, late)
    return e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


def stream_dedup(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """One row of each event_id, remembered as long as the watermark allows."""
    return _timed(events, late).dropDuplicatesWithinWatermark(["event_id"])
