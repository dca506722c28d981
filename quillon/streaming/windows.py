"""Event-time aggregates, for tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def late(events: DataFrame, delay: str | None) -> DataFrame:
    """A stream with a watermark, which needs times with a zone; a table as it is."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay) if events.isStreaming and delay else events


def tumbling(events: DataFrame, length: str, slide: str | None = None, delay: str | None = "1 hour") -> DataFrame:
    """start, event_type, n, total of windows of a length, each `slide`."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return late(events, delay).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, delay: str | None = "1 hour") -> DataFrame:
    """user_id, start, n, total of runs of events that less than the gap divides."""
    return late(events, delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").alias("start"), "n", "total")


def once(events: DataFrame, keys: list[str], order: str, delay: str | None = "1 hour") -> DataFrame:
    """One event a key: of a table the first in order, of a stream the first to come within the watermark."""
    if events.isStreaming:
        return late(events, delay).dropDuplicatesWithinWatermark(keys)
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
