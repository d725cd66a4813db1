"""Windowed aggregates over event streams (group K); each works on batch and streaming tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, ts: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late) if events.isStreaming else events


def tumbling_counts(events: DataFrame, width: str, ts: str = "ts", kind: str = "event_type", late: str = "1 hour") -> DataFrame:
    """Counts and sums by window and kind; late rows within ``late`` are still counted."""
    w = F.window(ts, width)
    return _marked(events, ts, late).groupBy(w.alias("w"), kind).agg(
        F.count("*").alias("n"), F.sum("value").alias("total")
    ).select(F.col("w.start").alias("window_start"), kind, "n", "total")


def sliding_counts(events: DataFrame, width: str, slide: str, ts: str = "ts", kind: str = "event_type", late: str = "1 hour") -> DataFrame:
    return _marked(events, ts, late).groupBy(F.window(ts, width, slide).alias("w"), kind).agg(
        F.count("*").alias("n")
    ).select(F.col("w.start").alias("window_start"), kind, "n")


def sessions(events: DataFrame, gap: str, key: str = "user_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Sessions of each key: first and last event and their number; a gap of ``gap`` closes one."""
    return _marked(events, ts, late).groupBy(key, F.session_window(ts, gap).alias("w")).agg(
        F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts")
    ).select(key, "first_ts", "last_ts", "n")


def deduplicated(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Redelivered events dropped, state kept only as long as they may still arrive."""
    if events.isStreaming:
        return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


