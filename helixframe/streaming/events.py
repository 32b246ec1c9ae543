"""Structured Streaming forms of the windowed and keyed operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def sliding_counts(events: DataFrame, ts: str, key: str, size: str, slide: str, late: str) -> DataFrame:
    """Counts and sums per window and key; rows later than ``late`` are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size, slide), key).agg(F.count("*").alias("n"))


def first_per_key(events: DataFrame, key: str, ts: str, late: str) -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """Collapsed activity intervals: the streaming twin of the interval collapse with a gap."""
    w = F.session_window(ts, gap)
    got = events.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n"))
    return got.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
