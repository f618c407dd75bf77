"""Streaming over events: an extension, since spreadsheets and documents don't stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_totals(events: DataFrame, time: str, key: str, value: str, size: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and key; the same plan for a table and for a stream, whose late rows are bounded."""
    base = events.withWatermark(time, late) if events.isStreaming else events
    w = F.window(time, size, slide) if slide else F.window(time, size)
    totals = base.groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return totals.select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, time: str, key: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Sessions of a key: rows no further apart than the gap."""
    base = events.withWatermark(time, late) if events.isStreaming else events
    found = base.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
