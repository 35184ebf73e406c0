"""Beyond the reference: sessions and counts over event streams, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, keys: list[str], ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Start, end and rows of each session: rows of a key closer than the gap. Works on streams and tables."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    s = rows.groupBy(*keys, F.session_window(ts, gap)).agg(F.count("*").alias("n"))
    return s.select(*keys, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windowed_counts(events: DataFrame, keys: list[str], ts: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Rows per key and fixed or sliding window."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    g = rows.groupBy(*keys, F.window(ts, width, slide or width)).agg(F.count("*").alias("n"))
    return g.select(*keys, F.col("window.start").alias("start"), "n")
