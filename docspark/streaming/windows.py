"""Windowed aggregates of event streams; the same plan serves batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, width: str, by: list[str], value: str, late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums by window; `late` sets the watermark of a stream, `slide` makes windows overlap."""
    rows = events.withWatermark(time, late) if late else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """Sessions that end after a gap without events."""
    rows = events.withWatermark(time, late) if late else events
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
