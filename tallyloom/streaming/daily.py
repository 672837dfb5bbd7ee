"""Day buckets of an event stream. The record pipelines are batch; this is an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, at: str = "ts", late: str = "1 day", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts by day and ``by``; with a stream, days close once ``late`` has passed."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, "1 day"), *by).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), *by, "n")
