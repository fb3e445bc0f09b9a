"""Streaming form of the category and entity activity counts: watermarked windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def activity(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """events(ts, entity) streaming or not -> window_start, entity, n. State is bounded by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "entity").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "entity", "n")
