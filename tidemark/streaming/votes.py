"""Majority votes over event-time windows of a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_votes(votes: DataFrame, window: str, late: str) -> DataFrame:
    """(start, o, n, count) of votes (ts, o, n) by tumbling window; votes later than ``late`` are dropped. Counts are
    kept as state by Spark; the winner of each window is the batch majority of the closed windows."""
    each = votes.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "o", "n").agg(F.count("*").alias("count"))
    return each.select(F.col("w.start").alias("start"), "o", "n", "count")
