"""Micro-batch ingestion of cells: windowed completeness, and sessions without gaps, both with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_missing(stream: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and valid values of each segment and window, final when the watermark passes the window's end."""
    timed = stream.withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "segment").agg(F.count("*").alias("n"), F.count("value").alias("n_valid")).select("segment", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "n_valid")


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of values that are nowhere further apart than the gap."""
    timed = stream.where(F.col("value").isNotNull()).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("s"), "segment").agg(F.count("*").alias("n")).select("segment", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")
