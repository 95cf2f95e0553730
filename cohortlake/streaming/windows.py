"""Audit counts by time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def audit_counts(log: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, action_type, n) of a stream or table of log rows; later rows than ``late`` are left out of a stream."""
    counted = log.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "action_type").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "action_type", "n")
