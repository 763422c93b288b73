"""Event-time windows over a transaction stream (the same code runs on a table)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATENESS = "1 hour"


def session_totals(txn: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """Count and volume per user session; a silence of ``gap`` ends a session.

    ``txn`` has user_id, ts (timestamp), cents. Spark merges partial sessions before the shuffle.
    """
    src = txn.withWatermark("ts", watermark) if watermark else txn
    g = src.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "cents")


def sliding_totals(txn: DataFrame, width: str, step: str, watermark: str | None = None) -> DataFrame:
    """Count and volume per user in windows of ``width`` that start every ``step``."""
    src = txn.withWatermark("ts", watermark) if watermark else txn
    g = src.groupBy("user_id", F.window("ts", width, step).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "cents")
