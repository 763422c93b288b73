"""Regulatory extracts and operational summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sar_report(predictions: DataFrame, cases: DataFrame, start_us: int, end_us: int, min_score: float = 0.70) -> DataFrame:
    """Suspicious activity: high scores with their cases, a row per case. Both range ends count."""
    p = predictions.filter((F.col("score") >= min_score) & F.col("created_us").between(start_us, end_us))
    c = cases.select("case_id", F.col("entity_id").alias("_e"), F.col("status").alias("case_status"), "trigger_reason")
    j = p.join(c, p["transaction_id"] == c["_e"], "left")
    return j.select("prediction_id", "transaction_id", "user_id", "score", "level", "decision", "case_id", "case_status", "trigger_reason",
                    "created_us").orderBy(F.col("score").desc(), "prediction_id", "case_id")


def str_report(predictions: DataFrame, start_us: int, end_us: int) -> DataFrame:
    """Blocked and reviewed transactions, newest first."""
    p = predictions.filter(F.col("decision").isin("BLOCK", "REVIEW") & F.col("created_us").between(start_us, end_us))
    return p.select("prediction_id", "transaction_id", "user_id", "score", "level", "decision", "created_us").orderBy(
        F.col("created_us").desc(), F.col("prediction_id").desc())


def amount_bands(txn: DataFrame, bounds: list[tuple[str, float | None]]) -> DataFrame:
    """Count, mean, smallest and largest amount per band; a band ends below its bound."""
    def band() -> Column:
        out = F.lit(None).cast("string")
        for name, below in reversed(bounds):
            out = F.lit(name) if below is None else F.when(F.col("amount") < below, name).otherwise(out)
        return out
    g = txn.withColumn("band", band()).groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cents").alias("_s"), F.min("amount").alias("min_amount"), F.max("amount").alias("max_amount"))
    return g.select("band", "n", (F.col("_s") / F.col("n") / 100.0).alias("avg_amount"), "min_amount", "max_amount")


def risk_distribution(predictions: DataFrame) -> DataFrame:
    """Rows per level, from LOW to CRITICAL."""
    order = F.when(F.col("level") == "LOW", 1).when(F.col("level") == "MEDIUM", 2).when(F.col("level") == "HIGH", 3).otherwise(4)
    return predictions.groupBy("level").agg(F.count(F.lit(1)).alias("n")).withColumn("position", order).orderBy("position")


def channel_mix(txn: DataFrame, channel: str = "type") -> DataFrame:
    """Rows per channel and their percentage of all rows, to one decimal."""
    g = txn.groupBy(channel).agg(F.count(F.lit(1)).alias("n"))
    total = txn.agg(F.count(F.lit(1)).alias("_t"))
    return g.join(F.broadcast(total)).select(  # one row
        F.col(channel).alias("channel"), "n", F.round(F.col("n") * 100 / F.col("_t"), 1).alias("percent"))


def entity_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One count per table."""
    frames = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("entity"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, frames)
