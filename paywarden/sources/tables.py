"""Tables on storage: month-partitioned predictions, training sets, snapshots, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import REGISTRY


def month_of(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM")


def _by_month(df: DataFrame) -> DataFrame:
    """Rows of a (domain, month) together; the adaptive planner splits a large partition into files
    of its advisory size and merges small ones."""
    return df.withColumn("month", month_of(F.col("created_us"))).hint("rebalance", "domain", "month")


def write_predictions(df: DataFrame, path: str, mode: str = "append") -> None:
    """Append to a table partitioned by domain and month; files are ordered by time."""
    _by_month(df).sortWithinPartitions("domain", "month", "created_us").write.mode(mode).partitionBy("domain", "month").parquet(path)


def replace_partitions(df: DataFrame, path: str) -> None:
    """Rewrite only the (domain, month) partitions present in ``df``; it must not read from ``path``."""
    _by_month(df).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("domain", "month").parquet(path)


def read_predictions(spark: SparkSession, path: str, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Predictions of [start, end); the month predicate prunes partitions before any file is opened."""
    df = spark.read.parquet(path)
    if start_us is not None:
        df = df.filter((F.col("created_us") >= start_us) & (F.col("month") >= month_of(F.lit(start_us))))
    if end_us is not None:
        df = df.filter((F.col("created_us") < end_us) & (F.col("month") <= month_of(F.lit(end_us))))
    return df


def snapshot_hash(df: DataFrame, domain: str) -> DataFrame:
    """JSON of the vector, keys in order, and the first 32 hex digits of its SHA-256."""
    body = F.to_json(F.struct(*sorted(REGISTRY[domain])), {"ignoreNullFields": "false"})
    return df.withColumn("feature_data", body).withColumn("feature_hash", F.substring(F.sha2("feature_data", 256), 1, 32))


def load_training(spark: SparkSession, path: str, domain: str, target: str) -> DataFrame:
    """Only the registry's columns and the target are read."""
    return spark.read.parquet(path).select(*REGISTRY[domain], target)


def fingerprint(df: DataFrame) -> DataFrame:
    """Content hash that does not depend on row order or partitioning: row count and the sums of two
    independent 60-bit slices of every row's MD5."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)]
    h = F.md5(F.concat_ws("\x1f", *cols))
    def part(at: int) -> Column:
        return F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")
    a = df.select(part(1).alias("a"), part(17).alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    text = F.concat_ws(":", F.col("n").cast("string"), F.coalesce(F.col("a"), F.lit(0)).cast("string"), F.coalesce(F.col("b"), F.lit(0)).cast("string"))
    return a.select(F.col("n").alias("rows"), F.md5(text).alias("fingerprint"))


def export_sink(df: DataFrame, path: str, export_type: str, fmt: str, start_us: int, end_us: int) -> DataFrame:
    """Write an extract as CSV (lists as JSON text) or JSON and return its manifest row.

    The extract is written in parts by all tasks; the manifest's hash covers the rows and not the
    file boundaries. Both read ``df``, so hand in a stored table or a checkpoint.
    """
    out = df
    if fmt == "CSV":
        lists = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
        out = df.select(*[F.to_json(c).alias(c) if c in lists else F.col(c) for c in df.columns])
        out.write.mode("overwrite").option("header", "true").csv(path)
    elif fmt == "JSON":
        out.write.mode("overwrite").json(path)
    else:
        raise ValueError("fmt must be CSV or JSON")
    plain = df.select(*[F.to_json(c).alias(c) if f.dataType.typeName() in ("array", "struct", "map") else F.col(c) for c, f in zip(df.columns, df.schema.fields)])
    f = fingerprint(plain)
    return f.select(F.lit(export_type).alias("export_type"), F.lit(fmt).alias("format"), F.col("rows").alias("record_count"), F.lit(start_us).cast("long").alias("range_start"),
                    F.lit(end_us).cast("long").alias("range_end"), F.lit(path).alias("path"), F.sha2("fingerprint", 256).alias("content_hash"))
