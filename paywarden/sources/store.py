"""Tables that are written back: upserts into month partitions under numbered batches.

``path/data`` holds partitions by batch and month, ``path/current`` says which batch wrote a month last. A batch rewrites the
months it touches, each from the version before it, and names them as its own in the end; readers see a batch only once it
is named. Running a batch again starts from the same versions and overwrites its own files, so it leaves the same table.
Nothing is renamed or deleted, so it works on object stores; months not touched are not read.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import month_of


def _versions(spark: SparkSession, path: str, before: int | None) -> list[tuple[str, int]]:
    """(month, batch that wrote it last); a row for each month."""
    try:
        named = spark.read.schema("month string, batch long").parquet(f"{path}/current")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    named = named if before is None else named.filter(F.col("batch") < before)
    return sorted((r["month"], r["batch"]) for r in named.groupBy("month").agg(F.max("batch").alias("batch")).collect())


def _at(versions: list[tuple[str, int]]) -> Column:
    cond = F.lit(False)
    for month, batch in versions:
        cond = cond | ((F.col("month") == month) & (F.col("batch") == batch))
    return cond


def read(spark: SparkSession, path: str, schema: str, before: int | None = None, months: list[str] | None = None) -> DataFrame:
    """The table (as it was ``before`` a batch); partitions of other versions are pruned. No table yet: no rows."""
    versions = [v for v in _versions(spark, path, before) if months is None or v[0] in months]
    if not versions:
        return spark.createDataFrame([], schema)
    stored = spark.read.schema(f"{schema}, batch long, month string").parquet(f"{path}/data")
    return stored.filter(_at(versions)).drop("batch", "month")


def upsert(rows: DataFrame, path: str, keys: list[str], batch: int, time: str = "created_us") -> None:
    """Rows replace those of equal keys in their month, or are added. ``rows`` has one row for each key."""
    spark, cols = rows.sparkSession, rows.columns
    new = rows.withColumn("month", month_of(F.col(time)))
    months = sorted(r["month"] for r in new.select("month").distinct().collect())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    old = read(spark, path, schema, batch, months)
    match = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    kept = old.alias("o").join(new.select(*keys).alias("n"), match, "left_anti").select(*cols).withColumn("month", month_of(F.col(time)))
    merged = kept.unionByName(new).hint("rebalance", "month")
    # a month's rows lie under this batch's number: written again, they replace themselves
    merged.write.mode("overwrite").partitionBy("month").parquet(f"{path}/data/batch={batch}")
    spark.createDataFrame([(m, batch) for m in months], "month string, batch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/current/of={batch}")
