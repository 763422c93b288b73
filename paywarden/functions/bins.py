"""Histogram bins and value-ordered prefix sums."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def histogram_bin(v: Column, lo: Column, hi: Column, bins: Column) -> Column:
    """Index of the equal-width bin; edges are ``lo + i * step``, the last bin includes ``hi``, and
    a value outside gives null."""
    step = (hi - lo) / bins
    i = F.least(F.floor((v - lo) * bins / (hi - lo)), bins - 1)
    i = F.when(v < lo + i * step, i - 1).when((i < bins - 1) & (v >= lo + (i + 1) * step), i + 1).otherwise(i)
    return F.when((v >= lo) & (v <= hi), i.cast("long"))


def value_slices(df: DataFrame, columns: list[str], parts: int = 64) -> dict[str, list[float]]:
    """Per column the inner cut points of about equally filled value ranges (a few numbers each)."""
    probs = [i / parts for i in range(1, parts)]
    cuts = df.approxQuantile(columns, probs, 0.25 / parts)
    return {c: sorted(set(q)) for c, q in zip(columns, cuts)}


#: Rows of a value range that one task may order.
MOST = 1_000_000


def sliced_by_value(df: DataFrame, column: str, cuts: list[float], out: str = "_vslice", rows: int | None = None, most: int = MOST) -> DataFrame:
    """Number of the value range a row falls into; ranges keep the order of the values.

    A range of more than ``most`` rows is cut again, at quantiles of its own that are found for all such ranges in one
    aggregate, so that their number follows the rows. ``rows``: how many there are, if known; few rows need no second look.
    """
    edges = [-float("inf"), *cuts, float("inf")]
    sliced = Bucketizer(splits=edges, inputCol=column, outputCol=out, handleInvalid="keep").transform(df) if cuts else df.withColumn(out, F.lit(0.0))
    if rows is not None and rows <= most:
        return sliced
    large = sliced.groupBy(out).agg(F.count(column).alias("n")).filter(F.col("n") > most)
    largest = large.agg(F.max("n")).first()[0]
    if largest is None:
        return sliced
    parts = 2 * -(-largest // most)
    probs = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    finer = sliced.join(F.broadcast(large.select(out)), out, "left_semi").groupBy(out).agg(F.array_distinct(F.percentile_approx(column, probs, F.lit(8 * parts))).alias("_finer"))
    joined = sliced.join(F.broadcast(finer), out, "left")  # a row of ``parts`` numbers for each large range
    below = F.size(F.filter(F.coalesce("_finer", F.array().cast("array<double>")), lambda c: c < F.col(column)))
    return joined.withColumn(out, F.col(out) + below / float(parts + 1)).select(*df.columns, out)
