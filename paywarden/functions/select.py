"""Exact order statistics of large groups, without ordering them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts a range is cut into in one pass, and rows of a range that may be ordered.
PARTS, FEW = 512, 10_000


def at_ranks(df: DataFrame, group: str, value: str, wanted: dict, few: int = FEW) -> dict:
    """The values at the given ranks (0 for the least) of each group: {group: [value, ...]}.

    Ranges that hold a rank are cut into equal parts and counted, for all groups and ranks in one pass, until a range is one
    value or short enough to be ordered. What comes to the driver is a range for each rank and its counts: ``group`` has few
    values (features, trees, domains). ``df`` has no nulls or NaNs in ``value``.
    """
    spark, found = df.sparkSession, {}
    kind = df.schema[group].dataType.simpleString()
    rows = df.select(F.col(group).alias("_g"), F.col(value).cast("double").alias("_v"))
    ends = {r["_g"]: r for r in rows.groupBy("_g").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n")).collect()}
    open_ = [(g, r, ends[g]["lo"], ends[g]["hi"], r, ends[g]["n"]) for g, ranks in wanted.items() for r in set(ranks) if g in ends and 0 <= r < ends[g]["n"]]
    short = []
    while open_:
        for s in open_:
            if s[2] == s[3]:
                found[s[0], s[1]] = s[2]
            elif s[5] <= few:
                short.append(s)
        open_ = [s for s in open_ if s[2] < s[3] and s[5] > few]
        if not open_:
            break
        state = F.broadcast(spark.createDataFrame([(*s[:4],) for s in open_], f"_g {kind}, _r long, _lo double, _hi double"))  # one row for each rank
        inside = rows.join(state, "_g").where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        # halves first: a range of all doubles is wider than any double
        part = F.least(F.floor((F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * PARTS), F.lit(PARTS - 1))
        counts: dict = {}
        for r in inside.groupBy("_g", "_r", part.alias("p")).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi")).collect():
            counts.setdefault((r["_g"], r["_r"]), []).append(r)
        after = []
        for g, rank, _, _, left, _ in open_:
            for r in sorted(counts[g, rank], key=lambda r: r["p"]):
                if left < r["n"]:
                    after.append((g, rank, r["lo"], r["hi"], left, r["n"]))
                    break
                left -= r["n"]
        open_ = after
    if short:
        state = F.broadcast(spark.createDataFrame([(*s[:5],) for s in short], f"_g {kind}, _r long, _lo double, _hi double, _left long"))
        order = Window.partitionBy("_g", "_r").orderBy("_v")  # few rows each
        inside = rows.join(state, "_g").where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))).withColumn("_n", F.row_number().over(order) - 1)
        found |= {(r["_g"], r["_r"]): r["_v"] for r in inside.where("_n = _left").select("_g", "_r", "_v").collect()}
    return {g: [found.get((g, r)) for r in ranks] for g, ranks in wanted.items()}


def medians(df: DataFrame, group: str, value: str, counts: dict) -> dict:
    """Median of each group, the mean of the middle two for even numbers of rows. ``counts``: rows of each group."""
    got = at_ranks(df, group, value, {g: [(n - 1) // 2, n // 2] for g, n in counts.items() if n})
    return {g: a + (b - a) / 2 for g, (a, b) in got.items()}


def lookup_constant(values: dict, key: Column) -> Column:
    """The value of a few keys as an expression."""
    out = F.lit(None).cast("double")
    for k, v in values.items():
        out = F.when(key == k, F.lit(float(v))).otherwise(out)
    return out
