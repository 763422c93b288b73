"""Join and top-n shapes shared by the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 8


def lookup(facts: DataFrame, dim: DataFrame, on: dict[str, str], spread_by: list[str], salts: int = SALTS) -> DataFrame:
    """Left join to a table with one row per key, with facts of a hot key spread over ``salts``.

    ``on`` maps fact column to dim key column; ``spread_by`` are fact columns that vary inside a
    key. The dim is copied ``salts`` times instead. Whether the dim is broadcast stays with the
    adaptive planner, which knows its real size.
    """
    salted = facts.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    kept = [c for c in dim.columns if c not in on.values()]
    copies = dim.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(on.values())], *[F.col(c).alias(f"_v{i}") for i, c in enumerate(kept)],
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"))
    cond = reduce(lambda a, b: a & b, [F.col(f) == F.col(f"_k{i}") for i, f in enumerate(on)], F.col("_salt") == F.col("_s"))
    return salted.join(copies, cond, "left").select(*facts.columns, *[F.col(f"_v{i}").alias(c) for i, c in enumerate(kept)])


def newest(df: DataFrame, keys: list[str], by: list[Column | str]) -> DataFrame:
    """Newest row per key as an aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r"))
    return picked.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


#: Equal parts a range is cut into while the n-th row is looked for, and rows that one task may order.
PARTS, FEW = 256, 10_000


def top_n(df: DataFrame, n: int | None, *order: Column) -> DataFrame:
    """The ``n`` rows with the highest numeric ``order`` columns; ``n`` of None keeps all.

    Nothing is ordered but the few rows around the cut: the range of the first column is cut into
    equal parts, rows are counted per part, parts above the n-th row are kept whole and the part it
    falls in is cut again; rows that are equal in a column go on by the next one.
    """
    if n is None:
        return df
    keep, at = F.lit(False), F.lit(True)
    for o in order:
        v = o.cast("double")
        while True:
            s = df.filter(at).agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(F.lit(1)).alias("n"), F.count(v).alias("known")).first()
            if s["n"] <= n:
                return df.filter(keep | at)
            if n <= 0:
                return df.filter(keep)
            if s["n"] <= FEW:
                last = df.filter(at).orderBy(*[x.desc() for x in order]).limit(n)
                return df.filter(keep).unionByName(last)
            if s["known"] < s["n"] and s["known"] > 0:  # nulls come last
                if s["known"] >= n:
                    at = at & v.isNotNull()
                else:
                    keep, at, n = keep | (at & v.isNotNull()), at & v.isNull(), n - s["known"]
                continue
            if s["lo"] is None or s["lo"] == s["hi"]:
                break
            width = (s["hi"] - s["lo"]) / PARTS
            part = F.least(F.floor((v - s["lo"]) / width), F.lit(PARTS - 1))
            counts = sorted(df.filter(at).groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("c"), F.min(v).alias("lo")).collect(), key=lambda r: -r["p"])  # PARTS rows
            for r in counts:
                if r["c"] >= n:
                    break
                n -= r["c"]
            keep, at = keep | (at & (part > r["p"])), at & (part == r["p"])
    last = df.filter(at).orderBy(*[x.desc() for x in order]).limit(n)
    return df.filter(keep).unionByName(last)


def latest_n(df: DataFrame, n: int | None, time: str, *ties: Column) -> DataFrame:
    """The ``n`` newest rows by ``time``, then by the highest ``ties``."""
    return top_n(df, n, F.col(time), *ties)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: Column | int, name: str = "rank") -> DataFrame:
    """Rows ranked 1..n per group (a partial limit runs before the shuffle: ``n`` is a small number)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= n)
