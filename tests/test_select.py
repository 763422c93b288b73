"""Exact order statistics and draws."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paywarden.functions.select import at_ranks, medians
from paywarden.operators import training


@pytest.mark.parametrize("few", [10_000, 3])
def test_ranks_and_medians_of_many_groups(spark, few):
    rng = random.Random(1)
    groups = {"skew": [rng.expovariate(1) ** 9 for _ in range(801)], "ties": [1.0] * 500 + [2.0] * 300, "wide": [-1.7e308, 1.7e308] + [rng.gauss(0, 1) for _ in range(98)], "one": [5.0], "two": [1.0, 4.0], "tiny": [5e-324 * k for k in range(50)]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").repartition(5)
    wanted = {g: sorted({0, len(v) // 3, len(v) - 1}) for g, v in groups.items()}
    got = at_ranks(df, "g", "v", wanted, few)
    assert got == {g: [sorted(groups[g])[r] for r in ranks] for g, ranks in wanted.items()}
    middle = medians(df.where("g <> 'wide'"), "g", "v", {g: len(v) for g, v in groups.items() if g != "wide"})
    assert middle == pytest.approx({g: float(np.median(v)) for g, v in groups.items() if g != "wide"})
    assert at_ranks(df, "g", "v", {"none": [0], "one": [3]}) == {"none": [None], "one": [None]}


@pytest.mark.parametrize("n", [100, 900, 6000])
def test_samples_are_the_least_hashes_at_every_size(spark, n):
    """One rule for small and large tables, whatever the partitioning."""
    df = spark.range(n).select("id", F.array(F.col("id").cast("double")).alias("x"))
    one = training.draw_samples(df.repartition(1), "id", 7, 256)
    many = training.draw_samples(df.repartition(6), "id", 7, 256)
    a, b = (sorted((r["tree"], r["id"], r["h"]) for r in s.collect()) for s in (one, many))
    assert a == b
    h = df.select("id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("tree")).withColumn("h", training._unit(F.col("id"), F.col("tree"), F.lit("order"))).collect()
    for t in range(7):
        assert sorted((r["h"], r["id"]) for r in h if r["tree"] == t)[:256] == sorted((x[2], x[1]) for x in a if x[0] == t)


@pytest.mark.parametrize("share", [0.05, 0.13])
def test_flagged_share_is_exact(spark, share):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=3).tolist(), 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int").repartition(4)
    _, offset, out = training.isolation_forest(df, "id", "long", share, 20)
    raw = sorted(r["raw"] for r in out.collect())
    assert offset == raw[round(share * 1000) - 1]
    assert out.where("flagged = 1").count() == sum(v <= offset for v in raw)


def test_upserts_are_idempotent_and_touch_their_months_only(spark, tmp_path):
    from paywarden.functions.constants import DAY
    from paywarden.sources import store

    schema = "id long, created_us long, v string"
    path = str(tmp_path / "t")

    def put(rows, batch):
        store.upsert(spark.createDataFrame(rows, schema), path, ["id"], batch)

    def have(before=None):
        return sorted((tuple(r) for r in store.read(spark, path, schema, before).collect()), key=str)

    assert have() == []
    first = [(1, 0, "a"), (2, DAY, "b"), (3, 40 * DAY, "c"), (None, 41 * DAY, "n")]
    put(first, 1)
    assert have() == sorted(first, key=str)
    second = [(2, DAY, "B"), (4, 2 * DAY, "d")]
    for _ in range(2):  # run again after a failure
        put(second, 2)
        assert have() == sorted([(1, 0, "a"), *second, *first[2:]], key=str)
    assert have(before=2) == sorted(first, key=str)
    put([(None, 41 * DAY, "N")], 3)
    assert have() == sorted([(1, 0, "a"), *second, first[2], (None, 41 * DAY, "N")], key=str)
    assert {p.name for p in (tmp_path / "t" / "data").glob("batch=*/month=*")} == {"month=1970-01", "month=1970-02"}
    assert len(list((tmp_path / "t" / "data").glob("batch=*/month=1970-01"))) == 2
    put([], 4)
    assert len(have()) == 5


def test_value_ranges_follow_the_rows(spark):
    """Skewed values with ties: no range is too large but one that is a single value, and their order is that of the values."""
    from paywarden.functions.bins import sliced_by_value, value_slices

    rng = random.Random(7)
    values = [rng.expovariate(1) ** 6 for _ in range(5000)] + [1.5] * 900 + [1000.0 + rng.random() for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    cuts = value_slices(df, ["v"], 8)["v"]
    few, fine = (sorted((r["_vslice"], r["v"]) for r in sliced_by_value(df, "v", cuts, most=m).collect()) for m in (10_000, 200))
    for rows in (few, fine):
        assert [v for _, v in rows] == sorted(values)
    assert len({s for s, _ in few}) == 8 < len({s for s, _ in fine})
    held = {}
    for s, v in fine:
        held.setdefault(s, []).append(v)
    assert all(len(set(vs)) <= 300 for vs in held.values())
    assert sliced_by_value(df, "v", [], rows=10).select("_vslice").distinct().count() == 1
