"""Lookups as of a transaction's own time, keyed state of the scored stream, and screening by segments."""

import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paywarden.functions.constants import DAY, HOUR
from paywarden.operators import asof, screening, vector
from paywarden.plans import asof_queries as plans
from paywarden.sources.views import T0, Views
from paywarden.streaming import counters, scoring

FOLDER = "/root/testdata/sf0.001"


def test_newest_and_totals_equal_plain_scan(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(0, 6 * DAY, HOUR // 2)) for i in range(300)]
    updates = [(rng.choice("ab"), rng.randrange(0, 4 * DAY, HOUR // 2), rng.randrange(100)) for _ in range(80)]
    r = spark.createDataFrame(rows, "txn_id long, k string, us long")
    u = spark.createDataFrame(updates, "k string, us long, v long")
    got = {x["txn_id"]: x["v"] for x in asof.newest(r, u, ["k"], "us", ["v"]).collect()}
    sums = {x["txn_id"]: x["v"] for x in asof.totals(r, u, ["k"], "us", ["v"]).collect()}
    for i, k, us in rows:
        past = [(t, v) for q, t, v in updates if q == k and t < us]
        assert got[i] == (max(past)[1] if past else None)
        assert sums[i] == sum(v for _, v in past)


@pytest.mark.parametrize("domain", ["fraud", "merchant", "graph"])
def test_later_rows_change_no_vector(spark, domain):
    v = Views(spark, FOLDER)
    middle = v.dense.approxQuantile("us", [0.5], 0.0)[0]

    def made(t):
        late = t is v.dense
        known = plans.arrivals(v).filter(F.lit(late) | (F.col("us") < middle))
        if domain == "fraud":
            return vector.fraud_vector(t, v.auth_failures, v.accounts, v.confirmed_frauds, None, arrivals=known)
        if domain == "merchant":
            scores = plans.scores(v).filter(F.lit(late) | (F.col("us") < middle))
            return asof.merchant_ratios(t, known, scores).select("txn_id", "us", "fraud_transaction_rate", "high_risk_customer_ratio", "cross_border_ratio", "avg_customer_risk_score")
        snaps = spark.createDataFrame([(u, T0 + k * HOUR, u / 100, k % 2, k) for u in range(1, 120) for k in (2, 9, 15, 25)], "user_id long, us long, network_risk_score double, circular_transfer_flag int, shared_device_cluster_size long")
        return asof.user_graph(t.select("txn_id", "user_id", "us"), snaps if late else snaps.filter(F.col("us") < middle))

    whole, part = made(v.dense).filter(F.col("us") <= middle).toPandas(), made(v.dense.filter(F.col("us") <= middle)).toPandas()
    assert len(part) > 100
    pd.testing.assert_frame_equal(*(x.sort_values("txn_id", ignore_index=True)[sorted(x.columns)] for x in (whole, part)))


def test_state_from_before_the_stream(spark, tmp_path):
    """Half of the transactions give the first state, the rest arrive in three micro-batches with ties, a null device and a null customer."""
    from test_streams import _refs

    v = Views(spark, FOLDER)
    cols = [c.split()[0] for c in counters.TXN.split(", ")]
    t = v.dense.select(cols).withColumn("us", F.col("us") - F.pmod("us", F.lit(HOUR // 4)))  # many of one instant
    t = t.withColumn("device", F.when(F.pmod("txn_id", F.lit(7)) > 0, F.col("device"))).withColumn("lat", F.when(F.pmod("txn_id", F.lit(5)) > 0, F.col("lat")))
    t = spark.createDataFrame(t.toPandas(), t.schema)
    a, b, c = (T0 + k * HOUR for k in (10, 16, 22))
    for lo, hi in ((a, b), (b, c), (c, T0 + 90 * DAY)):
        t.filter((F.col("us") >= lo) & (F.col("us") < hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    scoring.score_stream(stream, _refs(v), str(tmp_path / "out"), str(tmp_path / "ck"), past=t.filter(F.col("us") < a)).trigger(availableNow=True).start().awaitTermination()
    keep = ["domain", "txn_id", "score", "decision", "level"]
    got = spark.read.parquet(str(tmp_path / "out" / "results")).select(keep).toPandas()
    want = scoring.score_all(t, _refs(v)).join(t.filter(F.col("us") >= a).select("txn_id"), "txn_id").select(keep).toPandas()
    pd.testing.assert_frame_equal(*(x.sort_values(keep[:2], ignore_index=True) for x in (got, want)))
    assert len(got) > 300


def _names(rng, n):
    parts = ["an", "bel", "chi", "dor", "el", "fa", "gus", "hor", "ila", "jo", "ka", "lem", "mar", "nu", "ov", "pet", "qui", "ros", "sta", "tur", "ud", "vik", "wen", "xi", "yo", "zar"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(2, 4))).title() + " " + "".join(rng.choice(parts) for _ in range(rng.randint(2, 4))).title() for _ in range(n)]


def test_fuzzy_of_many_names_equals_brute_force(spark):
    rng = random.Random(9)
    listed = _names(rng, 300) + ["A" * 90, "Al", "Zed"]

    def typo(s):
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(s))
            s = rng.choice([s[:i] + s[i + 1:], s[:i] + rng.choice("abcxyz ") + s[i:], s[:i] + rng.choice("abcxyz") + s[i + 1:]]) or s
        return s

    asked = sorted({typo(rng.choice(listed)) for _ in range(1200)} | set(_names(rng, 800)) | {"A" * 80, "zed", ""})
    p = spark.createDataFrame([(n,) for n in asked], "name string").repartition(4)
    e = spark.createDataFrame([(i, n, "L") for i, n in enumerate(listed)], "ordinal long, name string, source string")
    got = {r["lname"]: (r["entity"], r["confidence"]) for r in screening.fuzzy(p, e).collect()}
    found = 0
    for n in {a.lower() for a in asked}:
        want = None
        for m in listed:
            s = SequenceMatcher(None, n, m.lower())
            if n and s.real_quick_ratio() >= 0.85 and s.quick_ratio() >= 0.85 and s.ratio() >= 0.85:
                want = (m, pytest.approx(s.ratio(), abs=1e-4))
                break
        assert got.get(n) == want
        found += want is not None
    assert found > 500


def test_common_subsequence_bounds_every_ratio():
    rng = random.Random(2)
    a = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 70))) for _ in range(300)]
    b = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 70))) for _ in range(300)]

    def plain(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            last = 0
            for j, d in enumerate(y):
                row[j + 1], last = (last + 1 if c == d else max(row[j + 1], row[j])), row[j + 1]
        return row[-1]

    got = screening.bounds(a, b)
    assert got.tolist() == [plain(x, y) for x, y in zip(a, b, strict=True)]
    assert all(2 * n / (len(x) + len(y)) >= SequenceMatcher(None, x, y).ratio() - 1e-9 for n, x, y in zip(got, a, b, strict=True))


def test_few_candidates_for_each_name(spark):
    """Beside 100,000 listed names a name meets few of them."""
    rng = random.Random(3)
    listed = list(dict.fromkeys(n.lower() for n in _names(rng, 100_000)))
    entries = spark.createDataFrame([(i, n) for i, n in enumerate(listed)], "ordinal long, lentity string").repartition(8)
    names = spark.createDataFrame([(n,) for n in rng.sample(listed, 30)], "lname string")
    pairs = screening.candidate_pairs(names, entries).distinct().toPandas()
    size = pairs["lname"].str.len() + pairs["lentity"].str.len()
    left = pairs[2 * screening.bounds(pairs["lname"].tolist(), pairs["lentity"].tolist()) >= screening.FUZZY_THRESHOLD * size]
    assert left["lname"].nunique() == 30 and len(pairs) < 0.12 * 30 * len(listed) and len(left) < 30 * 300
