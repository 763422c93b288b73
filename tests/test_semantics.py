"""Small hand-made and random cases, checked against plain Python."""

import math
import random
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from paywarden.functions import constants as K
from paywarden.functions import timeline as tl
from paywarden.functions.bins import histogram_bin
from paywarden.functions.joins import lookup, top_n
from paywarden.operators import adwin, decisions, drift, governance, graph, maturity, profiles, pseudo, screening, training, vector, velocity
from paywarden.operators.scoring import model_confidence

HOUR, DAY = K.HOUR, K.DAY


def _events(seed, n=400, keys=3, span=5 * DAY, hot=0.7):
    """Random rows; one key owns most of them, and times repeat."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        k = 1 if r.random() < hot else r.randint(2, keys)
        out.append((i, k, r.randrange(0, span, 7 * 60_000_000), r.randint(1, 10_000), r.choice(["a", "b", "c", None])))
    return out


SCHEMA = "txn_id long, user_id long, us long, cents long, device string"


# ---- timelines --------------------------------------------------------------------
@pytest.mark.parametrize("seed,slice_us", [(1, HOUR), (2, 3 * HOUR), (3, 400 * DAY)])
def test_session_counters_follow_an_expiring_counter(spark, seed, slice_us):
    rows = _events(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    moves = F.col("device").isNotNull()
    got = {r["txn_id"]: (r["count_1h"], r["sum_1h"], r["count_24h"], r["sum_24h"]) for r in tl.session_counters(
        df, ["user_id"], "us", "txn_id", "cents", {"1h": HOUR, "24h": DAY}, moves=moves, slice_us=slice_us).collect()}
    state = {}
    for i, k, us, c, d in sorted(rows, key=lambda x: (x[2], x[0])):
        want = []
        for ttl in (HOUR, DAY):
            n, s, last = state.get((k, ttl), (0, 0, None))
            if last is None or us - last >= ttl:
                n, s = 0, 0
            want += [n, s]
            if d is not None:
                state[(k, ttl)] = (n + 1, s + c, us)
        assert got[i] == tuple(want), (i, k, us)


@pytest.mark.parametrize("seed,slice_us", [(4, HOUR), (5, 5 * HOUR), (6, 400 * DAY)])
def test_trailing_and_distinct_equal_brute_force(spark, seed, slice_us):
    rows = _events(seed, 250)
    df = spark.createDataFrame(rows, SCHEMA)
    flagged = tl.presence(df, ["user_id"], "device", "us", "txn_id", DAY, "_d", slice_us)
    one = F.lit(1).cast("long")
    t = tl.trailing(flagged, ["user_id"], "us", {"n": (HOUR, one, one), "s": (DAY, F.col("cents"), F.col("cents")), "u": (DAY, F.col("_d_in"), F.col("_d_out"))}, slice_us)
    got = {r["txn_id"]: (r["n"], r["s"], r["u"]) for r in t.collect()}
    for i, k, us, _, _ in rows:
        def before(w):
            return [x for x in rows if x[1] == k and us - w <= x[2] < us]  # noqa: B023
        day = before(DAY)
        assert got[i] == (len(before(HOUR)), sum(x[3] for x in day), len({x[4] for x in day if x[4] is not None}))


@pytest.mark.parametrize("slice_us", [HOUR, 400 * DAY])
def test_neighbours_both_ways(spark, slice_us):
    rows = _events(7)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r["txn_id"]: (r["p"], r["n"]) for r in tl.neighbours(df, ["user_id"], "us", "txn_id", {"p": "txn_id"}, {"n": "txn_id"}, slice_us).collect()}
    for k in (1, 2, 3):
        line = [x[0] for x in sorted((x for x in rows if x[1] == k), key=lambda x: (x[2], x[0]))]
        for a, i in enumerate(line):
            assert got[i] == (line[a - 1] if a else None, line[a + 1] if a + 1 < len(line) else None)


def test_running_with_and_without_ties(spark):
    rows = _events(8, 200)
    df = spark.createDataFrame(rows, SCHEMA)
    sl = tl.slice_start(F.col("us"), 2 * HOUR)
    by_row = {r["txn_id"]: r["s"] for r in tl.running(df, ["user_id"], "us", {"s": F.col("cents")}, sl, tie="txn_id").collect()}
    by_time = {r["txn_id"]: r["s"] for r in tl.running(df, ["user_id"], "us", {"s": F.col("cents")}, sl).collect()}
    for i, k, us, _, _ in rows:
        assert by_row[i] == sum(x[3] for x in rows if x[1] == k and (x[2], x[0]) < (us, i))
        assert by_time[i] == sum(x[3] for x in rows if x[1] == k and x[2] < us)


def test_lookup_keeps_rows_and_leaves_unknown_null(spark):
    f = spark.createDataFrame([(i, i % 3 if i % 7 else None) for i in range(100)], "id long, k long")
    d = spark.createDataFrame([(0, "zero"), (1, "one")], "k long, name string")
    out = lookup(f, d, {"k": "k"}, ["id"]).collect()
    assert len(out) == 100
    assert all(r["name"] == {0: "zero", 1: "one"}.get(r["k"]) for r in out)


def test_top_n_is_exact(spark):
    rows = [(i, (i * 37) % 50) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v long")
    for n in (0, 23, 100, 500, 900):
        got = sorted(tuple(r) for r in top_n(df, n, F.col("v"), -F.col("id")).collect())
        assert got == sorted(sorted(rows, key=lambda x: (-x[1], x[0]))[:n])


def test_top_n_cuts_without_ordering(spark):
    """Half of many rows, a third of them equal, some null."""
    rows = spark.range(60_000).select("id", F.when(F.col("id") % 50 == 0, None).when(F.col("id") % 3 == 0, 7.5).otherwise(F.pmod(F.xxhash64("id"), F.lit(1000)) / 64).alias("v"))
    got = {r["id"] for r in top_n(rows, 30_000, F.col("v"), -F.col("id")).collect()}
    want = sorted(rows.collect(), key=lambda r: (r["v"] is None, -(r["v"] or 0), r["id"]))[:30_000]
    assert got == {r["id"] for r in want}
    assert top_n(rows, None, F.col("v")) is rows


# ---- features ------------------------------------------------------------------------
@pytest.mark.parametrize("a,b,low,high", [((0, 0), (0, 0), 0, 0), ((-1.2921, 36.8219), (-4.0435, 39.6682), 430, 460), ((0, 0), (0, 180), 20_000, 20_100)])
def test_haversine(spark, a, b, low, high):
    df = spark.createDataFrame([(float(a[0]), float(a[1]), float(b[0]), float(b[1]))], "a double, b double, c double, d double")
    km = df.select(velocity.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).first()[0]
    assert low <= km <= high


def test_geo_distance_ignores_unlocated_rows_and_old_places(spark):
    rows = [(1, 1, 0, 0.0, 0.0), (2, 1, HOUR, None, None), (3, 1, 2 * HOUR, 0.0, 1.0), (4, 1, 3 * DAY, 0.0, 2.0)]
    df = spark.createDataFrame(rows, "txn_id long, user_id long, us long, lat double, lng double")
    got = {r["txn_id"]: r["geo_distance_from_last_tx"] for r in velocity.with_geo_distance(df).collect()}
    assert got[1] == got[2] == got[4] == 0.0 and 110 < got[3] < 112


def test_blend_prior(spark):
    df = spark.createDataFrame([(0, 5.0), (10, 5.0), (-1, 5.0)], "n int, v double")
    got = [r[0] for r in df.select(vector.blend_prior(F.lit(1.0), F.col("v"), F.col("n"))).collect()]
    assert got == [1.0, 3.0, 1.0]


def test_population_priors_mode_and_small_features(spark):
    values = [1.0] * 7 + [2.0, 3.0, 11.0]
    feats = K.FRAUD_FEATURES
    rows = [(i, i, *[v if j == 0 else (5.0 if j == 1 else (1.0 if j == 2 and i < 4 else None)) for j in range(len(feats))]) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "txn_id long, us long, " + ", ".join(f"{f} double" for f in feats))
    got = {r["feature"]: r for r in vector.population_priors(df, "fraud").collect()}
    counts, edges = np.histogram(values, bins=min(50, len(values) // 2 + 1))
    m = int(np.argmax(counts))
    assert got[feats[0]]["mode"] == pytest.approx((edges[m] + edges[m + 1]) / 2, abs=1e-4)
    assert got[feats[0]]["std"] == pytest.approx(np.std(values), abs=1e-4) and got[feats[0]]["n"] == 10
    assert feats[2] not in got and feats[1] in got


def test_account_age(spark):
    df = spark.createDataFrame([(0, 3 * DAY + 5), (None, DAY)], "c long, t long")
    got = [r[0] for r in df.select(profiles.age_days(F.col("c"), F.col("t"), 365.0)).collect()]
    assert got == [3.0, 365.0]


# ---- decisions --------------------------------------------------------------------------
FRAUD_FLAGS = ["sanctioned_country", "blacklisted_device", "blacklisted_ip", "blacklisted_user", "velocity_anomaly", "new_account_high_amount"]
AML_FLAGS = ["sanctions_match", "watchlist_hit", "blacklisted_user", "blacklisted_device", "structuring_detected", "velocity_spike"]


def _decide(spark, fn, names, score, raised, conf, mat):
    df = spark.createDataFrame([(float(score), float(conf), mat, *[n in raised for n in names])], "s double, c double, m string, " + ", ".join(f"{n} boolean" for n in names))
    r = df.select(fn(F.col("s"), {n: F.col(n) for n in names}, F.col("c"), F.col("m")).alias("v")).first()["v"]
    return r["decision"], r["level"], r["overrides"]


@pytest.mark.parametrize("score,raised,want", [
    (0.3, [], ("APPROVE", "LOW", [])), (0.55, [], ("APPROVE", "LOW", [])), (0.78, [], ("REVIEW", "MEDIUM", [])), (0.82, [], ("REVIEW", "HIGH", [])),
    (0.95, [], ("BLOCK", "CRITICAL", [])), (0.90, [], ("BLOCK", "CRITICAL", [])), (0.05, ["sanctioned_country"], ("BLOCK", "CRITICAL", ["SANCTIONED_COUNTRY"])),
    (0.1, ["blacklisted_device", "blacklisted_user"], ("BLOCK", "CRITICAL", ["BLACKLISTED_DEVICE"])), (0.1, ["blacklisted_ip"], ("BLOCK", "CRITICAL", ["BLACKLISTED_IP"])),
    (0.3, ["velocity_anomaly"], ("REVIEW", "MEDIUM", ["VELOCITY_ANOMALY"])), (0.3, ["new_account_high_amount"], ("REVIEW", "MEDIUM", ["NEW_ACCOUNT_HIGH_AMOUNT"])),
    (0.85, ["velocity_anomaly", "new_account_high_amount"], ("REVIEW", "HIGH", ["VELOCITY_ANOMALY", "NEW_ACCOUNT_HIGH_AMOUNT"])),
])
def test_fraud_decisions(spark, score, raised, want):
    assert _decide(spark, decisions.fraud_decide, FRAUD_FLAGS, score, raised, 1.0, "HOT") == want


def test_fraud_low_confidence_is_stricter(spark):
    assert _decide(spark, decisions.fraud_decide, FRAUD_FLAGS, 0.82, [], 0.1, "COLD")[0] == "BLOCK"
    assert _decide(spark, decisions.fraud_decide, FRAUD_FLAGS, 0.40, [], 0.1, "COLD") == ("MONITOR", "LOW", ["LOW_CONFIDENCE_MONITOR"])


@pytest.mark.parametrize("score,raised,want", [
    (0.3, [], ("APPROVE", "LOW", [])), (0.55, [], ("MONITOR", "MEDIUM", [])), (0.75, [], ("REVIEW", "HIGH", [])), (0.90, [], ("BLOCK", "CRITICAL", [])),
    (0.1, ["sanctions_match"], ("BLOCK", "CRITICAL", ["SANCTIONS_MATCH"])), (0.1, ["watchlist_hit", "blacklisted_user"], ("BLOCK", "CRITICAL", ["WATCHLIST_HIT"])),
    (0.3, ["structuring_detected"], ("REVIEW", "HIGH", ["STRUCTURING_DETECTED"])), (0.3, ["velocity_spike"], ("REVIEW", "MEDIUM", ["VELOCITY_SPIKE"])),
])
def test_aml_decisions(spark, score, raised, want):
    assert _decide(spark, decisions.aml_decide, AML_FLAGS, score, raised, 1.0, "HOT") == want


@pytest.mark.parametrize("score,cb,fr,spike,want", [
    (0.2, 0, 0, False, ("APPROVE", "STANDARD")), (0.5, 0, 0, False, ("MONITOR", "ENHANCED")), (0.7, 0, 0, False, ("REVIEW", "RESTRICTED")), (0.9, 0, 0, False, ("BLOCK", "BLOCKED")),
    (0.1, 0.12, 0, False, ("BLOCK", "BLOCKED")), (0.1, 0, 0.06, False, ("REVIEW", "RESTRICTED")), (0.1, 0, 0, True, ("REVIEW", "ENHANCED"))])
def test_merchant_decisions(spark, score, cb, fr, spike, want):
    df = spark.createDataFrame([(score, float(cb), float(fr), spike)], "s double, cb double, fr double, sp boolean")
    r = df.select(decisions.merchant_decide(F.col("s"), F.col("cb"), F.col("fr"), F.col("sp"), F.lit(1.0), F.lit("HOT")).alias("v")).first()["v"]
    assert (r["decision"], r["tier"]) == want


@pytest.mark.parametrize("n,cov,psi,want", [(50, 0.9, 0.0, "COLD"), (500, 0.6, 0.0, "COLD"), (500, 0.95, 0.0, "WARMING"), (5000, 0.95, 0.0, "WARM"), (20000, 0.95, 0.05, "HOT"), (20000, 0.95, 0.5, "WARM"), (20000, 0.95, None, "WARM")])
def test_maturity_levels(spark, n, cov, psi, want):
    df = spark.createDataFrame([(n, cov, psi)], "n long, c double, p double")
    assert df.select(maturity.maturity_level(F.col("n"), F.col("c"), F.col("p"))).first()[0] == want


def test_model_confidence(spark):
    got = spark.range(1).select(model_confidence(F.lit(0.5), F.lit(0.7), False)).first()[0]
    assert got == pytest.approx((0.5 * 0.7 * 0.7) ** (1 / 3))


# ---- screening -----------------------------------------------------------------------------
def test_fuzzy_equals_brute_force(spark):
    r = random.Random(3)
    base = ["Ivan Petrov", "Acme Trading Ltd", "Global Export Co", "Maria Gonzalez", "Zed", "Al"]
    def typo(s):
        i = r.randrange(len(s))
        return r.choice([s[:i] + s[i + 1:], s[:i] + r.choice("abcxyz ") + s[i:], s[:i] + r.choice("abcxyz") + s[i + 1:]])
    names = base + [typo(b) for b in base for _ in range(8)] + [typo(typo(b)) for b in base for _ in range(8)] + ["", "Nobody At All"]
    names = sorted({n for n in names})
    entities = [(i, n, "L") for i, n in enumerate(base + [typo(b) for b in base])]
    p = spark.createDataFrame([(n,) for n in names], "name string")
    e = spark.createDataFrame(entities, "ordinal long, name string, source string")
    got = {x["lname"]: (x["entity"], x["confidence"]) for x in screening.fuzzy(p, e).collect()}
    for n in names:
        want = next(((en, SequenceMatcher(None, n.lower(), en.lower()).ratio()) for _, en, _ in entities if n and SequenceMatcher(None, n.lower(), en.lower()).ratio() >= 0.85), None)
        if want is None:
            assert n.lower() not in got
        else:
            assert got[n.lower()][0] == want[0] and got[n.lower()][1] == pytest.approx(want[1], abs=1e-4)


# ---- drift and governance ---------------------------------------------------------------------
def _psi(a, b, bins=10, add=1.0):
    edges = np.linspace(0, 1, bins + 1)
    x, y = np.histogram(a, edges)[0] + add, np.histogram(b, edges)[0] + add
    x, y = x / x.sum(), y / y.sum()
    return float(((y - x) * np.log(y / x)).sum())


def test_psi_equals_numpy_and_is_zero_on_itself(spark):
    rng = np.random.default_rng(0)
    a, b = rng.beta(2, 5, 2000), np.concatenate([rng.uniform(0, 1, 1500), [0.3, 0.6, 0.7, 1.0, 0.0]])
    A, B = (spark.createDataFrame([(float(v),) for v in x], "score double") for x in (a, b))
    assert drift.score_psi(A, B).first()[0] == pytest.approx(_psi(a, b))
    assert drift.score_psi(A, A).first()[0] == pytest.approx(0.0, abs=1e-12)
    assert drift.score_psi(A.limit(0), B).first()[0] == 0.0
    assert governance.validation_psi(A, B).first()["psi"] == pytest.approx(_psi(a, b, add=1e-6))


def test_histogram_bins_equal_numpy(spark):
    values = [i / 20 for i in range(21)] + [0.3, 0.7, 0.29999999]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(histogram_bin(F.col("v"), F.lit(0.0), F.lit(1.0), F.lit(10))).collect()]
    want = [int(np.argmax(np.histogram([v], np.linspace(0, 1, 11))[0])) for v in values]
    assert got == want


def _wasserstein(a, b):
    v = np.sort(np.concatenate([a, b]))
    fa, fb = np.searchsorted(np.sort(a), v[:-1], side="right") / len(a), np.searchsorted(np.sort(b), v[:-1], side="right") / len(b)
    return float((np.abs(fa - fb) * np.diff(v)).sum())


def test_wasserstein_equals_numpy_and_measures_a_shift(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=700), rng.normal(0.4, 1.2, size=500)
    A, B, C = (spark.createDataFrame([(float(v),) for v in x], "score double") for x in (a, b, a + 2.0))
    assert drift.wasserstein(A, B).first()[0] == pytest.approx(_wasserstein(a, b))
    assert drift.wasserstein(B, A).first()[0] == pytest.approx(_wasserstein(a, b))
    assert drift.wasserstein(A, C).first()[0] == pytest.approx(2.0)


def test_auc_equals_pair_counting(spark):
    r = random.Random(5)
    rows = [(r.randint(0, 20) / 20, r.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "score double, y int")
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > q) + 0.5 * (p == q) for p in pos for q in neg) / len(pos) / len(neg)
    assert governance.roc_auc(df).first()["roc_auc"] == pytest.approx(want)


def test_parity_reference_is_most_common_group(spark):
    rows = [("a", 1, 1)] * 40 + [("a", 0, 0)] * 40 + [("b", 1, 1)] * 10 + [("b", 0, 0)] * 40 + [("c", 1, 1)] * 5
    df = spark.createDataFrame(rows, "g string, y int, pred int")
    r = governance.bias_report(df, ["g"]).first()
    assert r["reference_group"] == "a" and r["disparate_impact_ratio"] == pytest.approx(0.4) and r["passed"] == 0
    assert r["small_groups"] == 1 and [x["warning"] for x in governance.bias_warnings(df, ["g"]).collect()] == ["Group 'c' has only 5 samples (min: 30)"]


# ---- change detection -----------------------------------------------------------------------
def test_window_equals_plain_scan():
    rng = np.random.default_rng(2)
    values = np.concatenate([rng.uniform(0, 0.4, 260), rng.uniform(0.5, 1.0, 260)])
    fast, slow, hits = adwin.Window(), [], []
    for i, v in enumerate(values):
        slow.append(v)
        hit = False
        if len(slow) >= 100:
            for s in range(50, len(slow) - 50):
                eps = math.sqrt((1 / s + 1 / (len(slow) - s)) * 0.5 * math.log(4 / 0.002))
                if abs(np.mean(slow[:s]) - np.mean(slow[s:])) >= eps:
                    slow, hit = slow[s:], True
                    break
        assert fast.add(v) == hit and len(fast.values) == len(slow)
        hits.append(hit)
    assert any(hits[260:]) and not any(hits[:260])


def test_batch_and_stream_detectors_agree(spark, tmp_path):
    from paywarden.streaming.drift import stream_monitor

    rng = np.random.default_rng(4)
    values = np.concatenate([rng.uniform(0, 0.4, 200), rng.uniform(0.5, 1.0, 200)])
    df = spark.createDataFrame([("fraud", "score_distribution", i, i, float(v)) for i, v in enumerate(values)], "domain string, metric string, us long, id long, value double")
    for i in range(2):
        df.filter((F.col("id") >= 200 * i) & (F.col("id") < 200 * (i + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream_monitor(s).writeStream.format("memory").queryName("drift_alerts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [tuple(r) for r in spark.table("drift_alerts").orderBy("id").collect()]
    want = [tuple(r) for r in adwin.adwin_batch(df, 1).orderBy("id").collect()]
    assert got == want and got


# ---- graph -------------------------------------------------------------------------------------
def test_pagerank_converges_like_power_iteration(spark):
    edges = [(1, 2, 1.0, 0), (2, 3, 2.0, 1), (3, 1, 1.0, 2), (3, 4, 1.0, 3), (2, 1, 5.0, 4)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double, ord long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 6)], "node long")
    a = np.zeros((5, 5))
    for s, d, w, _ in edges:
        a[s - 1, d - 1] = a[d - 1, s - 1] = w
    col = a.sum(axis=0)
    col[col == 0] = 1
    x = np.ones(5) / 5
    for _ in range(100):
        x = 0.15 / 5 + 0.85 * (a / col) @ x
    got = {r["node"]: r["rank"] for r in graph.pagerank(nodes, df).collect()}
    assert [got[i] for i in range(1, 6)] == pytest.approx(list(x), abs=1e-6)


def test_components_on_a_long_chain(spark):
    pairs = [(i, f"d{i}") for i in range(40)] + [(i, f"d{i + 1}") for i in range(39)] + [(100, "x"), (101, "x")]
    got = {r["u"]: r["label"] for r in graph.components(spark.createDataFrame(pairs, "u long, d string"), "u", "d").collect()}
    assert all(got[i] == 0 for i in range(40)) and got[100] == got[101] == 100


def test_shared_entities_do_not_depend_on_the_block_size(spark):
    r = random.Random(6)
    rows = [(r.randint(1, 30), r.randint(1, 4), i) for i in range(300)]
    df = spark.createDataFrame(rows, "merchant_id long, user_id long, us long")
    a = sorted(tuple(x) for x in graph.shared_entity_edges(df, "user_id", "T", block=3).collect())
    b = sorted(tuple(x) for x in graph.shared_entity_edges(df, "user_id", "T", block=1000).collect())
    assert a == b and a


def test_circular_transfers(spark):
    rows = [(1, 1, 2, 0), (2, 2, 1, HOUR), (3, 5, 6, 0), (4, 6, 5, 2 * DAY), (5, 7, 8, 0), (6, 8, 9, HOUR), (7, 9, 7, 2 * HOUR), (8, 10, 11, 0), (9, 11, 12, 20 * HOUR), (10, 12, 10, 30 * HOUR)]
    df = spark.createDataFrame(rows, "txn_id long, sender long, receiver long, us long")
    assert {r[0] for r in graph.circular_transfer_users(df).collect()} == {1, 2, 7, 8, 9}


# ---- learning --------------------------------------------------------------------------------------
def test_split_and_folds_are_balanced(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(1000)], "id long, y int")
    s = training.stratified_kfold(training.stratified_split(df, "id", "y"), "id", "y").toPandas()
    assert s.groupby("y")["is_test"].sum().to_dict() == {0: 180, 1: 20}
    assert set(s.groupby(["y", "fold"]).size().loc[1]) == {20}


def test_isolation_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(7)
    odd = rng.normal(size=(50, 3))
    odd[:, 1] += 9.0
    x = np.vstack([rng.normal(size=(950, 3)), odd])
    df = spark.createDataFrame(pd.DataFrame({"id": range(1000), "x": x.tolist(), "y": [0] * 950 + [1] * 50}), "id long, x array<double>, y int")
    forest, offset, scores = training.isolation_forest(df, "id", "bigint", 0.05, trees=60)
    auc = governance.roc_auc(scores.withColumn("score", F.col("anomaly_score"))).first()["roc_auc"]
    assert auc > 0.97
    top = training.anomaly_attribution(df.filter("id >= 995"), forest, offset, "id", "bigint", 3).filter("rank = 1").collect()
    assert all(r["impact"] > 0 and r["feature"] == 1 for r in top)


def test_near_rows_are_the_nearest(spark):
    """Clusters, scattered points, and one point that a third of the rows share."""
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(size=(150, 4)), rng.normal(size=(150, 4)) * 0.1 + rng.integers(0, 5, size=(150, 1)) * 3, np.full((150, 4), 1.5)])
    df = spark.createDataFrame(pd.DataFrame({"id": range(450), "x": x.tolist()}), "id long, x array<double>")
    got = {(r["id"], r["rank"]): r["other"] for r in training.near_rows(df, "id", 4, 3, block=40).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    assert got == {(i, r + 1): int(j) for i in range(450) for r, j in enumerate(np.lexsort((np.arange(450), d[i]))[:3])}


def test_oversampling_balances_and_interpolates(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.uniform(0, 1, size=(30, 2)), rng.uniform(5, 6, size=(120, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": range(150), "x": x.tolist(), "y": [1] * 30 + [0] * 120}), "id long, x array<double>, y int")
    s = training.oversample(df, "id", 2).collect()
    assert 70 <= len(s) <= 110 and all(0 <= v <= 1 for r in s for v in r["x"])


def test_label_spreading_separates_two_clusters(spark):
    from paywarden.operators.semisupervised import label_spreading

    rng = np.random.default_rng(10)
    x = np.vstack([rng.normal(0, 0.3, size=(60, 2)), rng.normal(4, 0.3, size=(60, 2))])
    y = [0] * 60 + [1] * 60
    known = [i for i in range(120) if i % 10 == 0]
    schema = "prediction_id long, x array<double>, y int"
    lab = spark.createDataFrame([(i, x[i].tolist(), y[i]) for i in known], schema)
    unl = spark.createDataFrame([(i, x[i].tolist(), 0) for i in range(120) if i not in known], schema).drop("y")
    out = label_spreading(lab, unl, 2, k=8, rounds=30).collect()
    assert len(out) > 30 and all(r["pseudo_label"] == y[r["prediction_id"]] for r in out)


def test_self_training_gains_labels(spark):
    from paywarden.operators.semisupervised import self_training

    rng = np.random.default_rng(11)
    x = np.vstack([rng.normal(0, 1, size=(150, 2)), rng.normal(3, 1, size=(150, 2))])
    y = [0] * 150 + [1] * 150
    lab = spark.createDataFrame([(i, x[i].tolist(), y[i]) for i in range(0, 300, 3)], "prediction_id long, x array<double>, y int")
    unl = spark.createDataFrame([(i, x[i].tolist()) for i in range(300) if i % 3], "prediction_id long, x array<double>")
    chosen, history = self_training(lab, unl, "fraud", rounds=1, trees=12, depth=3)
    assert history.count() == 1


def test_noise_is_standard_normal_and_repeatable(spark):
    df = spark.range(4000).withColumnRenamed("id", "prediction_id").withColumn("copy", F.lit(1))
    z = df.select(pseudo.noise(F.col("copy"), 0)[0].alias("z")).toPandas()["z"]
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05
    again = df.repartition(7).select(F.sum(pseudo.noise(F.col("copy"), 0)[0])).first()[0]
    assert again == pytest.approx(z.sum())


def test_copies_of_one_point_are_split_into_blocks(spark):
    """A third of the rows are the same point; no task meets them all, and each finds others of them."""
    rng = np.random.default_rng(12)
    x = np.vstack([np.zeros((300, 2)), rng.normal(size=(600, 2))])
    df = spark.createDataFrame(pd.DataFrame({"id": range(900), "x": x.tolist()}), "id long, x array<double>")
    got = training.near_rows(df, "id", 2, 3, block=50).filter("id < 300").collect()
    assert len(got) == 900 and all(r["distance"] == 0 and r["other"] in (0, 1, 2, 3) for r in got)
