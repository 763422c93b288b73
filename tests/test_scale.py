"""Steps whose memory or time grew faster than their input."""

import time
import tracemalloc

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from paywarden.operators import training


def test_distances_take_bounded_memory():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2000, 64)), rng.normal(size=(512, 64))
    tracemalloc.start()
    d = training._distances(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 100 << 20
    assert np.array_equal(d[7], np.sqrt(((a[7] - b) ** 2).sum(1)))


def test_near_rows_over_tiles_and_for_some_rows_only(spark, monkeypatch):
    """Copies, scattered points far from the origin and two rows of one id, in tiles of 60 rows."""
    monkeypatch.setattr(training, "TILE", 60)
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(200, 5)) + 1e6, rng.normal(size=(150, 5)), np.full((150, 5), 1.5)])
    ids = [*range(499), 498]
    df = spark.createDataFrame(pd.DataFrame({"id": ids, "x": x.tolist()}), "id long, x array<double>")
    got = {(r["id"], r["rank"]): (r["other"], r["distance"]) for r in training.near_rows(df, "id", 5, 4, block=30, asking=F.col("id") % 3 == 0).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    d[np.equal.outer(ids, ids)] = np.inf
    want = {}
    for i in range(0, 498, 3):
        for r, j in enumerate(np.lexsort((ids, d[i]))[:4]):
            want[i, r + 1] = (ids[j], d[i, j])
    assert {k: v for k, v in got.items() if k[0] != 498} == want and {k[0] for k in got} == set(range(0, 499, 3))


def test_change_detector_skips_blocks_and_answers_alike(monkeypatch):
    """Nearly no value of a steady stretch is tried by itself, and alerts are those of adding value by value."""
    from paywarden.operators import adwin

    rng = np.random.default_rng(3)
    v = np.concatenate([rng.random(4000), 0.3 + 0.7 * rng.random(1500), (np.arange(3000) * 37 % 1000) / 1000.0, [np.nan], rng.random(300), rng.random(900) * 0.2])
    plain, want = adwin.Window(largest=2000), []
    for i, x in enumerate(v):
        if plain.add(float(x)):
            want.append((i, len(plain.values), float(plain.values.mean())))
    calls, add = [], adwin.Window.add
    monkeypatch.setattr(adwin.Window, "add", lambda self, value: calls.append(1) or add(self, value))
    rows = pd.DataFrame({"us": range(len(v)), "id": range(len(v)), "value": v})
    got = adwin.detect(("fraud", "m"), rows[rows.index < 4000], window := adwin.Window(largest=2000))
    assert len(calls) < 400 and len(got) == sum(i < 4000 for i, _, _ in want)
    later = adwin.detect(("fraud", "m"), rows[rows.index >= 4000], window)
    got = pd.concat([x for x in (got, later) if len(x)])
    assert list(zip(got["id"], got["window_size"], got["new_mean"], strict=True)) == want and want
    assert np.array_equal(window.values, plain.values, equal_nan=True)


def test_names_that_share_a_frequent_beginning_do_not_become_pairs(spark):
    """Nearly equal names of one family meet, families that share segments do not, and each name is given its first hit."""
    from difflib import SequenceMatcher

    from paywarden.operators import screening

    names = [f"customer#{i * 7:09d}" for i in range(300)] + [f"supplier#{i:09d}" for i in range(0, 400, 3)] + ["a rather long name of a party that has many letters", "zo\u00eb \U0001f600 m\u00fcller"]
    entries = [f"supplier#{i:09d}" for i in range(0, 400, 10)] + ["a rather long name of a party that had many letters", "zoe \U0001f600 m\u00fcller", "united kingdom"]
    parties = spark.createDataFrame([(x.upper() if i % 2 else x,) for i, x in enumerate(names)], "name string")
    listed = spark.createDataFrame([(1000 - i, x, "L") for i, x in enumerate(entries)], "ordinal long, name string, source string")
    pairs = screening.candidate_pairs(screening._names(parties), listed.select("ordinal", F.lower("name").alias("lentity")))
    assert pairs.filter("lname like 'customer%'").count() == 0
    want = {}
    for a in sorted({x.lower() for x in names}):
        hits = [(1000 - i, b) for i, b in enumerate(entries) if SequenceMatcher(None, a, b.lower()).ratio() >= 0.85]
        if hits:
            want[a] = min(hits)[1]
    assert {r["lname"]: r["entity"] for r in screening.fuzzy(parties, listed).collect()} == want


def test_rings_are_looked_up_only_for_users_not_found_yet(spark, monkeypatch):
    """Rings in one slice, over two slices and too slow ones, beside many senders that nobody pays; as by trying all triples."""
    from paywarden.operators import graph

    rng = np.random.default_rng(4)
    rows = [(int(a), int(b), int(u)) for a, b, u in zip(rng.integers(0, 14, 70), rng.integers(0, 14, 70), rng.integers(0, 4000, 70), strict=True)]
    rows += [(100 + i, i % 14, i) for i in range(300)] + [(50, 51, 990), (51, 52, 1005), (52, 50, 1080), (60, 61, 0), (61, 62, 90), (62, 60, 110), (70, 71, 10), (71, 70, 20)]
    seen, legs = [], graph._legs
    monkeypatch.setattr(graph, "_legs", lambda rings: seen.append(rings.count()) or legs(rings))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "txn_id long, sender long, receiver long, us long")
    got = {r[0] for r in graph.circular_transfer_users(df, 100).collect()}
    want, rows = set(), [r for r in rows if r[0] != r[1]]
    for a in rows:
        for b in rows:
            if b[0] == a[1] and abs(a[2] - b[2]) <= 100:
                if b[1] == a[0]:
                    want |= {a[0], a[1]}
                else:
                    for c in rows:
                        if c[0] == b[1] and c[1] == a[0] and abs(c[2] - a[2]) <= 100 and abs(c[2] - b[2]) <= 100:
                            want |= {a[0], b[0], c[0]}
    assert got == want and {50, 51, 52, 70, 71} <= got and not {60, 61, 62} & got
    assert seen[1] < seen[0]


def test_tokens_met_first_stay_when_the_cache_is_full():
    """A batch of many new stretches neither pushes out the frequent ones nor stays in the cache, and ids are the same."""
    import pytest

    pytest.importorskip("tokenizers")
    pytest.importorskip("public_tokenizers")
    from paywarden.llm.tokens import Encoder

    first, rest = " ".join(f"word{i}" for i in range(60)), " ".join(f"x{i * 7919}q" for i in range(500))
    small, large = Encoder(cache=100), Encoder()
    assert small.encode_all([first, None]) == large.encode_all([first, None])
    met = set(small.known)
    assert small.encode_all([rest, first, ""]) == large.encode_all([rest, first, ""])
    assert len(small.known) == 100 and met <= set(small.known)
    assert small.encode_all([rest]) == large.encode_all([rest])


def _timeline(spark, n=400):
    """Rows of a few users and devices; some without user, time, device or cents, some twice."""
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(1, 4)) if i % 17 else None, int(rng.integers(0, 4 * 24)) * 1_800_000_000 if i % 23 else None, int(rng.integers(1, 9)) * 100 if i % 19 else None,
             f"d{rng.integers(0, 4)}" if i % 5 else None) for i in range(n)]
    return spark.createDataFrame(rows + rows[:20], "txn_id long, user_id long, us long, cents long, device string")


def test_trailing_sends_no_more_than_it_needs(spark):
    """Fewer columns, rows that only count and an end of time change no total, and fewer rows are summed."""
    from paywarden.functions import timeline as tl

    hour, df, one = 3_600_000_000, _timeline(spark), F.lit(1).cast("long")
    asked, wide = F.col("cents") > 300, 24 * hour
    some = F.when(F.col("txn_id") % 3 == 0, F.col("cents")).otherwise(F.lit(0).cast("long"))
    specs = {"n": (hour, some, some), "s": (wide, some, some)}
    plain = tl.trailing(df, ["user_id"], "us", specs).filter(asked).select("txn_id", "user_id", "us", "n", "s")
    less = tl.trailing(df, ["user_id"], "us", specs, keep=["txn_id", "user_id", "us"], asking=asked, last=tl.last_time(df.filter(asked)))
    assert less.columns == plain.columns and sorted(map(str, less.collect())) == sorted(map(str, plain.collect())) != []
    seen = []

    def counted(flat, *args):
        seen.append(flat.count())
        return running(flat, *args)

    running = tl.running
    tl.running = counted
    try:
        tl.trailing(df, ["user_id"], "us", {"n": (hour, one, one), "s": (30 * wide, one, one)}, last=tl.last_time(df))
        tl.trailing(df, ["user_id"], "us", specs, asking=F.lit(False))
    finally:
        tl.running = running
    known = df.filter("us is not null").count()
    assert known <= seen[0] <= 2 * df.count() + (df.count() - known) and seen[1] <= 3 * df.filter("txn_id % 3 = 0").count()


def test_rows_and_summaries_read_one_shuffle(spark):
    """What a timeline helper reads for its summaries is the shuffle that it reads for its rows, where one feeds another."""
    from paywarden.functions import timeline as tl

    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        flagged = tl.presence(_timeline(spark).filter("device is not null"), ["user_id"], "device", "us", "txn_id", 3_600_000_000, "_d")
        t = tl.trailing(flagged, ["user_id"], "us", {"u": (3_600_000_000, F.col("_d_in"), F.col("_d_out"))}, keep=["txn_id"])
        plan = t._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)
    assert plan.count("ReusedExchange") >= 2


def test_neighbours_tell_a_null_from_no_row(spark):
    from paywarden.functions import timeline as tl

    rows = [(1, 1, 5, None), (2, 1, 7, 30), (3, 1, 9 * 3_600_000_000, 40), (4, 2, 5, 50)]
    df = spark.createDataFrame(rows, "txn_id long, user_id long, us long, cents long")
    got = tl.neighbours(df, ["user_id"], "us", "txn_id", {"pc": "cents", "pt": "us"}, {"nt": "us"}).collect()
    assert {r["txn_id"]: (r["pc"], r["pt"], r["nt"]) for r in got} == {
        1: (None, None, 7), 2: (None, 5, 9 * 3_600_000_000), 3: (30, 7, None), 4: (None, None, None)}


def test_settled_rows_give_back_their_shuffles(spark):
    from paywarden.functions.session import settle

    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    small = settle(spark.range(20_000, numPartitions=3).groupBy((F.col("id") % 7_000).alias("k")).count().agg(F.sum("count").alias("n")))
    end = time.time() + 30
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before and small.first()["n"] == 20_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_merchant_aggregates_are_combined_before_the_shuffle(spark):
    """As told by plain Python, with customers, amounts, flags and merchants that are not known."""
    from paywarden.operators import profiles

    day, now = 86_400_000_000, 100 * 86_400_000_000
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(0, 3)) if i % 29 else None, int(rng.integers(0, 6)) if i % 7 else None, int(rng.integers(0, 110)) * day, int(rng.integers(1, 9)) * 100 if i % 11 else None,
             bool(rng.integers(0, 2)), bool(rng.integers(0, 2)) if i % 13 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "merchant_id long, user_id long, us long, cents long, refund boolean, chargeback boolean")
    got = {r["merchant_id"]: r for r in profiles.merchant_aggregates(df, now).collect()}
    for m in (None, 0, 1, 2):
        mine = [r for r in rows if r[0] == m and r[2] < now]
        in30, in90 = ([r for r in mine if r[2] >= now - d * day] for d in (30, 90))
        want = (len(mine), sum(r[3] or 0 for r in mine) / 100.0, len({r[1] for r in in30} - {None}), sum(r[5] or False for r in in90) / len(in90), sum(r[4] for r in in90) / len(in90))
        assert tuple(got[m][c] for c in ("total_transactions", "total_volume", "unique_customers_30d", "chargeback_rate_90d", "refund_rate_90d")) == want
        if in30:
            assert abs(got[m]["avg_transaction_amount_30d"] - sum(r[3] or 0 for r in in30) / len(in30) / 100.0) < 1e-9
