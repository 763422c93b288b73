"""Streams give what the batch form gives."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paywarden.functions import constants as K
from paywarden.operators import profiles
from paywarden.plans.scoring_queries import blacklists
from paywarden.sources import ingest, schemas, tables
from paywarden.sources.views import AS_OF, Views
from paywarden.streaming import devices, scoring, windows

FOLDER = "/root/testdata/sf0.001"


def _refs(v):
    users, devs, ips = blacklists(v)
    watch = v.txn.select("user_id").distinct().select("user_id", (F.col("user_id") % 41 == 0).cast("int").alias("sanctions_match"), F.lit(0).alias("watchlist_hit"))
    return scoring.References(
        v.auth_failures, v.accounts, v.confirmed_frauds, profiles.device_profile(v.txn, v.fraud_labels), v.ip_geo, v.user_graph, profiles.merchant_aggregates(v.payments, AS_OF),
        profiles.merchant_risk_ratios(v.txn, v.fraud_labels, v.customer_risk), v.merchant_accounts, v.mcc_table, users, devs, ips, watch)


def test_scored_stream_equals_batch(spark, tmp_path):
    """Two micro-batches in time order, scored against the stored past, against one scoring of everything."""
    v = Views(spark, FOLDER)
    t = v.dense
    middle = t.approxQuantile("us", [0.5], 0.0)[0]
    for part in (F.col("us") < middle, F.col("us") >= middle):
        t.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    sent = []
    q = scoring.score_stream(stream, _refs(v), str(tmp_path / "out"), str(tmp_path / "ck"), publish=lambda m, n: sent.append(m.count())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert len(sent) == 2
    cols = ["txn_id", "domain", "score", "decision", "level"]
    got = spark.read.parquet(str(tmp_path / "out" / "results")).select(cols).toPandas()
    want = scoring.score_all(t, _refs(v)).select(cols).toPandas()
    key = ["domain", "txn_id"]
    assert set(got["domain"]) == {"fraud", "aml", "merchant"}
    got, want = (x.sort_values(key).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want)


def test_session_stream_equals_batch(spark, tmp_path):
    t = Views(spark, FOLDER).dense.select("user_id", "us", "cents", F.timestamp_micros("us").alias("ts"))
    last = t.agg(F.max("us")).first()[0]
    for part in (F.col("us") < last - 12 * K.HOUR, F.col("us") >= last - 12 * K.HOUR):
        t.filter(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    # a row far in the future closes every session
    spark.createDataFrame([(0, last + 40 * K.DAY, 0)], "user_id long, us long, cents long").withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windows.session_totals(s, "1 hour", windows.LATENESS).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = sorted(tuple(r) for r in windows.session_totals(t, "1 hour").collect())
    assert got == want


def test_known_devices_expire_as_a_whole(spark, tmp_path):
    day = K.DAY
    rows = [(1, 1, "a", 0), (2, 1, "a", 5 * day), (3, 1, "b", 20 * day), (4, 1, "a", 45 * day), (5, 1, "b", 49 * day), (6, 1, "b", 51 * day), (7, 1, None, 52 * day), (8, 1, "a", 53 * day)]
    df = spark.createDataFrame(rows, "txn_id long, user_id long, device string, us long")
    for lo, hi in ((1, 4), (5, 8)):
        df.filter(F.col("txn_id").between(lo, hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = devices.new_devices(s).writeStream.format("memory").queryName("new_devices").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["txn_id"]: r["new_device_flag"] for r in spark.table("new_devices").collect()}
    assert got == {1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 1, 7: 0, 8: 1}


def test_parsed_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "t1", "sender_id": "u1", "device_id": "d"}\n{"user_id": "u2"}\n{"transaction_id": "t3", "user_id": "u3", "amount": 5.5, "currency": "UGX", "type": "X"}\n')
    s = ingest.normalise_transactions(ingest.read_json_stream(spark, str(tmp_path / "in"), schemas.TRANSACTION_EVENT))
    q = s.writeStream.format("memory").queryName("parsed").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["transaction_id"]: (r["user_id"], r["amount"], r["currency"], r["type"], r["device"]) for r in spark.table("parsed").collect()}
    assert got == {"t1": ("u1", 0.0, "KES", "UNKNOWN", "d"), "t3": ("u3", 5.5, "UGX", "X", None)}


def test_chargeback_stream_is_idempotent(spark, tmp_path):
    p = spark.createDataFrame([(1, 10, 5), (2, 10, 9), (3, 11, 1)], "prediction_id long, transaction_id long, created_us long")
    p.write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([(10,), (12,)], "transaction_id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("transaction_id long").parquet(str(tmp_path / "in"))
    q = scoring.feedback_stream(s, lambda sp: sp.read.parquet(str(tmp_path / "p")), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["prediction_id"], r["label"]) for r in got] == [(2, 1)]


def test_month_predicate_prunes_partitions(spark, tmp_path):
    p = spark.createDataFrame([(i, "fraud", i * 20 * K.DAY) for i in range(10)], "prediction_id long, domain string, created_us long")
    path = str(tmp_path / "t")
    tables.write_predictions(p, path)
    df = tables.read_predictions(spark, path, 0, 25 * K.DAY)
    assert {r["prediction_id"] for r in df.collect()} == {0, 1}
    assert "PartitionFilters: [isnotnull(month" in df._jdf.queryExecution().executedPlan().toString()
    tables.replace_partitions(p.filter("prediction_id = 0").withColumn("domain", F.lit("fraud")), path)
    assert spark.read.parquet(path).count() == 10 - 1


@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprint_ignores_order(spark, parts):
    df = spark.range(100).withColumn("s", F.concat(F.lit("x"), F.col("id")))
    assert tables.fingerprint(df.repartition(parts)).first() == tables.fingerprint(df.orderBy(F.col("id").desc())).first()
    assert tables.fingerprint(df.filter("id <> 5")).first() != tables.fingerprint(df).first()


def test_monitor_watches_all_metrics_of_all_domains(spark, tmp_path, monkeypatch):
    """Every scored event gives its score, confidence, decision and each feature of its domain's vector, once and at its own time."""
    from paywarden.plans import streaming_queries

    n, t0 = 40, pd.Timestamp("2024-01-10")
    tables_ = {
        "events": pd.DataFrame({"event_id": range(n), "ts": [t0 + pd.Timedelta(minutes=7 * i) for i in range(n)], "user_id": [i % 3 for i in range(n)],
                                "event_type": ["view", "error"] * (n // 2), "value": [10.0 + i for i in range(n)], "props": [f'{{"k": {i % 7}}}' for i in range(n)]}),
        "orders": pd.DataFrame({"o_orderkey": [1, 2], "o_custkey": [1, 2], "o_orderdate": [pd.Timestamp("1995-05-05")] * 2}),
        "lineitem": pd.DataFrame({"l_orderkey": [1, 2], "l_suppkey": [5, 6], "l_linenumber": [1, 1], "l_partkey": [1, 1], "l_extendedprice": [10.0, 20.0],
                                  "l_returnflag": ["R", "A"], "l_linestatus": ["F", "F"]})}
    for name, rows in tables_.items():
        spark.createDataFrame(rows).write.parquet(str(tmp_path / f"{name}.parquet"))
    fed = []

    monkeypatch.setattr(streaming_queries, "streamed", lambda v, df, *a, **k: fed.append(df))
    v = Views(spark, str(tmp_path))
    streaming_queries.stream_monitor(v)
    values = fed[0] if "metric" in fed[0].columns else streaming_queries.adwin.fan_out(fed[0])
    got = values.toPandas()
    want = {(d, m) for d in K.REGISTRY for m in ("score_distribution", "confidence", "positive_rate", *[f"feature:{f}" for f in K.REGISTRY[d]])}
    assert set(zip(got["domain"], got["metric"], strict=True)) == want and len(got) == n * len(want)
    at = {r["txn_id"]: r["us"] for r in v.txn.collect()}
    assert all(at[i] == us for i, us in zip(got["id"], got["us"], strict=True))
    amounts = got[(got["domain"] == "aml") & (got["metric"] == "feature:amount")].set_index("id")["value"].to_dict()
    assert amounts == {r["txn_id"]: r["amount"] for r in v.txn.collect()}


def test_packed_values_come_back_in_order(monkeypatch):
    """Blocks that overlap in time, that tie or that have no time or id give what one sorted table gives."""
    import numpy as np
    import pyarrow as pa

    from paywarden.streaming import drift

    monkeypatch.setattr(drift, "GATHER", 100)
    rng = np.random.default_rng(5)
    rows = pd.DataFrame({"domain": rng.choice(["fraud", "aml"], 900), "metric": rng.choice(["a", "b"], 900), "us": pd.array(rng.integers(0, 60, 900), "Int64"),
                         "id": pd.array(np.arange(900) - 450, "Int64"), "value": rng.random(900)})
    rows.loc[[7, 300], "us"] = pd.NA
    rows.loc[[11, 500], "id"] = pd.NA
    rows.loc[[20], "value"] = None
    batches = pa.Table.from_pandas(rows, preserve_index=False).to_batches(max_chunksize=60)
    packed = pa.Table.from_batches(drift._pack(iter(batches))).to_pandas()
    assert len(packed) > 8
    for key, blocks in packed.groupby(["domain", "metric"]):
        got = pd.concat(list(drift._in_order(blocks)))
        want = rows[(rows["domain"] == key[0]) & (rows["metric"] == key[1])].fillna({"us": drift.MISSING, "id": drift.MISSING}).sort_values(["us", "id"])
        assert got["us"].tolist() == want["us"].tolist() and got["id"].tolist() == want["id"].tolist()
        assert np.array_equal(got["value"].to_numpy(), want["value"].to_numpy(float), equal_nan=True)
