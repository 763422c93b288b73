"""Scoring every micro-batch of a transaction stream."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import lookup
from ..functions import constants as K
from ..operators import decisions, profiles, screening, vector, velocity
from ..sources import ingest
from . import counters


@dataclass
class References:
    """Tables the features look up. See ``operators.vector`` for their columns."""

    auth: DataFrame
    accounts: DataFrame
    confirmed: DataFrame
    devices: DataFrame
    ip_geo: DataFrame
    user_graph: DataFrame
    merchant_aggregates: DataFrame
    merchant_ratios: DataFrame
    merchant_accounts: DataFrame
    mcc: DataFrame
    blocked_users: DataFrame
    blocked_devices: DataFrame
    blocked_ips: DataFrame
    watchlist: DataFrame  # user_id, sanctions_match, watchlist_hit


RESULT = ["txn_id", "domain", "entity_id", "score", "confidence", "decision", "level", "overrides"]


def score_all(txn: DataFrame, refs: References, maturity=None) -> DataFrame:
    """Fraud and AML for every row and merchant risk where a merchant is known, in one frame.

    ``txn``: txn_id, user_id, merchant_id, us, cents, amount, device, ip, country, currency, lat, lng.
    """
    level = F.lit("COLD") if maturity is None else maturity
    keys = txn.select("txn_id", "user_id", "us", "cents", "device", "ip", "country")
    flags = vector.override_flags(screening.blacklist_flags(velocity.velocity_session(keys), refs.blocked_users, refs.blocked_devices, refs.blocked_ips))
    names = ["sanctioned_country", "blacklisted_device", "blacklisted_ip", "blacklisted_user", "velocity_anomaly", "new_account_high_amount"]
    flags = flags.select("txn_id", *names)
    fv = vector.fraud_vector(txn, refs.auth, refs.accounts, refs.confirmed, refs.devices).join(flags, "txn_id", "left")
    fraud = decisions.fraud_score_batch(fv, level).withColumn("entity_id", F.col("user_id"))

    av = vector.aml_vector(txn, refs.accounts, refs.ip_geo, refs.user_graph, ["country"])
    av = velocity.with_hourly_past(av, txn, "user_id").withColumn("velocity_spike", velocity.spike_flag(F.col("velocity_1h"))).drop("past_n", "past_hours")
    av = lookup(av, refs.watchlist.select("user_id", "sanctions_match", "watchlist_hit"), {"user_id": "user_id"}, ["txn_id"])
    av = av.join(flags.select("txn_id", "blacklisted_user", "blacklisted_device"), "txn_id", "left").fillna(0, ["velocity_spike", "sanctions_match", "watchlist_hit"])
    aml = decisions.aml_score_batch(av, level).withColumn("entity_id", F.col("user_id"))

    mv = vector.merchant_vector(txn.filter(F.col("merchant_id").isNotNull()), refs.merchant_aggregates, refs.merchant_ratios, refs.merchant_accounts, refs.mcc)
    merchant = decisions.merchant_score_batch(mv, level).withColumn("entity_id", F.col("merchant_id"))
    parts = [d.withColumn("domain", F.lit(n)).select(RESULT) for n, d in (("fraud", fraud), ("aml", aml), ("merchant", merchant))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def messages(scored: DataFrame) -> DataFrame:
    """Routed result messages (topic, key, value)."""
    key = F.when(F.col("domain") == "merchant", F.col("entity_id")).otherwise(F.col("txn_id"))
    return ingest.route(scored.select("domain", key.alias("key"), "decision", F.to_json(F.struct(*RESULT)).alias("value")))


def score_counted(rows: DataFrame, refs: References, maturity=None) -> DataFrame:
    """What :func:`score_all` gives, for rows of ``counters.counted``: nothing of the past is read but what they carry."""
    level = F.lit("COLD") if maturity is None else maturity
    past = ["past_n", "past_hours"]
    u = rows.filter("kind = 'u'")
    flags = vector.override_flags(screening.blacklist_flags(u.select("txn_id", "user_id", "device", "ip", "country", "count_1h"), refs.blocked_users, refs.blocked_devices, refs.blocked_ips))
    flags = flags.select("txn_id", "sanctioned_country", "blacklisted_device", "blacklisted_ip", "blacklisted_user", "velocity_anomaly", "new_account_high_amount")

    # failed logins and confirmed frauds come from tables: the logins of the batch's own days, the first fraud of a user
    span = u.agg(F.min("us").alias("lo"), F.max("us").alias("hi")).first()
    logins = refs.auth if span["lo"] is None else refs.auth.filter((F.col("us") >= span["lo"] - K.DAY) & (F.col("us") < span["hi"]))
    failed = velocity.failed_logins_24h(u.select("txn_id", "user_id", "us"), logins).select("txn_id", "failed_login_attempts_24h")
    first = refs.confirmed.groupBy("user_id").agg(F.min("us").alias("first_fraud_us"))
    km = velocity.haversine(F.col("last_lat"), F.col("last_lng"), F.col("lat"), F.col("lng"))
    here = F.col("lat").isNotNull() & F.col("lng").isNotNull()
    f = lookup(u, first, {"user_id": "user_id"}, ["txn_id"]).join(failed, "txn_id", "left")
    f = f.select("txn_id", "user_id", "us", "amount", "device", "country", "currency", "failed_login_attempts_24h", F.col("n_1h").alias("transaction_velocity_1h"), F.col("n_24h").alias("transaction_velocity_24h"),
                 velocity._mean("cents_7d", "n_7d").alias("avg_transaction_amount_7d"), F.coalesce(F.col("first_fraud_us") < F.col("us"), F.lit(False)).cast("int").alias("historical_fraud_flag"),
                 F.when(here & (F.col("us") - F.col("last_us") < K.DAY), F.round(km, 4)).otherwise(0.0).alias("geo_distance_from_last_tx"))
    fraud = decisions.fraud_score_batch(vector.finish_fraud(f, refs.accounts, refs.devices).join(flags, "txn_id", "left"), level).withColumn("entity_id", F.col("user_id"))

    a = u.withColumn("squares_30d", F.col("squares_30d").cast("decimal(38,0)"))
    a = a.select("txn_id", "user_id", "us", "amount", "device", "ip", "country", *past, *velocity.amounts_30d(), "device_count_30d", "ip_count_30d", "new_device_flag", "historical_structuring_flag",
                 F.col("count_1h").alias("velocity_1h"), F.col("count_24h").alias("velocity_24h"), (F.col("sum_24h") / 100.0).alias("total_volume_24h"),
                 velocity.structuring_score().alias("structuring_score_24h"), velocity.rapid_drain().alias("rapid_drain_flag"))
    av = vector.finish_aml(a, refs.accounts, refs.ip_geo, refs.user_graph, ["country", *past])
    av = av.withColumn("velocity_spike", velocity.spike_flag(F.col("velocity_1h"))).drop(*past)
    av = lookup(av, refs.watchlist.select("user_id", "sanctions_match", "watchlist_hit"), {"user_id": "user_id"}, ["txn_id"])
    av = av.join(flags.select("txn_id", "blacklisted_user", "blacklisted_device"), "txn_id", "left").fillna(0, ["velocity_spike", "sanctions_match", "watchlist_hit"])
    aml = decisions.aml_score_batch(av, level).withColumn("entity_id", F.col("user_id"))

    m = rows.filter("kind = 'm'").withColumns({"transaction_count_1h": F.col("count_1h"), "transaction_count_24h": F.col("count_24h"), "transaction_volume_24h": F.col("sum_24h") / 100.0,
                                              "velocity_spike_flag": velocity.spike_flag(F.col("count_1h"))}).drop(*past)
    mv = vector.finish_merchant(m, refs.merchant_aggregates, refs.merchant_ratios, refs.merchant_accounts, refs.mcc)
    merchant = decisions.merchant_score_batch(mv, level).withColumn("entity_id", F.col("merchant_id"))
    parts = [d.withColumn("domain", F.lit(n)).select(RESULT) for n, d in (("fraud", fraud), ("aml", aml), ("merchant", merchant))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def score_stream(stream: DataFrame, refs: References, folder: str, checkpoint: str, past: DataFrame | None = None,
                 publish: Callable[[DataFrame, int], None] | None = None):
    """A writer that scores each micro-batch from itself and the keyed state of ``streaming.counters``.

    Counted rows and results are written under the batch number and overwritten by it, so a batch that is run again after a
    failure leaves the same files. ``past``: transactions from before the stream, for the first state. ``publish`` sends the
    messages on.
    """
    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        here = f"{folder}/counted/batch={number}"
        batch.write.mode("overwrite").parquet(here)
        score_counted(spark.read.schema(batch.schema).parquet(here), refs).write.mode("overwrite").parquet(f"{folder}/results/batch={number}")
        if publish is not None:
            publish(messages(spark.read.parquet(f"{folder}/results/batch={number}").select(RESULT)), number)

    return counters.counted(stream, past).writeStream.outputMode("append").foreachBatch(handle).option("checkpointLocation", checkpoint)


def feedback_stream(chargebacks: DataFrame, predictions: Callable[[SparkSession], DataFrame], path: str, checkpoint: str):
    """Chargebacks become label events of the newest prediction; written per batch number."""
    def handle(batch: DataFrame, number: int) -> None:
        ingest.chargeback_labels(batch, predictions(batch.sparkSession)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return chargebacks.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
