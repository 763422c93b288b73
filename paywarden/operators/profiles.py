"""Entity profiles and the lookups of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.joins import lookup

DAY = K.DAY


def age_days(created: Column, as_of: Column, unknown: float) -> Column:
    """Whole days since creation; ``unknown`` without a creation time."""
    span = as_of - created
    return F.coalesce((span - F.pmod(span, F.lit(DAY))) / DAY, F.lit(unknown)).cast("double")


def time_of_day(us: Column) -> Column:
    into = F.pmod(us, F.lit(DAY))
    return (into - F.pmod(into, F.lit(K.HOUR))) / K.HOUR / 24.0


def currency_risk(ccy: Column) -> Column:
    c = F.upper(ccy)
    return F.when(c.isin(K.HIGH_RISK_CURRENCIES), 0.9).when(c.isin(K.MEDIUM_RISK_CURRENCIES), 0.4).otherwise(0.1)


def high_risk_country(country: Column) -> Column:
    return F.coalesce(F.upper(country).isin(K.HIGH_RISK_COUNTRIES), F.lit(False)).cast("int")


def sanctions_proximity(country: Column) -> Column:
    c = F.upper(country)
    return F.when(c.isin(K.SANCTIONED_PROXIMITY), 1.0).when(c.isin(K.HIGH_RISK_COUNTRIES), 0.5).otherwise(0.0)


def cross_border(sender: Column, receiver: Column, country: Column) -> Column:
    """1 only when both wallets are known, differ, and the country is high-risk."""
    return F.when(sender.isNotNull() & receiver.isNotNull() & (sender != receiver) & (high_risk_country(country) == 1), 1).otherwise(0)


def device_profile(txn: DataFrame, labels: DataFrame) -> DataFrame:
    """Per device: labelled frauds, distinct users, last use and a risk score.

    ``labels`` has txn_id and label. The score is our own:
    ``min(1, frauds/5)*0.6 + min(1, (users-1)/10)*0.4``.
    """
    t = txn.filter(F.col("device").isNotNull()).join(labels.select("txn_id", "label"), "txn_id", "left")
    per_user = t.groupBy("device", "user_id").agg(
        F.count_if(F.col("label") == 1).alias("f"), F.max("us").alias("last"))
    d = per_user.groupBy("device").agg(
        F.sum("f").alias("device_fraud_count"), F.count("user_id").alias("distinct_user_count"), F.max("last").alias("last_seen_us"))
    score = (F.least(F.lit(1.0), F.col("device_fraud_count") / 5.0) * 0.6
             + F.least(F.lit(1.0), (F.col("distinct_user_count") - 1) / 10.0) * 0.4)
    return d.withColumn("device_risk_score", F.round(score, 4))


def device_lookup(txn: DataFrame, profile: DataFrame) -> DataFrame:
    """Device columns per transaction: (0.5, 0, 1) without device, (0.1, 0, 1) for an unknown one."""
    p = profile.select("device", "device_risk_score", "device_fraud_count", "distinct_user_count")
    j = lookup(txn, p, {"device": "device"}, ["txn_id"])
    missing = F.when(F.col("device").isNull(), 0.5).otherwise(0.1)
    return j.select(
        *txn.columns, F.coalesce("device_risk_score", missing).alias("device_risk_score"),
        F.coalesce("device_fraud_count", F.lit(0)).alias("device_fraud_count"),
        F.coalesce("distinct_user_count", F.lit(1)).alias("distinct_user_count"))


def ip_country_mismatch(txn: DataFrame, ip_geo: DataFrame) -> DataFrame:
    """1 when the ip's country is known and differs from the declared one; ``ip_geo`` has ip, ip_country."""
    j = lookup(txn, ip_geo.select("ip", "ip_country"), {"ip": "ip"}, ["txn_id"])
    differs = F.upper("ip_country") != F.upper("country")
    return j.withColumn("ip_country_mismatch", F.coalesce(differs, F.lit(False)).cast("int")).drop("ip_country")


def mcc_risk(merchants: DataFrame, table: DataFrame) -> DataFrame:
    """Risk of the merchant's category; 0 when unknown. ``table`` has mcc, mcc_risk_score."""
    j = lookup(merchants, table.select("mcc", "mcc_risk_score"), {"mcc": "mcc"}, ["merchant_id"])
    return j.withColumn("mcc_risk_score", F.coalesce("mcc_risk_score", F.lit(0.0)))


def merchant_aggregates(pay: DataFrame, as_of_us: int) -> DataFrame:
    """Merchant aggregates as of a time: 30-day mean, deviation, customers; 90-day chargebacks and refunds.

    Rows are combined per merchant before the shuffle; only the customers of the 30 days are told apart.
    """
    past = pay.filter(F.col("us") < as_of_us)
    in30, in90 = F.col("us") >= as_of_us - 30 * DAY, F.col("us") >= as_of_us - 90 * DAY
    x = F.col("cents")
    sq = x.cast("decimal(19,0)") * x.cast("decimal(19,0)")
    zero = F.lit(0)

    def some(cond, value):
        return F.sum(F.when(cond, value).otherwise(zero))

    m = past.groupBy("merchant_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), some(in30, 1).alias("n30"), some(in30, x).alias("s30"),
        some(in30, sq).alias("q30"), some(in90, 1).alias("n90"), some(in90 & F.col("chargeback"), 1).alias("c90"),
        some(in90 & F.col("refund"), 1).alias("r90"), F.count_distinct(F.when(in30, F.col("user_id"))).alias("u30"))
    d = {c: F.col(c).cast("double") for c in m.columns}
    std = F.sqrt(F.greatest((d["q30"] - d["s30"] * d["s30"] / d["n30"]) / (d["n30"] - 1.0), F.lit(0.0))) / 100.0
    return m.select(
        "merchant_id",
        F.when(F.col("n30") > 0, d["s30"] / d["n30"] / 100.0).otherwise(0.0).alias("avg_transaction_amount_30d"),
        F.when(F.col("n30") > 1, F.round(std, 4)).otherwise(0.0).alias("std_transaction_amount_30d"),
        F.col("n").alias("total_transactions"), (d["s"] / 100.0).alias("total_volume"), F.col("u30").alias("unique_customers_30d"),
        F.when(F.col("n90") > 0, d["c90"] / d["n90"]).otherwise(0.0).alias("chargeback_rate_90d"),
        F.when(F.col("n90") > 0, d["r90"] / d["n90"]).otherwise(0.0).alias("refund_rate_90d"))


def merchant_risk_ratios(txn: DataFrame, labels: DataFrame, customers: DataFrame) -> DataFrame:
    """Shares per merchant: labelled fraud, high-risk customers, cross-border; mean customer risk.

    ``customers`` has user_id, risk_milli (risk in thousandths) and level. Each customer counts once
    in the customer measures.
    """
    t = txn.join(labels.select("txn_id", "label"), "txn_id", "left")
    border = high_risk_country(F.col("country"))
    pair = t.groupBy("merchant_id", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("f"), F.sum(border).alias("b"))
    p = lookup(pair, customers.select("user_id", "risk_milli", "level"), {"user_id": "user_id"}, ["merchant_id"])
    m = p.groupBy("merchant_id").agg(
        F.sum("n").alias("n"), F.sum("f").alias("f"), F.sum("b").alias("b"), F.count("user_id").alias("u"),
        F.count_if(F.col("level").isin("HIGH", "CRITICAL")).alias("h"), F.sum("risk_milli").alias("r"), F.count("risk_milli").alias("rn"))
    def share(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return m.select(
        "merchant_id", share("f", "n").alias("fraud_transaction_rate"), share("h", "u").alias("high_risk_customer_ratio"),
        share("b", "n").alias("cross_border_ratio"),
        F.when(F.col("rn") > 0, F.col("r") / F.col("rn") / 1000.0).otherwise(0.0).alias("avg_customer_risk_score"))


def aml_user_risk_profile(predictions: DataFrame, txn: DataFrame, sanctioned: DataFrame, as_of_us: int) -> DataFrame:
    """Per user as of a time: last transaction, velocities, volume, sanctions flag, cumulative risk, trend.

    Ours: cumulative is the mean score of 30 days; the category uses 0.50 / 0.70 / 0.85; the trend
    compares the last 7 days with the 7 before, with a dead band of 0.05.
    """
    k = lambda days: F.col("us") >= as_of_us - days * DAY
    t = txn.filter(F.col("us") < as_of_us).groupBy("user_id").agg(
        F.max("us").alias("last_transaction_us"), F.count_if(F.col("us") >= as_of_us - K.HOUR).alias("velocity_1h"),
        F.count_if(k(1)).alias("velocity_24h"), F.sum(F.when(k(1), F.col("cents")).otherwise(0)).alias("cents_24h"))
    p = predictions.filter(F.col("created_us") < as_of_us).select(
        "user_id", F.col("created_us").alias("us"), F.round(F.col("score") * 1000).cast("long").alias("m"))
    cond = {"30": k(30), "7": k(7), "14": k(14) & ~k(7)}
    aggs = [a for n, c in cond.items() for a in (
        F.sum(F.when(c, F.col("m"))).alias(f"s{n}"), F.count_if(c).alias(f"c{n}"))]
    r = p.groupBy("user_id").agg(*aggs)
    mean = {n: F.when(F.col(f"c{n}") > 0, F.col(f"s{n}") / F.col(f"c{n}") / 1000.0) for n in cond}
    total = F.coalesce(mean["30"], F.lit(0.0))
    # compared as whole numbers: s7/c7 - s14/c14 against 50 thousandths
    diff = F.col("s7") * F.col("c14") - F.col("s14") * F.col("c7")
    band = 50 * F.col("c7") * F.col("c14")
    trend = (F.when((F.col("c7") > 0) & (F.col("c14") > 0) & (diff > band), "INCREASING")
             .when((F.col("c7") > 0) & (F.col("c14") > 0) & (diff < -band), "DECREASING").otherwise("STABLE"))
    s = sanctioned.select("user_id").distinct().withColumn("sanctions_flag", F.lit(1))
    j = t.join(r, "user_id", "left").join(s, "user_id", "left")
    return j.select(
        "user_id", "last_transaction_us", "velocity_1h", "velocity_24h", (F.col("cents_24h") / 100.0).alias("total_volume_24h"),
        F.coalesce("sanctions_flag", F.lit(0)).alias("sanctions_flag"), total.alias("cumulative_risk_score"),
        F.when(total >= 0.85, "CRITICAL").when(total >= 0.70, "HIGH").when(total >= 0.50, "MEDIUM").otherwise("LOW").alias("risk_category"),
        trend.alias("risk_trend"))
