"""Assembling, checking and completing the feature vectors."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import timeline as tl
from ..functions.bins import histogram_bin
from ..functions.joins import latest_n, lookup
from ..functions.select import lookup_constant, medians
from . import asof, profiles, velocity

HOUR, DAY = K.HOUR, K.DAY


def registry_select(df: DataFrame, domain: str, ids: list[str]) -> DataFrame:
    """The id columns and the registry's features, in order, as doubles with defaults filled."""
    defaults = K.VECTOR_DEFAULTS[domain]
    have = set(df.columns)
    cols = []
    for f in K.REGISTRY[domain]:
        d = F.lit(float(defaults.get(f, 0.0)))
        cols.append((F.coalesce(F.col(f).cast("double"), d) if f in have else d).alias(f))
    return df.select(*ids, *cols)


def _user_timeline(txn: DataFrame, auth: DataFrame | None, confirmed: DataFrame | None, specs: dict) -> DataFrame:
    """All sliding user measures by txn_id, in one shuffle; failed logins and confirmed frauds ride along as rows."""
    zero = F.lit(0).cast("long")
    one = F.lit(1).cast("long")
    both = txn.select("*", zero.alias("_auth"), zero.alias("_fraud"), one.alias("_txn"))
    if auth is not None:
        extra = auth.select("user_id", "us", one.alias("_auth"), zero.alias("_fraud"), zero.alias("_txn"))
        both = both.unionByName(extra, allowMissingColumns=True)
    if confirmed is not None:
        extra = confirmed.select("user_id", "us", zero.alias("_auth"), one.alias("_fraud"), zero.alias("_txn"))
        both = both.unionByName(extra, allowMissingColumns=True)
    return tl.trailing(both, ["user_id"], "us", specs, keep=["txn_id"], asking=F.col("_txn") == 1, last=tl.last_time(txn))


def fraud_vector(txn: DataFrame, auth: DataFrame, accounts: DataFrame, confirmed: DataFrame, devices: DataFrame | None,
                 keep: list[str] | None = None, arrivals: DataFrame | None = None) -> DataFrame:
    """The 13 fraud features of every transaction.

    ``auth`` (user_id, us): failed logins; ``accounts`` (user_id, created_us); ``confirmed``
    (user_id, us): times at which a fraud label arrived; ``devices``: a device profile. With ``arrivals`` (txn_id, label, us:
    when the label arrived) devices are seen as they were before each transaction instead.
    """
    x = F.when(F.col("_txn") == 1, F.col("cents")).otherwise(F.lit(0).cast("long"))
    n = F.col("_txn")
    specs = {
        "transaction_velocity_1h": (HOUR, n, n), "transaction_velocity_24h": (DAY, n, n),
        "_n7": (7 * DAY, n, n), "_s7": (7 * DAY, x, x),
        "failed_login_attempts_24h": (DAY, F.col("_auth"), F.col("_auth")),
        "_frauds": (DAY, F.col("_fraud"), F.lit(0).cast("long")),
    }
    past = _user_timeline(txn.select("txn_id", "user_id", "us", "cents"), auth, confirmed, specs)
    past = past.select(
        "txn_id", "transaction_velocity_1h", "transaction_velocity_24h", "failed_login_attempts_24h",
        velocity._mean("_s7", "_n7").alias("avg_transaction_amount_7d"),
        (F.col("_frauds") > 0).cast("int").alias("historical_fraud_flag"))
    v = tl.attach(txn, past, velocity.geo_distance(txn))
    if arrivals is not None:
        seen = asof.device_profile(txn.select("txn_id", "user_id", "us", "device"), arrivals)
        v = tl.attach(v, seen.select("txn_id", "device_risk_score", "device_fraud_count", "distinct_user_count"))
    return finish_fraud(v, accounts, devices if arrivals is None else None, keep)


def finish_fraud(v: DataFrame, accounts: DataFrame, devices: DataFrame | None, keep: list[str] | None = None) -> DataFrame:
    """The fraud vector of transactions that carry what their users did before (and device columns, if ``devices`` is None)."""
    v = v if devices is None else profiles.device_lookup(v, devices)
    v = lookup(v, accounts.select("user_id", "created_us"), {"user_id": "user_id"}, ["txn_id"])
    v = v.withColumns({
        "account_age_days": profiles.age_days(F.col("created_us"), F.col("us"), 365.0),
        "time_of_day": profiles.time_of_day(F.col("us")), "currency_risk": profiles.currency_risk(F.col("currency"))})
    return registry_select(v, "fraud", ["txn_id", "user_id", "us", *(keep or [])])


def aml_vector(txn: DataFrame, accounts: DataFrame, ip_geo: DataFrame, user_graph: DataFrame | None,
               keep: list[str] | None = None, snapshots: DataFrame | None = None) -> DataFrame:
    """The 22 AML features of every transaction; hour and day counts and the day's volume are the expiring counters.

    ``accounts`` (user_id, created_us, kyc_completeness_score); ``user_graph`` (user_id,
    network_risk_score, circular_transfer_flag, shared_device_cluster_size); ``txn`` may carry
    sender_wallet and receiver_wallet. With ``snapshots`` (user_id, us and those three) the newest before each transaction
    counts instead of ``user_graph``.
    """
    wide = velocity._specs(["n_30d", "cents_30d", "squares_30d"])
    past = velocity.distinct_30d(txn, wide).select("txn_id", *velocity.amounts_30d(), "device_count_30d", "ip_count_30d", "new_device_flag")
    shape = velocity.structuring(txn).select(
        "txn_id", F.col("count_1h").alias("velocity_1h"), F.col("count_24h").alias("velocity_24h"),
        (F.col("sum_24h") / 100.0).alias("total_volume_24h"), "structuring_score_24h", "rapid_drain_flag", "historical_structuring_flag")
    v = tl.attach(txn, past, shape)
    if snapshots is not None:
        v = tl.attach(v, asof.user_graph(txn.select("txn_id", "user_id", "us"), snapshots).select("txn_id", *asof.GRAPH))
    return finish_aml(v, accounts, ip_geo, user_graph if snapshots is None else None, keep)


def finish_aml(v: DataFrame, accounts: DataFrame, ip_geo: DataFrame, user_graph: DataFrame | None, keep: list[str] | None = None) -> DataFrame:
    """The AML vector of transactions that carry what their users did before (and graph features, if ``user_graph`` is None)."""
    wallets = {"sender_wallet", "receiver_wallet"} <= set(v.columns)
    v = profiles.ip_country_mismatch(v, ip_geo)
    v = lookup(v, accounts.select("user_id", "created_us", "kyc_completeness_score"), {"user_id": "user_id"}, ["txn_id"])
    v = v if user_graph is None else lookup(v, user_graph, {"user_id": "user_id"}, ["txn_id"])
    c = F.col("country")
    v = v.withColumns({
        "account_age_days": profiles.age_days(F.col("created_us"), F.col("us"), 365.0), "time_of_day": profiles.time_of_day(F.col("us")),
        "high_risk_country_flag": profiles.high_risk_country(c), "sanctions_proximity_score": profiles.sanctions_proximity(c)})
    if wallets:
        v = v.withColumn("is_cross_border", profiles.cross_border(F.col("sender_wallet"), F.col("receiver_wallet"), c))
    return registry_select(v, "aml", ["txn_id", "user_id", "us", *(keep or [])])


def merchant_vector(txn: DataFrame, aggregates: DataFrame, ratios: DataFrame | None, accounts: DataFrame, mcc: DataFrame,
                    keep: list[str] | None = None, arrivals: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """The 15 merchant features at every transaction of the merchant.

    ``accounts`` (merchant_id, created_us, mcc); ``mcc`` (mcc, mcc_risk_score). With ``arrivals`` (txn_id, label, us) and
    ``scores`` (user_id, us, milli) the ratios are those known before each transaction instead of ``ratios``.
    """
    v = velocity.merchant_velocity(txn)
    v = v.withColumnRenamed("count_1h", "transaction_count_1h").withColumnRenamed("count_24h", "transaction_count_24h")
    v = v.drop("sum_1h", "sum_24h")
    v = velocity.with_hourly_past(v, txn, "merchant_id").withColumn("velocity_spike_flag", velocity.spike_flag(F.col("transaction_count_1h"))).drop("past_n", "past_hours")
    if arrivals is not None:
        known = asof.merchant_ratios(txn.select("txn_id", "merchant_id", "user_id", "us", "country"), arrivals, scores)
        v = tl.attach(v, known.drop("merchant_id", "user_id", "us", "country"))
    return finish_merchant(v, aggregates, ratios if arrivals is None else None, accounts, mcc, keep)


def finish_merchant(v: DataFrame, aggregates: DataFrame, ratios: DataFrame | None, accounts: DataFrame, mcc: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The merchant vector of transactions that carry what their merchants did before (and the ratios, if ``ratios`` is None)."""
    profile = profiles.mcc_risk(accounts, mcc).select("merchant_id", "created_us", "mcc_risk_score")
    profile = profile.join(aggregates, "merchant_id", "full")
    profile = profile if ratios is None else profile.join(ratios, "merchant_id", "full")
    v = lookup(v, profile, {"merchant_id": "merchant_id"}, ["txn_id"])
    v = v.withColumn("account_age_days", profiles.age_days(F.col("created_us"), F.col("us"), 0.0))
    return registry_select(v, "merchant", ["txn_id", "merchant_id", "us", *(keep or [])])


def override_flags(txn: DataFrame) -> DataFrame:
    """Override inputs of the fraud decision; needs the J1 flags and session counters on the row."""
    return txn.select(
        "*", F.coalesce(F.upper("country").isin(K.SANCTIONED_OVERRIDE), F.lit(False)).cast("int").alias("sanctioned_country"),
        (F.col("count_1h") > 20).cast("int").alias("velocity_anomaly"), F.lit(0).alias("new_account_high_amount"))


def schema_hash(domain: str) -> str:
    body = json.dumps({"name": f"{domain}_features", "version": K.REGISTRY_VERSION, "features": K.REGISTRY[domain]}, sort_keys=True)
    return hashlib.sha256(body.encode()).hexdigest()[:16]


def invalid_vector(domain: str) -> Column:
    bad = None
    for f in K.REGISTRY[domain]:
        b = F.col(f).isNull() | F.isnan(f)
        bad = b if bad is None else bad | b
    return bad


def vector_contract(df: DataFrame, domain: str) -> DataFrame:
    """Per feature: bad values; beside them the rows with any bad value and the registry identity."""
    feats = K.REGISTRY[domain]
    one = df.agg(
        *[F.count_if(F.col(f).isNull() | F.isnan(f)).alias(f) for f in feats],
        F.count_if(invalid_vector(domain)).alias("_invalid"), F.count(F.lit(1)).alias("_rows"))
    return one.unpivot(["_rows", "_invalid"], feats, "feature", "bad_values").select(
        "feature", "bad_values", F.col("_invalid").alias("invalid_rows"), F.col("_rows").alias("rows"),
        F.lit(schema_hash(domain)).alias("schema_hash"))


def population_priors(snapshots: DataFrame, domain: str, newest: int | None = None) -> DataFrame:
    """Median, mean, histogram mode, deviation and count per feature over all (or the ``newest``) snapshots.

    The mode is the middle of the first fullest of ``min(50, n // 2 + 1)`` equal bins; a constant
    feature gets a range of one around its value. Features with fewer than 5 values are left out.
    """
    feats = K.REGISTRY[domain]
    recent = latest_n(snapshots, newest, "us", F.col("txn_id"))
    long = recent.unpivot(["txn_id"], feats, "feature", "value").filter(F.col("value").isNotNull() & ~F.isnan("value"))
    stats = long.groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.count("value").alias("n"), F.min("value").alias("lo0"), F.max("value").alias("hi0")).filter("n >= 5")
    known = {r["feature"]: r["n"] for r in stats.select("feature", "n").collect()}  # one row per registry feature
    stats = stats.withColumn("median", lookup_constant(medians(long, "feature", "value", known), F.col("feature")))
    flat = F.col("lo0") == F.col("hi0")
    stats = stats.select(
        "*", F.when(flat, F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
        F.when(flat, F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"),
        F.least(F.lit(50), F.floor(F.col("n") / 2) + 1).cast("long").alias("bins"))
    b = histogram_bin(F.col("value"), F.col("lo"), F.col("hi"), F.col("bins"))
    binned = long.join(F.broadcast(stats), "feature").select("feature", b.alias("bin"))  # one row per registry feature
    fullest = binned.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("c")).groupBy("feature").agg(
        F.min_by("bin", F.struct((-F.col("c")).alias("c"), F.col("bin"))).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    return stats.join(fullest, "feature").select(
        "feature", F.round("median", 4).alias("median"), F.round("mean", 4).alias("mean"),
        F.round(F.col("lo") + (F.col("bin") + 0.5) * width, 4).alias("mode"), F.round("std", 4).alias("std"), "n")


def blend_prior(prior: Column, value: Column, n: Column, k: float = 10.0) -> Column:
    """Shrink a user's own value towards the prior: weight n/(n+k)."""
    w = n / (n + F.lit(k))
    return F.when(n <= 0, prior).otherwise((1.0 - w) * prior + w * value)


def impute_defaults(df: DataFrame, priors: DataFrame, domain: str) -> DataFrame:
    """Missing features: computed median, else the fixed default. ``priors``: feature, median."""
    feats = K.REGISTRY[domain]
    wide = priors.groupBy().agg(*[F.max(F.when(F.col("feature") == f, F.col("median"))).alias(f"_m_{f}") for f in feats])
    fixed = dict(zip(feats, K.PRIOR_DEFAULTS[domain]))
    ids = [c for c in df.columns if c not in feats]
    j = df.join(F.broadcast(wide))  # one row
    return j.select(*ids, *[
        F.coalesce(F.nanvl(F.col(f), F.lit(None).cast("double")), F.col(f"_m_{f}"), F.lit(float(fixed[f]))).alias(f) for f in feats])


def feature_coverage(df: DataFrame, domain: str) -> DataFrame:
    """Share of features per row that differ from the prior default by more than 1e-6."""
    total = F.lit(0)
    for f, d in zip(K.REGISTRY[domain], K.PRIOR_DEFAULTS[domain]):
        total = total + F.when(F.abs(F.col(f) - F.lit(float(d))) > 1e-6, 1).otherwise(0)
    return df.withColumn("covered", total).withColumn("coverage", total / F.lit(float(len(K.REGISTRY[domain]))))


def mean_coverage(df: DataFrame, domain: str) -> DataFrame:
    """Mean coverage over all rows of a domain (not just of the last row)."""
    c = feature_coverage(df, domain).agg(F.sum("covered").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return c.select(F.lit(domain).alias("domain"), (F.col("_s") / F.col("_n") / float(len(K.REGISTRY[domain]))).alias("coverage"))
