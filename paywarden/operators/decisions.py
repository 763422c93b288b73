"""Score to decision, risk factors, cases, and the scored tables built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.joins import newest
from ..functions.timeline import SLICE, neighbours
from . import scoring
from .vector import invalid_vector

EARLY = ["COLD", "WARMING"]


def _said(*reasons: tuple[Column, str]) -> Column:
    """Names of the conditions that hold, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in reasons]))


def _verdict(decision: str, level: str, reasons: Column, tier: str | None = None) -> Column:
    parts = [F.lit(decision).alias("decision"), F.lit(level).alias("level"), reasons.alias("overrides")]
    if tier is not None:
        parts.append(F.lit(tier).alias("tier"))
    return F.struct(*parts)


def _only(reason: str) -> Column:
    return F.array(F.lit(reason))


def fraud_decide(score: Column, flags: dict[str, Column], confidence: Column, maturity: Column,
                 thresholds: dict[str, float] | None = None) -> Column:
    """Struct (decision, level, overrides). ``flags``: sanctioned_country, blacklisted_device,
    blacklisted_ip, blacklisted_user, velocity_anomaly, new_account_high_amount (booleans)."""
    t = thresholds or K.FRAUD_THRESHOLDS
    fast, fresh = flags["velocity_anomaly"], flags["new_account_high_amount"]
    below = score < t["review"]
    early = maturity.isin(EARLY)
    s = F.lit(1.0) - confidence * 0.5
    s = F.when(early, F.least(s * 1.3, F.lit(1.0))).otherwise(s)
    plain = (confidence >= 0.8) & (maturity == "HOT")

    def limit(name: str, share: float) -> Column:
        return F.when(plain, F.lit(t[name])).otherwise(F.lit(t[name]) * (1 - s * share))

    soft = [(fast, "VELOCITY_ANOMALY"), (fresh, "NEW_ACCOUNT_HIGH_AMOUNT")]
    watch = (confidence < 0.5) & early & (score >= limit("approve", 0.2) * 0.7)
    review = score >= limit("review", 0.15)
    return (
        F.when(flags["sanctioned_country"], _verdict("BLOCK", "CRITICAL", _only("SANCTIONED_COUNTRY")))
        .when(flags["blacklisted_device"], _verdict("BLOCK", "CRITICAL", _only("BLACKLISTED_DEVICE")))
        .when(flags["blacklisted_ip"], _verdict("BLOCK", "CRITICAL", _only("BLACKLISTED_IP")))
        .when(flags["blacklisted_user"], _verdict("BLOCK", "CRITICAL", _only("BLACKLISTED_USER")))
        .when(fast & below, _verdict("REVIEW", "MEDIUM", _only("VELOCITY_ANOMALY")))
        .when(fresh & below, _verdict("REVIEW", "MEDIUM", _only("NEW_ACCOUNT_HIGH_AMOUNT")))
        .when(score >= limit("block", 0.1), _verdict("BLOCK", "CRITICAL", _said(*soft)))
        .when(review & (score >= 0.80), _verdict("REVIEW", "HIGH", _said(*soft)))
        .when(review, _verdict("REVIEW", "MEDIUM", _said(*soft)))
        .when(watch, _verdict("MONITOR", "LOW", _said(*soft, (F.lit(True), "LOW_CONFIDENCE_MONITOR"))))
        .otherwise(_verdict("APPROVE", "LOW", _said(*soft)))
    )


def _factor(confidence: Column, maturity: Column) -> Column:
    return (F.when((confidence < 0.5) & maturity.isin(EARLY), 0.85).when((confidence >= 0.8) & (maturity == "HOT"), 1.0)
            .otherwise(1.0 - (1.0 - confidence) * 0.15))


def aml_decide(score: Column, flags: dict[str, Column], confidence: Column, maturity: Column,
               thresholds: dict[str, float] | None = None) -> Column:
    """``flags``: sanctions_match, watchlist_hit, blacklisted_user, blacklisted_device,
    structuring_detected, velocity_spike."""
    t = thresholds or K.AML_THRESHOLDS
    f = _factor(confidence, maturity)
    lifted = score < F.when(maturity.isin(EARLY), t["high"] / 2.0).otherwise(t["high"])
    shaped, spike = flags["structuring_detected"], flags["velocity_spike"]
    soft = [(shaped, "STRUCTURING_DETECTED"), (spike, "VELOCITY_SPIKE")]
    medium = F.lit(t["medium"]) * f
    return (
        F.when(flags["sanctions_match"], _verdict("BLOCK", "CRITICAL", _only("SANCTIONS_MATCH")))
        .when(flags["watchlist_hit"], _verdict("BLOCK", "CRITICAL", _only("WATCHLIST_HIT")))
        .when(flags["blacklisted_user"], _verdict("BLOCK", "CRITICAL", _only("BLACKLISTED_USER")))
        .when(flags["blacklisted_device"], _verdict("BLOCK", "CRITICAL", _only("BLACKLISTED_DEVICE")))
        .when(shaped & lifted, _verdict("REVIEW", "HIGH", _only("STRUCTURING_DETECTED")))
        .when(spike & lifted, _verdict("REVIEW", "MEDIUM", _only("VELOCITY_SPIKE")))
        .when(score >= F.lit(t["critical"]) * f, _verdict("BLOCK", "CRITICAL", _said(*soft)))
        .when(score >= F.lit(t["high"]) * f, _verdict("REVIEW", "HIGH", _said(*soft)))
        .when(score >= medium, _verdict("MONITOR", "MEDIUM", _said(*soft)))
        .when((confidence < 0.5) & (score >= medium * 0.7),
              _verdict("MONITOR", "LOW", _said(*soft, (F.lit(True), "LOW_CONFIDENCE_MONITOR"))))
        .otherwise(_verdict("APPROVE", "LOW", _said(*soft)))
    )


def merchant_decide(score: Column, chargeback_rate: Column, fraud_rate: Column, velocity_spike: Column,
                    confidence: Column, maturity: Column, thresholds: dict[str, float] | None = None) -> Column:
    """Struct with the merchant tier as well."""
    t = thresholds or K.MERCHANT_THRESHOLDS
    f = _factor(confidence, maturity)
    bad = fraud_rate >= 0.05
    soft = [(bad, "HIGH_FRAUD_RATE"), (velocity_spike, "VELOCITY_SPIKE")]
    enhanced = F.lit(t["enhanced"]) * f
    return (
        F.when(chargeback_rate >= 0.10, _verdict("BLOCK", "CRITICAL", _only("EXCESSIVE_CHARGEBACKS"), "BLOCKED"))
        .when(bad & (score < t["restricted"]), _verdict("REVIEW", "HIGH", _only("HIGH_FRAUD_RATE"), "RESTRICTED"))
        .when(velocity_spike & (score < t["enhanced"]), _verdict("REVIEW", "MEDIUM", _said(*soft), "ENHANCED"))
        .when(score >= F.lit(t["blocked"]) * f, _verdict("BLOCK", "CRITICAL", _said(*soft), "BLOCKED"))
        .when(score >= F.lit(t["restricted"]) * f, _verdict("REVIEW", "HIGH", _said(*soft), "RESTRICTED"))
        .when(score >= enhanced, _verdict("MONITOR", "MEDIUM", _said(*soft), "ENHANCED"))
        .when((confidence < 0.5) & (score >= enhanced * 0.7),
              _verdict("MONITOR", "LOW", _said(*soft, (F.lit(True), "LOW_CONFIDENCE_MONITOR")), "ENHANCED"))
        .otherwise(_verdict("APPROVE", "LOW", _said(*soft), "STANDARD"))
    )


def aml_risk_factors(overrides: Column) -> Column:
    c = F.col
    found = _said(
        (c("velocity_1h") > 5, "velocity_spike"), (c("high_risk_country_flag") > 0, "high_risk_country"),
        (c("new_device_flag") > 0, "new_device"), (c("sanctions_proximity_score") > 0.3, "sanctions_proximity"),
        (c("structuring_score_24h") > 0.3, "structuring_pattern"), (c("network_risk_score") > 0.5, "network_risk"),
        (c("rapid_drain_flag") > 0, "rapid_drain"), (c("ip_country_mismatch") > 0, "ip_country_mismatch"))
    return F.slice(F.concat(overrides, found), 1, 10)


def merchant_risk_factors(overrides: Column) -> Column:
    c = F.col
    found = _said(
        (c("chargeback_rate_90d") > 0.03, "high_chargeback_rate"), (c("fraud_transaction_rate") > 0.02, "high_fraud_rate"),
        (c("velocity_spike_flag") > 0, "velocity_spike"), (c("high_risk_customer_ratio") > 0.15, "high_risk_customers"),
        (c("cross_border_ratio") > 0.3, "high_cross_border_ratio"), (c("mcc_risk_score") > 0.5, "high_risk_mcc"),
        (c("account_age_days") < 30, "new_merchant"), (c("avg_customer_risk_score") > 0.4, "risky_customer_base"))
    return F.slice(F.concat(overrides, found), 1, 10)


def fail_closed(domain: str, score: Column, verdict: Column) -> tuple[Column, Column]:
    """(score, verdict) with invalid vectors blocked: a bad row never fails the job and never passes."""
    bad = invalid_vector(domain)
    reason = "MODEL_FAILURE_FAIL_CLOSED" if domain == "fraud" else "FAIL_CLOSED"
    blocked = _verdict("BLOCK", "CRITICAL", _only(reason), "BLOCKED" if domain == "merchant" else None)
    return F.when(bad, F.lit(1.0)).otherwise(score), F.when(bad, blocked).otherwise(verdict)


def _finish(v: DataFrame, domain: str, score: Column, confidence: Column, verdict_of) -> DataFrame:
    s = v.withColumns({"_score": score, "_conf": confidence})
    final, verdict = fail_closed(domain, F.col("_score"), verdict_of(F.col("_score"), F.col("_conf")))
    parts = ["decision", "level", "overrides"] + (["tier"] if domain == "merchant" else [])
    s = s.withColumns({"_v": verdict, "score": final})
    return s.select(*v.columns, "score", *[F.col(f"_v.{p}").alias(p) for p in parts], F.col("_conf").alias("confidence"))


def _scored(domain: str, cold: Column, maturity: Column, anomaly, ensemble, ml, calibrated) -> tuple[Column, Column]:
    """Blended score; rows without a model's own score fall back to the rules, and count as not calibrated."""
    none = F.lit(None).cast("double")
    rules = scoring.heuristic(domain)
    own = F.lit(False) if ml is None else ml.isNotNull()
    quality = own & (F.lit(calibrated) if isinstance(calibrated, bool) else F.coalesce(calibrated, F.lit(False)))
    return scoring.blend_by_maturity(rules if ml is None else F.coalesce(ml, rules), none if anomaly is None else anomaly,
                                     none if ensemble is None else ensemble, cold, maturity, quality)


def fraud_score_batch(v: DataFrame, maturity: Column, anomaly: Column | None = None, ensemble: Column | None = None,
                      ml: Column | None = None, calibrated: bool | Column = False) -> DataFrame:
    """Score and decide fraud vectors that also carry the six override flags (0/1).

    ``ml`` is a trained model's score (null: none, the rules stand in), ``calibrated`` whether it was calibrated.
    """
    names = ["sanctioned_country", "blacklisted_device", "blacklisted_ip", "blacklisted_user", "velocity_anomaly", "new_account_high_amount"]
    flags = {n: F.col(n) == 1 for n in names}
    cold = scoring.fraud_cold(flags["velocity_anomaly"], flags["new_account_high_amount"])
    score, conf = _scored("fraud", cold, maturity, anomaly, ensemble, ml, calibrated)
    return _finish(v, "fraud", score, conf, lambda s, c: fraud_decide(s, flags, c, maturity))


def aml_score_batch(v: DataFrame, maturity: Column, anomaly: Column | None = None, ensemble: Column | None = None,
                    ml: Column | None = None, calibrated: bool | Column = False) -> DataFrame:
    """Score and decide AML vectors with country, screening flags, blacklist flags and velocity_spike (0/1)."""
    names = ["sanctions_match", "watchlist_hit", "blacklisted_user", "blacklisted_device", "velocity_spike"]
    flags = {n: F.col(n) == 1 for n in names}
    flags["structuring_detected"] = F.coalesce(F.col("structuring_score_24h") > 0.5, F.lit(False))
    score, conf = _scored("aml", scoring.aml_cold(), maturity, anomaly, ensemble, ml, calibrated)
    out = _finish(v, "aml", scoring.aml_country_bump(score, F.col("country")), conf, lambda s, c: aml_decide(s, flags, c, maturity))
    return out.withColumn("risk_factors", aml_risk_factors(F.col("overrides")))


def merchant_score_batch(v: DataFrame, maturity: Column, anomaly: Column | None = None, ensemble: Column | None = None,
                         ml: Column | None = None, calibrated: bool | Column = False) -> DataFrame:
    score, conf = _scored("merchant", scoring.merchant_cold(), maturity, anomaly, ensemble, ml, calibrated)
    out = _finish(v, "merchant", score, conf, lambda s, c: merchant_decide(
        s, F.col("chargeback_rate_90d"), F.col("fraud_transaction_rate"), F.col("velocity_spike_flag") > 0, c, maturity))
    return out.withColumn("risk_factors", merchant_risk_factors(F.col("overrides")))


def rescore_summary(scored: DataFrame, job_type: str) -> DataFrame:
    """One row about a rescoring job; rows blocked for an invalid vector count as failed. A job that processed anything is complete."""
    failed = F.exists("overrides", lambda o: o.endswith("FAIL_CLOSED"))
    s = scored.agg(F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("failed"))
    return s.select(F.lit(job_type).alias("job_type"), "total", (F.col("total") - F.col("failed")).alias("processed"), "failed",
                    F.when(F.col("total") > F.col("failed"), "COMPLETED").otherwise("FAILED").alias("status"))


def aml_cases(scored: DataFrame) -> DataFrame:
    """An OPEN case for every HIGH or CRITICAL row."""
    first = F.when(F.size("overrides") > 0, F.col("overrides")[0]).otherwise("HIGH_RISK_SCORE")
    return scored.filter(F.col("level").isin("HIGH", "CRITICAL")).select(
        F.lit("TRANSACTION").alias("entity_type"), F.col("txn_id").alias("entity_id"), first.alias("trigger_reason"), "score",
        F.col("level").alias("priority"), F.lit("OPEN").alias("status"))


def explain(ids: DataFrame, predictions: DataFrame, vectors: DataFrame, domain: str) -> DataFrame:
    """Top contributions of the newest prediction of each asked transaction.

    ``ids``: transaction_id; ``predictions``: prediction_id, transaction_id, created_us, score;
    ``vectors``: txn_id and the features.
    """
    asked = predictions.join(ids.select("transaction_id").distinct(), "transaction_id", "left_semi")
    last = newest(asked.select("transaction_id", "prediction_id", "created_us", "score"), ["transaction_id"], ["created_us", "prediction_id"])
    j = last.join(vectors, last["transaction_id"] == vectors["txn_id"])
    return j.select("transaction_id", "prediction_id", "score", scoring.top_impacts(domain).alias("top_features"))


def scoring_rollup(predictions: DataFrame) -> DataFrame:
    """Counts by decision and level with all totals, and cumulative score buckets."""
    le = [x / 10 for x in range(1, 11)]
    return predictions.cube("decision", "level").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("score") <= b).alias(f"le_{int(b * 10):02d}") for b in le])


def latency_histogram(measured: DataFrame, key: str, bounds: tuple[int, ...] = (10, 25, 50, 100, 200, 500, 1000)) -> DataFrame:
    """Cumulative latency buckets per key; ``measured`` has latency_ms."""
    return measured.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("latency_ms") <= b).alias(f"le_{b}") for b in bounds])


def count_by(rows: DataFrame, column: str) -> DataFrame:
    """Rows per value: tiers, or kinds of watchlist match."""
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def merchant_tier_changes(predictions: DataFrame) -> DataFrame:
    """Rows whose tier differs from the merchant's previous one; has merchant_id, tier, us, prediction_id."""
    p = neighbours(predictions.select("merchant_id", "tier", "us", "prediction_id"), ["merchant_id"], "us", "prediction_id",
                   {"previous_tier": "tier"}, slice_us=SLICE)
    return p.filter(F.col("previous_tier").isNotNull() & (F.col("previous_tier") != F.col("tier"))).select(
        "merchant_id", "previous_tier", F.col("tier").alias("new_tier"), F.col("us").alias("at_us"))
