"""Rule scores per row, their explanation, and the blend by data maturity. Column math only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


def band(c: Column, *steps: tuple[float, float]) -> Column:
    """Points of the first limit that ``c`` exceeds, else 0."""
    out = None
    for limit, points in steps:
        out = F.when(c > limit, F.lit(points)) if out is None else out.when(c > limit, F.lit(points))
    return out.otherwise(F.lit(0.0))


def flag(c: Column, points: float) -> Column:
    return F.when(c > 0, F.lit(points)).otherwise(F.lit(0.0))


def _either(cond: Column, points: float, cond2: Column | None = None, points2: float = 0.0) -> Column:
    w = F.when(cond, F.lit(points))
    return (w.when(cond2, F.lit(points2)) if cond2 is not None else w).otherwise(F.lit(0.0))


def _clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def _total(base: float, terms: dict[str, Column]) -> Column:
    out = F.lit(base)
    for t in terms.values():
        out = out + t
    return F.round(_clamp(out), 4)


def _positive_or(c: Column, fallback: float) -> Column:
    return F.when(c > 0, c).otherwise(F.lit(fallback))


def fraud_terms() -> dict[str, Column]:
    c = F.col
    amount, age = c("amount"), c("account_age_days")
    ratio = amount / _positive_or(c("avg_transaction_amount_7d"), K.FRAUD_AVG_FALLBACK)
    return {
        "amount": band(ratio, (5, 0.15), (3, 0.08), (2, 0.04)),
        "transaction_velocity_1h": band(c("transaction_velocity_1h"), (10, 0.15), (5, 0.08)),
        "transaction_velocity_24h": band(c("transaction_velocity_24h"), (30, 0.08), (15, 0.04)),
        "failed_login_attempts_24h": band(c("failed_login_attempts_24h"), (5, 0.10), (2, 0.05)),
        "account_age_days": _either((age < 7) & (amount > 500), 0.15, (age < 30) & (amount > 1000), 0.08),
        "historical_fraud_flag": flag(c("historical_fraud_flag"), 0.20),
        "device_risk_score": c("device_risk_score") * 0.12,
        "device_fraud_count": F.least(c("device_fraud_count") / 5.0, F.lit(1.0)) * 0.10,
        "distinct_user_count": band(c("distinct_user_count"), (3, 0.05)),
        "geo_distance_from_last_tx": band(c("geo_distance_from_last_tx"), (2000, 0.08), (500, 0.04)),
        "time_of_day": _either((c("time_of_day") < 0.21) | (c("time_of_day") > 0.92), 0.04),
        "currency_risk": c("currency_risk") * 0.08,
    }


def aml_terms() -> dict[str, Column]:
    c = F.col
    age, vol, kyc = c("account_age_days"), c("total_volume_24h"), c("kyc_completeness_score")
    ratio = c("amount") / _positive_or(c("avg_amount_30d"), K.AML_AVG_FALLBACK)
    return {
        "amount": band(ratio, (10, 0.10), (5, 0.05)),
        "velocity_1h": band(c("velocity_1h"), (15, 0.12), (8, 0.06)),
        "total_volume_24h": band(vol, (50000, 0.10), (20000, 0.05)),
        "is_cross_border": flag(c("is_cross_border"), 0.08),
        "account_age_days": _either((age < 14) & (vol > 5000), 0.10, age < 30, 0.03),
        "device_count_30d": band(c("device_count_30d"), (5, 0.05)),
        "ip_count_30d": band(c("ip_count_30d"), (10, 0.05)),
        "new_device_flag": flag(c("new_device_flag"), 0.04),
        "kyc_completeness_score": _either(kyc < 0.3, 0.10, kyc < 0.6, 0.05),
        "network_risk_score": c("network_risk_score") * 0.10,
        "circular_transfer_flag": flag(c("circular_transfer_flag"), 0.15),
        "shared_device_cluster_size": band(c("shared_device_cluster_size"), (5, 0.06)),
        "high_risk_country_flag": flag(c("high_risk_country_flag"), 0.15),
        "sanctions_proximity_score": band(c("sanctions_proximity_score"), (0.7, 0.20), (0.3, 0.10)),
        "ip_country_mismatch": flag(c("ip_country_mismatch"), 0.06),
        "historical_structuring_flag": flag(c("historical_structuring_flag"), 0.12),
        "structuring_score_24h": band(c("structuring_score_24h"), (0.7, 0.15), (0.4, 0.08)),
        "rapid_drain_flag": flag(c("rapid_drain_flag"), 0.12),
    }


def merchant_terms() -> dict[str, Column]:
    c = F.col
    age = c("account_age_days")
    spread = c("std_transaction_amount_30d") / _positive_or(c("avg_transaction_amount_30d"), K.MERCHANT_AVG_FALLBACK)
    return {
        "chargeback_rate_90d": band(c("chargeback_rate_90d"), (0.018, 0.25), (0.009, 0.15), (0.005, 0.08)),
        "refund_rate_90d": band(c("refund_rate_90d"), (0.15, 0.12), (0.08, 0.06)),
        "fraud_transaction_rate": band(c("fraud_transaction_rate"), (0.05, 0.20), (0.02, 0.12), (0.01, 0.06)),
        "account_age_days": _either(age < 30, 0.10, age < 90, 0.05),
        "velocity_spike_flag": flag(c("velocity_spike_flag"), 0.10),
        "transaction_count_1h": band(c("transaction_count_1h"), (100, 0.06)),
        "transaction_count_24h": band(c("transaction_count_24h"), (500, 0.04)),
        "high_risk_customer_ratio": band(c("high_risk_customer_ratio"), (0.25, 0.10), (0.15, 0.05)),
        "cross_border_ratio": band(c("cross_border_ratio"), (0.5, 0.06), (0.3, 0.03)),
        "mcc_risk_score": c("mcc_risk_score") * 0.08,
        "avg_customer_risk_score": c("avg_customer_risk_score") * 0.08,
        "std_transaction_amount_30d": band(spread, (3, 0.05)),
    }


def heuristic(domain: str) -> Column:
    """Score of the rule fallback that stands in for a trained model."""
    base = {"fraud": K.FRAUD_BASE, "aml": K.AML_BASE, "merchant": K.MERCHANT_BASE}[domain]
    return _total(base, {"fraud": fraud_terms, "aml": aml_terms, "merchant": merchant_terms}[domain]())


def impacts(domain: str) -> dict[str, Column]:
    """Contribution per registry feature: the rule terms, with an old account counting in favour
    and, for AML, incomplete KYC shown as negative."""
    terms = {"fraud": fraud_terms, "aml": aml_terms, "merchant": merchant_terms}[domain]()
    age, kyc = F.col("account_age_days"), F.col("kyc_completeness_score")
    risen = terms["account_age_days"]
    terms["account_age_days"] = F.when(risen > 0, risen).when(age > 365, F.lit(-0.02)).otherwise(F.lit(0.0))
    if domain == "aml":
        terms["kyc_completeness_score"] = _either(kyc < 0.3, -0.10, kyc < 0.6, -0.05)
    return {f: terms.get(f, F.lit(0.0)) for f in K.REGISTRY[domain]}


def top_impacts(domain: str, n: int = 10) -> Column:
    """The n largest contributions as (feature, value, impact), ties in registry order."""
    entries = [
        F.struct((-F.abs(i)).alias("k"), F.lit(pos).alias("pos"), F.lit(f).alias("feature"), F.col(f).alias("value"), i.alias("impact"))
        for pos, (f, i) in enumerate(impacts(domain).items())
    ]
    best = F.slice(F.sort_array(F.array(*entries)), 1, n)
    return F.transform(best, lambda e: F.struct(e["feature"].alias("feature"), e["value"].alias("value"), e["impact"].alias("impact")))


def fraud_cold(velocity_anomaly: Column, new_account_high_amount: Column) -> Column:
    """Rule score used while there is no labelled data."""
    c = F.col
    avg = _positive_or(c("avg_transaction_amount_7d"), 50.0)
    s = (F.lit(0.3) + _either(velocity_anomaly, 0.3) + _either(new_account_high_amount, 0.2) + _either(c("amount") > avg * 5, 0.2)
         + band(c("transaction_velocity_1h"), (10, 0.15)) + flag(c("historical_fraud_flag"), 0.2) + band(c("device_risk_score"), (0.5, 0.1)))
    return _clamp(s)


def aml_cold() -> Column:
    c = F.col
    s = (F.lit(0.2) + band(c("velocity_1h"), (10, 0.2)) + flag(c("high_risk_country_flag"), 0.25)
         + band(c("structuring_score_24h"), (0.5, 0.2)) + flag(c("rapid_drain_flag"), 0.15)
         + flag(c("circular_transfer_flag"), 0.15) + band(c("sanctions_proximity_score"), (0.3, 0.2)))
    return _clamp(s)


def merchant_cold() -> Column:
    c = F.col
    s = (F.lit(0.2) + band(c("chargeback_rate_90d"), (0.03, 0.3)) + band(c("fraud_transaction_rate"), (0.02, 0.25))
         + flag(c("velocity_spike_flag"), 0.15) + band(c("high_risk_customer_ratio"), (0.15, 0.1))
         + _either(c("account_age_days") < 30, 0.1) + band(c("mcc_risk_score"), (0.5, 0.1)))
    return _clamp(s)


def model_confidence(coverage: Column, maturity_confidence: Column, calibrated: bool | Column) -> Column:
    """Cube root of coverage x maturity x calibration quality (1.0 calibrated, 0.7 not)."""
    quality = F.when(F.lit(calibrated) if isinstance(calibrated, bool) else calibrated, 1.0).otherwise(0.7)
    return _clamp(F.pow(coverage * maturity_confidence * quality, F.lit(1.0 / 3.0)))


def blend_by_maturity(ml: Column, anomaly: Column, ensemble: Column, cold: Column, maturity: Column,
                      calibrated: bool | Column = False) -> tuple[Column, Column]:
    """(score, confidence): rules when COLD, then growing trust in the model. A null anomaly score is
    neutral; a null ensemble means none is loaded."""
    odd = F.coalesce(anomaly, F.lit(0.5))
    score = (F.when(maturity == "COLD", cold).when(maturity == "WARMING", F.lit(0.3) * ml + F.lit(0.7) * odd)
             .when(maturity == "WARM", F.lit(0.7) * ml + F.lit(0.3) * odd).otherwise(F.coalesce(ensemble, ml)))
    one = F.lit(1.0)
    conf = (F.when(maturity == "COLD", 0.1).when(maturity == "WARMING", 0.3)
            .when(maturity == "WARM", model_confidence(one, F.lit(0.7), calibrated))
            .when(ensemble.isNotNull(), 0.95).otherwise(model_confidence(one, one, calibrated)))
    return score, conf


def aml_country_bump(score: Column, country: Column) -> Column:
    listed = F.coalesce(F.upper(country).isin(K.AML_BUMP_COUNTRIES), F.lit(False))
    return F.when(listed, F.least(F.lit(1.0), score + 0.15)).otherwise(score)


def feature_importance(scored: DataFrame, domain: str) -> DataFrame:
    """Mean absolute contribution per feature over a scored table, beside the fixed weight.

    Contributions are summed in whole millionths, so the result does not depend on row order.
    """
    weights = K.HEURISTIC_WEIGHTS[domain]
    n = F.count(F.lit(1)).alias("_n")
    sums = [F.sum(F.round(F.abs(i) * 1_000_000).cast("long")).alias(f) for f, i in impacts(domain).items()]
    long = scored.agg(n, *sums).unpivot(["_n"], K.REGISTRY[domain], "feature", "_s")
    weight = F.create_map(*[x for f, w in weights.items() for x in (F.lit(f), F.lit(w))])
    return long.select("feature", (F.col("_s") / F.col("_n") / 1e6).alias("importance"), weight[F.col("feature")].alias("fixed_weight"))
