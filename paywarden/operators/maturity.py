"""How far a domain's data has matured, from labels, coverage and stability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K

DAY, HOUR = K.DAY, K.HOUR


def maturity_signals(predictions: DataFrame, now_us: int) -> DataFrame:
    """Per domain: labelled rows, positive rate, and mean label delay in hours of the last 7 days."""
    recent = (F.col("created_us") > now_us - 7 * DAY) & F.col("labeled_us").isNotNull()
    s = predictions.groupBy("domain").agg(
        F.count("label").alias("sample_count"), F.count_if(F.col("label") == 1).alias("_p"),
        F.sum(F.when(recent, F.col("labeled_us") - F.col("created_us"))).alias("_d"), F.count_if(recent).alias("_n"))
    return s.select(
        "domain", "sample_count", F.when(F.col("sample_count") > 0, F.col("_p") / F.col("sample_count")).otherwise(0.0).alias("positive_rate"),
        F.when(F.col("_n") > 0, F.col("_d") / F.col("_n") / float(HOUR)).otherwise(0.0).alias("label_delay_hours"))


def feature_staleness(rows: DataFrame, now_us: int) -> DataFrame:
    """Median age in hours of feature rows per domain, from counts per distinct whole minute.

    Ages are grouped before the ordering, so the ordered side is bounded by the clock.
    """
    minute = 60_000_000
    age = F.lit(now_us) - F.col("us")
    counts = rows.groupBy("domain", ((age - F.pmod(age, F.lit(minute))) / minute).cast("long").alias("age_min")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("domain").agg((F.percentile("age_min", F.lit(0.5), F.col("n")) / 60.0).alias("feature_staleness_hours"))


def maturity_level(samples: Column, coverage: Column, psi: Column) -> Column:
    """COLD, WARMING, WARM or HOT; an unknown stability counts as unstable."""
    stable = F.coalesce(psi, F.lit(1.0)) <= 0.1
    return (F.when((samples < 100) | (coverage < 0.70), "COLD").when((samples < 1000) | (coverage < 0.90), "WARMING")
            .when((samples >= 10000) & stable, "HOT").otherwise("WARM"))


def percent(c: Column) -> Column:
    return F.format_string("%.2f%%", c * 100)


def maturity_report(signals: DataFrame, coverage: DataFrame, stability: DataFrame, staleness: DataFrame) -> DataFrame:
    """All signals per domain with level, blending weight, confidence floor and messages.

    ``coverage``: domain, feature_coverage; ``stability``: domain, psi; ``staleness`` as above.
    """
    j = signals.join(coverage, "domain", "left").join(stability, "domain", "left").join(staleness, "domain", "left")
    c = F.col
    cov = F.coalesce(c("feature_coverage"), F.lit(0.0))
    level = maturity_level(c("sample_count"), cov, c("psi"))

    def by_domain(pos: int) -> Column:
        out = F.lit((0.01, 0.10)[pos])
        for d, band in K.EXPECTED_RATES.items():
            out = F.when(c("domain") == d, F.lit(band[pos])).otherwise(out)
        return out

    low, high = (c("positive_rate") < by_domain(0)) & (c("sample_count") > 0), c("positive_rate") > by_domain(1)
    slow = c("label_delay_hours") > 72
    warnings = F.array_compact(F.array(
        F.when(low, F.concat(F.lit("Positive rate "), percent(c("positive_rate")), F.lit(" below expected minimum "), percent(by_domain(0))))
        .when(high, F.concat(F.lit("Positive rate "), percent(c("positive_rate")), F.lit(" above expected maximum "), percent(by_domain(1)))),
        F.when(slow, F.concat(F.lit("Label delay "), F.format_string("%.1f", c("label_delay_hours")), F.lit("h exceeds 72h target")))))
    advice = F.array_compact(F.array(
        F.when(low, "Check that labels arrive").when(high, "Check for labelling bias or data quality issues"),
        F.when(cov < 0.70, "Raise feature coverage"), F.when(slow, "Speed up label confirmation")))

    def of_level(table: dict[str, float]) -> Column:
        out = F.lit(0.0)
        for name, x in table.items():
            out = F.when(level == name, F.lit(x)).otherwise(out)
        return out

    return j.select(
        "domain", level.alias("level"), "sample_count", F.round("positive_rate", 6).alias("positive_rate"), F.round(cov, 6).alias("feature_coverage"),
        "feature_staleness_hours", F.round(F.coalesce("psi", F.lit(1.0)), 6).alias("distribution_stability"), F.round("label_delay_hours", 4).alias("label_delay_hours"),
        of_level(K.MATURITY_ALPHA).alias("alpha"), of_level(K.MATURITY_FLOOR).alias("confidence_floor"), warnings.alias("warnings"), advice.alias("recommendations"))
