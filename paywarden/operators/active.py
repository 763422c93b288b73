"""Active learning: which unlabelled predictions to show to an analyst next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.joins import latest_n
from .labels import page

DAY, HOUR = K.DAY, K.HOUR


def informativeness(score: Column, domain: str, strategy: str, anomaly: Column | None = None) -> Column:
    near = F.least(*[F.abs(score - t) for t in K.AL_THRESHOLDS[domain]])
    uncertainty = F.greatest(F.lit(0.0), 1.0 - near)
    if strategy == "UNCERTAINTY":
        return uncertainty
    if strategy == "MARGIN":
        return 1.0 - F.abs(2.0 * score - 1.0)
    if strategy == "ENTROPY":
        p = F.greatest(F.lit(1e-10), F.least(F.lit(1.0 - 1e-10), score))
        return -(p * F.log2(p) + (1.0 - p) * F.log2(1.0 - p))
    if strategy == "DISAGREEMENT":
        return uncertainty if anomaly is None else F.coalesce(F.abs(score - anomaly), uncertainty)
    if strategy == "DENSITY_WEIGHTED":
        return uncertainty * (0.5 + 0.5 * (1.0 - 2.0 * F.abs(score - 0.5)))
    raise ValueError(f"unknown strategy {strategy}")


def refresh_queue(predictions: DataFrame, queue: DataFrame, domain: str, now_us: int, active: bool = True, newest: int | None = None) -> DataFrame:
    """New queue rows of a domain: the most informative of the unlabelled predictions of 30 days.

    Twice the daily budget is the length of the queue; ``newest`` looks only at so many. Ties go to the higher id.
    """
    strategy, daily, _ = K.AL_CONFIG[domain]
    waiting = queue.filter((F.col("domain") == domain) & F.col("status").isin("PENDING", "ASSIGNED")).select("prediction_id")
    fresh = predictions.filter(F.col("label").isNull() & (F.col("created_us") > now_us - 30 * DAY) & (F.col("created_us") <= now_us))
    if not active:
        fresh = fresh.filter(F.lit(False))
    open_ = fresh.select("prediction_id", "entity_id", "score", "created_us").join(waiting, "prediction_id", "left_anti")
    recent = latest_n(open_, newest, "created_us", F.col("prediction_id"))
    ranked = recent.withColumn("informativeness", F.round(informativeness(F.col("score"), domain, strategy), 4))
    top = ranked.orderBy(F.col("informativeness").desc(), F.col("prediction_id").desc()).limit(2 * daily)
    return top.select(F.lit(domain).alias("domain"), "prediction_id", "entity_id", "score", "informativeness", F.lit(strategy).alias("strategy"),
                      F.lit("PENDING").alias("status"), F.lit(now_us + 48 * HOUR).cast("long").alias("expires_us"))


def expire_queue(queue: DataFrame, now_us: int) -> DataFrame:
    late = (F.col("status") == "PENDING") & (F.col("expires_us") < now_us)
    return queue.withColumn("status", F.when(late, "EXPIRED").otherwise(F.col("status")))


def expired_count(queue: DataFrame, now_us: int) -> DataFrame:
    return queue.agg(F.count_if((F.col("status") == "PENDING") & (F.col("expires_us") < now_us)).alias("expired"))


def _best_first() -> list[Column]:
    return [F.col("informativeness").desc(), F.col("prediction_id").desc()]


def queue_page(queue: DataFrame, events: DataFrame, domain: str, now_us: int, limit: int = 50, offset: int = 0) -> DataFrame:
    """Pending rows of a domain, most informative first, with total and remaining daily budget."""
    pending = queue.filter((F.col("domain") == domain) & (F.col("status") == "PENDING"))
    today = now_us - now_us % DAY
    used = events.filter((F.col("domain") == domain) & (F.col("us") >= today) & (F.col("us") < today + DAY)).agg(F.count(F.lit(1)).alias("_u"))
    budget = F.greatest(F.lit(0), F.lit(K.AL_CONFIG[domain][1]) - F.col("_u"))
    return page(pending, _best_first(), limit, offset).join(F.broadcast(used)).withColumn("daily_budget_remaining", budget).drop("_u")  # one row


def queue_to_cases(queue: DataFrame, count: int) -> DataFrame:
    """AML cases for the most informative pending rows."""
    top = queue.filter("status = 'PENDING'").orderBy(*_best_first(), "domain").limit(count)
    return top.select("domain", "prediction_id", F.lit("PREDICTION").alias("entity_type"), F.col("entity_id"), F.lit("ACTIVE_LEARNING_QUEUE").alias("trigger_reason"),
                      F.coalesce("score", F.lit(0.5)).alias("score"), F.lit("HIGH").alias("priority"), F.lit("OPEN").alias("status"))


def mark_assigned(queue: DataFrame, cases: DataFrame) -> DataFrame:
    taken = cases.select("domain", "prediction_id", F.lit(1).alias("_t"))
    j = queue.join(taken, ["domain", "prediction_id"], "left")
    return j.withColumn("status", F.when(F.col("_t") == 1, "ASSIGNED").otherwise(F.col("status"))).drop("_t")


def budget_usage(events: DataFrame) -> DataFrame:
    """Labels given per domain, per day and per ISO week (from Monday), with what is left of the budget."""
    day = F.col("us") - F.pmod(F.col("us"), F.lit(DAY))
    week = day - F.pmod(day + 3 * DAY, F.lit(7 * DAY))
    per = events.select("domain", F.explode(F.array(
        F.struct(F.lit("DAY").alias("period"), day.alias("start_us")), F.struct(F.lit("WEEK").alias("period"), week.alias("start_us")))).alias("p"))
    used = per.groupBy("domain", "p.period", "p.start_us").agg(F.count(F.lit(1)).alias("used"))
    budget = F.lit(None).cast("long")
    for d, (_, daily, weekly) in K.AL_CONFIG.items():
        budget = F.when(F.col("domain") == d, F.when(F.col("period") == "DAY", daily).otherwise(weekly)).otherwise(budget)
    return used.select("*", F.greatest(F.lit(0), budget - F.col("used")).cast("long").alias("remaining"))


def al_metrics(queue: DataFrame) -> DataFrame:
    """Pending, labelled, mean informativeness of pending rows (in whole ten-thousandths inside), yield."""
    q = queue.groupBy("domain").agg(
        F.count_if(F.col("status") == "PENDING").alias("pending"), F.count_if(F.col("status") == "LABELED").alias("labelled"),
        F.sum(F.when(F.col("status") == "PENDING", F.round(F.col("informativeness") * 10000).cast("long"))).alias("_s"))
    total = F.greatest(F.lit(1), F.col("pending") + F.col("labelled"))
    mean = F.when(F.col("pending") > 0, F.col("_s") / F.col("pending") / 10000.0).otherwise(0.0)
    return q.select("domain", "pending", "labelled", mean.alias("mean_informativeness"), (F.col("labelled") / total).alias("yield"))
