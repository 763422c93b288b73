"""The scheduled jobs, as chains of operators on tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import cut
from ..operators import active, adwin, alerts, drift, labels, pseudo


def label_cycle(predictions: DataFrame, cases: DataFrame, queue: DataFrame, now_us: int) -> dict[str, DataFrame]:
    """Closed cases become AML labels, queues are expired and refilled, label counts are renewed.

    ``predictions`` holds all domains; the result has the label events, the cases with those marked that events were made of
    (to be stored, so that the next run makes none again), the new queue and the statistics.
    """
    aml = predictions.filter("domain = 'aml'").drop("domain")
    events = labels.propagate_case_labels(cases, aml).select(
        F.col("case_id").alias("event_id"), "prediction_id", "label", F.lit(now_us).cast("long").alias("us"), F.lit("case").alias("labeled_by"), "source")
    events = cut(events)
    marked = labels.mark_propagated(cases, events.select(F.col("event_id").alias("case_id")))
    done = labels.apply_labels(aml, events).withColumn("domain", F.lit("aml"))
    cols = ["domain", "prediction_id", "entity_id", "score", "created_us", "label"]
    current = predictions.filter("domain <> 'aml'").select(cols).unionByName(done.select(cols))
    kept = active.expire_queue(queue, now_us)
    fresh = [active.refresh_queue(current.filter(F.col("domain") == d), kept, d, now_us) for d in ("fraud", "aml", "merchant")]
    names = ["domain", "prediction_id", "entity_id", "score", "informativeness", "status", "expires_us"]
    filled = reduce(DataFrame.unionByName, [kept.select(names), *[f.select(names) for f in fresh]])
    return {"events": events, "cases": marked, "queue": filled, "statistics": labels.label_statistics(current)}


def drift_cycle(baseline: DataFrame, current: DataFrame, features: list[str], baseline_confidence: float, model_version: str) -> dict[str, DataFrame]:
    """The drift report on stored scores and the alert messages it calls for."""
    report = cut(drift.drift_report(baseline, current, features, baseline_confidence, model_version))
    raised = report.select("model_version", F.posexplode("alerts").alias("alert_id", "message"), F.when(F.col("retrain_recommended") == 1, "CRITICAL").otherwise("WARNING").alias("severity"))
    return {"report": report, "alerts": alerts.alert_fanout(raised)}


def ssl_cycle(predictions: DataFrame, existing_transfers: DataFrame) -> dict[str, DataFrame]:
    """Which techniques to run per domain, and the cross-domain label transfers of this round."""
    by_domain = {d: predictions.filter(F.col("domain") == d) for d in ("fraud", "aml", "merchant")}
    return {"plan": pseudo.ssl_plan(predictions), "transfers": pseudo.cross_domain_transfer(by_domain, existing_transfers)}


def monitor_cycle(values: DataFrame, bucket_us: int) -> tuple[DataFrame, DataFrame]:
    """Change alerts over stored values with the status per metric."""
    raised = cut(adwin.adwin_batch(values, bucket_us))
    return raised, adwin.monitor_status(values, raised)[0]
