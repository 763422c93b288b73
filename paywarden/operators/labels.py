"""Label feedback: applying, auditing, propagating and counting labels; investigation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import DAY
from ..functions.joins import newest, top_n
from ..functions.timeline import neighbours


def apply_labels(predictions: DataFrame, events: DataFrame) -> DataFrame:
    """Predictions with the last event of each; events of unknown predictions change nothing.

    ``events``: event_id, prediction_id, label, us, labeled_by, source.
    """
    last = newest(events.select("prediction_id", "event_id", "label", "us", "labeled_by", "source"), ["prediction_id"], ["us", "event_id"])
    e = last.select("prediction_id", F.struct("label", "us", "labeled_by", "source").alias("_e"))
    j = predictions.join(e, "prediction_id", "left")
    hit = F.col("_e").isNotNull()
    kept = [c for c in predictions.columns if c not in ("label", "labeled_us")]
    return j.select(
        *kept, F.when(hit, F.col("_e.label")).otherwise(F.col("label")).alias("label"),
        F.when(hit, F.col("_e.us")).otherwise(F.col("labeled_us")).alias("labeled_us"),
        F.col("_e.labeled_by").alias("labeled_by"), F.col("_e.source").alias("label_source"))


def label_audit(predictions: DataFrame, events: DataFrame) -> DataFrame:
    """One row per accepted event with the label before it: the earlier event's, else the stored one."""
    e = neighbours(events, ["prediction_id"], "us", "event_id", {"_before": "label", "_before_id": "event_id"}, slice_us=30 * DAY)
    stored = predictions.select("prediction_id", F.col("label").alias("_stored"))
    j = e.join(stored, "prediction_id")
    previous = F.when(F.col("_before_id").isNotNull(), F.col("_before")).otherwise(F.col("_stored"))
    return j.select("event_id", "prediction_id", previous.alias("previous_label"), F.col("label").alias("new_label"),
                    "labeled_by", F.col("source").alias("label_source"), "us")


def label_errors(predictions: DataFrame, events: DataFrame) -> DataFrame:
    """Events whose prediction does not exist."""
    bad = events.join(predictions.select("prediction_id"), "prediction_id", "left_anti")
    return bad.select("event_id", "prediction_id", F.concat(F.lit("Prediction "), F.col("prediction_id").cast("string"), F.lit(" not found")).alias("error"))


def label_batch_summary(predictions: DataFrame, events: DataFrame) -> DataFrame:
    known = predictions.select("prediction_id", F.lit(1).alias("_k"))
    j = events.join(known, "prediction_id", "left")
    return j.agg(F.count(F.lit(1)).alias("total"), F.count("_k").alias("succeeded"), F.count_if(F.col("_k").isNull()).alias("failed"))


def _outcome(status: Column) -> tuple[Column, Column]:
    label = F.when(status == "CLOSED_CONFIRMED", 1).when(status == "CLOSED_FALSE_POSITIVE", 0)
    source = F.when(label == 1, "SAR_CONFIRMED").when(label == 0, "MANUAL_REVIEW")
    return label, source


def propagate_case_labels(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Label events of closed cases not yet propagated; a case without prediction is skipped.

    The target is the case's prediction, else the newest prediction (ties: highest id) of the
    transaction in entity_id.
    """
    label, source = _outcome(F.col("status"))
    closed = cases.filter(F.col("status").isin("CLOSED_CONFIRMED", "CLOSED_FALSE_POSITIVE") & ~F.col("propagated"))
    open_ = closed.select("case_id", "entity_id", F.col("prediction_id").alias("_direct"), label.alias("label"), source.alias("source"))
    wanted = open_.filter(F.col("_direct").isNull()).select(F.col("entity_id").alias("transaction_id")).distinct()
    found = predictions.join(wanted, "transaction_id", "left_semi").groupBy("transaction_id").agg(
        F.max(F.struct("created_us", "prediction_id")).alias("_n"))
    j = open_.join(found, open_["entity_id"] == found["transaction_id"], "left")
    target = F.coalesce("_direct", F.col("_n.prediction_id"))
    return j.withColumn("prediction_id", target).filter(F.col("prediction_id").isNotNull()).select("case_id", "prediction_id", "label", "source")


def mark_propagated(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Cases with ``propagated`` set where an event (case_id) was made of them, so that no later run makes it again."""
    done = events.select("case_id").distinct().withColumn("_done", F.lit(True))
    j = cases.join(done, "case_id", "left")
    return j.select(*[(F.col("propagated") | F.coalesce("_done", F.lit(False))).alias(c) if c == "propagated" else F.col(c) for c in cases.columns])


def auto_label_aged_reviews(predictions: DataFrame, now_us: int, limit: int | None = None) -> DataFrame:
    """Labels for confident reviews older than a day; with ``limit`` at most so many labels a run, oldest first."""
    old = predictions.filter((F.col("decision") == "REVIEW") & F.col("label").isNull() & (F.col("created_us") < now_us - DAY))
    sure = old.select("prediction_id", "score", "created_us").withColumn("label", F.when(F.col("score") > 0.9, 1).when(F.col("score") < 0.1, 0)).filter(F.col("label").isNotNull())
    return top_n(sure, limit, -F.col("created_us"), -F.col("prediction_id"))


def count_maturity(labelled: Column) -> Column:
    return F.when(labelled < 100, "COLD").when(labelled < 1000, "WARMING").when(labelled < 10000, "WARM").otherwise("HOT")


def label_statistics(predictions: DataFrame) -> DataFrame:
    """Counts per domain and in total (domain ALL), with the label-count maturity of each domain."""
    s = predictions.rollup("domain").agg(
        F.count(F.lit(1)).alias("total"), F.count("label").alias("labelled"), F.count_if(F.col("label") == 1).alias("positive"),
        F.count_if(F.col("label") == 0).alias("negative"), F.grouping("domain").alias("_g"))
    rate = F.when(F.col("total") > 0, F.round(F.col("labelled") / F.col("total"), 4))
    return s.select(
        F.when(F.col("_g") == 1, "ALL").otherwise(F.col("domain")).alias("domain"), "total", "labelled", "positive", "negative",
        (F.col("total") - F.col("labelled")).alias("unlabelled"), rate.alias("label_rate"), count_maturity(F.col("labelled")).alias("maturity"))


def case_update(cases: DataFrame, updates: DataFrame) -> DataFrame:
    """Cases after their newest update; empty notes, resolution and assignee keep the old value."""
    last = newest(updates, ["case_id"], ["us", "update_id"])
    u = last.select("case_id", F.struct("status", "assignee", "notes", "resolution", "us").alias("_u"))
    j = cases.join(u, "case_id", "left")

    def filled(name: str, old: Column) -> Column:
        new = F.col(f"_u.{name}")
        return F.coalesce(F.when(new != "", new), old).alias(name)

    kept = [c for c in cases.columns if c not in ("status", "assignee", "notes")]
    return j.select(*kept, F.coalesce("_u.status", "status").alias("status"), filled("assignee", F.col("assignee")),
                    filled("notes", F.col("notes")), filled("resolution", F.lit(None).cast("string")), F.col("_u.us").alias("updated_us"))


def closure_labels(updated: DataFrame) -> DataFrame:
    """Label events of cases that an update has closed."""
    label, source = _outcome(F.col("status"))
    closed = updated.filter(F.col("updated_us").isNotNull() & label.isNotNull() & F.col("prediction_id").isNotNull())
    return closed.select("case_id", "prediction_id", label.alias("label"), source.alias("source"), F.col("updated_us").alias("us"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in ``order`` with the total beside every row."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.orderBy(*order).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def case_page(cases: DataFrame, status: str | None = None, priority: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Cases newest first."""
    c = cases
    if status is not None:
        c = c.filter(F.col("status") == status)
    if priority is not None:
        c = c.filter(F.col("priority") == priority)
    return page(c, [F.col("created_us").desc(), F.col("case_id").desc()], limit, offset)
