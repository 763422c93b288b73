"""Has the distribution of scores, features, confidence or labels moved against a baseline?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeline as tl
from ..functions.bins import histogram_bin, sliced_by_value, value_slices


def _tagged(baseline: DataFrame, current: DataFrame, cols: list[str]) -> DataFrame:
    return baseline.select(*cols, F.lit(1).alias("_b"), F.lit(0).alias("_c")).unionByName(
        current.select(*cols, F.lit(0).alias("_b"), F.lit(1).alias("_c")))


def _psi_sum(counts: DataFrame, keys: list[str], bins: int, add: float) -> DataFrame:
    """PSI from bin counts (``b``, ``c`` per bin). Bins without rows on either side still count, so
    the sum over listed bins is completed with the missing ones."""
    totals = counts.groupBy(*keys).agg(F.sum("b").alias("nb"), F.sum("c").alias("nc"), F.count(F.lit(1)).alias("seen"),
                                       F.sort_array(F.collect_list(F.struct("bin", "b", "c"))).alias("list"))  # at most `bins` entries
    def term(b: Column, c: Column) -> Column:
        pb = (b + F.lit(add)) / (F.col("nb") + F.lit(add * bins))
        pc = (c + F.lit(add)) / (F.col("nc") + F.lit(add * bins))
        return (pc - pb) * F.log(pc / pb)
    listed = F.aggregate("list", F.lit(0.0), lambda acc, x: acc + term(x["b"], x["c"]))
    missing = (F.lit(bins) - F.col("seen")) * term(F.lit(0), F.lit(0))
    return totals.select(*keys, (listed + missing).alias("psi"))


def score_psi(baseline: DataFrame, current: DataFrame, score: str = "score", bins: int = 10, add: float = 1.0) -> DataFrame:
    """PSI over equal bins of [0, 1] with ``add`` added to every count; 0 without a baseline."""
    t = _tagged(baseline, current, [score])
    b = histogram_bin(F.col(score), F.lit(0.0), F.lit(1.0), F.lit(bins))
    counts = t.select(b.alias("bin"), "_b", "_c").filter("bin is not null").groupBy("bin").agg(F.sum("_b").alias("b"), F.sum("_c").alias("c"))
    psi = _psi_sum(counts, [], bins, add)
    some = baseline.limit(1).agg(F.count(F.lit(1)).alias("_has"))
    return psi.join(F.broadcast(some)).select(F.when(F.col("_has") > 0, F.coalesce("psi", F.lit(0.0))).otherwise(0.0).alias("psi"))  # one row


def feature_psi(baseline: DataFrame, current: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """PSI per feature over equal bins of its joint range, to 6 decimals.

    Only features the baseline has are compared. The ranges are one row per feature.
    """
    shared = [f for f in features if f in baseline.columns and f in current.columns]
    t = _tagged(baseline, current, shared)
    long = t.unpivot(["_b", "_c"], shared, "feature", "value").filter(F.col("value").isNotNull())
    span = long.groupBy("feature").agg(F.min("value").alias("lo0"), F.max("value").alias("hi0"))
    flat = F.col("lo0") == F.col("hi0")
    span = span.select("feature", F.when(flat, F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
                       F.when(flat, F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"))
    bin_ = histogram_bin(F.col("value"), F.col("lo"), F.col("hi"), F.lit(bins))
    counts = long.join(F.broadcast(span), "feature").groupBy("feature", bin_.alias("bin")).agg(F.sum("_b").alias("b"), F.sum("_c").alias("c"))
    return _psi_sum(counts, ["feature"], bins, 1.0).select("feature", F.round("psi", 6).alias("psi"))


def feature_wasserstein(baseline: DataFrame, current: DataFrame, features: list[str], digits: int | None = 6) -> DataFrame:
    """Earth mover's distance per feature: the area between the two distribution functions.

    Rows are first reduced to distinct values; prefix sums run inside value ranges cut at sampled
    quantiles, so no single task sees a whole feature.
    """
    t = _tagged(baseline, current, features)
    t = t.select(*[F.col(f).cast("double").alias(f) for f in features], "_b", "_c")
    cuts, rows = value_slices(t, features), t.count()
    entries = []
    for i, f in enumerate(features):
        t = sliced_by_value(t, f, cuts[f], f"_r{i}", rows)
        entries.append(F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.col(f"_r{i}").alias("_vslice")))
    long = t.select("_b", "_c", F.explode(F.array(*entries)).alias("e")).select("_b", "_c", "e.*").filter(F.col("value").isNotNull())
    values = long.groupBy("feature", "_vslice", "value").agg(F.sum("_b").alias("b"), F.sum("_c").alias("c"))
    run = tl.running(values, ["feature"], "value", {"fb": F.col("b"), "fc": F.col("c")}, F.col("_vslice"), tie="_vslice", inclusive=True)
    nxt = tl.neighbours(values.select("feature", "_vslice", "value"), ["feature"], "value", "_vslice", after={"next": "value"}, slice_col=F.col("_vslice"))
    total = values.groupBy("feature").agg(F.sum("b").alias("nb"), F.sum("c").alias("nc"))
    j = run.join(nxt.select("feature", "value", "next"), ["feature", "value"]).join(F.broadcast(total), "feature")  # one row per feature
    area = F.abs(F.col("fb") / F.col("nb") - F.col("fc") / F.col("nc")) * (F.col("next") - F.col("value"))
    d = F.coalesce(F.sum(area), F.lit(0.0))
    return j.groupBy("feature").agg((d if digits is None else F.round(d, digits)).alias("wasserstein"))


def wasserstein(baseline: DataFrame, current: DataFrame, score: str = "score") -> DataFrame:
    return feature_wasserstein(baseline, current, [score], None).select("wasserstein")


def confidence_drift(current: DataFrame, baseline_mean: float, threshold: float = 0.1) -> DataFrame:
    """Mean and population deviation of confidence and the drop against the baseline's mean."""
    a = current.agg(F.avg("confidence").alias("m"), F.stddev_pop("confidence").alias("s"))
    drop = F.lit(baseline_mean) - F.col("m")
    return a.select(F.round("m", 4).alias("confidence_mean"), F.round("s", 4).alias("confidence_std"), F.round(drop, 4).alias("confidence_drop"),
                    (drop > threshold).cast("int").alias("confidence_alert"))


def rate_and_accuracy(df: DataFrame) -> DataFrame:
    """Accuracy and positive rate of labelled rows and the mean label delay, as one row.

    ``df`` has decision, label, created_us and labeled_us; BLOCK and REVIEW count as predicted
    positive.
    """
    said = F.col("decision").isin("BLOCK", "REVIEW").cast("int")
    lab = df.filter(F.col("label").isNotNull())
    a = lab.agg(F.count(F.lit(1)).alias("n"), F.count_if(said == F.col("label")).alias("ok"), F.sum("label").alias("pos"),
                F.sum(F.col("labeled_us") - F.col("created_us")).alias("d"))
    return a.select((F.col("ok") / F.col("n")).alias("accuracy"), (F.col("pos") / F.col("n")).alias("rate"),
                    (F.col("d") / F.col("n") / 3.6e9).alias("delay_hours"))


def rate_and_accuracy_drift(baseline: DataFrame, current: DataFrame) -> DataFrame:
    b = rate_and_accuracy(baseline).select(F.col("accuracy").alias("ba"), F.col("rate").alias("br"))
    c = rate_and_accuracy(current)
    j = c.join(F.broadcast(b))  # one row each
    drop = F.col("ba") - F.col("accuracy")
    dev = F.abs(F.col("rate") - F.col("br")) / F.greatest(F.col("br"), F.lit(0.001))
    return j.select(
        F.round(drop, 4).alias("accuracy_drop"), (drop > 0.05).cast("int").alias("accuracy_alert"),
        F.round(dev, 4).alias("rate_deviation"), (dev > 0.15).cast("int").alias("rate_alert"),
        F.round("delay_hours", 2).alias("label_delay_hours"), (F.col("delay_hours") > 72).cast("int").alias("delay_alert"))


def drift_report(baseline: DataFrame, current: DataFrame, features: list[str], baseline_confidence: float, model_version: str,
                 psi_limit: float = 0.2, wasserstein_limit: float = 0.1) -> DataFrame:
    """Every signal in one row. Feature, confidence and delay alerts alone do not ask for retraining."""
    fp = feature_psi(baseline, current, features).filter(F.col("psi") > psi_limit)
    # at most one entry per registry feature
    worst = fp.agg(F.sort_array(F.collect_list(F.struct((-F.col("psi")).alias("k"), "feature"))).alias("_f"))
    j = score_psi(baseline, current)
    for part in (wasserstein(baseline, current), rate_and_accuracy_drift(baseline, current), confidence_drift(current, baseline_confidence), worst):
        j = j.join(F.broadcast(part))  # one row each
    psi_alert, w_alert = F.col("psi") > psi_limit, F.col("wasserstein") > wasserstein_limit
    names = F.transform("_f", lambda x: x["feature"])
    alerts = F.array_compact(F.array(
        F.when(psi_alert, F.format_string(f"PSI=%.4f exceeds threshold {psi_limit}", "psi")),
        F.when(w_alert, F.format_string(f"Wasserstein distance=%.4f exceeds threshold {wasserstein_limit}", "wasserstein")),
        F.when(F.col("accuracy_alert") == 1, F.format_string("Accuracy dropped by %.4f", "accuracy_drop")),
        F.when(F.col("rate_alert") == 1, F.format_string("Fraud rate deviation: %.2f%%", F.col("rate_deviation") * 100)),
        F.when(F.size(names) > 0, F.concat(F.size(names).cast("string"), F.lit(" features drifting: "), F.concat_ws(", ", F.slice(names, 1, 5)))),
        F.when(F.col("confidence_alert") == 1, F.format_string("Confidence dropping: %.4f below baseline", "confidence_drop")),
        F.when(F.col("delay_alert") == 1, F.format_string("Label delay %.1fh exceeds 72.0h threshold", "label_delay_hours"))))
    retrain = psi_alert | w_alert | (F.col("accuracy_alert") == 1) | (F.col("rate_alert") == 1)
    return j.select(
        F.lit(model_version).alias("model_version"), F.round("psi", 4).alias("psi"), psi_alert.cast("int").alias("psi_alert"),
        F.round("wasserstein", 4).alias("wasserstein"), w_alert.cast("int").alias("wasserstein_alert"), "accuracy_drop", "accuracy_alert",
        "rate_deviation", "rate_alert", "confidence_mean", "confidence_std", "confidence_drop", "confidence_alert", "label_delay_hours", "delay_alert",
        F.slice(names, 1, 10).alias("top_drifting_features"), retrain.cast("int").alias("retrain_recommended"), alerts.alias("alerts"))
