"""Fairness across groups and validation of a model before it is deployed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeline as tl
from ..functions.bins import sliced_by_value, value_slices
from .drift import score_psi


def _confusion() -> list[Column]:
    y, p = F.col("y"), F.col("pred")
    return [F.count(F.lit(1)).alias("n"), F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 1) & (y == 0)).alias("fp"),
            F.count_if((p == 0) & (y == 0)).alias("tn"), F.count_if((p == 0) & (y == 1)).alias("fn")]


def _over(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def all_group_metrics(preds: DataFrame, attribute: str) -> DataFrame:
    c = F.col
    g = preds.groupBy(F.col(attribute).cast("string").alias("group")).agg(*_confusion())
    return g.select(
        "*", (( c("tp") + c("fp")) / c("n")).alias("positive_rate"), _over(c("fp"), c("fp") + c("tn")).alias("fpr"),
        _over(c("fn"), c("fn") + c("tp")).alias("fnr"), _over(c("tp"), c("tp") + c("fn")).alias("tpr"), _over(c("tp"), c("tp") + c("fp")).alias("precision"))


def group_metrics(preds: DataFrame, attribute: str, min_size: int = 30) -> DataFrame:
    """Confusion counts and rates per group of at least ``min_size`` rows. ``preds``: y, pred, attribute."""
    return all_group_metrics(preds, attribute).filter(F.col("n") >= min_size)


def small_groups(preds: DataFrame, attribute: str, min_size: int = 30) -> DataFrame:
    small = all_group_metrics(preds, attribute).filter(F.col("n") < min_size)
    return small.select("group", "n", F.concat(F.lit("Group '"), "group", F.lit("' has only "), F.col("n").cast("string"), F.lit(f" samples (min: {min_size})")).alias("warning"))


def parity_ratios(preds: DataFrame, attribute: str, min_size: int = 30) -> DataFrame:
    """Disparate impact, false-positive parity and equal opportunity against the most common group."""
    every = all_group_metrics(preds, attribute)
    kept = every.filter(F.col("n") >= min_size)
    ref = every.groupBy().agg(F.min_by("group", F.struct((-F.col("n")).alias("k"), "group")).alias("reference_group"))
    r = kept.select(F.col("group").alias("_g"), F.col("positive_rate").alias("rp"), F.col("fpr").alias("rf"), F.col("tpr").alias("rt"))
    base = ref.join(r, F.col("reference_group") == F.col("_g"), "left").drop("_g")
    j = kept.join(F.broadcast(base)).filter(F.col("group") != F.col("reference_group"))  # one row

    def two_way(x: Column, ref_: Column) -> Column:
        q = x / ref_
        return F.when(ref_.isNull() | (ref_ == 0), 1.0).when(x == 0, 0.0).otherwise(F.least(q, 1.0 / q))

    hi, lo = F.greatest("rf", "fpr"), F.least("rf", "fpr")
    fp = F.when(F.col("rf").isNull() | (hi == 0), 1.0).otherwise(lo / hi)
    worst = j.agg(F.min(two_way(F.col("positive_rate"), F.col("rp"))).alias("di"), F.min(fp).alias("fp"), F.min(two_way(F.col("tpr"), F.col("rt"))).alias("eo"))
    def capped(c):
        return F.least(F.lit(1.0), F.coalesce(c, F.lit(1.0)))
    return ref.join(F.broadcast(worst)).select(  # one row each
        "reference_group", capped("di").alias("disparate_impact_ratio"), capped("fp").alias("fpr_parity_ratio"), capped("eo").alias("equal_opportunity_ratio"))


def bias_report(preds: DataFrame, attributes: list[str], min_size: int = 30, limit: float = 0.80) -> DataFrame:
    """One row per attribute with ratios, verdict, warnings about the ratios and the number of groups too small to judge (``bias_warnings`` names them)."""
    rows = []
    for a in attributes:
        p = parity_ratios(preds, a, min_size)
        small = small_groups(preds, a, min_size).agg(F.count(F.lit(1)).alias("small_groups"))
        j = p.join(F.broadcast(small))  # one row
        def under(col, text):
            return F.when(F.col(col) < limit, F.format_string(f"{text} %.3f below threshold {limit}", col))
        own = F.array_compact(F.array(under("disparate_impact_ratio", "Disparate impact ratio"), under("fpr_parity_ratio", "FPR parity ratio"),
                                      under("equal_opportunity_ratio", "Equal opportunity ratio")))
        ok = (F.col("disparate_impact_ratio") >= limit) & (F.col("fpr_parity_ratio") >= limit) & (F.col("equal_opportunity_ratio") >= limit)
        rows.append(j.select(F.lit(a).alias("attribute"), "reference_group", "disparate_impact_ratio", "fpr_parity_ratio", "equal_opportunity_ratio",
                             ok.cast("int").alias("passed"), own.alias("warnings"), "small_groups"))
    return reduce(DataFrame.unionByName, rows)


def bias_warnings(preds: DataFrame, attributes: list[str], min_size: int = 30) -> DataFrame:
    """A row for every group too small to judge: attribute, group, n, warning."""
    return reduce(DataFrame.unionByName, [small_groups(preds, a, min_size).select(F.lit(a).alias("attribute"), "group", "n", "warning") for a in attributes])


def bias_summary(report: DataFrame) -> DataFrame:
    return report.agg(F.count(F.lit(1)).alias("evaluations"), F.min("passed").alias("overall_pass"),
                      F.sort_array(F.collect_list(F.when(F.col("passed") == 0, F.col("attribute")))).alias("failing_attributes"),
                      F.sum(F.size("warnings") + F.col("small_groups")).alias("warnings"))


def roc_auc(preds: DataFrame, score: str = "score") -> DataFrame:
    """Exact area under the ROC curve, equal scores sharing their rank.

    Rows are reduced to distinct scores; the count of lower negatives is a prefix sum inside
    value ranges, in whole numbers.
    """
    cuts = value_slices(preds, [score])[score]
    sliced = sliced_by_value(preds.select(F.col(score).cast("double").alias("v"), "y"), "v", cuts)
    g = sliced.groupBy("_vslice", "v").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("q"))
    run = tl.running(g.withColumn("_one", F.lit(1)), ["_one"], "v", {"below": F.col("q")}, F.col("_vslice"), tie="_vslice")
    wins = (F.col("p").cast("decimal(19,0)") * (F.col("below") * 2 + F.col("q")).cast("decimal(19,0)"))
    t = run.agg(F.sum(wins).alias("w"), F.sum("p").alias("P"), F.sum("q").alias("N"))
    auc = F.col("w").cast("double") / 2.0 / (F.col("P").cast("double") * F.col("N").cast("double"))
    return t.select(F.when((F.col("P") > 0) & (F.col("N") > 0), auc).alias("roc_auc"), F.col("P").alias("positives"), F.col("N").alias("negatives"))


def classification_metrics(preds: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """precision, recall, F1 and accuracy; a zero division gives 0."""
    c = F.col
    g = preds.groupBy(*(keys or [])).agg(*_confusion())
    def div(a, b):
        return F.when(b > 0, a / b).otherwise(0.0)
    p, r = div(c("tp"), c("tp") + c("fp")), div(c("tp"), c("tp") + c("fn"))
    return g.select(*(keys or []), "n", p.alias("precision"), r.alias("recall"),
                    div(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"), div(c("tp") + c("tn"), c("n")).alias("accuracy"))


def validation_psi(expected: DataFrame, actual: DataFrame, score: str = "score") -> DataFrame:
    """PSI with a tiny smoothing, and whether all scores lie in [0, 1]."""
    psi = score_psi(expected, actual, score, add=1e-6)
    rng = actual.agg(F.min(score).alias("min_score"), F.max(score).alias("max_score"))
    ok = (F.col("min_score") >= 0) & (F.col("max_score") <= 1)
    return psi.join(F.broadcast(rng)).select("psi", "min_score", "max_score", ok.cast("int").alias("in_range"))  # one row each


def data_quality(df: DataFrame, features: list[str], y: str) -> DataFrame:
    """Size, missing share over all cells, positive rate and number of constant features, in one pass."""
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(F.col(y).cast("double")).alias("positive_rate")]
    missing, constant = F.lit(0), F.lit(0)
    for i, f in enumerate(features):
        bad = F.col(f).isNull() | F.isnan(F.col(f).cast("double"))
        aggs += [F.count_if(bad).alias(f"_b{i}"), F.min(F.when(~bad, F.col(f))).alias(f"_lo{i}"), F.max(F.when(~bad, F.col(f))).alias(f"_hi{i}")]
        missing = missing + F.col(f"_b{i}")
        constant = constant + F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), 1).otherwise(0)
    a = df.agg(*aggs)
    return a.select("n", (missing / (F.col("n") * len(features))).alias("missing_rate"), "positive_rate", constant.alias("constant_features"))


def validation_report(preds: DataFrame, baseline: DataFrame | None, features: DataFrame, names: list[str], attributes: list[str] | None = None,
                      min_auc: float = 0.90, min_precision: float = 0.85, min_recall: float = 0.80, max_psi: float = 0.20,
                      min_rows: int = 1000, max_missing: float = 0.05) -> DataFrame:
    """Check rows (name, passed, actual, threshold) and the overall verdict beside each."""
    def rows(df: DataFrame, checks: list[tuple[str, Column, Column, float | None]]) -> DataFrame:
        entries = [F.struct(F.lit(n).alias("check_name"), ok.cast("int").alias("passed"), actual.cast("double").alias("actual"),
                            F.lit(t).cast("double").alias("threshold")) for n, ok, actual, t in checks]
        return df.select(F.explode(F.array(*entries)).alias("c")).select("c.*")

    c = F.col
    auc = F.coalesce(c("roc_auc"), F.lit(0.0))
    parts = [
        rows(roc_auc(preds), [("roc_auc", auc >= min_auc, auc, min_auc)]),
        rows(classification_metrics(preds), [("precision", c("precision") >= min_precision, c("precision"), min_precision),
                                             ("recall", c("recall") >= min_recall, c("recall"), min_recall), ("f1_score", F.lit(True), c("f1"), None)]),
        rows(data_quality(features, names, "y"), [
            ("sample_size", c("n") >= min_rows, c("n"), float(min_rows)), ("missing_features", c("missing_rate") <= max_missing, c("missing_rate"), max_missing),
            ("class_balance", (c("positive_rate") > 0.001) & (c("positive_rate") < 0.5), c("positive_rate"), None),
            ("feature_variance", c("constant_features") == 0, c("constant_features"), None)]),
    ]
    if baseline is not None:
        parts.append(rows(validation_psi(baseline, preds), [("score_drift_psi", c("psi") <= max_psi, c("psi"), max_psi), ("score_range", c("in_range") == 1, c("in_range"), None)]))
    if attributes:
        b = bias_report(preds, attributes)
        parts.append(b.select(F.concat(F.lit("fairness_"), "attribute").alias("check_name"), "passed", F.col("disparate_impact_ratio").alias("actual"), F.lit(None).cast("double").alias("threshold")))
    checks = reduce(DataFrame.unionByName, parts)
    overall = checks.agg(F.min("passed").alias("overall_pass"))
    if attributes:  # warnings pass; there may be one for every small group
        w = b.select("attribute", F.explode("warnings").alias("w")).drop("w").unionByName(bias_warnings(preds, attributes).select("attribute"))
        checks = checks.unionByName(w.select(F.concat(F.lit("fairness_"), "attribute", F.lit("_warning")).alias("check_name"), F.lit(1).alias("passed"),
                                             F.lit(None).cast("double").alias("actual"), F.lit(None).cast("double").alias("threshold")))
    return checks.crossJoin(F.broadcast(overall))  # one row


# --- fixed values: acceptance limits per training job (auc, precision) ---------------
GATES = {"fraud": (0.92, 0.90), "aml": (0.90, 0.88), "ssl": (0.90, None)}


def deployment_gate(metrics: DataFrame) -> DataFrame:
    """Accepts a candidate when its job's limits are met; ``metrics``: job, roc_auc, precision."""
    ok = F.lit(False)
    for job, (auc, precision) in GATES.items():
        good = F.col("roc_auc") >= auc
        if precision is not None:
            good = good & (F.col("precision") >= precision)
        ok = F.when(F.col("job") == job, good).otherwise(ok)
    return metrics.withColumn("accepted", F.coalesce(ok, F.lit(False)).cast("int"))
