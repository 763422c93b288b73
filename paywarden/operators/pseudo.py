"""Choosing, storing and judging pseudo-labels."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.joins import latest_n, newest, top_n, top_per_group
from ..functions.select import medians
from ..functions.session import cut
from .labels import count_maturity


def ssl_pool(predictions: DataFrame, snapshots: DataFrame, labelled: int | None = 50_000, unlabelled: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Newest labelled and all (or the newest) unlabelled predictions that have a feature snapshot.

    ``snapshots``: prediction_id and features. ``labelled`` bounds the rows a classifier is fitted on.
    """
    have = predictions.select("prediction_id", "created_us", "label", "score").join(snapshots.select("prediction_id"), "prediction_id", "left_semi")
    ties = F.col("prediction_id")
    known = latest_n(have.filter(F.col("label").isNotNull()), labelled, "created_us", ties)
    unknown = latest_n(have.filter(F.col("label").isNull()), unlabelled, "created_us", ties)
    return known.join(snapshots, "prediction_id"), unknown.join(snapshots, "prediction_id")


def thresholds_at(iteration: int, pos: float = 0.95, neg: float = 0.05, step: float = 0.02) -> tuple[float, float]:
    """Acceptance limits, tightening with every iteration to 0.99 / 0.01."""
    return min(0.99, pos + step * iteration), max(0.01, neg - step * iteration)


def select_confident(scores: DataFrame, pos: float, neg: float, p: str = "p") -> DataFrame:
    """Pseudo-label and confidence of the rows beyond either limit."""
    label = F.when(F.col(p) >= pos, 1).when(F.col(p) <= neg, 0)
    out = scores.withColumn("pseudo_label", label).filter(F.col("pseudo_label").isNotNull())
    return out.withColumn("confidence", F.when(F.col("pseudo_label") == 1, F.col(p)).otherwise(1.0 - F.col(p)))


def flip_rate(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Share of predictions in both sets whose pseudo-label changed."""
    j = previous.select("prediction_id", F.col("pseudo_label").alias("_p")).join(current.select("prediction_id", "pseudo_label"), "prediction_id")
    a = j.agg(F.count(F.lit(1)).alias("common"), F.count_if(F.col("_p") != F.col("pseudo_label")).alias("flipped"))
    return a.select("common", "flipped", F.when(F.col("common") > 0, F.col("flipped") / F.col("common")).otherwise(0.0).alias("flip_rate"))


def guardrails(runs: DataFrame, max_ratio: float = 3.0, max_flip: float = 0.10) -> DataFrame:
    """Whether a run is safe. ``runs``: n_labelled, n_pseudo, flip_rate."""
    ratio = F.col("n_pseudo") / F.greatest(F.col("n_labelled"), F.lit(1))
    return runs.withColumn("ratio", ratio).withColumn("safe", ((F.col("ratio") <= max_ratio) & (F.col("flip_rate") <= max_flip)).cast("int"))


def keep_most_confident(selected: DataFrame, n_labelled: int, max_ratio: float = 3.0) -> DataFrame:
    """The most confident ``max_ratio`` x labelled pseudo-labels."""
    c = F.col("confidence")
    return top_n(selected, int(n_labelled * max_ratio), c, -F.col("prediction_id"))


def noise(k: Column, feature: int, row: str = "prediction_id", seed: int = 42) -> tuple[Column, Column]:
    """(standard normal, uniform) from hashes of row, copy and feature: the same on every retry."""
    def unit(salt: int) -> Column:
        h = F.pmod(F.xxhash64(F.col(row), k, F.lit(feature), F.lit(seed), F.lit(salt)), F.lit(1 << 52))
        return (h.cast("double") + 0.5) / float(1 << 52)
    return F.sqrt(-2.0 * F.log(unit(1))) * F.cos(2.0 * math.pi * unit(2)), unit(3)


def noisy_copies(pool: DataFrame, features: list[str], copies: int = 5, sigma: float = 0.1, dropout: float = 0.1, seed: int = 42) -> DataFrame:
    """Each row ``copies`` times with gaussian noise and feature dropout, other ones for another seed."""
    kept = [c for c in pool.columns if c not in features]
    e = pool.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    cols = []
    for i, f in enumerate(features):
        z, u = noise(F.col("copy"), i, seed=seed)
        cols.append(F.when(u < dropout, 0.0).otherwise(F.col(f) + sigma * z).alias(f))
    return e.select(*kept, "copy", *cols)


def consistency_select(scored: DataFrame, p: str = "p") -> DataFrame:
    """Rows whose score varies less over noisy copies than the median row's; labelled at 0.5.

    ``scored``: prediction_id, copy, p. Variances are rounded to 9 decimals.
    """
    g = scored.groupBy("prediction_id").agg(F.avg(p).alias("mean"), F.var_pop(p).alias("variance"))
    g = g.withColumn("variance", F.round("variance", 9))
    g = cut(g.withColumn("_all", F.lit(0)))
    median = medians(g, "_all", "variance", {0: g.count()})
    kept = g.filter(F.col("variance") < F.lit(float(median[0]))) if median else g
    label = (F.col("mean") >= 0.5).cast("int")
    return kept.select("prediction_id", F.round("mean", 6).alias("mean"), "variance", label.alias("pseudo_label"))


def sharpen(p: Column, temperature: float = 0.5) -> Column:
    a, b = F.pow(p, F.lit(1.0 / temperature)), F.pow(1.0 - p, F.lit(1.0 / temperature))
    return a / (a + b)


def feature_views(df: DataFrame, domain: str, ids: list[str]) -> dict[str, DataFrame]:
    """The named column groups of a domain."""
    return {name: df.select(*ids, *cols) for name, cols in K.FEATURE_VIEWS[domain].items()}


def multi_view_agreement(scores: DataFrame, views: list[str], threshold: float = 0.9, top: int | None = None) -> DataFrame:
    """Rows on which all views agree with confidence; with ``top`` the surest of each side, ranked."""
    n = float(len(views))
    mean = reduce(lambda a, b: a + b, [F.col(v) for v in views]) / n
    s = scores.withColumn("mean", mean)
    spread = reduce(lambda a, b: a + b, [F.pow(F.col(v) - F.col("mean"), F.lit(2.0)) for v in views]) / n
    s = s.withColumn("std", F.sqrt(spread)).filter(F.col("std") < 1.0 - threshold)
    s = s.withColumn("pseudo_label", F.when(F.col("mean") >= 0.9, 1).when(F.col("mean") <= 0.1, 0)).filter(F.col("pseudo_label").isNotNull())
    return s if top is None else top_per_group(s, ["pseudo_label"], [F.abs(F.col("mean") - 0.5).desc(), F.col("prediction_id")], top)


def tri_training_agreement(scores: DataFrame, learners: list[str], top: int | None = None) -> DataFrame:
    """(learner, prediction_id, pseudo_label): rows on which the other two agree with confidence;
    with ``top`` the surest of each learner, ranked."""
    parts = []
    for who in learners:
        a, b = [F.col(x) for x in learners if x != who]
        mean = (a + b) / 2.0
        agree = ((a >= 0.5) == (b >= 0.5)) & ((mean >= 0.8) | (mean <= 0.2))
        parts.append(F.when(agree, F.struct(F.lit(who).alias("learner"), mean.alias("mean"), (a >= 0.5).cast("int").alias("pseudo_label"))))
    e = scores.select("prediction_id", F.explode(F.array_compact(F.array(*parts))).alias("e")).select("prediction_id", "e.*")
    return e if top is None else top_per_group(e, ["learner"], [F.abs(F.col("mean") - 0.5).desc(), F.col("prediction_id")], top)


def disagreement(scores: DataFrame, a: str, b: str) -> DataFrame:
    return scores.agg(F.avg(((F.col(a) >= 0.5) != (F.col(b) >= 0.5)).cast("double")).alias("disagreement"))


def transfer_budget(target: DataFrame, existing: int, share: float = 0.20) -> int:
    """How many labels may still be transferred to a domain (two counts come back)."""
    labelled = target.agg(F.count("label")).first()[0]
    return max(0, int(max(10, labelled * share)) - existing)


def cross_domain_transfer(predictions: dict[str, DataFrame], existing: DataFrame, links: DataFrame | None = None,
                          rules: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """Positive labels of one domain carried to the newest unlabelled row of the same entity in another.

    ``existing``: source_domain, target_domain, source_id. ``links`` (source_domain, target_domain,
    source_entity, target_entity) maps entities where the domains name them differently; without
    it ids must be equal. Several sources may reach one target.
    """
    done = {(r[0], r[1]): r[2] for r in existing.groupBy("source_domain", "target_domain").agg(F.count(F.lit(1))).collect()}  # one row per rule
    out = []
    for source, target, decay in rules or K.TRANSFER_RULES:
        budget = transfer_budget(predictions[target], done.get((source, target), 0))
        taken = existing.filter(F.col("target_domain") == target).select(F.col("source_id").alias("prediction_id"))
        s = predictions[source].filter(F.col("label") == 1).select("prediction_id", "entity_id", F.coalesce("labeled_us", F.lit(0).cast("long")).alias("_at"))
        picked = latest_n(s.join(taken, "prediction_id", "left_anti"), budget, "_at", F.col("prediction_id"))
        if links is not None:
            ln = links.filter((F.col("source_domain") == source) & (F.col("target_domain") == target)).select(F.col("source_entity").alias("entity_id"), "target_entity").distinct()
            picked = picked.join(ln, "entity_id", "left").withColumn("entity_id", F.coalesce("target_entity", "entity_id")).drop("target_entity")
        entities = picked.select("entity_id").distinct()
        t = predictions[target].filter(F.col("label").isNull()).select("entity_id", "prediction_id", "created_us").join(entities, "entity_id", "left_semi")
        last = newest(t, ["entity_id"], ["created_us", "prediction_id"]).select("entity_id", F.col("prediction_id").alias("target_id"))
        out.append(picked.join(last, "entity_id").select(
            F.lit(source).alias("source_domain"), F.lit(target).alias("target_domain"), F.col("prediction_id").alias("source_id"), "target_id",
            F.lit(1).alias("transferred_label"), F.lit(decay).alias("confidence_decay")))
    return reduce(DataFrame.unionByName, out)


def transfer_training_rows(transfers: DataFrame, snapshots: DataFrame, domain: str, limit: int | None = None) -> DataFrame:
    """Transferred labels of a domain (all, or the newest) with their features and weight. ``transfers`` has created_us."""
    t = transfers.filter(F.col("target_domain") == domain).join(snapshots.select(F.col("prediction_id").alias("target_id")), "target_id", "left_semi")
    recent = latest_n(t, limit, "created_us", F.col("source_id"), -F.col("target_id"))
    s = snapshots.withColumnRenamed("prediction_id", "target_id")
    return recent.select("source_id", "target_id", F.col("transferred_label").alias("label"), F.col("confidence_decay").alias("weight")).join(s, "target_id")


def pseudo_label_rows(selected: DataFrame, domain: str, source: str, iteration: int) -> DataFrame:
    """Rows to append to the pseudo-label table."""
    return selected.select("prediction_id", F.lit(domain).alias("domain"), F.lit(source).alias("source"), F.col("pseudo_label").alias("label"),
                           F.round("confidence", 4).alias("confidence"), F.lit(iteration).alias("iteration"))


def pseudo_label_read(table: DataFrame, domain: str, source: str | None = None, min_confidence: float = 0.0, limit: int | None = None) -> DataFrame:
    """Stored pseudo-labels: all, or the surest."""
    t = table.filter((F.col("domain") == domain) & (F.col("confidence") >= min_confidence))
    if source is not None:
        t = t.filter(F.col("source") == source)
    return top_n(t, limit, F.col("confidence"), -F.col("prediction_id"))


def validate_pseudo(pseudo: DataFrame, human: DataFrame) -> DataFrame:
    """Pseudo-labels beside the human label, marked right or wrong."""
    h = human.select("prediction_id", "domain", F.col("label").alias("human_label"))
    return pseudo.join(h, ["prediction_id", "domain"]).withColumn("correct", (F.col("label") == F.col("human_label")).cast("int"))


def validation_counts(validated: DataFrame) -> DataFrame:
    v = validated.agg(F.count(F.lit(1)).alias("validated"), F.count_if(F.col("correct") == 1).alias("correct"))
    return v.select("validated", "correct", (F.col("validated") - F.col("correct")).alias("incorrect"),
                    F.when(F.col("validated") > 0, F.col("correct") / F.col("validated")).otherwise(0.0).alias("accuracy"))


def pseudo_quality(pseudo: DataFrame, runs: DataFrame) -> DataFrame:
    """Per domain: totals, validated share right, mean confidence, techniques, and the latest run.

    ``pseudo``: domain, source, confidence, correct (null when not validated); ``runs``: run_id,
    domain, technique, us, flip_rate, auc.
    """
    c = F.col
    p = pseudo.groupBy("domain").agg(
        F.count(F.lit(1)).alias("total"), F.count("correct").alias("validated"), F.count_if(c("correct") == 1).alias("right"),
        F.sum(F.round(c("confidence") * 10000).cast("long")).alias("_s"), F.countDistinct("source").alias("technique_count"))
    last = newest(runs.select("domain", "us", "run_id", "technique", "flip_rate", "auc"), ["domain"], ["us", "run_id"])
    j = p.join(last, "domain", "left")
    return j.select("domain", "total", "validated", F.when(c("validated") > 0, c("right") / c("validated")).alias("validated_accuracy"),
                    (c("_s") / c("total") / 10000.0).alias("avg_confidence"), "technique_count", c("technique").alias("latest_technique"),
                    c("flip_rate").alias("latest_flip_rate"), c("auc").alias("latest_auc"))


def flip_trend(runs: DataFrame, last: int = 10) -> DataFrame:
    """The newest runs with a flip rate, per domain."""
    r = runs.filter(F.col("flip_rate").isNotNull()).select("domain", "technique", "flip_rate", "us", "run_id")
    return top_per_group(r, ["domain"], [F.col("us").desc(), F.col("run_id").desc()], last)


def transfer_stats(transfers: DataFrame) -> DataFrame:
    """Count, mean decay and last time per pair of domains, with a total row (ALL, ALL)."""
    t = transfers.groupBy("source_domain", "target_domain").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("confidence_decay") * 1000).cast("long")).alias("_d"), F.max("created_us").alias("last_us"))
    total = t.agg(F.sum("n").alias("n"), F.sum("_d").alias("_d"), F.max("last_us").alias("last_us")).select(
        F.lit("ALL").alias("source_domain"), F.lit("ALL").alias("target_domain"), "n", "_d", "last_us")
    return t.unionByName(total).select("source_domain", "target_domain", "n", (F.col("_d") / F.col("n") / 1000.0).alias("avg_decay"), "last_us").orderBy(F.col("n").desc())


def technique_latest(runs: DataFrame) -> DataFrame:
    """Newest run per domain and technique."""
    return newest(runs, ["domain", "technique"], ["us", "run_id"])


def ssl_alerts(quality: DataFrame, min_accuracy: float = 0.85, max_flip: float = 0.10) -> DataFrame:
    c = F.col
    e = F.array_compact(F.array(
        F.when(c("validated_accuracy") < min_accuracy, F.struct(F.lit("LOW_PSEUDO_LABEL_ACCURACY").alias("alert"), c("validated_accuracy").alias("value"), F.lit(min_accuracy).alias("threshold"))),
        F.when(c("latest_flip_rate") > max_flip, F.struct(F.lit("HIGH_FLIP_RATE").alias("alert"), c("latest_flip_rate").alias("value"), F.lit(max_flip).alias("threshold")))))
    return quality.select("domain", F.explode(e).alias("e")).select("domain", "e.*")


# --- fixed values: techniques per stage ------------------------------------------------
SSL_TECHNIQUES = ["SELF_TRAINING", "LABEL_SPREADING", "CONSISTENCY"]
CO_TECHNIQUES = ["MULTI_VIEW", "TRI_TRAINING", "CROSS_DOMAIN"]


def ssl_plan(predictions: DataFrame) -> DataFrame:
    """(domain, level, technique) to run. The branch follows the most mature domain, so a WARMING
    domain also gets MIXMATCH when another one is WARM or HOT."""
    from pyspark.sql import Window

    n = predictions.groupBy("domain").agg(F.count("label").alias("n")).withColumn("level", count_maturity(F.col("n")))
    rank = F.when(F.col("level").isin("WARM", "HOT"), 2).when(F.col("level") == "WARMING", 1).otherwise(0)
    n = n.withColumn("branch", F.max(rank).over(Window.partitionBy()))  # one row per domain
    base = [F.lit(t) for t in SSL_TECHNIQUES]
    mix = F.when(F.col("branch") == 2, F.lit("MIXMATCH"))
    co = [F.when(F.col("level").isin("WARM", "HOT"), F.lit(t)) for t in CO_TECHNIQUES]
    plan = F.array_compact(F.array(*base, mix, *co))
    return n.filter("level <> 'COLD'").select("domain", "level", F.explode(plan).alias("technique"))
