"""Semi-supervised training loops. Each round is a distributed fit and a distributed selection.

Inputs: ``labelled`` (prediction_id, x array, y) and ``unlabelled`` (prediction_id, x).
Every loop returns an :class:`Outcome`: (pseudo-labels, history) - what the last accepted round chose, and one row per round -
with the fitted model of the best round as ``model``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import lookup
from ..functions.session import cut
from . import pseudo
from . import training as T

ID = "prediction_id"
HISTORY = "technique string, round int, auc double, n_pseudo long, flip_rate double, safe int"


class Outcome(tuple):
    """(pseudo-labels, history), and the best round's ``model`` (several learners: a dict of them) with its ``auc`` on the holdout."""

    def __new__(cls, chosen: DataFrame, history: DataFrame, model, auc: float | None):
        out = super().__new__(cls, (chosen, history))
        out.model, out.auc = model, auc
        return out


class _Best:
    """The model with the highest AUC; of equal ones the first."""

    def __init__(self):
        self.model, self.auc = None, None

    def offer(self, model, auc: float) -> None:
        if self.auc is None or auc > self.auc:
            self.model, self.auc = model, auc


def _model(domain: str, trees: int | None, depth: int | None, seed: int = T.SEED):
    return T.boosted(domain, trees, seed, depth)


def _fit(domain, rows: DataFrame, trees, depth, seed=T.SEED):
    """``rows``: x, y, weight."""
    w = T.weighted(T.with_vector(rows), T.K.TRAINING[domain][3], "weight")
    return _model(domain, trees, depth, seed).fit(w)


def _score(model, rows: DataFrame, name: str = "p") -> DataFrame:
    return T.probability(model.transform(T.with_vector(rows)), name).drop("features")


def _auc(model, holdout: DataFrame) -> float:
    s = _score(model, holdout)
    return float(BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="p", numBins=0).evaluate(s))


def _start(labelled: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    s = cut(T.stratified_split(labelled, ID, "y"))
    train = s.filter("is_test = 0").select(ID, "x", "y", F.lit(1.0).alias("weight"))
    return train, s.filter("is_test = 1").select(ID, "x", "y"), train.count()


def _with_pseudo(train: DataFrame, chosen: DataFrame, pool: DataFrame, weight: float = 0.5) -> DataFrame:
    extra = chosen.select(ID, F.col("pseudo_label").alias("y")).join(pool.select(ID, "x"), ID).select(ID, "x", "y", F.lit(weight).alias("weight"))
    return train.unionByName(extra)


def self_training(labelled: DataFrame, unlabelled: DataFrame, domain: str, rounds: int = 10, trees: int | None = None, depth: int | None = None, min_gain: float = 0.001):
    """Train, pseudo-label the surest rows, retrain; stops without gain, when unsafe or when nothing is sure."""
    train, holdout, n = _start(labelled)
    pool = cut(unlabelled)
    model = _fit(domain, train, trees, depth)
    best = before = _auc(model, holdout)
    top = _Best()
    top.offer(model, best)
    history = []
    kept = previous = None
    for r in range(rounds):
        pos, neg = pseudo.thresholds_at(r)
        chosen = cut(pseudo.select_confident(_score(model, pool).select(ID, "p"), pos, neg).select(ID, "pseudo_label", "confidence"))
        count = chosen.count()
        flips = 0.0 if previous is None else (pseudo.flip_rate(previous, chosen).first()["flip_rate"] or 0.0)
        safe = count <= 3.0 * n and flips <= 0.10
        if count == 0 or not safe:
            history.append(("SELF_TRAINING", r, round(best, 4), count, flips, int(safe)))
            break
        model = _fit(domain, _with_pseudo(train, chosen, pool), trees, depth)
        auc = _auc(model, holdout)
        history.append(("SELF_TRAINING", r, round(auc, 4), count, flips, 1))
        top.offer(model, auc)
        gain, before, previous = auc - before, auc, chosen
        if kept is None or auc > best:
            kept = chosen
        best = max(best, auc)
        if gain < min_gain:
            break
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], f"{ID} long, pseudo_label int, confidence double")
    return Outcome(kept if kept is not None else empty, spark.createDataFrame(history, HISTORY), top.model, top.auc)


def standardise(rows: DataFrame, width: int) -> DataFrame:
    """``x`` with mean 0 and deviation 1 per position (constant positions become 0)."""
    a = rows.agg(*[f for i in range(width) for f in (F.avg(F.col("x")[i]).alias(f"m{i}"), F.stddev_pop(F.col("x")[i]).alias(f"s{i}"))])
    j = rows.join(F.broadcast(a))  # one row
    z = [F.when(F.col(f"s{i}") > 0, (F.col("x")[i] - F.col(f"m{i}")) / F.col(f"s{i}")).otherwise(0.0) for i in range(width)]
    return j.select(*[c for c in rows.columns if c != "x"], F.array(*z).alias("x"))


def label_spreading(labelled: DataFrame, unlabelled: DataFrame, width: int, k: int = 10, alpha: float = 0.2, rounds: int = 100, accept: float = 0.7,
                    tolerance: float = 1e-3, every: int = 5) -> DataFrame:
    """Pseudo-labels spread over the graph of near rows; accepted from ``accept`` confidence, the surest first.

    Neighbours are exact (``training.near_rows``).
    """
    both = labelled.select(ID, "x", F.col("y").cast("int").alias("y")).unionByName(unlabelled.select(ID, "x", F.lit(None).cast("int").alias("y")))
    z = cut(standardise(both, width))
    near = T.near_rows(z.select(ID, "x"), ID, width, k).select("id", "other")
    links = cut(near.unionByName(near.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct())
    deg = links.groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    w = lookup(lookup(links, deg.withColumnRenamed("d", "d1"), {"id": "id"}, ["other"]), deg.withColumnRenamed("d", "d2"), {"other": "id"}, ["id"])
    links = cut(w.select("id", "other", (1.0 / F.sqrt(F.col("d1") * F.col("d2"))).alias("w")))
    seed = z.select(F.col(ID).alias("id"), F.when(F.col("y") == 1, 1.0).otherwise(0.0).alias("y1"), F.when(F.col("y") == 0, 1.0).otherwise(0.0).alias("y0"))
    seed = cut(seed)
    state = seed.select("id", F.col("y1").alias("f1"), F.col("y0").alias("f0"))
    for r in range(rounds):
        before = state
        near = lookup(links, state, {"other": "id"}, ["id"]).groupBy("id").agg(F.sum(F.col("w") * F.col("f1")).alias("s1"), F.sum(F.col("w") * F.col("f0")).alias("s0"))
        mix = lambda s, y: alpha * F.coalesce(F.col(s), F.lit(0.0)) + (1 - alpha) * F.col(y)
        state = seed.join(near, "id", "left").select("id", mix("s1", "y1").alias("f1"), mix("s0", "y0").alias("f0"))
        if (r + 2) % every == 0:  # the round that the next one is compared with
            state = cut(state)
        if (r + 1) % every == 0:
            state = cut(state)
            moved = state.join(before.select("id", F.col("f1").alias("o1"), F.col("f0").alias("o0")), "id").agg(F.sum(F.abs(F.col("f1") - F.col("o1")) + F.abs(F.col("f0") - F.col("o0")))).first()[0]
            if (moved or 0.0) < tolerance:
                break
    total = F.col("f1") + F.col("f0")
    p = state.select(F.col("id").alias(ID), F.when(total > 0, F.col("f1") / total).otherwise(0.5).alias("p"))
    c = F.greatest(F.col("p"), 1.0 - F.col("p"))
    out = p.join(unlabelled.select(ID), ID, "left_semi").withColumn("confidence", c).withColumn("pseudo_label", (F.col("p") >= 0.5).cast("int"))
    return pseudo.keep_most_confident(out.filter(F.col("confidence") >= accept), labelled.count()).select(ID, "pseudo_label", "confidence")


def spread_classifier(labelled: DataFrame, unlabelled: DataFrame, domain: str, width: int, trees: int | None = None, depth: int | None = None, **how) -> Outcome:
    """Labels spread from the training part, a classifier fitted on it and on the spread rows, and its AUC on the holdout."""
    train, holdout, _ = _start(labelled)
    pool = cut(unlabelled.select(ID, "x"))
    chosen = cut(label_spreading(train.select(ID, "x", "y"), pool, width, **how))
    model = _fit(domain, _with_pseudo(train, chosen, pool), trees, depth)
    auc = _auc(model, holdout)
    history = labelled.sparkSession.createDataFrame([("LABEL_SPREADING", 0, round(auc, 4), chosen.count(), 0.0, 1)], HISTORY)
    return Outcome(chosen, history, model, auc)


def _spread(rows: DataFrame, width: int) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != "x"], *[F.col("x")[i].alias(f"x{i}") for i in range(width)])


def _noisy(pool: DataFrame, width: int, copies: int, dropout: float = 0.1, seed: int = T.SEED) -> DataFrame:
    names = [f"x{i}" for i in range(width)]
    n = pseudo.noisy_copies(_spread(pool, width), names, copies, dropout=dropout, seed=seed)
    return n.select(*[c for c in n.columns if c not in names], F.array(*names).alias("x"))


#: Rounds and epochs, the epoch from which pseudo rows have their whole weight, that weight, and the gain a round must bring.
EPOCHS, RAMP, PSEUDO_WEIGHT, MIN_GAIN = 10, 5, 0.5, 0.001


def ramped(epoch: int, ramp: int = RAMP, most: float = PSEUDO_WEIGHT) -> float:
    """Weight of pseudo rows in an epoch: it rises in equal steps."""
    return most * min(1.0, epoch / ramp)


def consistency(labelled: DataFrame, unlabelled: DataFrame, domain: str, width: int, copies: int = 5, trees: int | None = None, depth: int | None = None,
                epochs: int = EPOCHS, min_gain: float = MIN_GAIN) -> Outcome:
    """Epochs of: fit on labelled rows and those chosen before, at a weight that rises; score noisy copies; choose the rows whose score is stable.

    Every epoch draws other noise. It ends without gain. The pseudo-labels are those of the last epoch.
    """
    train, holdout, n = _start(labelled)
    pool = cut(unlabelled)
    best, history, chosen, before = _Best(), [], None, None
    for e in range(epochs):
        rows = train if chosen is None else _with_pseudo(train, chosen, pool, ramped(e))
        model = _fit(domain, rows, trees, depth, T.SEED + e)
        scored = cut(_score(model, _noisy(pool.select(ID, "x"), width, copies, 0.1, T.SEED + e)).select(ID, "copy", "p"))
        stable = pseudo.consistency_select(scored).withColumn("confidence", F.greatest("mean", 1.0 - F.col("mean")))
        chosen = cut(pseudo.keep_most_confident(stable, n).select(ID, "pseudo_label", "confidence"))
        auc = _auc(model, holdout)
        history.append(("CONSISTENCY", e, round(auc, 4), chosen.count(), 0.0, 1))
        best.offer(model, auc)
        if before is not None and auc - before < min_gain:
            break
        before = auc
    return Outcome(chosen, labelled.sparkSession.createDataFrame(history, HISTORY), best.model, best.auc)


def _beta_quantiles(a: float, b: float, n: int = 128) -> list[float]:
    """Quantiles of the Beta(a, b) distribution by numeric integration."""
    t = (np.arange(200_000) + 0.5) / 200_000
    c = np.cumsum(t ** (a - 1) * (1 - t) ** (b - 1))
    return np.interp((np.arange(n) + 0.5) / n, c / c[-1], t).tolist()


def _places(rows: DataFrame, name: str, *seed) -> DataFrame:
    """A random permutation: each row's position (from 0) in the order of a hash that changes with the seed."""
    drawn = rows.withColumn("_draw", F.xxhash64(ID, *[F.lit(x) for x in seed])).withColumn("_one", F.lit(1))
    return T.class_rank(drawn, "_draw", "_one", name).drop("_draw", "_one")


def mixed_rows(train: DataFrame, chosen: DataFrame, beta: float, seed: int) -> DataFrame:
    """MixUp in both directions (id, x, y, weight).

    Labelled rows (weight 1) are mixed with pseudo rows, one each in a random permutation; those for which no pseudo row is
    left stay as they are. Pseudo rows (weight one half) are mixed with labelled rows drawn with replacement. The own share is
    a Beta(``beta``, ``beta``) quantile drawn by hash, one half at least. ``train``: id, x, y; ``chosen``: id, x, q.
    """
    n = train.count()
    quantiles = F.array(*[F.lit(q) for q in _beta_quantiles(beta, beta)])

    def share(name: str):
        lam = F.element_at(quantiles, (F.pmod(F.xxhash64(ID, F.lit(name), F.lit(seed)), F.lit(128)) + 1).cast("int"))
        return F.greatest(lam, 1.0 - lam)

    def mixed(weight: float):
        l = F.col("_l")  # noqa: E741
        x = F.when(F.col("_x2").isNull(), F.col("x")).otherwise(F.zip_with("x", "_x2", lambda u, v: l * u + (1.0 - l) * v))
        y = F.when(F.col("_x2").isNull(), F.col("_y1")).otherwise(l * F.col("_y1") + (1.0 - l) * F.col("_y2"))
        return [ID, x.alias("x"), (y >= 0.5).cast("int").alias("y"), F.lit(weight).alias("weight")]

    own = _places(train.select(ID, "x", F.col("y").cast("double").alias("_y1")), "_pos", seed, "labelled")
    mates = _places(chosen.select(ID, F.col("x").alias("_x2"), F.col("q").alias("_y2")), "_pos", seed, "pseudo").drop(ID)
    labelled = own.join(mates, "_pos", "left").withColumn("_l", share("labelled")).select(*mixed(1.0))
    one = _places(train.select(ID, F.col("x").alias("_x2"), F.col("y").cast("double").alias("_y2")), "_pos", seed, "mates").drop(ID)
    drawn = chosen.select(ID, "x", F.col("q").alias("_y1"), F.pmod(F.xxhash64(ID, F.lit("mate"), F.lit(seed)), F.lit(max(n, 1))).alias("_pos"))
    return labelled.unionByName(lookup(drawn, one, {"_pos": "_pos"}, [ID]).withColumn("_l", share("pseudo")).select(*mixed(PSEUDO_WEIGHT)))


def mixmatch(labelled: DataFrame, unlabelled: DataFrame, domain: str, width: int, copies: int = 3, temperature: float = 0.5, beta: float = 0.75,
             trees: int | None = None, depth: int | None = None, rounds: int = EPOCHS, min_gain: float = MIN_GAIN) -> Outcome:
    """Rounds of: fit (first on labelled, then on mixed rows), average over noisy copies, sharpen, keep the sure rows, mix them with labelled ones both ways.

    It ends without gain, or when no row is sure. The pseudo-labels are those of the last round that had any.
    """
    train, holdout, n = _start(labelled)
    pool = cut(unlabelled)
    best, history, chosen, rows, before = _Best(), [], None, train, None
    for r in range(rounds):
        model = _fit(domain, rows, trees, depth, T.SEED + r)
        mean = _score(model, _noisy(pool.select(ID, "x"), width, copies, 0.15, T.SEED + r)).groupBy(ID).agg(F.avg("p").alias("m"))
        sure = mean.withColumn("q", pseudo.sharpen(F.col("m"), temperature)).filter((F.col("q") >= 0.8) | (F.col("q") <= 0.2))
        sure = sure.select(ID, (F.col("q") >= 0.5).cast("int").alias("pseudo_label"), F.greatest("q", 1.0 - F.col("q")).alias("confidence"), "q")
        sure = cut(pseudo.keep_most_confident(sure, n))
        count, auc = sure.count(), _auc(model, holdout)
        history.append(("MIXMATCH", r, round(auc, 4), count, 0.0, 1))
        best.offer(model, auc)
        if count:
            chosen = sure
        if not count or (before is not None and auc - before < min_gain):
            break
        rows, before = cut(mixed_rows(train, sure.join(pool.select(ID, "x"), ID), beta, T.SEED + r)), auc
    spark = labelled.sparkSession
    out = spark.createDataFrame([], f"{ID} long, pseudo_label int, confidence double") if chosen is None else chosen.select(ID, "pseudo_label", "confidence")
    return Outcome(out, spark.createDataFrame(history, HISTORY), best.model, best.auc)


def multi_view(labelled: DataFrame, unlabelled: DataFrame, domain: str, views: dict[str, list[int]], rounds: int = 5, top: int | None = None, trees: int | None = None, depth: int | None = None):
    """Models on separate column groups label rows for one another. ``views``: name -> positions in x."""
    train, holdout, n = _start(labelled)
    pool = cut(unlabelled)
    sets = {name: train for name in views}
    history, picked, best, top_model = [], [], 0.0, _Best()
    def seen(rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn("x", F.array(*[F.col("x")[i] for i in views[name]]))
    for r in range(rounds):
        scores = pool.select(ID)
        for name in views:
            m = _fit(domain, seen(sets[name], name), trees, depth, T.SEED + r)
            scores = scores.join(_score(m, seen(pool.select(ID, "x"), name), name).select(ID, name), ID)
        chosen = cut(pseudo.multi_view_agreement(scores, list(views), top=top).select(ID, "pseudo_label", F.greatest("mean", 1.0 - F.col("mean")).alias("confidence")))
        count = chosen.count()
        if count == 0:
            history.append(("MULTI_VIEW", r, best, 0, 0.0, 1))
            break
        extra = chosen.join(pool.select(ID, "x"), ID).select(ID, "x", F.col("pseudo_label").alias("y"), F.lit(1.0).alias("weight"))
        sets = {name: cut(s.unionByName(extra)) for name, s in sets.items()}
        model = _fit(domain, _with_pseudo(train, chosen, pool), trees, depth)
        auc = _auc(model, holdout)
        top_model.offer(model, auc)
        best = max(best, auc)
        picked.append(chosen)
        safe = count * (r + 1) <= 3.0 * n
        history.append(("MULTI_VIEW", r, round(auc, 4), count, 0.0, int(safe)))
        if not safe:
            break
        pool = cut(pool.join(chosen.select(ID), ID, "left_anti"))
    spark = labelled.sparkSession
    out = reduce(DataFrame.unionByName, picked) if picked else spark.createDataFrame([], f"{ID} long, pseudo_label int, confidence double")
    return Outcome(out, spark.createDataFrame(history, HISTORY), top_model.model, top_model.auc)


def tri_training(labelled: DataFrame, unlabelled: DataFrame, domain: str, rounds: int = 8, top: int | None = None, max_disagreement: float = 0.10, bootstrap: float = 0.8,
                 trees: int | None = None, depth: int | None = None):
    """Three learners of different kinds (deep and shallow boosting, forest) on different samples; two that agree teach the third."""
    train, holdout, n = _start(labelled)
    pool = cut(unlabelled)
    names = ["a", "b", "c"]
    learners = dict(zip(names, T.base_learners(domain, trees, depth).values()))
    sets = {m: train for m in names}
    history, picked, total, best = [], [], 0, _Best()
    for r in range(rounds):
        models = {}
        for m in names:
            # how often a row is drawn follows from its hash, so a retried task draws the same
            u = T._unit(F.col(ID), F.lit(m), F.lit(r))
            times = F.when(u < np.exp(-bootstrap), 0).when(u < np.exp(-bootstrap) * (1 + bootstrap), 1).when(u < np.exp(-bootstrap) * (1 + bootstrap + bootstrap**2 / 2), 2).otherwise(3)
            drawn = sets[m].withColumn("_t", times).filter("_t > 0").withColumn("weight", F.col("weight") * F.col("_t")).drop("_t")
            models[m] = learners[m].fit(T.weighted(T.with_vector(drawn), T.K.TRAINING[domain][3], "weight"))
        scores, held = pool.select(ID, "x"), holdout
        for m in names:
            scores, held = _score(models[m], scores, m), _score(models[m], held, m)
        scores = cut(scores.drop("x"))
        auc = float(BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="p", numBins=0).evaluate(held.withColumn("p", (F.col("a") + F.col("b") + F.col("c")) / 3.0)))
        best.offer(models, auc)
        chosen = cut(pseudo.tri_training_agreement(scores, names, top).select("learner", ID, "pseudo_label", F.greatest("mean", 1.0 - F.col("mean")).alias("confidence")))
        apart = pseudo.disagreement(scores, "a", "b").first()[0] or 0.0
        count = chosen.count()
        total += count
        safe = apart <= max_disagreement and total <= 3.0 * n
        history.append(("TRI_TRAINING", r, round(auc, 4), count, round(float(apart), 4), int(safe)))
        picked.append(chosen)
        if not safe or count == 0:
            break
        for m in names:
            extra = chosen.filter(F.col("learner") == m).join(pool, ID).select(ID, "x", F.col("pseudo_label").alias("y"), F.lit(1.0).alias("weight"))
            sets[m] = cut(sets[m].unionByName(extra))
    every = reduce(DataFrame.unionByName, picked)
    out = every.groupBy(ID).agg(F.max_by("pseudo_label", "confidence").alias("pseudo_label"), F.max("confidence").alias("confidence"))
    return Outcome(out, labelled.sparkSession.createDataFrame(history, HISTORY), best.model, best.auc)
