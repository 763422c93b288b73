"""Supervised and anomaly models on pyspark.ml, with splits and scores that do not depend on row order.

Model inputs have an id, a ``features`` vector and a 0/1 target ``y``.
"""

from __future__ import annotations

import math
import random
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import timeline as tl
from ..functions.bins import sliced_by_value, value_slices
from ..functions.joins import lookup, top_per_group
from ..functions.select import at_ranks
from ..functions.session import cut
from . import governance

SEED = 42


def class_rank(df: DataFrame, id_col: str, y: str, name: str = "_rank") -> DataFrame:
    """Position of a row in its class, ordered by the hash of its id, from 0.

    The ranks are prefix sums over slices of the hash, so a class is never ordered in one task.
    """
    h = df.withColumn("_h", F.md5(F.col(id_col).cast("string")))
    r = tl.running(h, [y], "_h", {name: F.lit(1).cast("long")}, F.substring("_h", 1, 3), tie=id_col)
    return r.drop("_h")


def stratified_split(df: DataFrame, id_col: str, y: str, share: float = 0.2) -> DataFrame:
    """Adds ``is_test``: the first ``share`` of every class in hash order."""
    n = df.groupBy(y).agg(F.count(F.lit(1)).alias("_n"))
    r = class_rank(df, id_col, y).join(F.broadcast(n), y)  # one row per class
    return r.select(*df.columns, (F.col("_rank") < F.round(F.col("_n") * share)).cast("int").alias("is_test"))


def stratified_kfold(df: DataFrame, id_col: str, y: str, k: int = 5) -> DataFrame:
    """Adds ``fold`` 0..k-1, balanced within every class."""
    return class_rank(df, id_col, y).withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank")


def probability(scored: DataFrame, name: str = "p") -> DataFrame:
    return scored.withColumn(name, vector_to_array("probability")[1]).drop("probability", "rawPrediction", "prediction")


def weighted(df: DataFrame, positive_weight: float, weight: str | None = None) -> DataFrame:
    w = F.when(F.col("y") == 1, positive_weight).otherwise(1.0)
    return df.withColumn("_w", w * F.col(weight) if weight else w)


def boosted(domain: str, trees: int | None = None, seed: int = SEED, depth: int | None = None) -> GBTClassifier:
    n, d, rate, _ = K.TRAINING[domain]
    return GBTClassifier(labelCol="y", featuresCol="features", weightCol="_w", maxIter=trees or n, maxDepth=depth or d, stepSize=rate, seed=seed, maxBins=32)


def metric_rows(preds: DataFrame, model: str) -> DataFrame:
    """AUC, precision, recall, F1 and accuracy of scored rows (y, p) at 0.5, as rows."""
    cls = governance.classification_metrics(preds.withColumn("pred", (F.col("p") >= 0.5).cast("int")))
    j = cls.join(F.broadcast(governance.roc_auc(preds, "p")))  # one row each
    return j.select(F.lit(model).alias("model"), "n", *[F.round(c, 4).alias(c) for c in ("roc_auc", "precision", "recall", "f1", "accuracy")])


def train_classifier(df: DataFrame, domain: str, id_col: str, folds: int = 5, trees: int | None = None, depth: int | None = None):
    """(model, report): boosted trees with the domain's class weight; the report has cross-validated AUC
    and test metrics."""
    pos = K.TRAINING[domain][3]
    data = cut(weighted(stratified_kfold(stratified_split(df, id_col, "y"), id_col, "y", folds), pos))
    train, test = data.filter("is_test = 0"), data.filter("is_test = 1")
    gbt = boosted(domain, trees, depth=depth)
    aucs = []
    for f in range(folds):
        fold = probability(gbt.fit(train.filter(F.col("fold") != f)).transform(train.filter(F.col("fold") == f)))
        aucs.append(BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="p", numBins=0).evaluate(fold))
    model = gbt.fit(train)
    report = metric_rows(probability(model.transform(test)), domain).withColumn("cv_auc_mean", F.lit(round(float(np.mean(aucs)), 4))).withColumn(
        "cv_auc_std", F.lit(round(float(np.std(aucs)), 4)))
    return model, report


# ---- neighbours ------------------------------------------------------------------------
#: Rows of a cell, the most pivots, and the most rows of either side that meet in one task.
BLOCK, PIVOTS, TILE = 2000, 512, 16_384


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between two sets of points, by differences (a matrix product would round near neighbours), a few rows at a time."""
    out, step = np.empty((len(a), len(b))), max(1, 1_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        out[i:i + step] = np.sqrt(((a[i:i + step, None, :] - b[None, :, :]) ** 2).sum(2))
    return out


def _nearest_in(q_id, q, d_id, d, k: int, bound=None):
    """(query, other, distance, row of the query) of the k nearest rows of a tile; copies of the query itself are left out, further ones than ``bound`` too.

    A matrix product rules out rows that are too far, with room for its rounding; what is left is compared by differences.
    """
    bound = np.full(len(q), np.inf) if bound is None else bound
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    if not len(q) or not len(d):
        return out[0]
    shift = d.mean(0)
    a, b = q - shift, d - shift
    a2, b2 = (a * a).sum(1), (b * b).sum(1)
    room = 8 * (q.shape[1] + 8) * np.finfo(float).eps * (a2 + b2.max())
    again = np.isin(q_id, d_id)
    step = max(1, 4_000_000 // len(d))
    for i in range(0, len(q), step):
        part = slice(i, i + step)
        square = a[part] @ b.T
        square *= -2.0
        square += b2
        square += a2[part, None]
        for j in np.flatnonzero(again[part]):
            square[j, d_id == q_id[i + j]] = np.inf
        limit = bound[part] ** 2 * (1 + 1e-12) + room[part]
        near = (square <= limit[:, None]) & (square < np.inf)
        for j in np.flatnonzero(np.count_nonzero(near, axis=1) > 4 * k):
            kth = np.partition(square[j], k - 1)[k - 1] if k <= len(d) else np.inf
            near[j] &= square[j] <= kth + 2 * room[i + j]
        x, y = np.nonzero(near)
        exact = np.empty(len(x))
        for c in range(0, len(x), 50_000):
            exact[c:c + 50_000] = np.sqrt(((q[i + x[c:c + 50_000]] - d[y[c:c + 50_000]]) ** 2).sum(1))
        ok = np.isfinite(exact) & (exact <= bound[i + x])
        x, y, exact = x[ok], y[ok], exact[ok]
        order = np.lexsort((d_id[y], exact, x))
        x, y, exact = x[order], y[order], exact[order]
        first = np.arange(len(x)) - np.searchsorted(x, x) < k
        x, y, exact = x[first], y[first], exact[first]
        out.append((q_id[i + x], d_id[y], exact, i + x))
    return [np.concatenate(c) for c in zip(*out)]


def near_rows(df: DataFrame, id_col: str, width: int, k: int, seed: int = SEED, block: int = BLOCK, pivots: int = PIVOTS, asking: Column | None = None) -> DataFrame:
    """The k nearest other rows of every row: (id, other, distance, rank), ties by id. ``df``: a long id and ``x``, an array;
    ``asking``: a condition on ``df`` for the rows whose neighbours are wanted (all by default), against all rows.

    Exact. Rows belong to the cell of their nearest pivot (sampled rows; cells of about ``block`` rows). Cells near each other
    make a tile of at most about ``TILE`` rows, and a larger cell several tiles. The k-th distance inside the own tile bounds
    the search of a row; two tiles meet, in a task of their own, where a row of one may have a nearer one in a cell of the
    other, by the triangle inequality. A tile is shuffled as one packed row. In data without structure every tile is met and
    the work is that of all pairs of rows, in tasks of bounded size.
    """
    import pyarrow as pa

    x = df.select(F.col(id_col).cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"), (F.lit(True) if asking is None else F.coalesce(asking, F.lit(False))).alias("asks"))
    finite = F.forall("x", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(v))
    x = cut(x.filter("id is not null and x is not null").filter(finite))
    n = x.count()
    schema = "id long, other long, distance double"
    if n < 2:
        return x.sparkSession.createDataFrame([], schema + ", rank int")
    wanted = min(pivots, max(1, n // block))
    points = x.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(wanted).select("x").collect()  # at most ``pivots`` rows
    centre = np.array([r["x"] for r in points], float)

    def matrix(column) -> np.ndarray:
        return np.array(column.to_pylist(), float).reshape(len(column), -1)

    def placed(parts):
        for part in parts:
            for i in range(0, part.num_rows, 1000):
                few = part.slice(i, 1000)
                d = _distances(matrix(few.column("x")), centre)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([few.column("id"), few.column("x"), few.column("asks"), pa.array(cell), pa.array(d[np.arange(len(d)), cell])], names=["id", "x", "asks", "cell", "reach"])

    rows = cut(x.mapInArrow(placed, "id long, x array<double>, asks boolean, cell long, reach double"))
    cells = {r["cell"]: (r["n"], r["r"]) for r in rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("r")).collect()}  # one row a pivot
    most = max(block, min(TILE, n // 16))
    first, parts, size, at, left = {}, {}, 0, 0, sorted(cells)
    here = left[0]
    while left:  # from cell to nearest cell, so that a tile is one region
        here = min(left, key=lambda c: ((centre[c] - centre[here]) ** 2).sum())
        left.remove(here)
        m = cells[here][0]
        if size and size + m > most:
            at, size = at + 1, 0
        first[here], parts[here] = at, -(-m // most)
        if parts[here] > 1:
            at += parts[here]
        else:
            size += m
    pick = lambda of: F.element_at(F.create_map(*[F.lit(v).cast("long") for c in of for v in (c, of[c])]), F.col("cell"))
    rows = rows.withColumn("tile", pick(first) + F.pmod(F.xxhash64("id", F.lit(seed)), pick(parts)))
    known = np.array(sorted(cells))
    radius = np.array([cells[c][1] for c in known.tolist()])

    def packed(table):
        ids, points, asks = table.column("id").to_numpy(), matrix(table.column("x")), table.column("asks").to_numpy()
        bound = np.full(len(ids), np.nan)
        bound[asks] = np.inf
        reached = np.zeros(len(known), bool)
        if asks.any():
            _, _, d, row = _nearest_in(ids[asks], points[asks], ids, points, k)
            count = np.bincount(row, minlength=int(asks.sum()))
            last = np.cumsum(count) - 1
            bound[np.flatnonzero(asks)[count >= k]] = d[last[count >= k]]
            for i in range(0, len(ids), 1000):
                few = np.flatnonzero(asks[i:i + 1000]) + i
                least = _distances(points[few], centre[known]) - radius[None, :]
                reached |= (least <= bound[few, None] * (1 + 1e-9) + 1e-9 * radius[None, :] + 1e-12).any(0)
        met = sorted({first[c] + i for c in known[reached].tolist() for i in range(parts[c])})
        narrow = points.astype(np.float32)
        exact = bool((narrow == points).all())
        return pa.table({"tile": pa.array([table.column("tile")[0].as_py()], pa.int64()), "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                         "points": pa.array([(narrow if exact else points).tobytes()], pa.binary()), "single": pa.array([exact]),
                         "bound": pa.array([bound.tobytes()], pa.binary()), "meets": pa.array([met], pa.list_(pa.int64()))})

    body = "tile long, ids binary, points binary, single boolean, bound binary"
    tiles = cut(rows.groupBy("tile").applyInArrow(packed, f"{body}, meets array<long>"))
    what = ["ids", "points", "single"]
    ask = tiles.select(F.explode("meets").alias("data"), F.col("tile").alias("asked"), *what, "bound")
    data = ask.select("data", "asked").join(tiles.select(F.col("tile").alias("data"), *what, F.lit(None).cast("binary").alias("bound")), "data")

    def meet(table):
        sides = {}
        for r in table.to_pylist():
            ids = np.frombuffer(r["ids"], "<i8")
            p = np.frombuffer(r["points"], np.float32 if r["single"] else np.float64).reshape(len(ids), -1).astype(float)
            sides[r["bound"] is None] = ids, p, r["bound"]
        (ids, points, bound), (d_id, d, _) = sides[False], sides[True]
        bound = np.frombuffer(bound, float)
        asks = ~np.isnan(bound)
        q, o, far, _ = _nearest_in(ids[asks], points[asks], d_id, d, k, bound[asks])
        return pa.table({"id": pa.array(q, pa.int64()), "other": pa.array(o, pa.int64()), "distance": pa.array(far, pa.float64())})

    found = ask.unionByName(data).groupBy("data", "asked").applyInArrow(meet, schema)
    best = found.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "other"))), 1, k).alias("b"))  # k for each tile met
    e = best.select("id", F.posexplode("b").alias("rank", "e"))
    return e.select("id", F.col("e.other").alias("other"), F.col("e.distance").alias("distance"), (F.col("rank") + 1).alias("rank"))


def _unit(*keys: Column) -> Column:
    return (F.pmod(F.xxhash64(*keys), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def oversample(train: DataFrame, id_col: str, width: int, strategy: str = "SMOTE", k: int = 5, seed: int = SEED) -> DataFrame:
    """Synthetic minority rows (``x``, y = 1) that balance a training part; ``train``: id, x, y.

    SMOTE spreads them evenly; ADASYN in proportion to the share of majority rows near a row;
    BORDERLINE only over rows with at least half, but not all, of their neighbours in the majority.
    """
    counts = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    need = counts.get(0, 0) - counts.get(1, 0)
    minority = cut(train.filter("y = 1").select(id_col, "x"))
    if strategy == "SMOTE":
        share = minority.select(F.col(id_col).alias("id"), F.lit(1.0).alias("g"))
    else:
        near = near_rows(train, id_col, width, k, seed=seed, asking=F.col("y") == 1).join(minority.select(F.col(id_col).alias("id")), "id", "left_semi")
        y = train.select(F.col(id_col).alias("_o"), "y")
        r = lookup(near, y, {"other": "_o"}, ["id"]).groupBy("id").agg(F.avg((F.col("y") == 0).cast("double")).alias("r"))
        share = r.select("id", F.col("r").alias("g")) if strategy == "ADASYN" else r.select("id", ((F.col("r") >= 0.5) & (F.col("r") < 1.0)).cast("double").alias("g"))
    total = share.agg(F.sum("g")).first()[0] or 0.0
    if need <= 0 or total <= 0:
        return minority.limit(0).select(F.lit("").alias("synthetic_id"), "x", F.lit(1).alias("y"))
    want = F.col("g") * (need / total)
    copies = (F.floor(want) + (_unit(F.col("id"), F.lit(seed)) < want - F.floor(want)).cast("int")).cast("int")
    plan = share.select("id", copies.alias("c")).filter("c > 0").select("id", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("copy"))
    mates = near_rows(minority, id_col, width, k, seed=seed + 1).select("id", "rank", "other")
    degree = mates.groupBy("id").agg(F.max("rank").alias("deg"))
    pick = plan.join(degree, "id").withColumn("rank", (F.floor(_unit(F.col("id"), F.col("copy"), F.lit(seed)) * F.col("deg")) + 1).cast("int")).join(mates, ["id", "rank"])
    x = minority.select(F.col(id_col).alias("_id"), "x")
    j = lookup(lookup(pick, x.withColumnRenamed("x", "a"), {"id": "_id"}, ["copy"]), x.withColumnRenamed("x", "b"), {"other": "_id"}, ["id"])
    lam = _unit(F.col("copy"), F.col("id"), F.lit(seed + 7))
    j = j.withColumn("_l", lam)
    mixed = F.zip_with("a", "b", lambda a, b: a + F.col("_l") * (b - a))
    return j.select(F.concat_ws("-", F.lit("syn"), F.col("id").cast("string"), F.col("copy").cast("string")).alias("synthetic_id"), mixed.alias("x"), F.lit(1).alias("y"))


# ---- calibration and stacking ------------------------------------------------------------
def fit_calibrator(scored: DataFrame):
    """Isotonic map from score ``p`` to the share of positives; fit it on rows the model has not seen."""
    a = VectorAssembler(inputCols=["p"], outputCol="_pv")
    return IsotonicRegression(labelCol="y", featuresCol="_pv", predictionCol="calibrated").fit(a.transform(scored))


def calibrate(scored: DataFrame, calibrator) -> DataFrame:
    a = VectorAssembler(inputCols=["p"], outputCol="_pv")
    return calibrator.transform(a.transform(scored)).drop("_pv")


def base_learners(domain: str, trees: int | None, depth: int | None = None):
    """Three learners of different kinds, by name."""
    n, d, rate, _ = K.TRAINING[domain]
    d = depth or d
    common = {"labelCol": "y", "featuresCol": "features", "weightCol": "_w"}
    return {
        "boosted_deep": GBTClassifier(maxIter=trees or n, maxDepth=d, stepSize=rate, seed=SEED, **common),
        "boosted_shallow": GBTClassifier(maxIter=trees or n, maxDepth=max(2, d - 3), stepSize=2 * rate, subsamplingRate=0.8, seed=SEED + 1, **common),
        "forest": RandomForestClassifier(numTrees=trees or 300, maxDepth=d, seed=SEED + 2, **common),
    }


def stack(df: DataFrame, domain: str, id_col: str, folds: int = 5, trees: int | None = None):
    """(meta model, base models, report): out-of-fold scores of three learners feed a logistic model."""
    pos = K.TRAINING[domain][3]
    data = cut(weighted(stratified_kfold(stratified_split(df, id_col, "y"), id_col, "y", folds), pos))
    train, test = data.filter("is_test = 0"), data.filter("is_test = 1")
    learners = base_learners(domain, trees)
    parts = []
    for f in range(folds):
        rest, held = train.filter(F.col("fold") != f), train.filter(F.col("fold") == f)
        for name, learner in learners.items():
            held = probability(learner.fit(rest).transform(held), name)
        parts.append(held)
    oof = cut(reduce(DataFrame.unionByName, parts))
    a = VectorAssembler(inputCols=list(learners), outputCol="meta")
    meta = LogisticRegression(labelCol="y", featuresCol="meta", weightCol="_w").fit(a.transform(oof))
    models = {name: learner.fit(train) for name, learner in learners.items()}
    scored = test
    for name, m in models.items():
        scored = probability(m.transform(scored), name)
    scored = cut(probability(meta.transform(a.transform(scored)), "p"))
    rows = [metric_rows(scored, "stacked")] + [metric_rows(scored.withColumn("p", F.col(n)), n) for n in learners]
    return meta, models, reduce(DataFrame.unionByName, rows)


# ---- isolation forest ------------------------------------------------------------------------
NODE_SCHEMA = "tree int, node int, feature int, threshold double, size int"
SAMPLE = 256


def _average_path(n):
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        c = 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _grow(pdf: pd.DataFrame) -> pd.DataFrame:
    """One isolation tree over at most SAMPLE rows; children of node i are 2i+1 and 2i+2."""
    tree = int(pdf["tree"].iloc[0])
    pdf = pdf.sort_values("h").head(SAMPLE)
    x = np.array(pdf["x"].tolist(), dtype=float)
    rng = np.random.default_rng([SEED, tree])
    limit = int(math.ceil(math.log2(max(len(x), 2))))
    out, todo = [], [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            out.append((tree, node, -1, 0.0, len(rows)))
            continue
        f = int(rng.choice(usable))
        t = float(rng.uniform(lo[f], hi[f]))
        left = part[:, f] < t
        out.append((tree, node, f, t, len(rows)))
        todo += [(2 * node + 1, rows[left], depth + 1), (2 * node + 2, rows[~left], depth + 1)]
    return pd.DataFrame(out, columns=["tree", "node", "feature", "threshold", "size"])


def draw_samples(df: DataFrame, id_col: str, trees: int, size: int) -> DataFrame:
    """(tree, id, x, h): for each tree the ``size`` rows of least hash of id and tree, by one rule at every table size.

    Rows below a threshold are counted for each tree; it is raised until every tree has enough, so the least are all among
    them, and the few drawn are ordered.
    """
    n, row = df.count(), F.col(id_col)
    need, share = min(size, n), 2.0
    while True:
        below = min(1.0, share * size / max(n, 1))
        tree = F.explode(F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: _unit(row, t, F.lit("order")) < below))  # noqa: B023
        drawn = cut(df.select(row, "x", tree.alias("tree")).withColumn("h", _unit(row, F.col("tree"), F.lit("order"))))
        enough = drawn.groupBy("tree").count().where(F.col("count") >= need).count()
        if enough == trees or below >= 1.0:
            return top_per_group(drawn, ["tree"], [F.col("h"), row], size, "_rank").drop("_rank")
        share *= 2


def grow_forest(df: DataFrame, id_col: str, trees: int = 200) -> DataFrame:
    """Nodes of an isolation forest; every tree sees SAMPLE rows (all of a smaller table), drawn by hash."""
    return draw_samples(df, id_col, trees, SAMPLE).select("tree", "x", "h").groupBy("tree").applyInPandas(_grow, NODE_SCHEMA)


class Forest:
    """An isolation forest as arrays: trees x 2 * SAMPLE node slots at the most, so it is small enough to ship."""

    def __init__(self, nodes: pd.DataFrame):
        self.trees = []
        self.sample = 0
        for _, t in nodes.groupby("tree"):
            width = int(t["node"].max()) + 1
            feature, threshold, size = np.full(width, -1), np.zeros(width), np.zeros(width)
            at = t["node"].to_numpy()
            feature[at], threshold[at], size[at] = t["feature"], t["threshold"], t["size"]
            self.trees.append((feature, threshold, size))
            self.sample = max(self.sample, int(size[0]))

    @classmethod
    def from_frame(cls, nodes: DataFrame) -> Forest:
        return cls(nodes.toPandas())  # bounded by trees x 2 x SAMPLE rows

    def score(self, x: np.ndarray) -> np.ndarray:
        """-2^(-mean path / expected path): lower is more unusual."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, threshold, size in self.trees:
            node, depth = np.zeros(len(x), dtype=int), np.zeros(len(x))
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.where(inner, f, 0)] >= threshold[node]
                node = np.where(inner, 2 * node + 1 + right, node)
                depth += inner
            total += depth + _average_path(size[node])
        return -np.power(2.0, -(total / max(len(self.trees), 1)) / _average_path([max(self.sample, 2)])[0])


def forest_scores(df: DataFrame, forest: Forest, schema: str) -> DataFrame:
    """Adds ``raw``; ``schema`` is the DDL of the columns of ``df``."""
    shipped = df.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for pdf in batches:
            x = np.array(pdf["x"].tolist(), dtype=float).reshape(len(pdf), -1)
            yield pdf.assign(raw=shipped.value.score(x) if len(pdf) else np.zeros(0))

    return df.mapInPandas(run, schema + ", raw double")


def isolation_forest(df: DataFrame, id_col: str, id_type: str, contamination: float, trees: int = 200) -> tuple[Forest, float, DataFrame]:
    """(forest, offset, scores): anomaly score scaled to [0, 1], sigmoid score, and the flag for the
    ``contamination`` share of lowest raw scores. ``df``: id, x, y."""
    forest = Forest.from_frame(grow_forest(df, id_col, trees))
    raw = cut(forest_scores(df.select(id_col, "x", "y"), forest, f"{id_col} {id_type}, x array<double>, y int"))
    n = raw.count()
    rank = max(0, min(n, int(round(contamination * n))) - 1)
    offset = at_ranks(raw.withColumn("_all", F.lit(0)), "_all", "raw", {0: [rank]})[0][0]  # the last of the share, exactly
    rng = raw.agg(F.min("raw").alias("_lo"), F.max("raw").alias("_hi"))
    scaled = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("raw")) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    out = raw.join(F.broadcast(rng)).select(id_col, "y", "raw", scaled.alias("anomaly_score"), (F.col("raw") <= offset).cast("int").alias("flagged"))  # one row
    return forest, offset, out.withColumn("sigmoid_score", anomaly_sigmoid(F.col("raw") - offset))


def anomaly_sigmoid(decision: Column) -> Column:
    """1 / (1 + e^(5 * decision)): near 1 for clearly unusual rows."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 / (1.0 + F.exp(5.0 * decision))))


def anomaly_attribution(df: DataFrame, forest: Forest, offset: float, id_col: str, id_type: str, width: int, top: int = 10) -> DataFrame:
    """Per row the ``top`` features whose replacement by 0 changes the sigmoid score most.

    A row and its changed copies are scored together inside a batch, so nothing is shuffled.
    """
    shipped = df.sparkSession.sparkContext.broadcast(forest)

    def sigmoid(raw):
        return 1.0 / (1.0 + np.exp(np.clip(5.0 * (raw - offset), -60, 60)))

    def run(batches):
        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.array(pdf["x"].tolist(), dtype=float)
            base = sigmoid(shipped.value.score(x))
            impact = np.empty_like(x)
            for f in range(width):
                y = x.copy()
                y[:, f] = 0.0
                impact[:, f] = base - sigmoid(shipped.value.score(y))
            order = np.argsort(-np.abs(impact), axis=1, kind="stable")[:, :top]
            n, m = order.shape
            r = np.repeat(np.arange(n), m)
            f = order.ravel()
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy()[r], "rank": np.tile(np.arange(1, m + 1), n), "feature": f, "value": x[r, f], "impact": impact[r, f]})

    return df.select(id_col, "x").mapInPandas(run, f"{id_col} {id_type}, rank int, feature int, value double, impact double")


# ---- tuning -------------------------------------------------------------------------------------
# --- fixed values: search ranges -------------------------------------------------------------------
SEARCH_SPACE = {"maxDepth": (4, 12), "stepSize": (0.01, 0.3), "maxIter": (100, 1000), "minInstancesPerNode": (10, 100), "subsamplingRate": (0.6, 1.0)}


def tune(df: DataFrame, domain: str, id_col: str, trials: int = 50, folds: int = 5, parallelism: int = 4, space: dict | None = None):
    """(best model, report) of a seeded random search over the space, by cross-validated AUC on fixed folds.

    The positive weight is the ratio of the classes.
    """
    c = {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    data = cut(weighted(stratified_kfold(df, id_col, "y", folds), c.get(0, 0) / max(c.get(1, 0), 1)))
    gbt = GBTClassifier(labelCol="y", featuresCol="features", weightCol="_w", seed=SEED)
    rng = random.Random(SEED)
    grid = []
    for _ in range(trials):
        point = {}
        for name, (lo, hi) in (space or SEARCH_SPACE).items():
            value = rng.randint(lo, hi) if isinstance(lo, int) else rng.uniform(lo, hi)
            point[gbt.getParam(name)] = value
        grid.append(point)
    ev = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="rawPrediction", numBins=0)
    cv = CrossValidator(estimator=gbt, estimatorParamMaps=grid, evaluator=ev, numFolds=folds, foldCol="fold", parallelism=parallelism).fit(data)
    rows = [(i, ", ".join(f"{p.name}={v:.4g}" for p, v in sorted(g.items(), key=lambda x: x[0].name)), round(float(a), 4)) for i, (g, a) in enumerate(zip(grid, cv.avgMetrics))]
    return cv.bestModel, df.sparkSession.createDataFrame(rows, "trial int, parameters string, auc double")


def with_vector(df: DataFrame, array_col: str = "x") -> DataFrame:
    return df.withColumn("features", array_to_vector(array_col))
