"""Training queries over the given tables. Tree counts are kept small so that a run is quick."""

from pyspark.sql import functions as F

from ..functions.session import cut
from ..operators import semisupervised as S
from ..operators import training as T
from .registry import query
from .sqlviews import using

WIDTH = 64
TREES = 3


def ml(v):
    """Embeddings as arrays of doubles with the 0/1 target."""
    return v.ml_set.select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "y")


@query("stratified_split", using("", """
  SELECT doc_id, y::BIGINT AS y, (rn < round(n * 0.2::DOUBLE))::BIGINT AS is_test, rn % 5 AS fold
  FROM (SELECT doc_id, toxic AS y, row_number() OVER (PARTITION BY toxic ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS rn, count(*) OVER (PARTITION BY toxic) AS n FROM labels)"""))
def stratified_split(v):
    d = v.table("labels").select("doc_id", F.col("toxic").alias("y"))
    return T.stratified_kfold(T.stratified_split(d, "doc_id", "y"), "doc_id", "y")


@query("train_classifier")
def train_classifier(v):
    return T.train_classifier(T.with_vector(ml(v)), "fraud", "vec_id", folds=3, trees=TREES, depth=4)[1]


@query("near_rows", using("", """
  SELECT id, other, rank, round(distance, 6) AS distance FROM
    (SELECT a.vec_id AS id, b.vec_id AS other, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance,
            row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank
     FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id) WHERE rank <= 10"""))
def near_rows(v):
    """The ten nearest rows of every embedding, in blocks small enough to meet many of them here."""
    return T.near_rows(ml(v), "vec_id", WIDTH, 10, block=200).select("id", "other", "rank", F.round("distance", 6).alias("distance"))


@query("oversample")
def oversample(v):
    """Counts of synthetic rows per strategy, and their mean first coordinate."""
    train = cut(T.stratified_split(ml(v), "vec_id", "y").filter("is_test = 0").select("vec_id", "x", "y"))
    out = [T.oversample(train, "vec_id", WIDTH, s).select(F.lit(s).alias("strategy"), F.col("x")[0].alias("x0")) for s in ("SMOTE", "ADASYN", "BORDERLINE")]
    return out[0].unionByName(out[1]).unionByName(out[2]).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x0"), 4).alias("mean_x0"))


@query("calibrate")
def calibrate(v):
    """Fitted on one fold, applied to another."""
    d = cut(T.weighted(T.stratified_kfold(T.with_vector(ml(v)), "vec_id", "y", 3), 10.0))
    m = T.boosted("fraud", TREES, depth=4).fit(d.filter("fold = 0"))
    c = T.fit_calibrator(T.probability(m.transform(d.filter("fold = 1"))))
    return T.calibrate(T.probability(m.transform(d.filter("fold = 2"))), c).select("vec_id", "y", "p", "calibrated")


@query("stack")
def stack(v):
    return T.stack(T.with_vector(ml(v)), "merchant", "vec_id", folds=2, trees=TREES)[2]


@query("isolation_forest")
def isolation_forest(v):
    return T.isolation_forest(ml(v), "vec_id", "bigint", 0.05)[2]


@query("anomaly_attribution")
def anomaly_attribution(v):
    forest, offset, _ = T.isolation_forest(ml(v), "vec_id", "bigint", 0.05)
    return T.anomaly_attribution(ml(v), forest, offset, "vec_id", "bigint", WIDTH)


@query("tune")
def tune(v):
    space = {"maxDepth": (2, 4), "stepSize": (0.01, 0.3), "maxIter": (2, 4)}
    return T.tune(T.with_vector(ml(v)), "fraud", "vec_id", trials=2, folds=2, space=space)[1]


def pools(v):
    """A third of the vectors counts as labelled."""
    d = ml(v).select(F.col("vec_id").alias("prediction_id"), "x", "y")
    return cut(d.filter("prediction_id % 3 = 0")), cut(d.filter("prediction_id % 3 <> 0").drop("y"))


@query("self_training")
def self_training(v):
    return S.self_training(*pools(v), "fraud", rounds=2, trees=TREES, depth=4)[1]


@query("label_spreading")
def label_spreading(v):
    return S.label_spreading(*pools(v), WIDTH, rounds=10)


@query("consistency")
def consistency(v):
    return S.consistency(*pools(v), "fraud", WIDTH, trees=TREES, depth=4)[0]


@query("mixmatch")
def mixmatch(v):
    return S.mixmatch(*pools(v), "fraud", WIDTH, trees=TREES, depth=4)[0]


@query("multi_view")
def multi_view(v):
    third = WIDTH // 3
    views = {"left": list(range(third)), "middle": list(range(third, 2 * third)), "right": list(range(2 * third, WIDTH))}
    return S.multi_view(*pools(v), "fraud", views, rounds=1, trees=TREES, depth=4)[1]


@query("tri_training")
def tri_training(v):
    return S.tri_training(*pools(v), "fraud", rounds=1, trees=TREES, depth=4)[1]
