"""Semi-supervised loops on planted structure."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from paywarden.operators import semisupervised as S

WIDTH = 4


@pytest.fixture(scope="module")
def planted(spark):
    """Two clusters; few rows are labelled, some of them wrongly."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(1200):
        y = int(rng.random() < 0.12)
        x = rng.normal(1.5 if y else -1.5, 1.0, WIDTH)
        rows.append((i, x.tolist(), y))
    df = spark.createDataFrame(rows, "prediction_id long, x array<double>, y int").repartition(4)
    wrong = F.when(F.pmod("prediction_id", F.lit(400)) == 0, 1 - F.col("y")).otherwise(F.col("y"))
    return df.filter("prediction_id % 4 = 0").withColumn("y", wrong).cache(), df.filter("prediction_id % 4 <> 0").cache()


def test_mixed_rows_go_both_ways(spark, planted):
    train = planted[0].select("prediction_id", "x", "y")
    few = planted[1].filter("prediction_id < 200").select("prediction_id", "x", (F.col("y") * 0.8 + 0.1).alias("q"))
    n, m = train.count(), few.count()
    a, b = (S.mixed_rows(train, few, 0.75, seed).toPandas() for seed in (1, 2))
    assert len(a) == len(b) == n + m and (a["weight"] == 1.0).sum() == n and (a["weight"] == 0.5).sum() == m and set(a["y"]) <= {0, 1}
    own = {r["prediction_id"]: np.array(r["x"]) for r in train.collect()}

    def moved(t):
        return {r.prediction_id for r in t[t.weight == 1.0].itertuples() if not np.allclose(r.x, own[r.prediction_id])}

    assert len(moved(a)) == min(n, m) and moved(a) != moved(b)  # one pseudo row each, in another permutation
    again = S.mixed_rows(train.repartition(1), few.repartition(7), 0.75, 1).toPandas()
    key = ["weight", "prediction_id"]
    assert np.allclose(*(np.array(t.sort_values(key)["x"].tolist()) for t in (a, again)))
    one = few.limit(1)
    assert S.mixed_rows(train, one, 0.75, 1).count() == n + 1 and S.mixed_rows(train, few.limit(0), 0.75, 1).count() == n


def test_weight_of_pseudo_rows_rises():
    assert [S.ramped(e) for e in (0, 1, 4, 5, 9)] == pytest.approx([0.0, 0.1, 0.4, 0.5, 0.5])


@pytest.mark.parametrize("loop", ["mixmatch", "consistency", "spread"])
def test_loops_return_a_model_that_gains(planted, loop):
    labelled, unlabelled = planted
    pool = unlabelled.drop("y")
    if loop == "mixmatch":
        out = S.mixmatch(labelled, pool, "fraud", WIDTH, trees=30, depth=2, rounds=2, min_gain=-1.0)
    elif loop == "consistency":
        out = S.consistency(labelled, pool, "fraud", WIDTH, trees=30, depth=2, epochs=2, min_gain=-1.0)
    else:
        out = S.spread_classifier(labelled, pool, "fraud", WIDTH, trees=30, depth=2, k=8, rounds=20)
    chosen, history = out
    rows = history.orderBy("round").collect()
    assert len(rows) == (1 if loop == "spread" else 2) and out.auc == pytest.approx(max(r["auc"] for r in rows), abs=1e-4)
    if loop != "spread":
        assert out.auc >= rows[0]["auc"]
    right = chosen.join(unlabelled, "prediction_id").agg(F.avg((F.col("pseudo_label") == F.col("y")).cast("double"))).first()[0]
    assert right > 0.9 and chosen.count() > 100, right
    scored = S._score(out.model, unlabelled)
    assert scored.agg(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double"))).first()[0] > 0.9
