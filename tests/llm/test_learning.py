"""What toxicity learns is counted in tasks: the driver reads no text and holds no words."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from paywarden.llm import toxicity


def test_driver_holds_no_words(spark, monkeypatch):
    """The model is that of a plain pass over the sample, though nothing is restored in the driver."""
    rng = random.Random(4)
    plain = ["letter", "garden", "winter", "market", "river", "stone", "paper", "music"]
    rows = [(i, " ".join(rng.choices(plain, k=12) + ["idiot", "stup1d"] * (i % 3 == 0) + ["moron"] * (i % 6 == 0)), int(i % 3 == 0)) for i in range(240)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    cost = toxicity.costs(toxicity.trigram_counts([r[1] for r in rows]))
    words = {i: toxicity.Restorer(cost).words(t) for i, t, _ in rows}
    drawn = sorted(rows, key=lambda r: hashlib.blake2b(str(r[0]).encode(), digest_size=8).digest())
    sample = [r for t in (0, 1) for r in [r for r in drawn if r[2] == t][:80]]

    def learnt(part):
        seen = {t: Counter(f for i, _, y in part if y == t for f in toxicity.features(words[i])) for t in (0, 1)}
        n, m = (sum(y == t for _, _, y in part) + 1 for t in (1, 0))
        odds = {f: (math.log((k + 0.5) / n) - math.log((seen[0][f] + 0.5) / m), k) for f, k in seen[1].items() if k >= toxicity.LEAST_DOCS}
        return {f: v - math.sqrt(1 / k) for f, (v, k) in odds.items() if v >= toxicity.LEAST_ODDS}

    rest = [r for t in (0, 1) for r in [r for r in sample if r[2] == t][1::2]]
    first = learnt([r for r in sample if r not in rest])
    rest.sort(key=drawn.index)
    x, y = np.array([toxicity.evidence(words[i], first) for i, _, _ in rest]), np.array([t == 1 for _, _, t in rest])
    weight = np.where(y, 80 / y.sum(), 160 / (~y).sum())
    want = toxicity.logistic(x, y.astype(float), weight * len(y) / weight.sum())

    def refused(*_):
        raise AssertionError("a text is read in the driver")

    monkeypatch.setattr(toxicity.Restorer, "words", refused)
    monkeypatch.setattr(toxicity, "draw", lambda *_: F.lit(0.0))  # all labelled rows are drawn
    model = toxicity.fit(docs, labels, F.lit(True), sample_docs=80)
    assert model.odds == learnt(sample) and "idiot" in model.odds
    assert np.allclose(model.weights, want, rtol=1e-9)
