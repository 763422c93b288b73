"""Results of learnt operators against plain loops, and what used to have a cap."""

import math
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from paywarden.llm import binary, language, quality, toxicity
from paywarden.llm.common import held_out, read


def plain_decode(stretch, cost):
    """Every state keeps its text; of equally cheap texts the first in order."""
    best = {(0, 0): (0.0, "")}
    for edges in toxicity.lattice(stretch):
        after = {}
        for (a, b), (c, text) in best.items():
            for letter, e in edges:
                s = int(toxicity._SYMBOL[ord(letter)]) if letter else None
                key = (b, s) if letter else (a, b)
                value = (c + e + cost[a][b][s], text + letter) if letter else (c + e, text)
                if key not in after or value < after[key]:
                    after[key] = value
        best = after
    return min((c + cost[a][b][0], text) for (a, b), (c, text) in best.items())[1]


def test_stretches_of_any_length_are_decoded_whole():
    rng = random.Random(4)
    flat = np.ones((64, 64, 64)).tolist()
    model = toxicity.costs(toxicity.trigram_counts(["the idiot said a stupid thing to this other idiot and the rest of them"] * 5)).tolist()
    for n in [*range(1, 40), 300, 1000]:
        stretch = "".join(rng.choice("id10t ssstup1d!@.a") for _ in range(n))
        for cost in (flat, model):
            assert toxicity.decode(stretch, cost) == plain_decode(stretch, cost)
    long = "".join(rng.choice("ab") for _ in range(500)) + "1d10t" + "".join(rng.choice("ab") for _ in range(500))
    assert toxicity.decode(long, model) == plain_decode(long, model)
    assert len(toxicity.decode("a1b" * 20_000, model)) > 20_000  # no quadratic work
    assert toxicity.disguised("x" * 1000 + "1")[0] == "x" * 1000 + "1"


def test_scores_equal_plain_loops(spark, sample, folder):
    model = toxicity.fit(sample, read(spark, folder, "labels"), ~held_out("doc_id", 3, 1))
    got = {r["doc_id"]: (r["score"], r["predicted"]) for r in toxicity.score(sample, model).collect()}
    cost = model.cost.tolist()
    for r in sample.where("n_chars < 4000").collect():
        low = (r["text"] or "").lower()
        words = set(toxicity._WORD.findall(low))
        for m in toxicity.DISGUISED.finditer(low):
            words |= set(toxicity._WORD.findall(plain_decode(m.group(), cost)))
        odds = sorted((max(model.odds.get(x, 0.0) for x in (w, w[:4] + "*" if len(w) > 4 else w, w[:5] + "*" if len(w) > 5 else w)) for w in words), reverse=True)
        a, b = (odds[0] ** 2 / 5, math.log1p(sum(odds[:3]))) if odds and odds[0] > 0 else (0.0, 0.0)
        score = 1 / (1 + math.exp(-(model.weights[0] + model.weights[1] * a + model.weights[2] * b)))
        assert got[r["doc_id"]] == (pytest.approx(score, abs=1e-9), int(score >= 0.7))


def test_languages_equal_plain_loops(sample):
    learnt = ~held_out("doc_id", 4, 2)
    samples = language._sample(sample, "text", "lang", learnt, language.SAMPLE_CHARS)
    got = {r["doc_id"]: r for r in language.language(sample, learnt).collect()}
    for r in sample.where("n_chars < 3000").collect():
        if not any(c.isalpha() for c in r["text"] or ""):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        data, sizes = r["text"].lower().encode(), {}
        for lang, taught in samples.items():
            params = zstandard.ZstdCompressionParameters(window_log=22, chain_log=17, hash_log=17, search_log=2, min_match=3, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
            own = zstandard.ZstdCompressionDict(taught, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            sizes[lang] = len(zstandard.ZstdCompressor(dict_data=own, compression_params=params).compress(data))
        first, second = sorted((n, lang) for lang, n in sizes.items())[:2]
        assert got[r["doc_id"]]["lang_pred"] == first[1] and got[r["doc_id"]]["margin"] == pytest.approx(1 - first[0] / second[0])
        assert got[r["doc_id"]]["rejected"] == (1 - first[0] / second[0] < language.MARGIN)


def test_quality_equals_plain_shrinkage(spark, sample, folder):
    """Hosts and paths as sites and sections: posteriors shrunk by moments, added to the document's own evidence."""
    docs = sample.withColumns({"host": F.concat(F.lit("h"), F.pmod("doc_id", F.lit(11))), "path": F.concat(F.lit("/p"), F.pmod("doc_id", F.lit(29)))})
    labels = read(spark, folder, "labels")
    got = {r["doc_id"]: r for r in quality.quality(docs, labels, site_col="host", section_col="path").collect()}
    y = {r["doc_id"]: r["quality"] for r in labels.where("quality is not null").groupBy("doc_id").agg(F.ceil(F.avg("quality")).alias("quality")).collect()}
    rows = [(r["doc_id"], r["host"], r["path"]) for r in docs.select("doc_id", "host", "path").collect()]
    site, section = {}, {}
    for d, h, p in rows:
        if d in y:
            for table, key in ((site, h), (section, (h, p))):
                n, k = table.get(key, (0, 0))
                table[key] = (n + 1, k + y[d])
    n, k = sum(v[0] for v in site.values()), sum(v[1] for v in site.values())
    base = (k + 0.5) / (n + 1)

    def weight(groups):
        """``groups``: (n, k, expected share)."""
        between = sum(m * (q / m - p) ** 2 for m, q, p in groups)
        total, pq = sum(m for m, _, _ in groups), sum(m * p * (1 - p) for m, _, p in groups)
        spread = max(0.0, (between - sum(p * (1 - p) for _, _, p in groups)) / total)
        return min(quality.MOST_WEIGHT, max(quality.LEAST_WEIGHT, pq / total / spread - 1 if spread > 0 else quality.MOST_WEIGHT))

    w = weight([(m, q, base) for m, q in site.values()])
    of_site = {h: (q + w * base) / (m + w) for h, (m, q) in site.items()}
    v = weight([(m, q, of_site[h]) for (h, _), (m, q) in section.items()])
    of_section = {(h, p): (q + v * of_site[h]) / (m + v) for (h, p), (m, q) in section.items()}
    for d, h, p in rows:
        share = of_site.get(h, base)
        own = of_section.get((h, p), share)
        assert got[d]["site_share"] == pytest.approx(share) and got[d]["section_share"] == pytest.approx(own)
        x = got[d]["evidence"] + math.log(own / (1 - own)) - math.log(base / (1 - base))
        assert got[d]["score"] == pytest.approx(1 / (1 + math.exp(-x)))


def test_ids_that_need_more_bits_are_refused(odd, monkeypatch):
    """A vocabulary beyond 16 bits asks for wide ids."""
    docs = odd.where("doc_id = 1")
    wide = binary.matrices(docs, end_id=70_000, wide=True).first()
    assert np.frombuffer(wide["ids"], "<u4")[-1] == 70_000
    with pytest.raises(Exception, match="16 bits"):
        binary.matrices(docs, end_id=70_000).collect()
