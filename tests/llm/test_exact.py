"""Operators with exact results, against plain versions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from check import compare, connect
from llm_cases import LONG

from paywarden.llm import binary, decontaminate, fingerprints, jaccard, packing, queries
from paywarden.llm.shingles import shingle_sets
from paywarden.llm.tokens import Encoder

UP = {c: c + 32 for c in range(65, 91)}


def rows(df):
    return [tuple(r) for r in df.collect()]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(docs):
    sets, name = [(d, shingles(t)) for d, t in docs], list(range(len(docs)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                name[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i), d)) for i, (d, s) in enumerate(sets)), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, folder, name):
    assert compare(name, queries.QUERIES[name](spark, folder), connect(folder), queries.ORACLE[name]) is None


def test_shingles_are_those_of_words():
    texts = ["", None, " ", "a", "A b c d", "a b c d e", "a\tb\nc\x0bd e F g", "a b c d e a b c d e a b", "é É x y z w", LONG]
    for text, s in zip(texts, shingle_sets(texts), strict=True):
        assert len(s) == len(shingles(text))
    assert (shingle_sets(["x a B c d e y"])[0][1:2] != shingle_sets(["a b c d"])[0]).all()
    assert (shingle_sets(["a B c d"])[0] == shingle_sets(["q", "A b C d"])[1]).all()


def test_linked_sets_share_a_signature():
    rng, linked = np.random.default_rng(5), 0
    for _ in range(1500):
        n = int(2 ** rng.uniform(0, 11))
        a = rng.integers(0, 2 ** 63, n, dtype=np.uint64)
        b = np.unique(np.concatenate([a[:n - min(n, rng.integers(0, int(n * 0.3) + 2))], rng.integers(0, 2 ** 63, rng.integers(0, int(n * 0.34) + 2), dtype=np.uint64)]))
        a = np.unique(a)
        both = len(np.intersect1d(a, b))
        if len(b) and 100 * both >= 75 * (len(a) + len(b) - both):
            linked += 1
            frequent = jaccard.marks(rng.choice(a, len(a) // 2))
            assert abs(jaccard.size_code(len(a)) - jaccard.size_code(len(b))) <= jaccard.SIZE_REACH
            assert len(np.intersect1d(jaccard.signatures(a, frequent), jaccard.signatures(b, frequent)))
            assert jaccard.may_link(jaccard.bitmap(a), jaccard.bitmap(b), len(a), len(b), 75)
    assert linked > 400


def test_close_pairs_are_all_that_bitmaps_allow():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2 ** 63, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:int(rng.integers(20, 300))], rng.integers(0, 2 ** 63, int(rng.integers(0, 60)), dtype=np.uint64)])) for _ in range(60)]
    keys, comps = np.arange(60), np.arange(60) // 2
    sizes, maps = np.array([len(s) for s in sets]), [jaccard.bitmap(s) for s in sets]
    got = {(int(x), int(y)) for x, y in zip(*jaccard.close_pairs(keys, comps, sizes, maps, 75)[:2], strict=True)}
    some = {(int(x), int(y)) for x, y in zip(*jaccard.close_pairs(keys, comps, sizes, maps, 75, True)[:2], strict=True)}
    assert some <= got and len(some) == len({tuple(sorted((x // 2, y // 2))) for x, y in got})
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if comps[i] != comps[j] and jaccard.may_link(jaccard.bitmap(sets[i]), jaccard.bitmap(sets[j]), len(sets[i]), len(sets[j]), 75)}
    assert want <= got
    true = {(i, j) for i in range(60) for j in range(i + 1, 60) if comps[i] != comps[j] and 100 * len(np.intersect1d(sets[i], sets[j])) >= 75 * len(np.union1d(sets[i], sets[j]))}
    assert true and true <= got


@pytest.mark.parametrize("block", [jaccard.BLOCK, 7])
def test_jaccard_groups_that_need_every_pair(spark, monkeypatch, block):
    """A chain of near copies, in which members of a group link with each other but not with the group's first; also in groups of many blocks."""
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(4000)]
    docs, text = [], words[:60]
    for i in range(40):
        docs.append((i + 100, " ".join(text)))
        text = text[2:] + rng.sample(words, 2)
    docs += [(i + 500, " ".join(words[1000:1080] + rng.sample(words, 30 if i % 2 else 6))) for i in range(40)]
    members, links = jaccard.similarity_join(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert sorted(rows(members.select("doc_id", "n_shingles", "component")), key=str) == brute_components(docs)
    assert links.count() > 30


def test_jaccard_odd_rows(odd, empty):
    members, _ = jaccard.similarity_join(odd)
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sorted(rows(members.select("doc_id", "n_shingles", "component")), key=str) == brute_components(docs)
    assert jaccard.similarity_join(empty)[0].count() == 0


def brute_hits(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))

    w, hit, names = words(text), set(), set()
    for name, item in items:
        v = words(item)
        n = min(10, len(v))
        for i in range(len(v) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j:j + n] == v[i:i + n]:
                    hit.update(range(j, j + n))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


ITEMS = [(1, "quick brown fox jumps over the lazy dog near the old"), (2, "one two"), (2, "one two"), (3, None), (4, ""), (None, "a row without"), (5, "Über öl"), (6, "word5x word6x word7x word8x word9x word10x word11x word12x word13x word14x word15x")]


@pytest.mark.parametrize("most", [4_000_000, 300])
def test_decontamination(spark, odd, empty, most):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.decontaminate(odd, bench, most=most)
    got = sorted(((r["doc_id"], r["n_words"], sum(x["last"] - x["first"] for x in r["ranges"]), r["items"]) for r in found.collect()), key=str)
    items = [i for i in ITEMS if i[0] is not None]
    assert got == sorted(((r["doc_id"], *brute_hits(r["text"], items)) for r in odd.collect()), key=str)
    text = {r["doc_id"]: r["text"] for r in odd.collect()}
    span = [(r["doc_id"], text[r["doc_id"]][s["start"]:s["stop"]]) for r in found.collect() for s in r["spans"] if r["doc_id"] in (1, 6)]
    assert sorted(span) == [(1, "quick brown fox jumps over the lazy dog near the old"), (6, "one two")]
    kept = decontaminate.clean(odd, bench, most=most)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} >= {3, 4, 5, 11, 12, 13} and not {r["doc_id"] for r in kept.select("doc_id").collect()} & {1, 2, 6, 7}
    assert decontaminate.decontaminate(empty, bench, most=most).count() == 0
    assert {r["n"] for r in decontaminate.decontaminate(odd, bench.limit(0)).selectExpr("size(items) n").collect()} == {0}


def test_tokens_are_those_of_whole_texts(sample):
    e = Encoder()
    texts = [r["text"] for r in sample.limit(60).collect()] + ["İstanbul ΑΣ ς\x1cab\x85c d <|endoftext|> x é ́a it's 'll12", "", " ", "a\tb\r\nc", "ab\x00cd", "we'll×÷ÀŸſŉ!!x$%1234 '", "日本語 text 🙂", "x" * 3000]
    for text, ids in zip(texts, e.encode_all(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    small = Encoder(cache=50)
    assert [small.encode(t) for t in texts[:10]] == e.encode_all(texts[:10])


def test_packing_is_lossless_and_tight(odd, empty):
    e = Encoder()
    docs = odd.where("doc_id is not null")
    got = packing.pack(packing.pieces(docs, capacity=512), capacity=512).toPandas()
    assert len(got[got.doc_id == 7]) == 2
    for d, text in {(r["doc_id"], r["text"]) for r in docs.collect()}:
        ids = e.encode(text) + (2).to_bytes(4, "little")
        own = got[got.doc_id == d].drop_duplicates(["start"]).sort_values("start")
        assert own.start.tolist() == list(range(0, len(ids) // 4, 512)) and own.length.sum() == len(ids) // 4 == own.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[4 * s:4 * (s + n)]) == c for s, n, c in zip(own.start, own.length, own.ids_crc32, strict=True))
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 512
    assert packing.pack(packing.pieces(empty)).count() == 0


def test_fill_is_the_best_subset_sum():
    rng = random.Random(2)
    for _ in range(200):
        counts, capacity = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}, rng.randint(1, 70)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1)}
        used = packing.fill(counts, capacity)
        assert all(n <= counts[x] for x, n in used.items()) and sum(x * n for x, n in used.items()) == max(s for s in sums if s <= capacity)


def test_token_matrices(odd, empty):
    e = Encoder()
    got = binary.matrices(odd.where("doc_id is not null"), capacity=512, block=4000).collect()
    back = {}
    for r in got:
        ids, cu = np.frombuffer(r["ids"], "<u2"), r["cu_seqlens"]
        assert len(ids) == r["n_tokens"] == cu[-1] <= 512 and cu[0] == 0 and r["resets"] == cu[:-1]
        assert binary.positions(cu).tolist() == [i for a, b in zip(cu, cu[1:], strict=False) for i in range(b - a)]
        for d, s, a, b in zip(r["doc_ids"], r["starts"], cu, cu[1:], strict=False):
            back.setdefault((d, s), []).append(ids[a:b].tolist())
    for d, text in {(r["doc_id"], r["text"]) for r in odd.where("doc_id is not null").collect()}:
        ids = [*np.frombuffer(e.encode(text), "<u4").tolist(), 2]
        assert [x for s in range(0, len(ids), 512) for x in back[d, s][0]] == ids
    assert len(back[7, 0]) == 2 and len({r["sequence_id"] for r in got}) == len(got)
    assert binary.matrices(empty).count() == 0


def test_best_fit_takes_the_least_room():
    rng = random.Random(1)
    for _ in range(200):
        lengths, rooms = [rng.randint(1, 64) for _ in range(rng.randint(1, 60))], []
        for n in sorted(lengths, reverse=True):
            fit = [r for r in rooms if r >= n]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else 64) - n)
        assert sorted(64 - sum(lengths[i] for i in s) for s in binary.best_fit(lengths, 64)) == sorted(rooms)


def test_prefix_hashes():
    rng = random.Random(1)
    for _ in range(150):
        a, b = ("".join(rng.choice("abé🙂 ") for _ in range(rng.randint(0, 60))) for _ in range(2))
        x, y, k = fingerprints.Prefix(a), fingerprints.Prefix(b), len(a) // 3
        changed, whole = x.replaced_end(y, k), fingerprints.Prefix(a[:len(a) - k] + b[:k])
        assert all((p == q).all() for p, q in zip(changed.arrays, whole.arrays, strict=True)) and fingerprints.fingerprint(changed) == fingerprints.fingerprint(whole)
        i, j, n = rng.randint(0, len(a)), rng.randint(0, len(b)), 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        assert fingerprints.common_extension(x, i, y, j) == n
        m = min(len(a) - i, len(a) - k)
        assert x.equal(i, k, m) == (a[i:i + m] == a[k:k + m]) if m >= 0 and k + m <= len(a) else True


def test_fingerprints(spark, odd, empty, sample):
    for docs in (odd.where("doc_id is not null").dropDuplicates(["doc_id"]), sample):
        got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
        order = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
        assert len(got) == len(order)
        for (d, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
            n = len(text)
            edited = text[:n - n // 3] + after[:n // 3]
            assert got[d]["n_chars"] == n and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert got[d]["fingerprint"] == fingerprints.fingerprint(fingerprints.Prefix(text)) and got[d]["edited_fingerprint"] == fingerprints.fingerprint(fingerprints.Prefix(edited))
            assert 0 <= got[d]["near_next"] <= 1 and got[d]["near_edited"] >= (0.55 if n > 30 else 0)
    assert fingerprints.fingerprints(odd).count() == odd.count() and fingerprints.fingerprints(empty).count() == 0
    one = fingerprints.fingerprints(odd.where("doc_id = 1")).collect()[0]
    assert one["near_next"] == 1.0


def test_few_edges_write_few_files(spark, tmp_path, monkeypatch):
    """However many partitions shuffles have: rounds of a handful of edges, and groups of a few texts, are written by few tasks."""
    written = []

    def counted(df):
        out = cut_as_ever(df)
        written.append(out.rdd.getNumPartitions())
        return out

    cut_as_ever = jaccard.cut
    monkeypatch.setattr(jaccard, "cut", counted)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        chain = [(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 100), (7, 7)]
        found = dict(jaccard.components(spark.createDataFrame(chain, "x bigint, y bigint")).collect())
        assert found == {i: 1 for i in range(1, 41)} | {100: 100, 200: 100}
        assert len(written) > 1 and max(written[1:]) == 1
        del written[:]
        words = [f"w{i}" for i in range(40)]
        texts = [(i, " ".join(words[:36] + [f"x{i % 3}"] + words[36:])) for i in range(9)] + [(20, "all other words than those of the rest"), (21, None)]
        out, _ = jaccard.similarity_join(spark.createDataFrame(texts, "doc_id bigint, text string"))
        assert {r["doc_id"]: r["component"] for r in out.collect()} == {i: 0 for i in range(9)} | {20: 20, 21: 21}
        assert sum(written) < 37 * len(written) / 4
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
