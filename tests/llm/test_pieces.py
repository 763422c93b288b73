"""Token alignment, collocations and repeated strings, against plain versions."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from llm_cases import LONG

from paywarden.llm import alignment, collocations, queries, repeats
from paywarden.llm.suffixes import permuted_common_prefixes, suffix_array

UP = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def both():
    return alignment.Pair()


def plain_groups(p, text):
    """Tokens of the whole text, cut where both sides end; None without tokens."""
    if not text:
        return None
    a, b = p.a.encode(" " + text, add_special_tokens=False).ids, p.b.encode(text)
    if not b"".join(p.bytes_a[i] for i in a) == (" " + text).encode() == b"".join(p.bytes_b[i] for i in b):
        return None
    sides = []
    for ids, token in ((a, p.bytes_a), (b, p.bytes_b)):
        at, ends = 0, []
        for i in ids:
            at += len(token[i])
            ends.append(at)
        sides.append(list(zip(ids, ends, strict=True)))
    out, last = [], 0
    for c in sorted({e for _, e in sides[0]} & {e for _, e in sides[1]}):
        out.append(tuple([i for i, e in s if last < e <= c] for s in sides))
        last = c
    return out


def plain_alignment(p, docs):
    found = [plain_groups(p, t) for _, t in docs]
    links = [collections.Counter((x, y) for a, b in g or () for x in a for y in b) for g in found]
    count = collections.Counter(pair for own in links for pair in own)
    top = collections.Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (d, _), g, own in zip(docs, found, links, strict=True):
        line = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g or ())
        out.append((d, sum(len(a) for a, _ in g or ()), sum(len(b) for _, b in g or ()), len(g or ()), sum(own.values()), sum(m for q, m in own.items() if count[q] == top[q[0]]), sum(m * count[q] for q, m in own.items()), line))
    return sorted(out, key=str)


TEXTS = ["  a\n b  c\n", "\n\nfoo", "x" * 701, "a▁b", "▁ b", "<|endoftext|> <s> x\x00y", "🙂🙂 naïve\tcafé \t q \r\n z", "　foo　 bar", "\x1c a\x85 b", " ", "tail  \n ", "it's 12345 we'll\n\n\nend"]


@pytest.mark.parametrize("most", [alignment.MOST_PAIRS, 0])
def test_alignment(spark, sample, odd, both, most):
    docs = [(r["doc_id"], r["text"]) for r in sample.where("n_chars < 3000").limit(40).collect()] + [(r["doc_id"], r["text"]) for r in odd.collect() if len(r["text"] or "") < 60_000] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in alignment.align(df, most=most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()), key=str)
    assert got == plain_alignment(both, docs)
    digest = {r["doc_id"]: r["groups"] for r in alignment.align(df.where("doc_id >= 100"), digest=True, most=most).collect()}
    assert digest[100] == hashlib.sha256(next(x[7] for x in got if x[0] == 100).encode()).hexdigest() and digest[103] == ""


def test_alignment_of_long_and_empty(odd, empty):
    got = {r["doc_id"]: r for r in alignment.align(odd.where("doc_id in (9, 10)")).collect()}
    assert got[9]["n_a"] > 60_000 and got[10]["n_groups"] > got[9]["n_groups"]
    assert alignment.align(empty).count() == 0


def test_coalesce_breaks_where_both_end():
    start, end = np.array([0, 3, 5, 0, 2, 5]), np.array([3, 5, 9, 2, 5, 9])
    assert alignment.coalesce(start, end).tolist() == [0, 0, 1, 0, 0, 1]
    assert alignment.coalesce(start[:0], end[:0]).tolist() == []


def plain_collocations(docs, least=10, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UP)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    rows = collections.defaultdict(list)
    common = {g: a for g, a in f.items() if len(g) > 2 and a >= least}
    for g, a in common.items():
        if len(g) == 3 and any(h[0] == g[0] and len(h) == 4 and g[1:] in (h[1:3], h[2:4]) and 100 * m >= 50 * a for h, m in common.items()):
            continue
        score, _, left, right = min((10 ** 6 * a * a // (f[(g[0], *g[1:k + 1])] * f[(g[0], *g[k + 1:])]), k, f[(g[0], *g[1:k + 1])], f[(g[0], *g[k + 1:])]) for k in range(1, len(g) - 1))
        rows[g[0]].append((-score, -a, " ".join(g[1:]).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, own in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top]))


@pytest.mark.parametrize("budget", [collocations.BUDGET, 400, 16])
def test_collocations(spark, odd, budget):
    """Also with prefixes that are extended once and twice."""
    rng = random.Random(8)
    words = ["the", "of", "Ärger", "new", "york", "a", "b", "in", "x-y", "q"]
    docs = [("en" if i % 3 else None, " ".join(rng.choices(words, [20, 9, 1, 2, 2, 1, 1, 3, 1, 1], k=40)) + ("." if i % 2 else ",") + " New York is new york; ho ho ho ho\tho") for i in range(60)]
    docs += [(r["lang"], r["text"]) for r in odd.collect() if len(r["text"] or "") < 50_000]
    df = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, budget=budget).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert got == plain_collocations(docs) and len(got) > 50


def test_collocations_of_hard_tables(spark, empty, odd):
    assert collocations.collocations(empty).count() == 0
    got = collocations.collocations(odd.where("doc_id = 9")).collect()  # one text of 60,000 words
    assert got and all(r["n"] == 60_000 for r in got)


def test_words_of_bytes(spark):
    ids, first, end, more = collocations.words(np.frombuffer(b"ab cd. ef ab", np.uint8), 3)
    assert len(set(ids.tolist())) == 3 and ids[0] == ids[3] and more.tolist() == [True, False, True, False] and end.tolist() == [2, 5, 9, 12]
    assert not set(ids.tolist()) & set(collocations.words(np.frombuffer(b"ab cd. ef ab", np.uint8), 4)[0].tolist())
    table = collocations.count_words(spark.createDataFrame([("en", f"word{i} and more words {i}") for i in range(30)], "lang string, text string"), 0, 1)
    assert table.where("spellings > 1").count() == 0 and table.where("n = 30").count() == 3


def test_suffix_arrays():
    rng = random.Random(2)
    for _ in range(600):
        t = [rng.randint(0, rng.randint(1, 4)) for _ in range(rng.randint(0, 40))]
        array = suffix_array(np.array(t, np.int64)).tolist()
        assert array == sorted(range(len(t)), key=lambda i: t[i:])  # noqa: B023
        data = bytes(97 + x for x in t)
        shared = permuted_common_prefixes(data, np.array(array, np.int64)).tolist()
        for x, y in zip(array, array[1:], strict=False):
            n = 0
            while max(x, y) + n < len(data) and data[x + n] == data[y + n]:
                n += 1
            assert shared[y] == n


def plain_repeats(docs, length):
    first = {}
    order = lambda d, i: (d is None, d or 0, i)
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            first[w] = min(first.get(w, (True, 1 << 62, 0)), order(d, i))
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if first[b[i:i + length]] < order(d, i):
                gone[i:i + length] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((d, len(b), int(gone.sum()), list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def got_repeats(df, **how):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in repeats.remove_repeats(df, **how).collect()), key=str)


@pytest.mark.parametrize("hot", [repeats.HOT, 1, 0])
def test_repeats(spark, odd, hot, monkeypatch):
    rng = random.Random(6)
    word = lambda n: " ".join(rng.choice(["ab", "cde", "f", "ü", "🙂", "gh"]) for _ in range(n))
    shared = [word(40) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [word(rng.randint(0, 30)), rng.choice(shared)[rng.randint(0, 20):], word(5), rng.choice(shared)[:rng.randint(60, 110)], "z" * rng.randint(0, 150)]
        docs.append((i if i % 7 else None, "".join(parts)))
    docs += docs[:5] + [(3, "another text under an id " + shared[0]), (1000, shared[0] * 3)]
    docs += [(r["doc_id"], r["text"]) for r in odd.collect() if len(r["text"] or "") < 60_000]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    want = plain_repeats(docs, 100)
    assert got_repeats(df, hot=hot) == want and sum(w[2] for w in want) > 5000
    if not hot:
        assert got_repeats(df, length=60, seed=20) == plain_repeats(docs, 60)


def test_repeats_of_long_texts(spark, monkeypatch):
    """Texts of several parts, whose parts do not begin at the same places."""
    rng = random.Random(1)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3_000_000))
    docs = [(1, base), (2, "x" * 1234 + base[:2_500_000]), (3, LONG)]
    got = {r[0]: r for r in got_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(2))}
    assert got[1][2] == 0 and got[2][3] == [(1, 2_501_234)] and got[3][2] > 0


def test_repeats_of_empty_table(empty):
    assert repeats.remove_repeats(empty).count() == 0


def test_queries_have_the_columns_of_the_contracts(spark, folder):
    wanted = {"op11_token_alignment": "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", "op12_collocations": "lang rank phrase a l r n score", "op13_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256"}
    for name, columns in wanted.items():
        assert set(columns.split()) <= set(queries.QUERIES[name](spark, folder).columns)
