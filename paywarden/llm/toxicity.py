"""Toxicity by noisy-channel deobfuscation.

A character trigram model is counted over all texts. Stretches that look disguised (signs or digits inside a word, letters
set apart one by one, letters repeated) become a lattice: each sign may stand for itself or for letters, separators may fall
away or part words, repetitions may shrink. Viterbi finds the reading that is cheapest under the trigram model and the costs of the
disguise. Restored words join the words of the text, and the text is scored by its evidence for toxicity: log-odds of words
and word beginnings, learnt from labelled rows, put on a probability scale by logistic regression on the other half of the
sample.

Edge cases: null and empty texts score as texts without evidence; a sample without both labels gives every text score 0;
several labels of one document count as toxic if any is; of several texts under one id the model learns from the one that sorts first; ties between readings go to the one that sorts first; repeated rows
are scored each; long texts are scored whole.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, cut, draw, kept, release, texts

#: Bounds of the training sample: documents of each label, and the longest text in it.
SAMPLE_DOCS, SAMPLE_CHARS = 4_000, 20_000
#: Documents of the sample that must show a feature, and its least log-odds.
LEAST_DOCS, LEAST_ODDS = 2, 3.0
#: Readings of disguised stretches that a task remembers.
READINGS = 50_000
THRESHOLD = 0.7

#: Letters that a sign may stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e"}
SIGN_COST, DROP_COST, PAIR_COST, SEPARATOR_COST, BREAK_COST, LITERAL_COST = 1.5, 0.7, 3.0, 0.1, 0.5, 9.0

_WORD = re.compile(r"[^\W\d_]+")
_L, _S, _SEP = r"[^\W\d_]", "[0-9@$!|+€]", r"[ .\-_*~]"
_ITEM = rf"(?:{_L}|{_S})"
DISGUISED = re.compile(
    rf"(?<!\w){_L}(?:{_SEP}{_ITEM}){{2,}}(?!\w)"  # l e t t e r s  or l.e.t.t.e.r.s
    rf"|(?<![\w@$!|+€])(?<![^\w@$!|+€]{_S}{_SEP})(?<!\A{_S}{_SEP})(?={_S}{_SEP}{_ITEM}{_SEP}{_ITEM}(?!\w)){_S}(?:{_SEP}{_S})*+{_SEP}{_L}(?:{_SEP}{_ITEM})*(?!\w)"  # the same after signs set apart; tried where these begin
    rf"|(?<![\w@$!|+€]){_ITEM}*?{_L}{_S}{_ITEM}*"  # signs after letters
    rf"|(?<!\w){_S}{{1,4}}{_L}[^\W_]+"  # signs before letters
    rf"|(?<!\w)\w*({_L})\1\1\w*")  # three of a kind

_A = 64
#: Code point -> sum of what it is: a letter that words are made of, a sign that may stand for a letter, a separator, a character of ``\\w``.
_LETTER, _SIGN, _SEPARATOR, _INWORD = 1, 2, 4, 8


@functools.cache
def _class_table() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x40000):  # no letters lie above
        if chr(c).isalnum() or c == 95:
            out[c] = _INWORD + (_LETTER if _WORD.fullmatch(chr(c)) else 0)
    out[[ord(c) for c in SIGNS]] |= _SIGN
    out[[ord(c) for c in " .-_*~"]] |= _SEPARATOR
    return out


def disguised(low: str) -> list[str]:
    """Stretches that look disguised: the matches of ``DISGUISED``, in order.

    The text falls into regions no match can leave: they end at blanks and line ends, but not at a blank between two
    characters set apart. The pattern is only tried in regions with a letter beside a sign, three of a kind, or three set apart.
    """
    codes = np.frombuffer(low.encode("utf-32-le", "replace"), np.uint32)
    n = len(codes)
    if n < 2:
        return []
    kind = np.zeros(n + 2, np.uint8)
    kind[1:-1] = _class_table()[codes]
    letter, item, apart = (kind & _LETTER) > 0, (kind & (_LETTER | _SIGN)) > 0, (kind & _SEPARATOR) > 0
    edge = apart | ((kind & _INWORD) == 0)  # may stand beside the first or last of a run
    sign = (kind & _SIGN) > 0
    begins, ends = np.zeros(n + 2, bool), np.zeros(n + 2, bool)
    begins[1:], ends[:-1] = item[1:] & edge[:-1], item[:-1] & edge[1:]
    hot = np.zeros(n + 2, bool)
    hot[1:] = (letter[1:] & sign[:-1]) | (sign[1:] & letter[:-1])
    same = codes[1:] == codes[:-1]
    hot[3:-1] |= letter[3:-1] & same[1:] & same[:-1]
    hot[4:] |= ends[4:] & apart[3:-1] & item[2:-2] & apart[1:-3] & begins[:-4]
    at = np.flatnonzero(hot[1:-1])
    if not len(at):
        return []
    joined = np.zeros(n, bool)
    joined[:] = begins[:-2] & ends[2:]
    cuts = np.flatnonzero((codes == 10) | ((codes == 32) & ~joined))
    place = np.unique(np.searchsorted(cuts, at))
    starts, stops = np.append(0, cuts + 1)[place], np.append(cuts, n)[place]
    return [m.group() for a, b in zip(starts.tolist(), stops.tolist(), strict=True) for m in DISGUISED.finditer(low, a, b)]


def _table() -> np.ndarray:
    """Code point -> symbol: a-z, the Latin-1 letters; 0 for anything else."""
    out = np.zeros(0x110000, np.uint8)
    out[97:123] = np.arange(1, 27)
    for i, c in enumerate(c for c in range(0xDF, 0x100) if c != 0xF7):
        out[c] = 27 + i
    return out


_SYMBOL = _table()


def symbols(text: str) -> np.ndarray:
    return _SYMBOL[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]


def trigram_counts(values: list[str | None]) -> np.ndarray:
    """Counts of symbol triples; runs of symbol 0 count as one, with one before and after each text."""
    s = symbols(" \n ".join(v.lower() for v in values if v) + " ")
    s = np.concatenate([np.zeros(2, np.uint8), s]).astype(np.int64)
    keep = np.ones(len(s), bool)
    keep[2:] = (s[2:] != 0) | (s[1:-1] != 0)
    s = s[keep]
    return np.bincount(s[:-2] * _A * _A + s[1:-1] * _A + s[2:], minlength=_A ** 3)


def corpus_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all texts, summed per task, then over tasks; the result has at most 64^3 entries."""

    def run(parts):
        release()
        total = np.zeros(_A ** 3, np.int64)
        for part in parts:
            values = part.column(0).to_pylist()
            for i in range(0, len(values), 200):
                total += trigram_counts(values[i:i + 200])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    rows = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_A ** 3, np.int64)
    out[rows["k"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities of the third symbol after two, smoothed by bigrams and unigrams."""
    c = counts.reshape(_A, _A, _A).astype(float)
    uni = c.sum((0, 1)) + 0.5
    uni /= uni.sum()
    two = c.sum(0)
    bi = (two + 20 * uni) / (two.sum(1, keepdims=True) + 20)
    tri = (c + 20 * bi[None]) / (c.sum(2, keepdims=True) + 20)
    return -np.log(tri)


def lattice(stretch: str) -> list[list[tuple[str, float]]]:
    """For each character the letters it may stand for ("" falls away), with costs."""
    out, marks = [], len(stretch.rstrip("!"))
    for i, c in enumerate(stretch):
        if c.isalpha():
            edges = [(c, 0.0)]
            if i and stretch[i - 1] == c:  # twice is common, thrice is not
                edges.append(("", DROP_COST if stretch[i - 2:i - 1] == c or stretch[i + 1:i + 2] == c else PAIR_COST))
        else:
            edges = [(x, SIGN_COST) for x in SIGNS.get(c, "")]
            if c in " .-_*~":
                edges += [("", SEPARATOR_COST), (" ", BREAK_COST)]
            elif c == "!" and i >= marks:  # at the end as likely a mark as a letter
                edges.append((c, SIGN_COST))
            else:
                edges.append((" ", LITERAL_COST))
        out.append(edges)
    return out


class _Readings:
    """Readings as a tree of letters: equal texts are one node, so a stretch of any length costs as much as it is long."""

    def __init__(self):
        self.up, self.letter, self.depth, self.known = [0], [""], [0], {}

    def add(self, node: int, letter: str) -> int:
        at = self.known.get((node, letter))
        if at is None:
            at = self.known[node, letter] = len(self.up)
            self.up.append(node)
            self.letter.append(letter)
            self.depth.append(self.depth[node] + 1)
        return at

    def before(self, a: int, b: int) -> bool:
        """Whether the text of one node sorts before that of another."""
        x, y = a, b
        while self.depth[x] > self.depth[y]:
            x = self.up[x]
        while self.depth[y] > self.depth[x]:
            y = self.up[y]
        if x == y:  # one begins the other
            return self.depth[a] < self.depth[b]
        while self.up[x] != self.up[y]:
            x, y = self.up[x], self.up[y]
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node]
        return "".join(reversed(out))


def decode(stretch: str, cost) -> str:
    """The cheapest reading of a whole stretch: Viterbi over (place, last two symbols); of equally cheap ones the first in order."""
    read = _Readings()
    best = {(0, 0): (0.0, 0)}
    for edges in lattice(stretch):
        after: dict[tuple[int, int], tuple[float, int]] = {}
        for (a, b), (c, node) in best.items():
            for letter, e in edges:
                if letter:
                    s = int(_SYMBOL[ord(letter)])
                    key, total = (b, s), c + e + cost[a][b][s]
                else:
                    key, total = (a, b), c + e
                had = after.get(key)
                if had is None or total <= had[0]:
                    to = read.add(node, letter) if letter else node
                    if had is None or total < had[0] or read.before(to, had[1]):
                        after[key] = total, to
        best = after
    ends = [(c + cost[a][b][0], node) for (a, b), (c, node) in best.items()]
    least = min(ends)[0]
    return min(read.text(node) for c, node in ends if c == least)


class Restorer:
    """Words of a text, disguised ones restored."""

    def __init__(self, cost: np.ndarray):
        self.cost = cost.tolist()
        self.read = functools.lru_cache(READINGS)(lambda s: tuple(_WORD.findall(decode(s, self.cost))))

    def words(self, text: str | None) -> set[str]:
        if not text:
            return set()
        low = text.lower()
        found = set(_WORD.findall(low))
        for stretch in disguised(low):
            found.update(self.read(stretch))
        return found


def features(words: set[str]) -> set[str]:
    """Words, and beginnings of four and five letters (marked by a star)."""
    return words | {w[:4] + "*" for w in words if len(w) > 4} | {w[:5] + "*" for w in words if len(w) > 5}


def odds(counts: Iterable[tuple[str, int, int]], n: int, m: int) -> dict[str, float]:
    """Log-odds of the features that speak for toxicity, less a standard error for the documents that show them.

    ``counts``: (feature, toxic documents, others) of a sample of ``n`` toxic documents and ``m`` others.
    """
    found = {f: (math.log((k + 0.5) / (n + 1)) - math.log((other + 0.5) / (m + 1)), k) for f, k, other in counts if k >= LEAST_DOCS}
    return dict(sorted(((f, v - math.sqrt(1 / k)) for f, (v, k) in found.items() if v >= LEAST_ODDS), key=lambda x: (-x[1], x[0])))


def telling(rows: DataFrame, n: int, m: int) -> dict[str, float]:
    """``odds`` of rows (toxic, words) with ``n`` toxic ones and ``m`` others, counted by Spark; only features that pass come to the driver."""

    def run(parts):
        with_, without = Counter(), Counter()
        for part in parts:
            for t, words in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                (with_ if t else without).update(features(set(words)))
        names = list(with_.keys() | without.keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([with_[f] for f in names], pa.int64()), pa.array([without[f] for f in names], pa.int64())], names=["f", "k", "other"])

    counts = rows.select("toxic", "words").mapInArrow(run, "f string, k bigint, other bigint").groupBy("f").agg(F.sum("k").alias("k"), F.sum("other").alias("other"))
    likely = F.log((F.col("k") + 0.5) / (n + 1)) - F.log((F.col("other") + 0.5) / (m + 1)) >= LEAST_ODDS - 1e-6  # decided in ``odds``
    return odds(((r["f"], r["k"], r["other"]) for r in counts.where((F.col("k") >= LEAST_DOCS) & likely).collect()), n, m)


def evidence(words: set[str], model: dict[str, float]) -> tuple[float, float]:
    """The strongest log-odds of a word (squared, to part strong from weak words), and the logarithm of one plus the three strongest together."""
    get = model.get
    found = [v for w in words if (v := max(get(w, 0.0), get(w[:4] + "*", 0.0) if len(w) > 4 else 0.0, get(w[:5] + "*", 0.0) if len(w) > 5 else 0.0))]
    found.sort(reverse=True)
    return (found[0] ** 2 / 5, math.log1p(sum(found[:3]))) if found else (0.0, 0.0)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Weights of (1, x) by Newton's method."""
    z = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (weight * (y - p)) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """What a task needs to score: trigram costs, log-odds, logistic weights (None: nothing could be learnt)."""

    def __init__(self, cost: np.ndarray, odds: dict[str, float], weights: np.ndarray | None):
        self.cost, self.odds, self.weights = cost, odds, weights

    def scorer(self):
        release()
        restorer = Restorer(self.cost)

        def score(text: str | None) -> float:
            if self.weights is None:
                return 0.0
            a, b = evidence(restorer.words(text), self.odds)
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.weights[0] + self.weights[1] * a + self.weights[2] * b))))

        return score


def fit(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learns from all texts (trigrams) and from a bounded sample of labelled rows; ``train`` is a condition on ``doc_id``."""
    cost = costs(corpus_counts(docs, text_col))
    known = labels.select(F.col(f"`{label_id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null").where(train)
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not (n.get(0) and n.get(1)):
        return Model(cost, {}, None)
    # most texts are shorter than SAMPLE_CHARS: somewhat more are drawn, then cut to the bound in hash order
    share = F.when(F.col("toxic") == 1, F.lit(min(1.0, 1.2 * sample_docs / n[1]))).otherwise(F.lit(min(1.0, 1.2 * sample_docs / n[0])))
    drawn = cut(known.where(F.col("toxic").isin(0, 1) & (draw("doc_id") < share)))  # at most about 2.4 * sample_docs rows
    rows = texts(docs, id_col, text_col).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = cut(_sample(rows, cost, sample_docs))
    count = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(count) < 2:
        return Model(cost, {}, None)
    # every second document of each label
    first = telling(sample.where("rank % 2 = 1"), (count[1] + 1) // 2, (count[0] + 1) // 2)
    seen = _evidence(sample, first)
    rest = seen[seen["rank"] % 2 == 0]
    if rest["toxic"].nunique() < 2:
        rest = seen
    x, y = rest[["strongest", "together"]].to_numpy(), rest["toxic"].to_numpy() == 1
    weight = np.where(y, n[1] / max(1, y.sum()), n[0] / max(1, (~y).sum()))
    return Model(cost, telling(sample, count[1], count[0]), logistic(x, y.astype(float), weight * len(y) / weight.sum()))


def _sample(rows: DataFrame, cost: np.ndarray, sample_docs: int) -> DataFrame:
    """(toxic, words, h, rank): ``sample_docs`` rows of each label in order of the hash of their id, with their words restored."""
    sent = rows.sparkSession.sparkContext.broadcast(cost)  # 64^3 numbers

    def run(part, restorer):
        ids, found = part.column(0).to_pylist(), part.column(2).to_pylist()
        return [part.column(1), pa.array([hashlib.blake2b(str(d).encode(), digest_size=8).digest() for d in ids], pa.binary()),
                pa.array([sorted(restorer.words(t)) for t in found], pa.list_(pa.string()))]

    read = batches(rows.select("doc_id", "toxic", "text"), run, "toxic int, h binary, words array<string>", lambda: Restorer(sent.value))
    order = Window.partitionBy("toxic").orderBy("h")  # at most about 1.2 * sample_docs rows of each label
    return read.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= sample_docs)


def _evidence(sample: DataFrame, model: dict[str, float]):
    """The evidence in each document of the sample, in order of the hash: a few numbers a row."""
    sent = sample.sparkSession.sparkContext.broadcast(model)

    def run(part):
        got = [evidence(set(w), sent.value) for w in part.column(3).to_pylist()]
        return [part.column(0), part.column(1), part.column(2), pa.array([a for a, _ in got], pa.float64()), pa.array([b for _, b in got], pa.float64())]

    seen = batches(sample.select("toxic", "h", "rank", "words"), run, "toxic int, h binary, rank int, strongest double, together double").toPandas()
    return seen.sort_values("h", key=lambda h: h.map(bytes), kind="stable", ignore_index=True)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, score (0 to 1), predicted (1 from ``threshold`` on)."""
    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 64^3 costs, and log-odds of features of the bounded sample

    def run(part, scorer):
        got = [scorer(t) for t in part.column(1).to_pylist()]
        return [part.column(0), pa.array(got, pa.float64()), pa.array([int(s >= threshold) for s in got], pa.int32())]

    return batches(rows, run, f"doc_id {kind}, score double, predicted int", lambda: sent.value.scorer())


def keep(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text scores below ``threshold``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return kept(docs, text_col, lambda values, scorer: [scorer(t) < threshold for t in values], lambda: sent.value.scorer())


def restored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id and the text with every disguised stretch replaced by its reading."""
    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(part, cost):
        return [part.column(0), pa.array([None if t is None else DISGUISED.sub(lambda m: decode(m.group(), cost), t.lower()) for t in part.column(1).to_pylist()], pa.string())]

    return batches(rows, run, f"doc_id {kind}, text string", lambda: sent.value.cost.tolist())
