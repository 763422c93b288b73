"""Phrase collocations by vertical partitioning of the word suffixes (the ERA way of building suffix trees).

A word's suffix is the word with those that follow it in its piece, cut off after ``size`` words. Suffixes are parted by
their prefixes: a prefix is one word; a word with more suffixes than a share of the memory budget is extended by a second
word, and such a pair again by a third, so that no prefix but a whole phrase outgrows its group. Prefixes are dealt to
groups of about ``budget`` / 4 suffixes by hash, which needs no table. Each group builds its truncated subtree alone: tasks
send small trees of what they have read (equal suffixes once, with their number), a group merges them in order of words,
and a phrase's count is the sum of the leaves below it. Only the pairs that were extended lie in several groups; their
sums are added up. No count is approximate.

Words are 64-bit hashes of language and word; a clash is found when words are counted and another seed is taken. A phrase
that occurs ``least`` times has words that do, so words marked as rarer end a suffix. Marks are bits, as many as the number
of words asks for up to a bound; a bit shared by chance keeps a word that could have gone, which costs, but changes
nothing. The same holds for the marks of extended prefixes.

Edge cases: null and empty texts have no words; a null language is ``und``; repeated rows count each; a word that is no
piece of ASCII is compared byte by byte; texts of any length are read whole; an empty table gives no rows; ids and further
columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, cut_in, mark_bits, marked, pieces_of
from .shingles import mix, powers

SIZE, LEAST, COVER, TOP = 3, 10, 50, 2000
#: Suffixes a group may have (32 bytes each, before equal ones are merged); a prefix with more than an eighth is extended.
BUDGET = 4_000_000
#: Suffixes, or different words, a task holds before it sends them; characters read at once.
HELD, CHUNK = 1_000_000, 1 << 20
#: Bytes of text behind one task that counts words.
TEXT = 64 << 20
#: What ends a piece, and what parts words inside one.
ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(ENDS)] = 2
_U = np.uint64


def words(buf: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lower-cased bytes: hashes of the words, their first and end bytes, and whether the next word is in the same piece."""
    kind = np.concatenate([np.array([2], np.uint8), _KIND[buf], np.array([2], np.uint8)])
    edge = np.flatnonzero((kind[1:] == 0) != (kind[:-1] == 0))
    first, end = edge[0::2], edge[1::2]
    if not len(first):
        return np.zeros(0, _U), first, end, np.zeros(0, bool)
    p, q = powers(len(buf) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((buf.astype(_U) + _U(1)) * p[:len(buf)])])
    ids = mix(mix((sums[end] - sums[first]) * q[first] + (end - first).astype(_U)) + _U(seed & 0xFFFFFFFFFFFFFFFF))
    stops = np.concatenate([np.zeros(1, np.int64), np.cumsum(kind[1:-1] == 2)])
    return ids, first, end, np.append(stops[first[1:]] == stops[end[:-1]], False)


def _seed(lang: str, seed: int) -> int:
    x = seed + 1
    for b in lang.encode("utf-8", "surrogatepass"):
        x = (x * 0x100000001B3 + b + 1) % (1 << 64)
    return int(mix(np.array([x], _U))[0])


def _blocks(part: pa.RecordBatch):
    """(language, lower-cased bytes of some of its texts); texts are parted by a line end."""
    by: dict[str, list[str]] = {}
    for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
        if text:
            by.setdefault(lang, []).append(text)
    for lang, texts in by.items():
        for a, b in pieces_of(texts, CHUNK):
            yield lang, "\n".join(texts[a:b]).encode("utf-8", "surrogatepass").translate(_LOWER)


def count_words(rows: DataFrame, seed: int, least: int) -> DataFrame:
    """(id, lang, word, n) of words met ``least`` times or more, and for each language one row with null id for all others."""

    def run(parts):
        held, n = {}, 0

        def sent():
            out = [[], [], [], []]
            for lang, lists in held.items():
                ids, at = np.unique(np.concatenate([x[0] for x in lists]), return_inverse=True)
                total = np.bincount(at, np.concatenate([x[1] for x in lists]).astype(np.float64)).astype(np.int64)  # below 2^53: exact
                spelt = [None] * len(ids)
                for i, w in zip(at.tolist(), (w for x in lists for w in x[2]), strict=True):
                    spelt[i] = w
                out[0] += ids.view(np.int64).tolist()
                out[1] += [lang] * len(ids)
                out[2] += spelt
                out[3] += total.tolist()
            return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.int64())], names=["id", "lang", "word", "n"])

        for part in parts:
            for lang, data in _blocks(part):
                ids, first, end, _ = words(np.frombuffer(data, np.uint8), _seed(lang, seed))
                ids, at, number = np.unique(ids, return_index=True, return_counts=True)
                held.setdefault(lang, []).append((ids, number, [data[a:b] for a, b in zip(first[at].tolist(), end[at].tolist(), strict=True)]))
                n += len(ids)
                if n >= HELD:
                    yield sent()
                    held, n = {}, 0
        if held:
            yield sent()

    sent = rows.mapInArrow(run, "id bigint, lang string, word binary, n bigint")
    sent = sent.repartition("id")
    spelt = sent.groupBy("id", "lang", "word").agg(F.sum("n").alias("n"))
    one = spelt.groupBy("id").agg(F.first("lang").alias("lang"), F.first("word").alias("word"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("spellings"))
    common = (F.col("n") >= least) | (F.col("spellings") > 1)
    hide = lambda c: F.when(common, F.col(c)).alias(c)
    return one.select(hide("id"), "lang", hide("word"), "n", hide("spellings")).groupBy("id", "lang", "word", "spellings").agg(F.sum("n").alias("n"))


def pair_id(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _U(0x9E3779B97F4A7C15) + mix(b ^ _U(0xD6E8FEB86659FD93)))


def _suffixes(parts, seed: int, common: np.ndarray, size: int):
    """Blocks of suffixes as columns of words (0: no further word), from those whose first two words are marked."""
    for part in parts:
        for lang, data in _blocks(part):
            ids, _, _, more = words(np.frombuffer(data, np.uint8), _seed(lang, seed))
            known = marked(common, ids)
            go = more & known & np.append(known[1:], False)
            at, cols = np.flatnonzero(go), [ids]
            cols = [ids[at], ids[at + 1]]
            for j in range(2, size):
                on = np.flatnonzero(cols[-1] != 0)
                on = on[go[at[on] + j - 1]]
                col = np.zeros(len(at), _U)
                col[on] = ids[at[on] + j]
                cols.append(col)
            yield cols, len(ids)


def _heavy_pairs(rows: DataFrame, seed: int, common: np.ndarray, heavy: np.ndarray, share: float) -> DataFrame:
    """Ids of pairs that begin with a marked word and may make up more than ``share`` of all words.

    A pair that does so in the whole does so in one of the parts that are counted.
    """
    sent = rows.sparkSession.sparkContext.broadcast((common, heavy))

    def run(parts):
        common, heavy = sent.value
        held, n, words_read = [], 0, 0

        def found():
            ids, number = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(ids[number >= share * words_read].view(np.int64))], names=["id"])

        for cols, read in _suffixes(parts, seed, common, 2):
            first = marked(heavy, cols[0])
            held.append(pair_id(cols[0][first], cols[1][first]))
            n, words_read = n + len(held[-1]), words_read + read
            if n >= HELD:
                yield found()
                held, n, words_read = [], 0, 0
        if held:
            yield found()

    return rows.mapInArrow(run, "id bigint").distinct()


def _starts(*cols: np.ndarray) -> np.ndarray:
    """First rows of runs of equal rows."""
    return np.flatnonzero(reduce(np.logical_or, [np.concatenate([[True], c[1:] != c[:-1]]) for c in cols])) if len(cols[0]) else np.zeros(0, np.int64)


def merged(cols: list[np.ndarray], number: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal suffixes once, in order of their words: the leaves of the subtree, with their totals."""
    order = np.lexsort(cols[::-1])
    cols = [c[order] for c in cols]
    start = _starts(*cols)
    return [c[start] for c in cols], np.add.reduceat(number[order], start) if len(start) else number


_TREE = "bucket bigint, whole boolean, nodes array<binary>, below array<binary>"


def _trees(rows: DataFrame, seed: int, common: np.ndarray, heavy: np.ndarray, pairs: np.ndarray, buckets: int, size: int) -> DataFrame:
    """Small trees by group: for each level its nodes' words and how many children (for leaves: occurrences) each has."""
    sent = rows.sparkSession.sparkContext.broadcast((common, heavy, pairs))

    def run(parts):
        common, heavy, pairs = sent.value
        held, n = [], 0

        def grown():
            cols, number = merged([np.concatenate([h[j] for h in held]) for j in range(size)], np.ones(n, np.int64))
            key, deep = cols[0], marked(heavy, cols[0])
            pair = pair_id(cols[0], cols[1])
            key, split = np.where(deep, pair, key), np.zeros(len(key), bool)
            for j in range(2, size):
                split = split | (deep & marked(pairs, pair)) if j == 2 else split
                pair = pair_id(pair, cols[j])
                key = np.where(split, pair, key)
            to = (mix(key) >> _U(32)) % _U(buckets)
            order = np.lexsort((*cols[::-1], split, to))
            to, split, number, cols = to[order], split[order], number[order], [c[order] for c in cols]
            cuts = _starts(to, split).tolist()
            out = []
            for a, b in zip(cuts, [*cuts[1:], len(to)], strict=True):
                own = [c[a:b] for c in cols]
                levels = [_starts(*own[:j + 1]) for j in range(size)]
                nodes = [own[j][levels[j]].tobytes() for j in range(size)]
                below = [np.diff(np.append(np.searchsorted(levels[j + 1], levels[j]), len(levels[j + 1]))).astype(np.uint32).tobytes() for j in range(size - 1)]
                out.append((int(to[a]), not split[a], nodes, [*below, number[a:b].astype(np.uint32).tobytes()]))
            lists = pa.list_(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.bool_(), lists, lists))], names=["bucket", "whole", "nodes", "below"])

        for cols, _ in _suffixes(parts, seed, common, size):
            held.append(cols)
            n += len(cols[0])
            if n >= HELD:
                yield grown()
                held, n = [], 0
        if n:
            yield grown()

    return rows.mapInArrow(run, _TREE)


def _leaves(nodes: list[bytes], below: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """The suffixes of a tree, and their numbers."""
    number = np.frombuffer(below[-1], np.uint32).astype(np.int64)
    cols, times = [np.frombuffer(nodes[-1], _U)], np.ones(len(number), np.int64)
    for j in range(len(nodes) - 2, -1, -1):  # how many leaves a node has
        times = np.add.reduceat(times, np.concatenate([[0], np.cumsum(np.frombuffer(below[j], np.uint32))[:-1]]).astype(np.int64))
        cols.insert(0, np.repeat(np.frombuffer(nodes[j], _U), times))
    return cols, number


def _counted(trees: DataFrame, size: int, least: int) -> DataFrame:
    """Phrases of 2 to ``size`` words as (w1, ..., n); those split over groups with partial sums."""

    def run(table: pa.Table) -> pa.Table:
        out = [[] for _ in range(size + 1)]
        for whole in (True, False):
            own = table.filter(pa.compute.equal(table.column("whole"), whole))
            if not own.num_rows:
                continue
            read = [_leaves(a, b) for a, b in zip(own.column("nodes").to_pylist(), own.column("below").to_pylist(), strict=True)]
            cols, number = merged([np.concatenate([r[0][j] for r in read]) for j in range(size)], np.concatenate([r[1] for r in read]))
            for j in range(1, size):
                start = _starts(*cols[:j + 1])
                total = np.add.reduceat(number, start)
                keep = (cols[j][start] != 0) & ((total >= least) | (not whole and j < size - 1))
                start = start[keep]
                for i in range(size):
                    out[i].append(cols[i][start] if i <= j else np.zeros(len(start), _U))
                out[size].append(total[keep])
        joined = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
        return pa.table({**{f"w{i + 1}": pa.array(joined[i].view(np.int64)) for i in range(size)}, "n": pa.array(joined[size].astype(np.int64))})

    names = [f"w{i + 1}" for i in range(size)]
    counted = trees.groupBy("bucket").applyInArrow(run, ", ".join(f"{c} bigint" for c in [*names, "n"]))
    return counted.groupBy(*names).agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = SIZE, least: int = LEAST, budget: int = BUDGET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words (id, lang, word, n) and phrases (w1 to w{size}, 0 where there is none; n) met ``least`` times or more, and all words of each language (lang, total)."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").alias("text"))
    read = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    seed = 0
    while True:
        table = cut_in(count_words(rows, seed, least), -(-read // TEXT))
        if not table.where("spellings > 1").limit(1).count():
            break
        seed += 1
    totals = cut(table.groupBy("lang").agg(F.sum("n").alias("total")))
    known = table.where("id is not null").select("id", "lang", F.col("word").cast("string").alias("word"), "n")
    n = totals.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n")).first()["n"]
    common, most = mark_bits(known.select("id")), budget // 8
    heavy = mark_bits(known.where(F.col("n") > most).select("id"))
    pairs = mark_bits(cut(_heavy_pairs(rows, seed, common, heavy, most / n))) if heavy.any() else np.zeros(128, np.uint8)
    groups = max(1, -(-4 * n // budget))
    found = cut_in(_counted(_trees(rows, seed, common, heavy, pairs, groups, size), size, least), groups)
    return known, found, totals


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, cover: int = COVER, top: int | None = TOP, budget: int = BUDGET) -> DataFrame:
    """Per language the ``top`` phrases of two and three words by their weakest cut: lang, rank, phrase, a, l, r, n, score."""
    known, found, totals = phrases(docs, lang_col, text_col, 3, least, budget)
    word = lambda k: known.select(F.col("id").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("n").alias(f"f{k}"), *([F.col("lang")] if k == 1 else []))
    pair = found.where("w3 = 0").select("w1", "w2", F.col("n").alias("a"))
    triple = found.where("w3 <> 0").select("w1", "w2", "w3", F.col("n").alias("a"))
    part = lambda i, j, name: pair.select(F.col("w1").alias(f"w{i}"), F.col("w2").alias(f"w{j}"), F.col("a").alias(name))
    inside = triple.select("w1", "w2", "a").union(triple.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a")).groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    weight = lambda l, r: (wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), wide(l) * wide(r))

    def scored(df: DataFrame, l: str, r: str) -> F.Column:  # noqa: E741
        df = df.withColumns(dict(zip(("_x", "_y"), weight(l, r), strict=True)))
        return df.withColumn("score", F.expr("_x div _y")).drop("_x", "_y")

    two = pair.join(inside, ["w1", "w2"], "left").where(F.coalesce(100 * F.col("longer") < cover * F.col("a"), F.lit(True))).join(word(1), "w1").join(word(2), "w2")
    two = scored(two, "f1", "f2").select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r"), "score")
    three = triple.join(part(1, 2, "f12"), ["w1", "w2"]).join(part(2, 3, "f23"), ["w2", "w3"]).join(word(1), "w1").join(word(2), "w2").join(word(3), "w3")
    early, late = scored(three, "f1", "f23").withColumnRenamed("score", "early"), None
    late = scored(early, "f12", "f3").withColumnRenamed("score", "late")
    first = F.col("early") <= F.col("late")
    three = late.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("early", "late").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = two.union(three).withColumn("rank", F.row_number().over(order))  # limited before it is shuffled
    ranked = ranked if top is None else ranked.where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
