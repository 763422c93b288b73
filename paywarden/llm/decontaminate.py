"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark items.

Texts and items are normalised alike (ASCII letters lower-cased, words are runs of digits, ASCII letters and anything
beyond ASCII, single spaces between them). Every window of ``window`` words of an item is a pattern with a space on each
side, so that matches start and end at words. Each text is scanned once; a match ends at a word, whose offsets in the
original text are those of the same word there.

Edge cases: a null or empty text has no words and no hits; items with a null id or without words are left out; repeated
items count once; windows that several items share name all of them; an empty benchmark hits nothing; duplicated
documents give one row each.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, by_worker, cut, kept, texts

WINDOW = 10
#: Characters of patterns in one automaton (about 60 bytes of memory each). A benchmark beyond that takes one pass for each so many.
MAX_PATTERN_CHARS = 4_000_000

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LOWER = {c: c + 32 for c in range(65, 91)}


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Code point offsets of the words in the original text."""
    return [m.span() for m in WORD.finditer(text.translate(_LOWER))]


def windows(item: list[bytes], window: int) -> set[bytes]:
    if not item:
        return set()
    return {b" ".join(item[i:i + window]) for i in range(max(1, len(item) - window + 1))}


def patterns(items: list[tuple[str, str]], window: int) -> dict[bytes, set[str]]:
    """Window -> the items that have it."""
    found: dict[bytes, set[str]] = {}
    for item_id, text in items:
        for w in windows(words(text), window):
            found.setdefault(w, set()).add(item_id)
    return found


def automaton(found: dict[bytes, list[str]]):
    a = ahocorasick.Automaton()
    for w, ids in found.items():
        a.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(ids)))
    if found:
        a.make_automaton()
    return a if found else None


def scan(a, doc: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
    """Merged ranges [first, last) of hit words, and the items hit."""
    if a is None or not doc:
        return [], set()
    line = b" " + b" ".join(doc) + b" "
    spaces, ranges, items = None, [], set()
    for end, (n, ids) in a.iter(line.decode("latin-1")):
        if spaces is None:
            spaces = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        last = int(np.searchsorted(spaces, end))
        ranges.append((last - n, last))
        items.update(ids)
    merged: list[list[int]] = []
    for lo, hi in sorted(ranges):
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], hi)
        else:
            merged.append([lo, hi])
    return [(lo, hi) for lo, hi in merged], items


def _shards(benchmark: DataFrame, item_col: str, text_col: str, window: int, most: int) -> list[DataFrame]:
    """The benchmark in parts whose patterns have at most about ``most`` characters."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item_id"), F.col(f"`{text_col}`").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] * window
    n = max(1, -(-size // most))
    return [items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) for i in range(n)]


def _scanner(spark, shard: DataFrame, window: int):
    """A function that gives a task the shard's automaton, built once for each Python worker."""
    found = patterns([(r["item_id"], r["text"]) for r in shard.collect()], window)
    sent = spark.sparkContext.broadcast({w: sorted(ids) for w, ids in found.items()})
    key = hashlib.sha256(repr(sorted(found)).encode() + repr(sorted(map(sorted, found.values()))).encode()).hexdigest()

    def setup():
        return by_worker(key, lambda: automaton(sent.value))

    return setup


_COLUMNS = "doc_id {kind}, n_words bigint, ranges array<struct<first:bigint,last:bigint>>, spans array<struct<start:bigint,stop:bigint>>, items array<string>"
_RANGES = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  window: int = WINDOW, most: int = MAX_PATTERN_CHARS) -> DataFrame:
    """Per document: doc_id, n_words, ranges of hit words, spans (offsets of the ranges in the original text), items hit (sorted)."""
    spark, rows = docs.sparkSession, texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def found(part, a):
        n_words, ranges, spans, items = [], [], [], []
        for text in part.column(1).to_pylist():
            doc = words(text)
            hit, names = scan(a, doc)
            at = word_offsets(text) if hit else []
            n_words.append(len(doc))
            ranges.append([{"first": lo, "last": hi} for lo, hi in hit])
            spans.append([{"start": at[lo][0], "stop": at[hi - 1][1]} for lo, hi in hit])
            items.append(sorted(names))
        return [part.column(0), pa.array(n_words, pa.int64()), pa.array(ranges, _RANGES), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))]

    shards = _shards(benchmark, item_col, item_text_col, window, most)
    if len(shards) == 1:
        return batches(rows, found, _COLUMNS.format(kind=kind), _scanner(spark, shards[0], window), keeps=True)
    return _merged(rows, [lambda s=s: _scanner(spark, s, window) for s in shards], found, kind)


def _merged(rows: DataFrame, scanners: list, found, kind: str) -> DataFrame:
    """One pass for each shard; only hits are kept between passes, then united per text."""
    keyed = rows.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    key = keyed.schema["doc_id"].dataType.simpleString()
    parts, base = [], None
    for make in scanners:
        part = batches(keyed, found, _COLUMNS.format(kind=key), make(), keeps=True)
        parts.append(cut(part.where(F.size("items") > 0).select("doc_id", "ranges", "items").distinct()))
    base = batches(keyed, lambda p: [p.column(0), pa.array([len(words(t)) for t in p.column(1).to_pylist()], pa.int64()), p.column(1)], f"doc_id {key}, n_words bigint, text string")
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    hits = hits.groupBy("doc_id").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    def united(part):
        out, spans = [], []
        for text, ranges in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
            merged: list[list[int]] = []
            for r in sorted(ranges or [], key=lambda r: (r["first"], r["last"])):
                if merged and r["first"] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], r["last"])
                else:
                    merged.append([r["first"], r["last"]])
            at = word_offsets(text) if merged else []
            out.append([{"first": lo, "last": hi} for lo, hi in merged])
            spans.append([{"start": at[lo][0], "stop": at[hi - 1][1]} for lo, hi in merged])
        items = pa.array([x or [] for x in part.column(4).to_pylist()], pa.list_(pa.string()))
        return [part.column(0), part.column(1), pa.array(out, _RANGES), pa.array(spans, _SPANS), items]

    joined = base.join(hits, "doc_id", "left").select("doc_id", "n_words", "text", "ranges", "items")
    return batches(joined.select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", "text", "ranges", "items"), united, _COLUMNS.format(kind=kind))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most: int = MAX_PATTERN_CHARS) -> DataFrame:
    """Rows of ``docs``, with all their columns, whose text has no hit; a benchmark of several automata takes one pass for each."""
    for shard in _shards(benchmark, item_col, item_text_col, window, most):
        docs = kept(docs, text_col, lambda values, a: [not scan(a, words(t))[0] for t in values], _scanner(docs.sparkSession, shard, window))
    return docs
