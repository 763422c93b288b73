"""Screening of parties against blacklists and watchlists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import lookup
from ..functions.session import cut

FUZZY_THRESHOLD = 0.85


def blacklist_flags(txn: DataFrame, users: DataFrame, devices: DataFrame, ips: DataFrame, row: str = "txn_id") -> DataFrame:
    """0/1 membership of user, device and ip; a null value is never listed. One-column lists."""
    out = txn
    for lst, col, name in ((users, "user_id", "blacklisted_user"), (devices, "device", "blacklisted_device"), (ips, "ip", "blacklisted_ip")):
        entry = lst.toDF("_e").distinct().withColumn(name, F.lit(1))
        out = lookup(out, entry, {col: "_e"}, [row]).withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def _names(parties: DataFrame) -> DataFrame:
    return parties.select(F.lower("name").alias("lname")).filter(F.length("lname") > 0).distinct()


def exact_alias(parties: DataFrame, entities: DataFrame) -> DataFrame:
    """Per distinct lower-case name: the first list entry with that name or alias.

    Entries come in ``ordinal`` order, and the name goes before the aliases of its entry.
    """
    spelled = entities.select(
        "ordinal", "name", "source",
        F.posexplode(F.concat(F.array("name"), "aliases")).alias("pos", "spelling"))
    spelled = spelled.select(F.lower("spelling").alias("lname"), "ordinal", (F.col("pos") > 0).cast("int").alias("alias"), "name", "source")
    first = spelled.groupBy("lname").agg(F.min_by(F.struct("name", "source", "alias"), F.struct("ordinal", "alias")).alias("e"))
    return _names(parties).join(first, "lname").select(
        "lname", F.when(F.col("e.alias") == 0, "EXACT").otherwise("ALIAS").alias("match_type"), F.col("e.name").alias("entity"),
        F.lit(1.0).alias("confidence"), F.col("e.source").alias("source"))


def _matched_needed(a, b, threshold: float):
    """The fewest matched letters with which names of lengths ``a`` and ``b`` reach the ratio."""
    return F.ceil((a + b) * (threshold / 2) - 1e-9).cast("int")


def _segments(size, other, threshold: float):
    """How many segments the list's name of length ``size`` falls into beside a name of length ``other``: one more than letters
    that stay unmatched on both sides together, so that one segment is matched whole."""
    return size + other - 2 * _matched_needed(size, other, threshold) + 1


def _codes(names: list[str]) -> np.ndarray:
    """Names as rows of code points, filled up with zeros."""
    lengths = np.array([len(x) for x in names])
    out = np.zeros((len(names), int(lengths.max(initial=1))), np.uint32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = np.frombuffer("".join(names).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def common_subsequence(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of each two names (rows of code points, ``a`` at most 64 wide): no ratio can
    match more letters. Bit-parallel: a word holds the whole first name of a pair, a step takes one letter of all second ones."""
    n = len(a)
    place = np.uint64(1) << np.arange(a.shape[1], dtype=np.uint64)
    state = np.full(n, ~np.uint64(0))
    for j in range(b.shape[1]):
        hit = (np.where(a == b[:, j, None], place, np.uint64(0))).sum(1, dtype=np.uint64)
        hit[b[:, j] == 0] = 0
        both = state & hit
        state = (state + both) | (state - both)
    return (a.shape[1] - np.bitwise_count(state << np.uint64(64 - a.shape[1]) if a.shape[1] < 64 else state)).astype(np.int64)


def _longest_common(a: str, b: str) -> int:
    """The same for names of any length, one pair at a time, on Python's long integers."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    state = full
    for c in b:
        both = state & at.get(c, 0)
        state = ((state + both) | (state - both)) & full
    return len(a) - state.bit_count()


def bounds(a: list[str], b: list[str]) -> np.ndarray:
    """For each two names a number of letters that no matching exceeds."""
    out = np.zeros(len(a), np.int64)
    short = np.array([len(x) <= 64 for x in a], bool)
    at = np.flatnonzero(short)
    for k in range(0, len(at), 20_000):
        some = at[k:k + 20_000]
        out[some] = common_subsequence(_codes([a[i] for i in some]), _codes([b[i] for i in some]))
    for i in np.flatnonzero(~short):
        out[i] = _longest_common(a[i], b[i])
    return out


def _first_hits(threshold: float):
    """Of pairs in order of (lname, ordinal) the first of each name that reaches the ratio; what follows it is not compared."""
    from difflib import SequenceMatcher

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done = None
        for pdf in batches:
            pdf = pdf[pdf["lname"] != done].drop_duplicates()
            a, b = pdf["lname"].tolist(), pdf["lentity"].tolist()
            size = np.array([len(x) + len(y) for x, y in zip(a, b)], float)
            rows = []
            for i in np.flatnonzero(2.0 * bounds(a, b) >= threshold * size - 1e-9).tolist():
                if a[i] != done:
                    ratio = SequenceMatcher(None, a[i], b[i]).ratio()
                    if ratio >= threshold:
                        done = a[i]
                        rows.append((i, ratio))
            yield pdf.iloc[[i for i, _ in rows]].assign(ratio=[r for _, r in rows])

    return run


#: Names are compared by what is left of them without a few letters where there are at most so many ways to leave them out.
VARIANTS = 400


def _fits(names: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """Lengths (lx, ly) that can reach the ratio, the letters to be matched, and whether names of both lengths have few variants."""
    lx, ly = F.col("lx"), F.col("ly")
    both = names.select(F.length("lname").alias("lx")).distinct().join(entries.select(F.length("lentity").alias("ly")).distinct(), 2 * F.least("lx", "ly") >= threshold * (lx + ly) - 1e-9)
    ways = lambda n: F.expr(f"aggregate(filter(sequence(0, {n} - m), i -> i > 0), 1D, (p, i) -> p * ({n} - i + 1) / i)")
    both = both.withColumn("m", _matched_needed(lx, ly, threshold))
    return both.select("lx", "ly", "m", ((ways("lx") <= VARIANTS) & (ways("ly") <= VARIANTS)).alias("few"))


def _without(text: str, n: int) -> set[str]:
    """What is left of ``text`` without ``n`` of its letters."""
    left = {text}
    for _ in range(n):
        left = {x[:i] + x[i + 1:] for x in left for i in range(len(x))}
    return left


def _variants(rows: DataFrame) -> DataFrame:
    """``rows`` (text, lx, ly, m) once for every subsequence of ``m`` letters: text, lx, ly, and its hash ``key``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), 500):
                some = pdf.iloc[i:i + 500]
                found = [list(_without(t, len(t) - m)) for t, m in zip(some["text"], some["m"])]
                at = np.repeat(np.arange(len(some)), [len(f) for f in found])
                yield some[["text", "lx", "ly"]].iloc[at].assign(left=[x for f in found for x in f])

    out = rows.select("text", "lx", "ly", "m").mapInPandas(run, "text string, lx int, ly int, left string")
    return out.select("text", "lx", "ly", F.xxhash64("left").alias("key"))


def _letters(name: str):
    """The letters of a name in order."""
    return F.array_join(F.array_sort(F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.substring(name, i, F.lit(1)))), "")


def _pairs_by_variants(names: DataFrame, entries: DataFrame, fits: DataFrame) -> DataFrame:
    """Pairs (lname, lentity, ordinal) with a common subsequence of the letters needed: they share a variant of that length.

    The same is asked of their sorted letters first, once for each distinct set of letters, which leaves out names whose letters
    alone are too different from any list name's."""
    few = fits.filter("few").select("lx", "ly", "m")
    left = names.select("lname", F.length("lname").alias("lx"), _letters("lname").alias("text")).join(few, "lx")
    right = entries.select("ordinal", "lentity", F.length("lentity").alias("ly")).join(few, "ly")
    asked = _variants(left.select("text", "lx", "ly", "m").distinct())
    held = _variants(right.select(_letters("lentity").alias("text"), "lx", "ly", "m").distinct()).select("lx", "ly", "key").distinct()
    alike = asked.join(held, ["lx", "ly", "key"], "left_semi").select("text", "lx", "ly").distinct()
    left = left.join(alike, ["text", "lx", "ly"], "left_semi").select(F.col("lname").alias("text"), "lx", "ly", "m")
    listed = _variants(right.select(F.col("lentity").alias("text"), "lx", "ly", "m")).withColumnRenamed("text", "lentity")
    pairs = _variants(left).withColumnRenamed("text", "lname").join(listed, ["lx", "ly", "key"]).select("lname", "lentity").distinct()
    return pairs.join(entries.select("lentity", "ordinal"), "lentity").select("lname", "lentity", "ordinal")


def _pairs_by_segments(names: DataFrame, entries: DataFrame, fits: DataFrame, threshold: float) -> DataFrame:
    """Pairs (lname, lentity, ordinal) that share a segment.

    A ratio of t over lengths a and b leaves at most d = a + b - 2 * ceil(t * (a + b) / 2) letters of both names unmatched. Of
    d + 1 segments of the list's name one is therefore matched whole, and no other letters come between: it stands unchanged in
    the other name, moved by no more than the letters that either side may have too many.
    """
    fits = fits.filter("not few").select("lx", "ly")
    lx, ly, seg = F.col("lx"), F.col("ly"), F.col("seg")
    parts = _segments(ly, lx, threshold)
    begin, end = F.floor(seg * ly / parts).cast("int"), F.floor((seg + 1) * ly / parts).cast("int")
    right = entries.withColumn("ly", F.length("lentity")).join(fits, "ly").withColumn("seg", F.explode(F.sequence(F.lit(0), parts - 1)))
    right = right.withColumns({"_b": begin, "_e": end}).select("ordinal", "lentity", "lx", "ly", "seg", F.expr("substring(lentity, _b + 1, _e - _b)").alias("piece"))
    left = names.withColumn("lx", F.length("lname")).join(fits, "lx").withColumn("seg", F.explode(F.sequence(F.lit(0), parts - 1)))
    matched = _matched_needed(lx, ly, threshold)
    left = left.withColumns({"_b": begin, "_e": end}).withColumn("_at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_b") - (ly - matched)), F.col("_b") + (lx - matched))))
    left = left.where(F.col("_at") + F.col("_e") - F.col("_b") <= lx).select("lname", "lx", "ly", "seg", F.expr("substring(lname, _at + 1, _e - _b)").alias("piece"))
    return left.join(right, ["lx", "ly", "seg", "piece"]).select("lname", "lentity", "ordinal")


def candidate_pairs(names: DataFrame, entries: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Pairs (lname, lentity, ordinal); every pair that reaches the ratio is among them.

    Short names meet over what is left of both without the letters that may stay unmatched, so that names which merely share a
    frequent beginning never become pairs; where that has too many forms, over segments. ``names``: lname; ``entries``:
    ordinal, lentity, each lentity once.
    """
    fits = _fits(names, entries, threshold)
    return _pairs_by_variants(names, entries, fits).unionByName(_pairs_by_segments(names, entries, fits, threshold))


def fuzzy(parties: DataFrame, entities: DataFrame, threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Per distinct name: the first entry in list order whose name is at least ``threshold`` similar (Ratcliff-Obershelp ratio).

    Pairs come from a lossless index; the longest common subsequence, found for all pairs of a batch at once, rules out nearly
    all that are chance, and of the rest those of a name are compared exactly, in list order, up to its first hit. Each distinct
    list name is indexed once, under its first entry.
    """
    names = cut(_names(parties))
    first = cut(entities.where(F.length("name") > 0).groupBy(F.lower("name").alias("lentity")).agg(F.min_by(F.struct("name", "source"), "ordinal").alias("entry"), F.min("ordinal").alias("ordinal")).where("ordinal is not null"))
    pairs = candidate_pairs(names, first.select("ordinal", "lentity"), threshold).repartition("lname").sortWithinPartitions("lname", "ordinal", "lentity")
    best = pairs.mapInPandas(_first_hits(threshold), "lname string, lentity string, ordinal long, ratio double").select("lname", "lentity", "ratio")
    return best.join(first, "lentity").select("lname", F.lit("FUZZY").alias("match_type"), F.col("entry.name").alias("entity"),
                                              F.round("ratio", 4).alias("confidence"), F.col("entry.source").alias("source"))


def country(parties: DataFrame, entities: DataFrame) -> DataFrame:
    """Per distinct country: the first entry of that country; an empty country matches nothing."""
    first = entities.groupBy(F.upper("country").alias("ucountry")).agg(F.min_by(F.struct("name", "source"), "ordinal").alias("e"))
    asked = parties.select(F.upper("country").alias("ucountry")).filter(F.length("ucountry") > 0).distinct()
    return asked.join(first, "ucountry").select(
        "ucountry", F.lit("COUNTRY").alias("match_type"), F.col("e.name").alias("entity"), F.lit(0.7).alias("confidence"),
        F.col("e.source").alias("source"))


def screen(parties: DataFrame, entities: DataFrame, blacklist: DataFrame, with_fuzzy: bool = True,
           threshold: float = FUZZY_THRESHOLD) -> DataFrame:
    """Best finding per party: BLACKLIST, then EXACT/ALIAS, then FUZZY, then COUNTRY.

    Names and countries are matched once per distinct value; the result is looked up per party.
    """
    def packed(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(key, F.struct("match_type", "entity", "confidence", "source").alias(name))

    found = exact_alias(parties, entities)
    if with_fuzzy:
        unmatched = _names(parties).join(found, "lname", "left_anti").withColumnRenamed("lname", "name")
        found = found.unionByName(fuzzy(unmatched, entities, threshold))
    p = parties.withColumn("lname", F.lower("name")).withColumn("ucountry", F.upper("country"))
    j = lookup(p, packed(found, "lname", "_name"), {"lname": "lname"}, ["party_id"])
    j = lookup(j, packed(country(parties, entities), "ucountry", "_country"), {"ucountry": "ucountry"}, ["party_id"])
    listed = blacklist.toDF("_e").distinct().withColumn("_black", F.lit(1))
    j = lookup(j, listed, {"party_id": "_e"}, ["party_id"])
    hit = F.struct(F.lit("BLACKLIST").alias("match_type"), F.col("name").alias("entity"), F.lit(1.0).alias("confidence"),
                   F.lit("BLACKLIST").alias("source"))
    best = F.coalesce(F.when(F.col("_black") == 1, hit), F.col("_name"), F.col("_country"))
    return j.withColumn("_b", best).select(
        "party_id", F.col("_b").isNotNull().cast("int").alias("matched"), F.coalesce(F.col("_b.match_type"), F.lit("NONE")).alias("match_type"),
        F.col("_b.entity").alias("entity"), F.coalesce(F.col("_b.confidence"), F.lit(0.0)).alias("confidence"), F.col("_b.source").alias("source"))


def screening_flags(screened: DataFrame) -> DataFrame:
    """sanctions_match for EXACT and ALIAS; watchlist_hit for any finding of confidence 0.95 or more."""
    return screened.select(
        "*", F.col("match_type").isin("EXACT", "ALIAS").cast("int").alias("sanctions_match"),
        ((F.col("matched") == 1) & (F.col("confidence") >= 0.95)).cast("int").alias("watchlist_hit"))
