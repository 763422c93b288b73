"""URL filter: rules, and where none fits, word segmentation and naive Bayes.

A host label such as ``thebluecar`` is split into words by Viterbi under a unigram model counted over the text of all pages;
path parts likewise. Multinomial naive Bayes scores the words: every word met on either side has a weight, smoothed over the
joint vocabulary and put on one scale by the totals of its class, so a larger table shifts no verdict. The block side learns
from a labelled table of whole hosts and paths, a parameter; the allow side from the pages that rules allow. (Pages that
rules block teach nothing: a rule names a site or a language, not what is wrong with its words.) Numbers count as one word.

Scale: each different label is segmented beside the counts of its own substrings, which are joined to it in Spark; each
different url is scored by joining its words with their weights. Frequent words are spread over salts, and nothing that
grows with the table is sent to the driver or to all tasks.

Edge cases: a null url or one without ``://`` has an empty host and path, no words, and the verdict of the prior; ties go to
allow, and between rules of one length to the one that sorts first; if the rules allow no page, or the labelled table is
empty, that side has smoothed weights only; words met on neither side say nothing; repeated rows are judged each; labels of
any length are decoded whole (a word of a split has at most ``WORD_LENGTH`` letters; an unknown name is split in such parts).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import lookup
from .common import batches, cut, release

#: Letters of a word in a segmentation.
WORD_LENGTH = 24
NUMBER = "<number>"
#: The default labelled table: hosts and paths of unwanted pages, as whole strings. They are written like those of the pages
#: that the usual rules allow, so that sites, languages and numbers weigh alike on both sides and the wording decides.
UNWANTED = (
    "casino-win.example.net/en/100", "www.free-bets.example.net/en/137.html", "m.cheap-pills.example.org/fr/174/", "blog.ads-track.example.org/fr/211",
    "spam-farm.example.net/en/248", "www.adult-tube.example.net/en/285.html", "m.poker-casino.example.org/fr/322/", "blog.viagra-pills.example.org/fr/359",
    "slots-jackpot.example.net/en/396", "www.betting-bets.example.net/en/433.html", "m.porn-sex.example.org/fr/470/", "blog.xxx-adult.example.org/fr/507",
    "payday-loans.example.net/en/544", "www.loan-cash.example.net/en/581.html", "m.warez-crack.example.org/fr/618/", "blog.torrent-keygen.example.org/fr/655",
    "malware-virus.example.net/en/692", "www.trojan-malware.example.net/en/729.html", "m.phish-login.example.org/fr/766/", "blog.scam-prize.example.org/fr/803",
    "replica-cheap.example.net/en/840", "www.clicks-tracker.example.net/en/877.html", "m.spam-links.example.org/fr/914/", "blog.escort-dating.example.org/fr/951",
    "sex-dating.example.net/en/988", "www.casino-bonus.example.net/en/1025.html", "m.jackpot-win.example.org/fr/1062/", "blog.cheap-viagra.example.org/fr/1099",
    "adult-porn.example.net/en/1136", "www.free-casino.example.net/en/1173.html", "m.win-bets.example.org/fr/1210/", "blog.gambling-slots.example.org/fr/1247",
    "betting-poker.example.net/en/1284", "www.virus-scam.example.net/en/1321.html", "m.crack-warez.example.org/fr/1358/", "blog.ads-clicks.example.org/fr/1395",
    "spam-backlinks.example.net/en/1432", "www.payday-cash.example.net/en/1469.html", "m.xxx-sex.example.org/fr/1506/", "blog.track-ads.example.org/fr/1543",
)
#: Odds of an unwanted page before its words are seen; words a class counts as, however many it has; pseudo-count of every word.
PRIOR_ODDS, SCALE, PSEUDO = 0.2, 1000.0, 1.0

_WORD = re.compile(r"[^\W\d_]+")
_TAGS = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_PARTS = re.compile(r"[^\W\d_]+|[0-9]+")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased; empty without one."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[tuple[str, str]], host_col: str = "host", path_col: str = "path") -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. ``rules``: (verdict, host + path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (-len(r[1]), r[1]), reverse=True):
        own_host, slash, rest = text.partition("/")
        fits = ((F.col(host_col) == own_host) | F.col(host_col).endswith("." + own_host)) & F.col(path_col).startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def html_words(html: str | None) -> list[str]:
    return _WORD.findall(_TAGS.sub(" ", html).lower()) if html else []


def page_words(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n) over the text of all pages, summed per batch, then over tasks."""

    def run(parts):
        release()
        for part in parts:
            got = Counter()
            for v in part.column(0).to_pylist():
                got.update(html_words(v))
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.string()), pa.array(got.values(), pa.int64())], names=["word", "n"])

    return pages.select(F.col(f"`{html_col}`").alias("html")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def parts_of(host_: str, path_: str) -> list[str]:
    """Labels (letters) and numbers of a host and path, in order."""
    return [NUMBER if p[0].isdigit() else p for text in (host_, path_) for p in _PARTS.findall(text.lower())]


def segment(label: str, logp: dict[str, float], log_total: float) -> list[str]:
    """The likeliest split into words. An unknown word of n letters counts as one in ``total`` times ten to the n."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - WORD_LENGTH), end):
            w = label[start:end]
            options.append((best[start][0] + logp.get(w, -log_total - 2.302585 * len(w)), -start))
        score, start = max(options)
        best.append((score, -start))
    words, end = [], len(label)
    while end:
        start = best[end][1]
        words.append(label[start:end])
        end = start
    return words[::-1]


def segmented(labels: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(label, words) of each different label. The counts of a label's substrings are joined to it: it can look up no others."""

    def substrings(parts):
        for part in parts:
            held: list[tuple[str, str]] = []
            for x in part.column(0).to_pylist():
                for a in range(len(x)):
                    held += {(x, x[a:b]) for b in range(a + 1, min(len(x), a + WORD_LENGTH) + 1)}
                    if len(held) > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=["label", "word"])
                        held = []
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*held, strict=True)], names=["label", "word"])

    met = labels.mapInArrow(substrings, "label string, word string")
    known = lookup(met, counts, {"word": "word"}, ["label"]).where("n is not null").groupBy("label").agg(F.collect_set(F.struct("word", "n")).alias("known"))
    log_total = math.log(max(2, total))

    def run(part):
        out = []
        for label, own in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            logp = {r["word"]: math.log(r["n"]) - log_total for r in own or ()}
            out.append(segment(label, logp, log_total))
        return [part.column(0), pa.array(out, pa.list_(pa.string()))]

    return batches(labels.join(known, "label", "left"), run, "label string, words array<string>")


def weights(tokens: DataFrame) -> DataFrame:
    """(token, weight): log-odds of block for every word of either side. ``tokens``: token, block, allow (how often)."""
    all_ = cut(tokens.groupBy("token").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).where("block > 0 or allow > 0"))
    t = all_.agg(F.coalesce(F.sum("block"), F.lit(0)).alias("b"), F.coalesce(F.sum("allow"), F.lit(0)).alias("a"), F.count(F.lit(1)).alias("v")).first()
    share = lambda c, n: (F.col(c) / float(n) * SCALE if n else F.lit(0.0)) + PSEUDO
    # one side may be empty: it then has pseudo-counts only
    norm = math.log((SCALE if t["b"] else 0.0) + PSEUDO * t["v"] or 1.0) - math.log((SCALE if t["a"] else 0.0) + PSEUDO * t["v"] or 1.0)
    return all_.select("token", (F.log(share("block", t["b"])) - F.log(share("allow", t["a"])) - norm).cast("decimal(20,12)").alias("weight"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html", unwanted: tuple[str, ...] = UNWANTED) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, words (segmented), block_score."""
    spark = pages.sparkSession
    url = F.col(f"`{url_col}`")
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    rule, verdict = rule_of(rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), F.xxhash64("host", "path").alias("h"))
    table = spark.createDataFrame([(u.partition("/")[0], "/" + u.partition("/")[2]) for u in unwanted] or [("", "")], "host string, path string").select("host", "path", F.lit(1).cast("long").alias("block"), F.lit(0).cast("long").alias("allow"))
    urls = rows.groupBy("host", "path").agg(F.lit(0).cast("long").alias("block"), F.count(F.when(F.col("ruled") == "allow", 1)).alias("allow"))

    def parted(part):
        return [*part.columns[:4], pa.array([parts_of(a, b) for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], pa.list_(pa.string()))]

    both = cut(batches(urls.unionByName(table), parted, "host string, path string, block bigint, allow bigint, parts array<string>"))
    counts = cut(page_words(pages, html_col))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    seeds = both.where("block > 0").select(F.explode("parts").alias("word"), F.lit(1).cast("long").alias("n"))  # words of the table count once at least
    counts = counts.unionByName(seeds).groupBy("word").agg(F.max("n").alias("n"))
    labels = both.select(F.explode("parts").alias("label")).where(F.col("label") != NUMBER).distinct()
    split = cut(segmented(labels, counts, total))
    placed = both.select(F.xxhash64("host", "path").alias("h"), "block", "allow", F.posexplode("parts").alias("place", "label"))
    words = lookup(placed, split, {"label": "label"}, ["h"]).select("h", "block", "allow", "place", F.posexplode(F.coalesce("words", F.array("label"))).alias("part", "token"))
    words = cut(words)
    weight = cut(weights(words.select("token", "block", "allow")))
    # words of the labelled table are no pages
    scored = lookup(words.where("block = 0"), weight, {"token": "token"}, ["h", "place"]).groupBy("h").agg(
        F.sum(F.coalesce("weight", F.lit(0).cast("decimal(20,12)"))).alias("odds"), F.array_sort(F.collect_list(F.struct("place", "part", "token"))).alias("in_order"))
    scored = scored.select("h", "odds", F.array_join(F.transform("in_order", lambda s: s["token"]), " ").alias("words"))
    j = lookup(rows, scored, {"h": "h"}, ["page_id"])
    odds = F.coalesce(F.col("odds"), F.lit(0)).cast("double") + math.log(PRIOR_ODDS)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-500.0), F.least(F.lit(500.0), odds))))
    return j.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(odds > 0, "block").otherwise("allow")).alias("verdict"), F.coalesce("words", F.lit("")).alias("words"), score.alias("block_score"))
