"""Quality by hierarchical empirical Bayes.

A logistic classifier over the make-up of a text gives its own evidence. Labelled rows are summed by site and by section of
a site; the share of good texts of a site is shrunk toward the global share, that of a section toward its site's, by as many
pseudo-observations as the spread between groups warrants (moments of the summed counts). A document's score adds its own
evidence to what its section's posterior says beyond the global share.

Edge cases: null texts count as empty; null sites and sections are groups of their own; a document without labels in its
site gets the global share; several labels of one document count as their mean, rounded up; of several texts under one id the classifier learns from the one that sorts first; without both labels every score
is the global share (one half without any); repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, draw, texts
from .toxicity import logistic

#: Labelled documents of each class the classifier learns from, and the longest text among them.
SAMPLE_DOCS, SAMPLE_CHARS = 5_000, 50_000
#: Bounds of the pseudo-observations that shrink a group.
LEAST_WEIGHT, MOST_WEIGHT = 2.0, 10_000.0
FEATURES = ("log_chars", "upper", "digits", "marks", "signs", "blanks", "word_length", "repeated_words", "repeated_lines", "compression")

_CLASS = np.zeros(256, np.int64)
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 3
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 4
_CLASS[[9, 10, 13, 32]] = 5
_LINE = re.compile(r"[^\n]+")


def features(text: str | None) -> list[float]:
    """Make-up of the whole text, each about between 0 and 2."""
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return [0.0] * len(FEATURES)
    n = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=6) / len(data)
    words, lines = text.split(), _LINE.findall(text)
    return [np.log1p(len(data)) / 8, n[1], n[2] * 4, n[3] * 4, n[4] * 8, n[5], min(2.0, len(data) / max(1, len(words)) / 8), 1 - len(set(words)) / max(1, len(words)), 1 - len(set(lines)) / max(1, len(lines)), len(zlib.compress(data, 1)) / (len(data) + 20)]


def _weight(summed: DataFrame, share) -> float:
    """Pseudo-observations for groups of (n, k) around ``share`` (a column), from the moments of their counts."""
    m = summed.where("n > 0").select("n", "k", share.alias("p")).agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("p"), 2)).alias("between"), F.sum(F.col("p") * (1 - F.col("p"))).alias("noise"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("p") * (1 - F.col("p"))).alias("pq"), F.count(F.lit(1)).alias("g")).first()
    if not m["g"] or not m["pq"]:
        return MOST_WEIGHT
    # sum n (x - p)^2 is the noise pq of each group plus n times the spread of true shares
    spread = max(0.0, (m["between"] - m["noise"]) / m["n"])
    pq = m["pq"] / m["n"]
    return float(min(MOST_WEIGHT, max(LEAST_WEIGHT, pq / spread - 1 if spread > 0 else MOST_WEIGHT)))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", section_col: str = "lang", label_id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Per document: doc_id, evidence (log-odds of its own text), site_share, section_share, score (0 to 1), keep (score of one half or more)."""
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{label_id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").groupBy("doc_id").agg(F.ceil(F.avg("y")).cast("int").alias("y"))
    where = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("\0")).alias("site"), F.coalesce(F.col(f"`{section_col}`").cast("string"), F.lit("\0")).alias("section"))
    sections = cut(where.join(known, "doc_id").groupBy("site", "section").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("k")))
    total = sections.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    n1, n0 = total["k"], total["n"] - total["k"]
    base = (n1 + 0.5) / (total["n"] + 1)

    sites = sections.groupBy("site").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    w = _weight(sites, F.lit(base))
    sites = sites.select("site", ((F.col("k") + w * base) / (F.col("n") + w)).alias("site_share"))
    held = sections.join(sites, "site")
    v = _weight(held, F.col("site_share"))
    shares = cut(held.select("site", "section", "site_share", ((F.col("k") + v * F.col("site_share")) / (F.col("n") + v)).alias("section_share")))

    weights = _classifier(docs, known, n0, n1, id_col, text_col)
    sent = spark.sparkContext.broadcast(weights)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{site_col}`").cast("string"), F.lit("\0")).alias("site"), F.coalesce(F.col(f"`{section_col}`").cast("string"), F.lit("\0")).alias("section"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(part):
        x = np.array([features(t) for t in part.column(1).to_pylist()]).reshape(part.num_rows, len(FEATURES))
        z = np.zeros(len(x)) if sent.value is None else np.clip(sent.value[0] + x @ sent.value[1:], -30, 30)
        return [part.column(0), part.column(2), part.column(3), pa.array(z)]

    scored = batches(rows, run, f"doc_id {kind}, site string, section string, evidence double")
    joined = scored.join(shares, ["site", "section"], "left").join(sites.withColumnRenamed("site_share", "own"), "site", "left")
    site = F.coalesce("site_share", "own", F.lit(base))
    section = F.coalesce("section_share", site)
    logit = lambda p: F.log(p / (1 - p))
    score = 1 / (1 + F.exp(-(F.col("evidence") + logit(section) - float(np.log(base / (1 - base))) + (0.0 if weights is not None else float(np.log(base / (1 - base)))))))
    return joined.select("doc_id", "evidence", site.alias("site_share"), section.alias("section_share"), score.alias("score")).withColumn("keep", F.col("score") >= 0.5)


def _classifier(docs: DataFrame, known: DataFrame, n0: int, n1: int, id_col: str, text_col: str) -> np.ndarray | None:
    """Logistic weights from a bounded sample of labelled rows; None if one class is missing."""
    if not n0 or not n1:
        return None
    part = F.when(F.col("y") == 1, F.lit(min(1.0, SAMPLE_DOCS / n1))).otherwise(F.lit(min(1.0, SAMPLE_DOCS / n0)))
    drawn = cut(known.where(draw("doc_id") < part))  # about 2 * SAMPLE_DOCS rows
    rows = texts(docs, id_col, text_col).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = batches(rows, lambda p: [p.column(0), pa.array([features(t) for t in p.column(1).to_pylist()], pa.list_(pa.float64())), p.column(2)], f"doc_id {kind}, x array<double>, y int").toPandas().sort_values("doc_id")
    y = made["y"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return None
    weight = np.where(y == 1, n1 / y.sum(), n0 / (len(y) - y.sum()))
    return logistic(np.array(made["x"].tolist()), y, weight * len(y) / weight.sum())
