"""Language identification by compression: the language whose dictionary makes a text smallest.

Each language gets a zstandard raw-content dictionary of sampled training texts. A text is lower-cased and compressed
whole with each of them; the smallest wins. A narrow margin (share of the second smallest size that the winner saves)
marks the answer as rejected.

Edge cases: null texts and texts without a letter are ``und`` with score 0 and rejected; ties go to the language that
sorts first; without any training rows every text is ``und``; duplicated rows give one row each; long texts are
compressed whole.
"""

from __future__ import annotations

import math

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, draw, texts

#: Bounds of the training sample: characters for each language, of all dictionaries together (with many languages each gets an equal share), of one sampled text.
SAMPLE_CHARS, ALL_CHARS, TEXT_CHARS = 40_000, 8_000_000, 4_000
#: Share that the winner must save.
MARGIN = 0.01
UNDECIDED = "und"


def _sample(docs: DataFrame, text_col: str, lang_col: str, train: Column, chars: int) -> dict[str, bytes]:
    """For each language, different texts of about ``chars`` characters in all, one at least, chosen by a hash of the text alone."""
    rows = docs.where(train).select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where("lang is not null and length(text) > 0")
    rows = rows.withColumn("text", F.substring("text", 1, TEXT_CHARS)).withColumn("h", draw("text"))
    different = rows.groupBy("lang", "h").agg(F.max(F.length("text")).alias("n"))  # copies count once
    counts = different.groupBy("lang").agg(F.sum("n").alias("n"), F.min("h").alias("least")).collect()  # a row for each language
    if not counts:
        return {}
    chars = min(chars, max(1, ALL_CHARS // len(counts)))
    bounds = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, 1.5 * chars / r["n"]), r["least"]) for r in counts], f"lang {rows.schema['lang'].dataType.simpleString()}, share double, least double")
    picked = rows.join(F.broadcast(bounds), "lang").where("h < share or h = least").select("lang", "text").distinct().collect()
    out: dict[str, bytes] = {}
    for lang in sorted({r["lang"] for r in picked}):
        lines = sorted((r["text"] for r in picked if r["lang"] == lang), key=lambda t: (hash_of(t), t))
        out[lang] = "\n".join(lines)[:chars].lower().encode("utf-8", "replace")
    return out


def hash_of(text: str) -> int:
    h = 0
    for b in text[:64].encode("utf-8", "replace"):
        h = (h * 1_000_003 ^ b) & 0xFFFFFFFF
    return h


def compressors(samples: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    """Greedy matching from three bytes on: the words of a language share short stems and endings."""
    out = []
    for lang, data in sorted(samples.items()):
        params = zstandard.ZstdCompressionParameters(window_log=22, chain_log=17, hash_log=17, search_log=2, min_match=3, target_length=16, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=params)))
    return out


def guess(models, text: str | None) -> tuple[str, float, float]:
    """Language, score (softmax of the sizes in bits per 64 bits of text), margin."""
    if not text or not models or not any(map(str.isalpha, text)):
        return UNDECIDED, 0.0, 0.0
    data = text.lower().encode("utf-8", "replace")
    sizes = [(len(c.compress(data)), lang) for lang, c in models]
    best, lang = min(sizes)
    scale = max(1.0, len(data) / 64)
    score = 1.0 / sum(math.exp(-8 * math.log(2) * (n - best) / scale) for n, _ in sizes)
    second = sorted(sizes)[1][0] if len(sizes) > 1 else best * 2
    return lang, score, 1 - best / second


def language(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", margin: float = MARGIN, sample_chars: int = SAMPLE_CHARS) -> DataFrame:
    """Per document: doc_id, lang_pred, score (0 to 1), margin, rejected. ``train`` marks the rows whose text and language may be learnt."""
    samples = _sample(docs, text_col, lang_col, train, sample_chars)
    sent = docs.sparkSession.sparkContext.broadcast(samples)  # at most ALL_CHARS characters, or one for each language
    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(part, models):
        got = [guess(models, t) for t in part.column(1).to_pylist()]
        return [part.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.float64()), pa.array([g[2] < margin for g in got], pa.bool_())]

    return batches(rows, run, f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean", lambda: compressors(sent.value))
