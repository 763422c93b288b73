"""The stages of the corpus pipeline: (spark, docs, folder) -> DataFrame with the columns of ``docs``, but for the last.

Edge cases: columns beside ``doc_id`` and ``text`` pass untouched; rows with null ids or texts stay unless a stage's decision
is about them (a null text is never toxic, has no words, no personal data and packs as the end id alone); of repeated rows
with words one stays after the near-duplicate stage; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, jaccard, packing, pii, toxicity
from .common import cut, held_out, read, ready


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents whose score stays below the threshold. Learns from labelled documents outside the held-out fold."""
    model = toxicity.fit(docs, read(spark, folder, "labels"), ~held_out("doc_id", 3, 1))
    return toxicity.keep(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Of each component the row with the least doc_id (null ids come last). Texts without words are no component and all stay.

    Rows are told apart by id and text: different texts under one id each stay or go with their own component. Of repeated rows
    that would stay, the one that sorts first does.
    """
    ready(spark)
    members, _ = jaccard.similarity_join(docs)
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    named = members.where("n_shingles > 0").select("group", row.alias("row"))
    least = named.groupBy("group").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    close = cut(named.join(least, "group").groupBy("row", (F.col("row") == F.col("least")).alias("stays")).count().select(F.col("row.doc_id").alias("_id"), F.col("row.text_hash").alias("_text"), "stays", "count"))
    own = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_text"))

    def listed(rows: DataFrame) -> DataFrame:
        rows = rows.select("_id", "_text")
        return F.broadcast(rows) if rows.count() <= jaccard.MAX_BROADCAST else rows

    stay = docs.join(listed(close.where("not stays")), own, "left_anti")
    again = close.where("stays and count > 1")
    if not again.limit(1).count():
        return stay
    again = listed(again)
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    one = stay.join(again, own, "left_semi").groupBy("doc_id", F.xxhash64("text")).agg(F.min(F.struct(F.col("text"), *rest)).alias("row")).select("doc_id", "row.*").select(docs.columns)
    return stay.join(again, own, "left_anti").unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    ready(spark)
    return decontaminate.clean(docs, read(spark, folder, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; ``n_chars`` is counted anew where it is there."""
    ready(spark)
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def pack_documents(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents with their places in sequences."""
    ready(spark)
    return packing.pack(packing.pieces(docs))

