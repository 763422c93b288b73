"""Reading events and routing results; the same columns work on tables and on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import newest
from . import schemas


def read_json_stream(spark: SparkSession, folder: str, schema, files_per_batch: int = 100) -> DataFrame:
    """JSON lines arriving as files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(folder)


def read_kafka_stream(spark: SparkSession, servers: str, topics: list[str], per_batch: int = 1_000_000) -> DataFrame:
    """Topic and JSON text of messages (the Kafka connector must be on the class path)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
           .option("startingOffsets", "latest").option("maxOffsetsPerTrigger", per_batch).load())
    return raw.select("topic", F.col("value").cast("string").alias("value"))


def parse_transactions(messages: DataFrame, value: str = "value") -> DataFrame:
    """Transaction events from JSON text, with alternative field names resolved and defaults filled.

    Messages without a transaction id are dropped.
    """
    e = messages.select(F.from_json(value, schemas.TRANSACTION_EVENT).alias("e")).select("e.*")
    return normalise_transactions(e)


def normalise_transactions(e: DataFrame) -> DataFrame:
    def given(c: str) -> Column:
        return F.when(F.col(c) != "", F.col(c))
    return e.select(
        F.coalesce(given("transaction_id"), given("id")).alias("transaction_id"), F.coalesce("user_id", "sender_id").alias("user_id"), "merchant_id",
        F.coalesce("amount", F.lit(0.0)).alias("amount"), F.coalesce("currency", F.lit("KES")).alias("currency"),
        F.coalesce("transaction_type", "type", F.lit("UNKNOWN")).alias("type"), F.coalesce("device_fingerprint", "device_id").alias("device"),
        F.col("ip_address").alias("ip"), "sender_wallet_id", "receiver_wallet_id", "channel", "mcc_code", F.col("timestamp").alias("ts"),
    ).filter(F.col("transaction_id").isNotNull())


def route(decisions: DataFrame) -> DataFrame:
    """(topic, key, value) per message that a result calls for. ``decisions``: domain, key, decision, value."""
    c = F.col
    topics = F.array_compact(F.array(
        F.when(c("domain") == "fraud", "fraud.decisions"), F.when((c("domain") == "fraud") & (c("decision") == "REVIEW"), "fraud.review.queue"),
        F.when(c("domain") == "aml", "aml.scored"), F.when((c("domain") == "aml") & (c("decision") == "BLOCK"), "aml.blocked"),
        F.when(c("domain") == "merchant", "merchant.risk.scored"), F.when((c("domain") == "merchant") & (c("decision") == "BLOCK"), "merchant.risk.blocked")))
    return decisions.select(F.explode(topics).alias("topic"), c("key").cast("string").alias("key"), "value")


def route_labels(updates: DataFrame) -> DataFrame:
    """Label updates go to their domain's topic. ``updates``: domain, key, value."""
    return updates.select(F.concat("domain", F.lit(".labels.updated")).alias("topic"), F.col("key").cast("string").alias("key"), "value")


def chargeback_labels(chargebacks: DataFrame, predictions: DataFrame) -> DataFrame:
    """Label 1 for the newest fraud prediction of every charged-back transaction. ``chargebacks``: transaction_id."""
    asked = chargebacks.select("transaction_id").filter(F.col("transaction_id").isNotNull()).distinct()
    hit = predictions.select("transaction_id", "prediction_id", "created_us").join(asked, "transaction_id", "left_semi")
    last = newest(hit, ["transaction_id"], ["created_us", "prediction_id"])
    return last.select("prediction_id", F.lit("fraud").alias("domain"), F.lit(1).alias("label"), F.lit("CHARGEBACK").alias("source"))


def partner_labels(feedback: DataFrame) -> DataFrame:
    """Partner feedback with prediction, domain and label all present."""
    ok = F.col("prediction_id").isNotNull() & F.col("domain").isNotNull() & F.col("label").isNotNull()
    return feedback.filter(ok).select("prediction_id", "domain", "label", F.lit("PARTNER_FEEDBACK").alias("source"))
