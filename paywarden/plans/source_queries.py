"""Source, sink and contract queries over the given tables."""

import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.session import checkpoint_folder, cut
from ..operators import reports
from ..sources import contracts, ingest, tables
from ..sources.views import T0
from .feature_queries import fraud_vector_of
from .registry import query
from .sqlviews import VIEWS, using


def _scratch(v, name):
    """A fresh folder beside the checkpoints, which all executors share."""
    base = checkpoint_folder(v.spark)
    if v.spark.sparkContext.master.startswith("local") and "://" not in base:
        return tempfile.mkdtemp(prefix=f"{name}-", dir=base)
    return f"{base}/{name}-{uuid.uuid4().hex}"


def event_json(v):
    """Transactions as JSON messages with changing field names, missing fields and missing ids."""
    t, i = v.txn, F.col("txn_id")
    def some(n, r, c):
        return F.when(F.pmod(i, F.lit(n)) == r, c)
    body = F.struct(
        F.when(F.pmod(i, F.lit(3)) != 0, i.cast("string")).alias("transaction_id"),
        F.when((F.pmod(i, F.lit(3)) == 0) & (F.pmod(i, F.lit(21)) != 0), F.concat(F.lit("x"), i.cast("string"))).alias("id"),
        some(2, 0, F.col("user_id").cast("string")).alias("user_id"), F.col("user_id").cast("string").alias("sender_id"),
        F.when(F.pmod(i, F.lit(5)) != 0, F.col("amount")).alias("amount"), F.when(F.pmod(i, F.lit(7)) != 0, F.col("currency")).alias("currency"),
        some(4, 0, F.col("type")).alias("transaction_type"), some(4, 1, F.lit("TRANSFER")).alias("type"),
        some(2, 1, F.col("device")).alias("device_fingerprint"), F.lit("d0").alias("device_id"))
    return t.select(F.to_json(body).alias("value"))


@query("parse_transactions", using("txn", """
  SELECT CASE WHEN txn_id % 3 <> 0 THEN txn_id::VARCHAR ELSE 'x' || txn_id::VARCHAR END AS transaction_id, user_id::VARCHAR AS user_id,
         CASE WHEN txn_id % 5 <> 0 THEN amount ELSE 0.0 END::DOUBLE AS amount, CASE WHEN txn_id % 7 <> 0 THEN currency ELSE 'KES' END AS currency,
         CASE txn_id % 4 WHEN 0 THEN type WHEN 1 THEN 'TRANSFER' ELSE 'UNKNOWN' END AS type, CASE WHEN txn_id % 2 = 1 THEN device ELSE 'd0' END AS device
  FROM txn WHERE txn_id % 21 <> 0"""))
def parse_transactions(v):
    return ingest.parse_transactions(event_json(v)).select("transaction_id", "user_id", "amount", "currency", "type", "device")


@query("route", using("p_all", """
  SELECT topic, key, value FROM (SELECT unnest(CASE domain
       WHEN 'fraud' THEN CASE WHEN decision = 'REVIEW' THEN ['fraud.decisions', 'fraud.review.queue'] ELSE ['fraud.decisions'] END
       WHEN 'aml' THEN CASE WHEN decision = 'BLOCK' THEN ['aml.scored', 'aml.blocked'] ELSE ['aml.scored'] END
       ELSE CASE WHEN decision = 'BLOCK' THEN ['merchant.risk.scored', 'merchant.risk.blocked'] ELSE ['merchant.risk.scored'] END END) AS topic,
       (CASE WHEN domain = 'merchant' THEN merchant_id ELSE transaction_id END)::VARCHAR AS key, decision || '/' || level AS value FROM p_all)
  UNION ALL SELECT domain || '.labels.updated', prediction_id::VARCHAR, label::VARCHAR FROM p_all WHERE label IS NOT NULL"""))
def route(v):
    p = v.all_predictions
    d = p.select("domain", F.when(F.col("domain") == "merchant", F.col("merchant_id")).otherwise(F.col("transaction_id")).alias("key"), "decision", F.concat_ws("/", "decision", "level").alias("value"))
    u = p.filter("label is not null").select("domain", F.col("prediction_id").alias("key"), F.col("label").cast("string").alias("value"))
    return ingest.route(d).unionByName(ingest.route_labels(u))


@query("feedback_labels", using("p_fraud", """
  SELECT prediction_id + 100000000 AS prediction_id, 'fraud' AS domain, 1::BIGINT AS label, 'CHARGEBACK' AS source FROM p_fraud WHERE transaction_id % 9 = 0
  UNION ALL SELECT prediction_id, 'aml', prediction_id % 2, 'PARTNER_FEEDBACK' FROM p_fraud WHERE prediction_id % 14 = 0 AND prediction_id % 5 <> 0"""))
def feedback_labels(v):
    p = v.predictions("fraud")
    twice = p.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "transaction_id", (F.col("prediction_id") + F.col("copy") * 100_000_000).alias("prediction_id"), (F.col("created_us") + F.col("copy")).alias("created_us"))
    cb = p.filter("transaction_id % 9 = 0").select("transaction_id")
    i = F.col("prediction_id")
    fb = p.filter("prediction_id % 7 = 0").select(
        "prediction_id", F.when(i % 2 == 0, "aml").alias("domain"), F.when(i % 5 != 0, (i % 2).cast("int")).alias("label"))
    return ingest.chargeback_labels(cb, twice).unionByName(ingest.partner_labels(fb))


@query("prediction_table", using("p_all", f"""
  SELECT domain, strftime(make_timestamp(created_us), '%Y-%m') AS month, count(*) AS n, sum(prediction_id)::BIGINT AS ids FROM p_all
  WHERE created_us >= {T0 + 3 * K.DAY} AND created_us < {T0 + 20 * K.DAY} GROUP BY ALL"""))
def prediction_table(v):
    """Write predictions partitioned by domain and month, then read a range back."""
    path = _scratch(v, "predictions")
    tables.write_predictions(v.all_predictions, path, mode="overwrite")
    r = tables.read_predictions(v.spark, path, T0 + 3 * K.DAY, T0 + 20 * K.DAY)
    return r.groupBy("domain", F.col("month").cast("string").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum("prediction_id").alias("ids"))


@query("snapshot_hash")
def snapshot_hash(v):
    return tables.snapshot_hash(fraud_vector_of(v), "fraud").select("txn_id", "feature_data", "feature_hash")


@query("text_hash", using("txn", "SELECT txn_id, substr(sha256(txn_id::VARCHAR || '|' || device || '|' || cents::VARCHAR), 1, 32) AS feature_hash FROM txn"))
def text_hash(v):
    body = F.concat_ws("|", F.col("txn_id").cast("string"), "device", F.col("cents").cast("string"))
    return v.txn.select("txn_id", F.substring(F.sha2(body, 256), 1, 32).alias("feature_hash"))


@query("load_training", using("fv", f"SELECT {', '.join(K.FRAUD_FEATURES)}, (txn_id % 12 = 0)::BIGINT AS is_fraud FROM fv"))
def load_training(v):
    path = _scratch(v, "training")
    fraud_vector_of(v).withColumn("is_fraud", (F.pmod("txn_id", F.lit(12)) == 0).cast("int")).write.mode("overwrite").parquet(path)
    return tables.load_training(v.spark, path, "fraud", "is_fraud")


@query("export_sink")
def export_sink(v):
    """Manifest of a CSV and of a JSON extract."""
    r = cut(reports.str_report(v.predictions("aml"), T0, T0 + 30 * K.DAY))
    a = tables.export_sink(r, _scratch(v, "export-csv"), "STR", "CSV", T0, T0 + 30 * K.DAY)
    b = tables.export_sink(r, _scratch(v, "export-json"), "STR", "JSON", T0, T0 + 30 * K.DAY)
    return a.unionByName(b).drop("path")


def requests(v):
    """Transactions with broken fields here and there."""
    i = F.col("txn_id")
    def hit(n):
        return F.pmod(i, F.lit(n)) == 0
    return v.txn.select(
        "txn_id", F.when(hit(11), 0.0).otherwise(F.col("amount")).alias("amount"), F.when(hit(13), "KE").otherwise(F.col("currency")).alias("currency"),
        F.when(hit(17), "").otherwise(F.col("type")).alias("type"), F.when(hit(19), "KENYA").when(~hit(23), F.col("country")).alias("country"),
        F.when(hit(29), 90.5).otherwise(F.col("lat")).alias("lat"), F.when(hit(31), -181.0).otherwise(F.col("lng")).alias("lng"),
        F.when(hit(37), F.repeat(F.lit("d"), 256)).otherwise(F.col("device")).alias("device"), F.when(hit(41), F.repeat(F.lit("i"), 46)).otherwise(F.col("ip")).alias("ip"),
        F.when(hit(43), "mcc-too-long").otherwise(F.lit("mcc")).alias("mcc"), F.pmod(i, F.lit(3)).cast("int").alias("label"))


@query("validate_requests", using("txn", """
  SELECT 'fraud' AS kind, txn_id, concat_ws('|', CASE WHEN txn_id % 11 = 0 THEN 'amount' END, CASE WHEN txn_id % 13 = 0 THEN 'currency' END, CASE WHEN txn_id % 17 = 0 THEN 'type' END,
         CASE WHEN txn_id % 19 = 0 THEN 'country' END, CASE WHEN txn_id % 29 = 0 OR abs(lat) > 90 THEN 'lat' END, CASE WHEN txn_id % 31 = 0 THEN 'lng' END, CASE WHEN txn_id % 37 = 0 THEN 'device' END, CASE WHEN txn_id % 41 = 0 THEN 'ip' END) AS reasons
  FROM txn WHERE txn_id % 11 = 0 OR txn_id % 13 = 0 OR txn_id % 17 = 0 OR txn_id % 19 = 0 OR txn_id % 29 = 0 OR txn_id % 31 = 0 OR txn_id % 37 = 0 OR txn_id % 41 = 0 OR abs(lat) > 90
  UNION ALL SELECT 'merchant', txn_id, concat_ws('|', CASE WHEN txn_id % 13 = 0 THEN 'currency' END, CASE WHEN txn_id % 43 = 0 THEN 'mcc' END) FROM txn WHERE txn_id % 13 = 0 OR txn_id % 43 = 0
  UNION ALL SELECT 'label', txn_id, 'label' FROM txn WHERE txn_id % 3 = 2"""))
def validate_requests(v):
    r = requests(v)
    frames = [contracts.validate_requests(r, p)[1].select(F.lit(k).alias("kind"), "txn_id", "reasons") for k, p in (
        ("fraud", contracts.request_problems("fraud")), ("merchant", contracts.request_problems("merchant")), ("label", contracts.label_problems()))]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


VIEWS["damaged"] = (["p_fraud"], """
      SELECT *, CASE WHEN prediction_id % 101 = 0 THEN 1.5 ELSE score END AS s2, CASE WHEN prediction_id % 103 = 0 THEN 'SEVERE' ELSE level END AS l2,
             CASE WHEN prediction_id % 107 = 0 THEN NULL ELSE decision END AS d2, CASE WHEN prediction_id % 109 = 0 THEN 2 ELSE label END AS b2 FROM p_fraud""")


@query("contract_check", using("damaged merchant_edges merchants", """
  SELECT 'score_range' AS rule, count(*) FILTER (NOT s2 BETWEEN 0 AND 1) AS violations FROM damaged
  UNION ALL SELECT 'level_enum', count(*) FILTER (l2 NOT IN ('LOW','MEDIUM','HIGH','CRITICAL')) FROM damaged
  UNION ALL SELECT 'decision_enum', count(*) FILTER (d2 IS NULL) FROM damaged UNION ALL SELECT 'label_values', count(*) FILTER (b2 = 2) FROM damaged
  UNION ALL SELECT 'threshold_order', count(*) FILTER (merchant_id % 10 >= 5) FROM merchants
  UNION ALL SELECT 'edge_unique', count(*) FROM (SELECT src, dst FROM merchant_edges GROUP BY ALL HAVING count(*) > 1)"""))
def contract_check(v):
    i = F.col("prediction_id")
    p = v.predictions("fraud").select(
        F.when(i % 101 == 0, 1.5).otherwise(F.col("score")).alias("score"), F.when(i % 103 == 0, "SEVERE").otherwise(F.col("level")).alias("level"),
        F.when(i % 107 != 0, F.col("decision")).alias("decision"), F.when(i % 109 == 0, 2).otherwise(F.col("label")).alias("label"))
    t = v.merchants.select((F.pmod("merchant_id", F.lit(10)) / 10.0).alias("approve"), F.lit(0.5).alias("review"), F.lit(0.9).alias("block"))
    return contracts.contract_check(p, t, v.merchant_edges.withColumn("edge_type", F.lit("TRANSACTION_FLOW")))


@query("dataset_fingerprint", using("txn", """
  SELECT n AS rows, md5(n::VARCHAR || ':' || a::VARCHAR || ':' || b::VARCHAR) AS fingerprint
  FROM (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 15))::BIGINT) AS a, sum(('0x' || substr(h, 17, 15))::BIGINT) AS b
        FROM (SELECT md5(concat_ws(chr(31), cents::VARCHAR, txn_id::VARCHAR, type, user_id::VARCHAR)) AS h FROM txn))"""))
def dataset_fingerprint(v):
    return tables.fingerprint(v.txn.select("txn_id", "user_id", "cents", "type"))
