"""The scheduled jobs, the scored stream and the small operational counts as queries."""

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import decisions, profiles, screening, vector
from ..functions.session import cut
from ..sources import store
from ..sources.views import AS_OF
from ..streaming import scoring as stream_scoring
from . import jobs
from .feature_queries import aml_vector_of
from .label_queries import NOW, queue
from .monitoring_queries import FEATURES, feature_halves
from .pseudo_queries import existing_transfers
from .registry import query
from .scoring_queries import AML_COLD, AML_DECIDE_SQL, FRAUD_COLD, FRAUD_DECIDE_SQL, MERCHANT_COLD, MERCHANT_DECIDE_SQL, _blacklisted_parties, _screen_sql, blacklists, merchant_scored
from .source_queries import _scratch
from .sqlviews import using


@query("label_cycle_statistics", using("p_all cases", """
  SELECT coalesce(domain, 'ALL') AS domain, count(*) AS total, count(lab) AS labelled, count(*) FILTER (lab = 1) AS positive, count(*) FILTER (lab = 0) AS negative, count(*) - count(lab) AS unlabelled,
         round(count(lab) / count(*)::DOUBLE, 4) AS label_rate, CASE WHEN count(lab) < 100 THEN 'COLD' WHEN count(lab) < 1000 THEN 'WARMING' WHEN count(lab) < 10000 THEN 'WARM' ELSE 'HOT' END AS maturity
  FROM (SELECT p.domain, coalesce(c.label, p.label) AS lab FROM p_all p LEFT JOIN
        (SELECT coalesce(prediction_id, entity_id) AS prediction_id, 'aml' AS domain, (status = 'CLOSED_CONFIRMED')::INTEGER AS label FROM cases WHERE status LIKE 'CLOSED%' AND NOT propagated) c USING (prediction_id, domain))
  GROUP BY ROLLUP (domain)"""))
def label_cycle_statistics(v):
    return jobs.label_cycle(v.all_predictions, v.cases, queue(v), NOW)["statistics"]


@query("label_cycle_twice", using("cases p_aml", """
  SELECT 1 AS run, count(*) AS events FROM cases c WHERE c.status IN ('CLOSED_CONFIRMED', 'CLOSED_FALSE_POSITIVE') AND NOT c.propagated
    AND (c.prediction_id IS NOT NULL OR c.entity_id IN (SELECT transaction_id FROM p_aml))
  UNION ALL SELECT 2, 0"""))
def label_cycle_twice(v):
    """Label events of two runs; the first stores the cases it has marked, and the second, which reads them, makes none."""
    path, schema = _scratch(v, "cases"), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in v.cases.schema.fields)
    store.upsert(v.cases, path, ["case_id"], 1)
    counts = None
    for run in (1, 2):
        cases = store.read(v.spark, path, schema)
        made = jobs.label_cycle(v.all_predictions, cases, queue(v), NOW)
        store.upsert(cut(made["cases"]), path, ["case_id"], run + 1)
        n = made["events"].agg(F.count(F.lit(1)).alias("events")).select(F.lit(run).alias("run"), "events")
        counts = n if counts is None else counts.unionByName(n)
    return counts


@query("label_cycle_queue")
def label_cycle_queue(v):
    q = jobs.label_cycle(v.all_predictions, v.cases, queue(v), NOW)["queue"]
    return q.groupBy("domain", "status").agg(F.count(F.lit(1)).alias("n"))


@query("drift_cycle_alerts")
def drift_cycle_alerts(v):
    b, c = feature_halves(v)
    return jobs.drift_cycle(b, c, FEATURES, 0.745, "v1")["alerts"]


@query("ssl_cycle_transfers", using("moved", "SELECT source_domain, target_domain, count(*) AS n FROM moved GROUP BY ALL"))
def ssl_cycle_transfers(v):
    return jobs.ssl_cycle(v.all_predictions, existing_transfers(v))["transfers"].groupBy("source_domain", "target_domain").agg(F.count(F.lit(1)).alias("n"))


_STREAM_SQL = {
    "sfraud": FRAUD_DECIDE_SQL.format(keep="txn_id, s", source=f"""
   (SELECT *, 'COLD' AS maturity, {FRAUD_COLD} AS s, 0.1::DOUBLE AS conf, sanctioned_country = 1 AS h1, blacklisted_device = 1 AS h2, blacklisted_ip = 1 AS h3,
           blacklisted_user = 1 AS h4, velocity_anomaly = 1 AS v, new_account_high_amount = 1 AS n
    FROM (SELECT fin.* REPLACE ((d.count_1h > 20)::INTEGER AS velocity_anomaly) FROM fin JOIN dsess d ON d.txn_id = fin.txn_id))"""),
    "saml": AML_DECIDE_SQL.format(keep="txn_id, s", source=f"""
   (SELECT *, CASE WHEN country IN ('IR','KP','SY','AF','YE') THEN least(1.0::DOUBLE, s0 + 0.15::DOUBLE) ELSE s0 END AS s
    FROM (SELECT x.*, {AML_COLD} AS s0, 0.1::DOUBLE AS conf, user_id % 41 = 0 AS h1, false AS h2, user_id % 29 = 0 AS h3, bd = 1 AS h4, structuring_score_24h > 0.5 AS g
    FROM (SELECT av.* REPLACE (0.0::DOUBLE AS is_cross_border), coalesce(velocity_1h * u.c > 3 * u.s, false) AS p, 'COLD' AS maturity, bd
          FROM av LEFT JOIN uspike u ON u.user_id = av.user_id AND u.hour_us = av.us - av.us % 3600000000
          JOIN (SELECT txn_id AS tid, blacklisted_device AS bd FROM blacklisted) ON tid = txn_id) x))"""),
    "smerchant": MERCHANT_DECIDE_SQL.format(keep="txn_id, s", source=f"""
   (SELECT *, 'COLD' AS maturity, chargeback_rate_90d AS cb, fraud_transaction_rate AS fr, velocity_spike_flag > 0 AS p, {MERCHANT_COLD} AS s, 0.1::DOUBLE AS conf FROM mv)"""),
}


@query("score_stream", using("fin dsess av uspike blacklisted mv", " UNION ALL ".join(
    f"SELECT '{d}' AS domain, txn_id, round(s, 6) AS score, decision, level FROM s{d}" for d in ("fraud", "aml", "merchant")), **_STREAM_SQL))
def score_stream(v):
    """Every transaction scored in two micro-batches from keyed state; the same as scoring all of them at once."""
    src, out, ck = _scratch(v, "score-in"), _scratch(v, "score-out"), _scratch(v, "score-ck")
    middle = v.dense.approxQuantile("us", [0.5], 0.01)[0]
    for part in (F.col("us") < middle, F.col("us") >= middle):
        v.dense.filter(part).repartitionByRange(2, "us").write.mode("append").parquet(src)
    users, devices, ips = blacklists(v)
    watch = v.txn.select("user_id").distinct().select("user_id", (F.col("user_id") % 41 == 0).cast("int").alias("sanctions_match"), F.lit(0).alias("watchlist_hit"))
    refs = stream_scoring.References(
        v.auth_failures, v.accounts, v.confirmed_frauds, profiles.device_profile(v.txn, v.fraud_labels), v.ip_geo, v.user_graph, profiles.merchant_aggregates(v.payments, AS_OF),
        profiles.merchant_risk_ratios(v.txn, v.fraud_labels, v.customer_risk), v.merchant_accounts, v.mcc_table, users, devices, ips, watch)
    stream = v.spark.readStream.schema(v.dense.schema).option("maxFilesPerTrigger", 2).parquet(src)
    stream_scoring.score_stream(stream, refs, out, ck).trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(f"{out}/results").select("domain", "txn_id", F.round("score", 6).alias("score"), "decision", "level")


@query("tier_counts", using("mdecided", "SELECT tier, count(*) AS n FROM mdecided GROUP BY tier"))
def tier_counts(v):
    return decisions.count_by(merchant_scored(v), "tier")


@query("match_type_counts", _screen_sql("SELECT match_type, count(*) AS n FROM fully GROUP BY match_type"))
def match_type_counts(v):
    return decisions.count_by(screening.screen(v.parties, v.sanctions, _blacklisted_parties(v)), "match_type")


@query("mean_coverage", using("av", "SELECT 'aml' AS domain, sum(covered)::BIGINT / count(*) / 22.0::DOUBLE AS coverage FROM (SELECT "
       + " + ".join(f"(abs({f} - {d}::DOUBLE) > 1e-6)::INTEGER" for f, d in zip(K.AML_FEATURES, K.PRIOR_DEFAULTS["aml"])) + " AS covered FROM av)"))
def mean_coverage(v):
    return vector.mean_coverage(aml_vector_of(v), "aml")
