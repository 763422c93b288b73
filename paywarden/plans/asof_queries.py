"""Vectors whose profiles, ratios and graph features are those known before each transaction."""

from pyspark.sql import functions as F

from ..functions.constants import HOUR
from ..functions.session import cut
from ..operators import asof, graph, profiles, vector
from ..sources.views import T0
from .feature_queries import AML_SQL, AS_OF, FRAUD_SQL, MERCHANT_SQL
from .graph_queries import KNOWN_SQL, _risk_views, known_risk
from .registry import query
from .sqlviews import HIGH_RISK_SQL, VIEWS, using

#: When the graph features are computed, and how close together the transfers of a ring lie, on the fast clock.
SNAPSHOTS, RING = (T0 + 10 * HOUR, T0 + 20 * HOUR), HOUR // 6


def arrivals(v):
    """Labels with the time at which they arrive, on the fast clock."""
    d = v.dense.select("txn_id", (F.col("us") + F.pmod("txn_id", F.lit(96)) * (HOUR // 24)).alias("us"))
    return d.join(v.fraud_labels, "txn_id")


def scores(v):
    """AML scores in thousandths at the time of their transactions."""
    p = v.predictions("aml").select(F.col("prediction_id").alias("txn_id"), F.round(F.col("score") * 1000).cast("long").alias("milli"))
    return v.dense.select("txn_id", "user_id", "us").join(p, "txn_id")


VIEWS["arrivals"] = (["dense", "p_fraud"], "SELECT d.txn_id, p.label, d.us + (d.txn_id % 96) * 150000000 AS us FROM dense d JOIN p_fraud p ON p.prediction_id = d.txn_id")
VIEWS["ascores"] = (["dense", "p_aml"], "SELECT d.user_id, d.us, round(p.score * 1000)::BIGINT AS milli FROM dense d JOIN p_aml p ON p.prediction_id = d.txn_id")
VIEWS["dev_known"] = (["dense", "arrivals"], """
      SELECT device, us, sum(sum(u)) OVER (PARTITION BY device ORDER BY us) AS u, sum(sum(f)) OVER (PARTITION BY device ORDER BY us) AS f
      FROM (SELECT device, min(us) AS us, 1 AS u, 0 AS f FROM dense GROUP BY device, user_id
            UNION ALL SELECT d.device, a.us, 0, 1 FROM arrivals a JOIN dense d USING (txn_id) WHERE a.label = 1) GROUP BY device, us""")
VIEWS["dev_asof"] = (["dense", "dev_known"], """
      SELECT txn_id, CASE WHEN coalesce(u, 0) = 0 THEN 0.1::DOUBLE ELSE round(least(1.0::DOUBLE, f / 5.0::DOUBLE) * 0.6::DOUBLE + least(1.0::DOUBLE, (u - 1) / 10.0::DOUBLE) * 0.4::DOUBLE, 4) END AS device_risk_score,
             CASE WHEN coalesce(u, 0) = 0 THEN 0 ELSE f END::BIGINT AS device_fraud_count, CASE WHEN coalesce(u, 0) = 0 THEN 1 ELSE u END::BIGINT AS distinct_user_count
      FROM dense t ASOF LEFT JOIN dev_known k ON k.device = t.device AND k.us < t.us""")
VIEWS["visits"] = (["dense", "ascores"], """
      SELECT v.merchant_id, v.us, s.n AS sn, s.total // s.n AS risk
      FROM (SELECT merchant_id, user_id, min(us) AS us FROM dense GROUP BY ALL) v
      ASOF LEFT JOIN (SELECT user_id, us, sum(count(*)) OVER w AS n, sum(sum(milli)) OVER w AS total FROM ascores GROUP BY user_id, us WINDOW w AS (PARTITION BY user_id ORDER BY us)) s
        ON s.user_id = v.user_id AND s.us < v.us""")
VIEWS["m_known"] = (["dense", "arrivals", "visits"], f"""
      SELECT merchant_id, us, sum(sum(n)) OVER w AS n, sum(sum(b)) OVER w AS b, sum(sum(f)) OVER w AS f, sum(sum(u)) OVER w AS u, sum(sum(h)) OVER w AS h, sum(sum(r)) OVER w AS r, sum(sum(rn)) OVER w AS rn
      FROM (SELECT merchant_id, us, 1 AS n, (upper(country) IN {HIGH_RISK_SQL})::INTEGER AS b, 0 AS f, 0 AS u, 0 AS h, 0 AS r, 0 AS rn FROM dense
            UNION ALL SELECT d.merchant_id, a.us, 0, 0, 1, 0, 0, 0, 0 FROM arrivals a JOIN dense d USING (txn_id) WHERE a.label = 1
            UNION ALL SELECT merchant_id, us, 0, 0, 0, 1, coalesce(risk >= 520, false)::INTEGER, coalesce(risk, 0), (risk IS NOT NULL)::INTEGER FROM visits)
      GROUP BY merchant_id, us WINDOW w AS (PARTITION BY merchant_id ORDER BY us)""")
VIEWS["m_asof"] = (["dense", "m_known"], """
      SELECT txn_id, CASE WHEN n > 0 THEN f / n::DOUBLE ELSE 0.0 END AS fraud_transaction_rate, CASE WHEN u > 0 THEN h / u::DOUBLE ELSE 0.0 END AS high_risk_customer_ratio,
             CASE WHEN n > 0 THEN b / n::DOUBLE ELSE 0.0 END AS cross_border_ratio, CASE WHEN rn > 0 THEN r / rn::DOUBLE / 1000.0::DOUBLE ELSE 0.0 END AS avg_customer_risk_score
      FROM dense t ASOF LEFT JOIN m_known k ON k.merchant_id = t.merchant_id AND k.us < t.us""")
VIEWS["dtransfers"] = (["transfers"], "SELECT * REPLACE (1704067200000000 + (us - 1704067200000000) // 24 AS us) FROM transfers")


def _snapshot_views():
    out, parts = {}, []
    for i, at in enumerate(SNAPSHOTS):
        out[f"tr{i}"] = f"SELECT * FROM dtransfers WHERE us < {at}"
        out[f"ue{i}"] = f"SELECT sender AS src, receiver AS dst, (count(*) % 10 + 1) / 20.0::DOUBLE AS weight FROM tr{i} GROUP BY ALL"
        out[f"un{i}"] = f"SELECT src AS node FROM ue{i} UNION SELECT dst FROM ue{i}"
        out[f"ul{i}"] = f"SELECT src AS node, dst AS other, weight FROM ue{i} UNION ALL SELECT dst, src, weight FROM ue{i}"
        out |= _risk_views(f"ul{i}", f"un{i}", f"ur{i}", KNOWN_SQL)
        out[f"ring{i}"] = f"""SELECT DISTINCT unnest([a.sender, a.receiver]) AS user_id FROM tr{i} a JOIN tr{i} b ON a.receiver = b.sender AND b.receiver = a.sender AND abs(a.us - b.us) <= {RING}
          UNION SELECT DISTINCT unnest([a.sender, b.sender, c.sender]) FROM tr{i} a JOIN tr{i} b ON a.receiver = b.sender AND abs(a.us - b.us) <= {RING} AND b.receiver <> a.sender
          JOIN tr{i} c ON b.receiver = c.sender AND c.receiver = a.sender AND abs(c.us - a.us) <= {RING} AND abs(c.us - b.us) <= {RING}"""
        out[f"pair{i}"] = f"SELECT user_id, count(*) OVER (PARTITION BY user_id % 37) - 1 AS size FROM (SELECT DISTINCT user_id FROM dense WHERE us < {at})"
        parts.append(f"""SELECT u.user_id, {at} AS us, coalesce(r.risk, 0.0) AS network_risk_score, (c.user_id IS NOT NULL)::INTEGER AS circular_transfer_flag, coalesce(p.size, 0) AS shared_device_cluster_size
          FROM (SELECT user_id FROM pair{i} UNION SELECT node FROM un{i}) u LEFT JOIN ur{i}_3 r ON r.node = u.user_id LEFT JOIN ring{i} c ON c.user_id = u.user_id LEFT JOIN pair{i} p ON p.user_id = u.user_id""")
    return out | {"snaps": " UNION ALL ".join(parts)}


def snapshots(v):
    """Graph features at the snapshot times; each user has one device, which others share."""
    t0 = F.lit(T0)
    moves = v.transfers.withColumn("us", t0 + F.floor((F.col("us") - t0) / 24).cast("long"))
    use = v.dense.select("user_id", F.concat(F.lit("a"), F.pmod("user_id", F.lit(37)).cast("string")).alias("device"), "us")
    out = None
    for at in SNAPSHOTS:
        e = cut(moves.filter(F.col("us") < at).groupBy(F.col("sender").alias("src"), F.col("receiver").alias("dst")).agg(((F.count(F.lit(1)) % 10 + 1) / 20.0).alias("weight")))
        nodes, _ = graph.merchant_graph(e)
        one = asof.graph_snapshot(moves, use, e, known_risk(nodes), at, RING)
        out = one if out is None else out.unionByName(one)
    return cut(out)


@query("device_profile_as_of", using("dev_asof", "SELECT * FROM dev_asof"))
def device_profile_as_of(v):
    return asof.device_profile(v.dense, arrivals(v)).select("txn_id", "device_risk_score", "device_fraud_count", "distinct_user_count")


@query("merchant_ratios_as_of", using("m_asof", "SELECT * FROM m_asof"))
def merchant_ratios_as_of(v):
    return asof.merchant_ratios(v.dense, arrivals(v), scores(v)).select("txn_id", "fraud_transaction_rate", "high_risk_customer_ratio", "cross_border_ratio", "avg_customer_risk_score")


@query("fraud_vector_as_of", using("fv dev_asof", f"""
  SELECT txn_id, {FRAUD_SQL} FROM (SELECT fv.* REPLACE (k.device_risk_score AS device_risk_score, k.device_fraud_count::DOUBLE AS device_fraud_count, k.distinct_user_count::DOUBLE AS distinct_user_count)
    FROM fv JOIN dev_asof k ON k.txn_id = fv.txn_id)"""))
def fraud_vector_as_of(v):
    return vector.fraud_vector(v.dense, v.auth_failures, v.accounts, v.confirmed_frauds, None, arrivals=arrivals(v)).drop("user_id", "us")


@query("aml_vector_as_of", using("av dtransfers", f"""
  SELECT txn_id, {AML_SQL} FROM (SELECT av.* REPLACE (round(coalesce(g.network_risk_score, 0), 10)::DOUBLE AS network_risk_score, coalesce(g.circular_transfer_flag, 0)::DOUBLE AS circular_transfer_flag,
    coalesce(g.shared_device_cluster_size, 0)::DOUBLE AS shared_device_cluster_size) FROM av ASOF LEFT JOIN snaps g ON g.user_id = av.user_id AND g.us < av.us)""", **_snapshot_views()))
def aml_vector_as_of(v):
    t = v.dense.withColumn("sender_wallet", F.concat(F.lit("w"), "user_id")).withColumn("receiver_wallet", F.concat(F.lit("m"), "merchant_id"))
    a = vector.aml_vector(t, v.accounts, v.ip_geo, None, snapshots=snapshots(v)).drop("user_id", "us")
    return a.withColumn("network_risk_score", F.round("network_risk_score", 10))


@query("merchant_vector_as_of", using("mv m_asof", f"""
  SELECT txn_id, {MERCHANT_SQL} FROM (SELECT mv.* REPLACE (k.fraud_transaction_rate AS fraud_transaction_rate, k.high_risk_customer_ratio AS high_risk_customer_ratio,
    k.cross_border_ratio AS cross_border_ratio, k.avg_customer_risk_score AS avg_customer_risk_score) FROM mv JOIN m_asof k ON k.txn_id = mv.txn_id)"""))
def merchant_vector_as_of(v):
    agg = profiles.merchant_aggregates(v.payments, AS_OF)
    return vector.merchant_vector(v.dense, agg, None, v.merchant_accounts, v.mcc_table, arrivals=arrivals(v), scores=scores(v)).drop("merchant_id", "us")
