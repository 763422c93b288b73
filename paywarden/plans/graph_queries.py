"""Graph queries over the given tables."""

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.session import cut
from ..operators import graph
from .registry import query
from .sqlviews import VIEWS, using

ROUNDS = 5


def merchant_edges(v):
    """Weights between 0.1 and 1."""
    return cut(v.merchant_edges.withColumn("weight", F.col("weight") / 10.0))


VIEWS["medges"] = (["merchant_edges"], "SELECT src, dst, ord, weight / 10.0::DOUBLE AS weight FROM merchant_edges")
VIEWS["mnodes"] = (["medges"], "SELECT src AS node FROM medges UNION SELECT dst FROM medges")
VIEWS["mlinks"] = (["medges"], "SELECT src AS node, dst AS other, weight FROM medges UNION ALL SELECT dst, src, weight FROM medges")


@query("merchant_graph", using("mnodes medges", """
  SELECT 'node' AS kind, node AS a, node AS b, 0.0::DOUBLE AS weight FROM mnodes UNION ALL SELECT 'edge', src, dst, weight FROM medges"""))
def merchant_graph(v):
    nodes, edges = graph.merchant_graph(merchant_edges(v))
    return nodes.select(F.lit("node").alias("kind"), F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.0).alias("weight")).unionByName(
        edges.select(F.lit("edge").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), "weight"))


def _shared_sql(entity, kind):
    return f"""SELECT a.merchant_id AS src, b.merchant_id AS dst, '{kind}' AS edge_type, count(*) AS shared_entity_count,
      round(count(*) / (any_value(sa.s) + any_value(sb.s) - count(*))::DOUBLE, 4) AS weight, min(least(a.f, b.f)) AS first_seen, max(greatest(a.l, b.l)) AS last_seen
      FROM (SELECT merchant_id, {entity} AS e, min(us) AS f, max(us) AS l FROM txn GROUP BY ALL) a JOIN (SELECT merchant_id, {entity} AS e, min(us) AS f, max(us) AS l FROM txn GROUP BY ALL) b
           ON a.e = b.e AND a.merchant_id < b.merchant_id
      JOIN (SELECT merchant_id, count(DISTINCT {entity}) AS s FROM txn GROUP BY ALL) sa ON sa.merchant_id = a.merchant_id
      JOIN (SELECT merchant_id, count(DISTINCT {entity}) AS s FROM txn GROUP BY ALL) sb ON sb.merchant_id = b.merchant_id GROUP BY ALL"""


@query("shared_entity_edges", using("txn", " UNION ALL ".join(_shared_sql(e, k) for e, k in (("user_id", "SHARED_CUSTOMERS"), ("device", "SHARED_DEVICES"), ("ip", "SHARED_IPS")))))
def shared_entity_edges(v):
    frames = [graph.shared_entity_edges(v.txn, e, k, block=20) for e, k in (("user_id", "SHARED_CUSTOMERS"), ("device", "SHARED_DEVICES"), ("ip", "SHARED_IPS"))]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def _pagerank_views(rounds):
    views = {
        "pr_pair": "SELECT least(src, dst) AS a, greatest(src, dst) AS b, arg_max(weight, (ord, src, dst)) AS w FROM medges GROUP BY ALL",
        "pr_dir": "SELECT a AS node, b AS other, w FROM pr_pair UNION ALL SELECT b, a, w FROM pr_pair",
        "pr_flow": "SELECT node, other, w / sum(w) OVER (PARTITION BY other) AS share FROM pr_dir",
        "pr_0": "SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM mnodes) AS rank FROM mnodes",
    }
    for i in range(rounds):
        views[f"pr_{i + 1}"] = f"""SELECT n.node, 0.15::DOUBLE / (SELECT count(*) FROM mnodes) + 0.85::DOUBLE * coalesce(sum(share * rank), 0) AS rank
          FROM mnodes n LEFT JOIN pr_flow f ON f.node = n.node LEFT JOIN pr_{i} r ON r.node = f.other GROUP BY n.node"""
    return views


def _community_views(rounds):
    views = {"cm_0": "SELECT node, node AS label FROM mnodes"}
    for i in range(rounds):
        views[f"cm_{i + 1}"] = f"""SELECT node, label FROM (SELECT v.node, v.label, row_number() OVER (PARTITION BY v.node ORDER BY round(w, 6) DESC, v.label <> o.label, v.label) AS rn
          FROM (SELECT l.node, c.label, sum(weight) AS w FROM mlinks l JOIN cm_{i} c ON c.node = l.other GROUP BY ALL) v JOIN cm_{i} o ON o.node = v.node) WHERE rn = 1"""
    return views


def _risk_views(links, nodes, prefix, known):
    views = {f"{prefix}_0": f"SELECT node, ({known})::DOUBLE AS risk FROM {nodes}"}
    for i in range(3):
        views[f"{prefix}_{i + 1}"] = f"""SELECT r.node, greatest(r.risk, least(1.0, coalesce(greatest(0.7::DOUBLE * s / d, 0.7::DOUBLE * m), 0.0))) AS risk FROM {prefix}_{i} r
          LEFT JOIN (SELECT l.node, sum(x.risk * weight) AS s, max(x.risk * weight) AS m, count(*) AS d FROM {links} l JOIN {prefix}_{i} x ON x.node = l.other GROUP BY l.node) g ON g.node = r.node"""
    return views


KNOWN_SQL = "CASE WHEN node % 9 = 0 THEN 0.8 WHEN node % 5 = 0 THEN 0.3 ELSE 0 END"


def known_risk(nodes):
    n = F.col("node")
    return nodes.select("node", F.when(n % 9 == 0, 0.8).when(n % 5 == 0, 0.3).otherwise(0.0).alias("risk"))


@query("pagerank", using("mnodes medges", f"SELECT node, round(rank, 8) AS rank FROM pr_{ROUNDS}", **_pagerank_views(ROUNDS)))
def pagerank(v):
    nodes, edges = graph.merchant_graph(merchant_edges(v))
    return graph.pagerank(nodes, edges, rounds=ROUNDS, tolerance=None).withColumn("rank", F.round("rank", 8))


@query("communities", using("mnodes mlinks", "SELECT * FROM cm_3", **_community_views(3)))
def communities(v):
    """Integer votes, so that ties are exact."""
    e = merchant_edges(v).withColumn("weight", F.round(F.col("weight") * 10))
    nodes, edges = graph.merchant_graph(e)
    return graph.communities(nodes, edges, rounds=3, converge=False)


@query("degree_centrality", using("mlinks", """
  SELECT node, count(*) AS degree, count(*) / (SELECT max(c) FROM (SELECT count(*) AS c FROM mlinks GROUP BY node))::DOUBLE AS degree_centrality FROM mlinks GROUP BY node"""))
def degree_centrality(v):
    return graph.degree_centrality(merchant_edges(v))


@query("propagate_risk", using("mnodes mlinks", "SELECT node, round(risk, 10) AS risk FROM pg_3", **_risk_views("mlinks", "mnodes", "pg", KNOWN_SQL)))
def propagate_risk(v):
    nodes, edges = graph.merchant_graph(merchant_edges(v))
    return graph.propagate_risk(nodes, edges, known_risk(nodes)).withColumn("risk", F.round("risk", 10))


def _metrics_at(v):
    nodes, edges = graph.merchant_graph(merchant_edges(v).withColumn("weight", F.round(F.col("weight") * 10) / 16.0))
    return edges, graph.graph_metrics(nodes, edges, known_risk(nodes), rank_rounds=ROUNDS, label_rounds=3)


_METRIC_VIEWS = {"medges2": "SELECT src, dst, ord, round(weight * 10) / 16.0::DOUBLE AS weight FROM medges"}
_METRIC_VIEWS.update({"links2": "SELECT src AS node, dst AS other, weight FROM medges2 UNION ALL SELECT dst, src, weight FROM medges2"})
_METRIC_VIEWS.update({k: s.replace("medges", "medges2") for k, s in _pagerank_views(ROUNDS).items()})
_METRIC_VIEWS.update({k: s.replace("mlinks", "links2") for k, s in _community_views(3).items()})
_METRIC_VIEWS.update(_risk_views("links2", "mnodes", "pg", KNOWN_SQL))
_METRIC_VIEWS["metrics"] = f"""SELECT n.node AS merchant_id, rank AS pagerank_score, label AS community_id, dg / (max(dg) OVER ())::DOUBLE AS degree_centrality, 0.0::DOUBLE AS betweenness_centrality, risk AS cluster_risk_score
  FROM mnodes n JOIN pr_{ROUNDS} USING (node) JOIN cm_3 USING (node) JOIN pg_3 USING (node) JOIN (SELECT node, count(*) AS dg FROM links2 GROUP BY node) USING (node)"""


@query("graph_metrics", using("mnodes medges", """
  SELECT merchant_id, round(pagerank_score, 8) AS pagerank_score, community_id, degree_centrality, betweenness_centrality, round(cluster_risk_score, 10) AS cluster_risk_score FROM metrics""", **_METRIC_VIEWS))
def graph_metrics(v):
    return _metrics_at(v)[1].withColumn("pagerank_score", F.round("pagerank_score", 8)).withColumn("cluster_risk_score", F.round("cluster_risk_score", 10))


@query("graph_summary", using("mnodes medges", """
  SELECT count(*) AS nodes_processed, count(DISTINCT community_id) AS communities_found, (SELECT count(*) FROM medges) AS edges_processed, 'completed' AS status FROM metrics""", **_METRIC_VIEWS))
def graph_summary(v):
    edges, m = _metrics_at(v)
    return graph.graph_summary(m, edges)


@query("latest_graph_features", using("txn merchants", """
  SELECT m.merchant_id, coalesce(s, 0.0)::DOUBLE AS pagerank_score, coalesce(c, 0)::BIGINT AS community_id, coalesce(d, 0.0)::DOUBLE AS degree_centrality, coalesce(r, 0.0)::DOUBLE AS cluster_risk_score
  FROM merchants m LEFT JOIN (SELECT DISTINCT ON (merchant_id) merchant_id, (txn_id % 100) / 100.0::DOUBLE AS s, txn_id % 7 AS c, (txn_id % 10) / 10.0::DOUBLE AS d, (txn_id % 50) / 50.0::DOUBLE AS r
       FROM txn WHERE merchant_id % 4 <> 0 ORDER BY merchant_id, us DESC) x ON x.merchant_id = m.merchant_id"""))
def latest_graph_features(v):
    i = F.col("txn_id")
    m = v.txn.filter("merchant_id % 4 <> 0").select(
        "merchant_id", F.col("us").alias("computed_us"), (i % 100 / 100.0).alias("pagerank_score"), (i % 7).alias("community_id"), (i % 10 / 10.0).alias("degree_centrality"),
        (i % 50 / 50.0).alias("cluster_risk_score"))
    return graph.latest_graph_features(m, v.merchants)


@query("circular_transfer_users", using("transfers", f"""
  SELECT DISTINCT unnest([a.sender, a.receiver]) AS user_id FROM transfers a JOIN transfers b ON a.receiver = b.sender AND b.receiver = a.sender AND abs(a.us - b.us) <= {K.DAY}
  UNION
  SELECT DISTINCT unnest([a.sender, b.sender, c.sender]) FROM transfers a JOIN transfers b ON a.receiver = b.sender AND abs(a.us - b.us) <= {K.DAY} AND b.receiver <> a.sender
  JOIN transfers c ON b.receiver = c.sender AND c.receiver = a.sender AND abs(c.us - a.us) <= {K.DAY} AND abs(c.us - b.us) <= {K.DAY}"""))
def circular_transfer_users(v):
    return graph.circular_transfer_users(v.transfers)


def device_use(v):
    """Users with one device each, and a second one for every fifth user."""
    u = F.col("user_id")
    first = v.txn.select(u, F.concat(F.lit("a"), F.pmod(u, F.lit(37)).cast("string")).alias("device"))
    second = v.txn.filter("user_id % 5 = 0").select(u, F.concat(F.lit("b"), F.pmod(u * 7, F.lit(53)).cast("string")).alias("device"))
    return first.unionByName(second)


@query("shared_device_cluster_size", using("txn", """
  SELECT user_id, count(*) OVER (PARTITION BY label) - 1 AS shared_device_cluster_size FROM (SELECT user_id, min(reach) AS label FROM walk GROUP BY user_id)""", recursive=True,
       use_="SELECT DISTINCT user_id, 'a' || (user_id % 37) AS device FROM txn UNION SELECT DISTINCT user_id, 'b' || (user_id * 7 % 53) FROM txn WHERE user_id % 5 = 0",
       links="SELECT DISTINCT a.device AS x, b.device AS y FROM use_ a JOIN use_ b USING (user_id)",
       reached="SELECT DISTINCT device, device AS dev FROM use_ UNION SELECT r.device, l.y FROM reached r JOIN links l ON l.x = r.dev",
       least="SELECT device, min(u.user_id) AS label FROM reached r JOIN (SELECT device AS dev, min(user_id) AS user_id FROM use_ GROUP BY device) u USING (dev) GROUP BY device",
       walk="SELECT DISTINCT user_id, label AS reach FROM use_ JOIN least USING (device)"))
def shared_device_cluster_size(v):
    return graph.shared_device_cluster_size(device_use(v))


VIEWS["uedges"] = (["transfers"], "SELECT sender AS src, receiver AS dst, (count(*) % 10 + 1) / 20.0::DOUBLE AS weight FROM transfers GROUP BY ALL")
VIEWS["unodes"] = (["uedges"], "SELECT src AS node FROM uedges UNION SELECT dst FROM uedges")
VIEWS["ulinks"] = (["uedges"], "SELECT src AS node, dst AS other, weight FROM uedges UNION ALL SELECT dst, src, weight FROM uedges")


@query("network_risk_score", using("unodes ulinks", "SELECT node AS user_id, round(risk, 10) AS network_risk_score FROM ug_3", **_risk_views("ulinks", "unodes", "ug", KNOWN_SQL)))
def network_risk_score(v):
    e = cut(v.transfers.groupBy(F.col("sender").alias("src"), F.col("receiver").alias("dst")).agg(((F.count(F.lit(1)) % 10 + 1) / 20.0).alias("weight")))
    nodes, _ = graph.merchant_graph(e)
    return graph.network_risk_score(e, known_risk(nodes)).withColumn("network_risk_score", F.round("network_risk_score", 10))
