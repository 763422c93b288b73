"""Graph measures over merchant and user relations, as joins and aggregates.

Hubs are expected: tables with one row per node are joined to the edges through salted lookups,
sums are combined before the shuffle, and iterations cut their lineage by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import timeline as tl
from ..functions.constants import DAY
from ..functions.joins import lookup, newest
from ..functions.session import cut


def merchant_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): distinct endpoints, and edges with a double weight."""
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    return nodes, edges.withColumn("weight", F.col("weight").cast("double"))


def both_ways(edges: DataFrame, *extra: str) -> DataFrame:
    """Every edge row seen from either end: node, other, weight."""
    a = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight", *extra)
    return a.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("other"), "weight", *extra))


def shared_entity_edges(txn: DataFrame, entity: str, edge_type: str, block: int = 1000) -> DataFrame:
    """Merchant pairs (src < dst) that share entities: how many, Jaccard weight, first and last seen.

    Transactions are reduced to distinct (merchant, entity) first. Every pair of merchants of an
    entity is part of the result, so none can be skipped; an entity of many merchants is split
    into blocks of about ``block`` merchants that meet pairwise in different tasks.
    """
    m = txn.filter(F.col(entity).isNotNull()).groupBy("merchant_id", F.col(entity).alias("e")).agg(F.min("us").alias("f"), F.max("us").alias("l"))
    per_entity = m.groupBy("e").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sized = lookup(m, per_entity, {"e": "e"}, ["merchant_id"])
    left = sized.withColumn("b", F.pmod(F.xxhash64("merchant_id"), F.col("blocks")).cast("int"))
    right = sized.withColumn("b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = left.select("e", "b", F.col("merchant_id").alias("src"), "f", "l").join(
        right.select("e", "b", F.col("merchant_id").alias("dst"), F.col("f").alias("f2"), F.col("l").alias("l2")), ["e", "b"]).filter("src < dst")
    shared = pairs.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("shared_entity_count"), F.min(F.least("f", "f2")).alias("first_seen"),
                                             F.max(F.greatest("l", "l2")).alias("last_seen"))
    size = m.groupBy("merchant_id").agg(F.count(F.lit(1)).alias("s"))
    j = lookup(shared, size.withColumnRenamed("s", "s1"), {"src": "merchant_id"}, ["dst"])
    j = lookup(j, size.withColumnRenamed("s", "s2"), {"dst": "merchant_id"}, ["src"])
    n = F.col("shared_entity_count")
    return j.select("src", "dst", F.lit(edge_type).alias("edge_type"), "shared_entity_count", F.round(n / (F.col("s1") + F.col("s2") - n), 4).alias("weight"),
                    "first_seen", "last_seen")


def _transitions(edges: DataFrame) -> DataFrame:
    """node, other, share: the part of ``other``'s rank that flows to ``node``.

    A repeated pair, in either direction, keeps its last edge (by ``ord``).
    """
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    pair = edges.groupBy(lo.alias("src"), hi.alias("dst")).agg(F.max_by("weight", F.struct("ord", F.col("src"), F.col("dst"))).alias("weight"))
    d = both_ways(pair.filter("src <> dst")).unionByName(
        pair.filter("src = dst").select(F.col("src").alias("node"), F.col("dst").alias("other"), "weight"))
    out = d.groupBy(F.col("other").alias("o")).agg(F.sum("weight").alias("total"))
    j = lookup(d, out, {"other": "o"}, ["node"])
    return j.select("node", "other", F.when(F.col("total") != 0, F.col("weight") / F.col("total")).otherwise(0.0).alias("share"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-8, every: int = 5) -> DataFrame:
    """Undirected weighted PageRank from a uniform start; rank of nodes without edges is not passed on.

    ``edges``: src, dst, weight, ord. Every ``every`` rounds the ranks are checkpointed and, with a
    ``tolerance``, compared with the round before (one number comes back).
    """
    flow = cut(_transitions(edges))
    nodes = cut(nodes.crossJoin(F.broadcast(nodes.agg(F.count(F.lit(1)).alias("n")))))  # one row
    base = (1.0 - damping) / F.col("n")
    ranks = nodes.select("node", (F.lit(1.0) / F.col("n")).alias("rank"))
    done = 0
    while done < rounds:
        before = ranks
        sent = lookup(flow, ranks, {"other": "node"}, ["node"])
        got = sent.groupBy("node").agg(F.sum(F.col("share") * F.col("rank")).alias("g"))
        ranks = nodes.join(got, "node", "left").select("node", (base + F.lit(damping) * F.coalesce("g", F.lit(0.0))).alias("rank"))
        done += 1
        if (done + 1) % every == 0:  # the round that the next one is compared with
            ranks = cut(ranks)
        if done % every == 0 and done < rounds:
            ranks = cut(ranks)
            if tolerance is not None:
                moved = ranks.join(before.withColumnRenamed("rank", "old"), "node").agg(F.sum(F.abs(F.col("rank") - F.col("old")))).first()[0]
                if moved is None or moved < tolerance:
                    break
    return ranks


def communities(nodes: DataFrame, edges: DataFrame, rounds: int = 100, converge: bool = True) -> DataFrame:
    """Label propagation with weighted votes in synchronous rounds.

    Ours: a node keeps its label when that is among the best, else takes the smallest best one,
    so the result does not depend on row order. ``rounds`` bounds the loop.
    """
    links = cut(both_ways(edges).groupBy("node", "other").agg(F.sum("weight").alias("weight")))
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    for _ in range(rounds):
        heard = lookup(links, labels, {"other": "node"}, ["node"])
        votes = heard.groupBy("node", "label").agg(F.sum("weight").alias("v"))
        own = lookup(votes, labels.withColumnRenamed("label", "own"), {"node": "node"}, ["label"])
        order = F.struct((-F.col("v")).alias("v"), (F.col("label") != F.col("own")).alias("other"), "label")
        best = own.groupBy("node").agg(F.min_by("label", order).alias("best"))
        step = cut(labels.join(best, "node", "left").select("node", F.coalesce("best", "label").alias("label"), (F.coalesce("best", "label") != F.col("label")).alias("moved")))
        labels = step.select("node", "label")
        if converge and step.filter("moved").limit(1).count() == 0:
            break
    return labels


def degree_centrality(edges: DataFrame) -> DataFrame:
    """Edge rows per node over the largest such count."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    top = ends.agg(F.max("degree").alias("top"))
    return ends.join(F.broadcast(top)).select("node", "degree", (F.col("degree") / F.col("top")).alias("degree_centrality"))  # one row


def propagate_risk(nodes: DataFrame, edges: DataFrame, known: DataFrame, decay: float = 0.7, hops: int = 3) -> DataFrame:
    """Risk spreading over ``hops`` synchronous hops; parallel edges count separately. ``known``: node, risk."""
    links = cut(both_ways(edges))
    risk = nodes.join(known.select("node", "risk"), "node", "left").select("node", F.coalesce("risk", F.lit(0.0)).alias("risk"))
    for _ in range(hops):
        near = lookup(links, risk, {"other": "node"}, ["node"])
        r = F.coalesce("risk", F.lit(0.0)) * F.col("weight")
        g = near.groupBy("node").agg(F.sum(r).alias("s"), F.max(r).alias("m"), F.count(F.lit(1)).alias("d"))
        spread = F.greatest(F.lit(decay) * F.col("s") / F.col("d"), F.lit(decay) * F.col("m"))
        risk = risk.join(g, "node", "left").select(
            "node", F.greatest("risk", F.coalesce(F.least(F.lit(1.0), spread), F.lit(0.0))).alias("risk"))
    return risk


def graph_metrics(nodes: DataFrame, edges: DataFrame, known: DataFrame, rank_rounds: int = 100, label_rounds: int = 100) -> DataFrame:
    """All measures per node; betweenness is a constant 0.0."""
    j = nodes.join(pagerank(nodes, edges, rounds=rank_rounds, tolerance=None if rank_rounds < 100 else 1e-8), "node", "left")
    j = j.join(communities(nodes, edges, label_rounds), "node", "left").join(degree_centrality(edges), "node", "left").join(propagate_risk(nodes, edges, known), "node", "left")
    return j.select(F.col("node").alias("merchant_id"), F.col("rank").alias("pagerank_score"), F.col("label").alias("community_id"),
                    F.coalesce("degree_centrality", F.lit(0.0)).alias("degree_centrality"), F.lit(0.0).alias("betweenness_centrality"), F.col("risk").alias("cluster_risk_score"))


def graph_summary(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    m = metrics.agg(F.count(F.lit(1)).alias("nodes_processed"), F.countDistinct("community_id").alias("communities_found"))
    return m.join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges_processed")))).withColumn("status", F.lit("completed"))  # one row each


def latest_graph_features(metrics: DataFrame, merchants: DataFrame) -> DataFrame:
    """Newest metrics per merchant (by computed_us), zeros where there are none."""
    cols = ["pagerank_score", "community_id", "degree_centrality", "cluster_risk_score"]
    last = newest(metrics.select("merchant_id", "computed_us", *cols), ["merchant_id"], ["computed_us"])
    j = merchants.select("merchant_id").join(last, "merchant_id", "left")
    return j.select("merchant_id", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols])


def circular_transfer_users(transfers: DataFrame, within_us: int = DAY) -> DataFrame:
    """Users in a directed cycle of two or three transfers that all lie within ``within_us`` (definition ours).

    Two-cycles show as neighbouring opposite transfers on a pair's timeline, so no pairs are
    formed. Three-cycles start from triangles of the distinct undirected graph; each triangle is
    found once, at its member with the fewest neighbours, which keeps a hub from pairing its
    neighbours. Users that only send or only receive are in no cycle; a triangle whose members are
    all found already needs no further look; one whose three transfers fall into one slice of
    ``within_us`` is found from distinct slices, and only the others need single transfers.
    ``transfers``: txn_id, sender, receiver, us.
    """
    t = transfers.filter(F.col("sender") != F.col("receiver")).select("txn_id", "sender", "receiver", "us")
    through = cut(t.select(F.col("sender").alias("_n")).distinct().intersect(t.select(F.col("receiver").alias("_n")).distinct()))
    t = t.join(through.withColumnRenamed("_n", "sender"), "sender", "left_semi").join(through.withColumnRenamed("_n", "receiver"), "receiver", "left_semi")
    t = cut(t.select("txn_id", "sender", "receiver", "us"))
    pair = t.select("txn_id", "us", F.least("sender", "receiver").alias("lo"), F.greatest("sender", "receiver").alias("hi"), (F.col("sender") < F.col("receiver")).alias("up"))
    p = tl.neighbours(pair, ["lo", "hi"], "us", "txn_id", {"pup": "up", "pus": "us"})
    two = p.filter((F.col("pup") != F.col("up")) & (F.col("us") - F.col("pus") <= within_us)).select(F.explode(F.array("lo", "hi")).alias("user_id"))
    two = cut(two.distinct())

    arcs = t.select(F.col("sender").alias("a"), F.col("receiver").alias("b")).distinct()
    links = arcs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    degree = links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d"))
    d = lookup(lookup(links, degree.withColumnRenamed("d", "du"), {"u": "node"}, ["v"]), degree.withColumnRenamed("d", "dv"), {"v": "node"}, ["u"])
    first = F.struct("du", "u") < F.struct("dv", "v")
    out = d.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("y"),
                   F.when(first, F.col("dv")).otherwise(F.col("du")).alias("dy"))
    other = out.select("x", F.col("y").alias("z"), F.col("dy").alias("dz"))
    wedges = out.join(other, "x").filter(F.struct("dy", "y") < F.struct("dz", "z"))
    closed = wedges.join(out.select(F.col("x").alias("y"), F.col("y").alias("z")), ["y", "z"], "left_semi").select("x", "y", "z")
    # both ways round, as three arcs each
    ring = closed.select(F.explode(F.array(F.array("x", "y", "z"), F.array("x", "z", "y"))).alias("r"))
    ring = cut(_legs(_with_unfound(ring, two)))
    at = tl.slice_start(F.col("us"), within_us)
    slices = cut(t.groupBy(F.col("sender").alias("a"), F.col("receiver").alias("b"), at.alias("slice")).agg(F.count(F.lit(1)).alias("n")))
    close = ring.join(slices.select("a", "b", "slice"), ["a", "b"]).groupBy("r", "slice").agg(F.count(F.lit(1)).alias("n")).filter("n = 3")
    two = cut(two.unionByName(close.select(F.explode("r").alias("user_id"))).distinct())
    whole = ring.join(arcs, ["a", "b"], "left_semi").groupBy("r").agg(F.count(F.lit(1)).alias("n")).filter("n = 3").select("r")
    legs = _legs(_with_unfound(whole, two)).join(t.select(F.col("sender").alias("a"), F.col("receiver").alias("b"), "us").distinct(), ["a", "b"])
    # a row looks back over its own and the previous bucket only, so it is placed in two buckets
    bucket = tl.slice_start(F.col("us"), within_us)
    placed = legs.select("r", "leg", "us", F.explode(F.array(bucket, bucket + within_us)).alias("bucket"))
    from pyspark.sql import Window

    upto = Window.partitionBy("r", "bucket").orderBy("us").rangeBetween(Window.unboundedPreceding, 0)
    seen = placed.select("r", "us", *[F.max(F.when(F.col("leg") == i, F.col("us"))).over(upto).alias(f"t{i}") for i in range(3)])
    ok = F.lit(True)
    for i in range(3):
        ok = ok & (F.col("us") - F.col(f"t{i}") <= within_us)
    three = seen.filter(ok).select(F.explode("r").alias("user_id"))
    return two.unionByName(three).distinct()


def _with_unfound(rings: DataFrame, found: DataFrame) -> DataFrame:
    """Those of ``rings`` (r: its users) with a member that is not among ``found``."""
    left = rings.select("r", F.explode("r").alias("user_id")).join(found, "user_id", "left_anti")
    return left.select("r").distinct()


def _legs(rings: DataFrame) -> DataFrame:
    """The three arcs of every ring: r, leg, a, b."""
    x, y, z = (F.col("r")[i] for i in range(3))
    arcs = F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in ((x, y), (y, z), (z, x))])
    return rings.select("r", F.posexplode(arcs).alias("leg", "arc")).select("r", "leg", "arc.a", "arc.b")


def components(pairs: DataFrame, left: str, right: str, max_rounds: int = 50) -> DataFrame:
    """Connected components of a two-sided graph: (left, component), the smallest member as label.

    Labels go across to the right side and back, then jump to their label's label, which shortens
    long chains to a logarithmic number of rounds.
    """
    links = cut(pairs.select(left, right).distinct())
    labels = cut(links.select(left).distinct().withColumn("label", F.col(left)))
    for _ in range(max_rounds):
        across = lookup(links, labels, {left: left}, [right]).groupBy(right).agg(F.min("label").alias("m"))
        back = lookup(links, across, {right: right}, [left]).groupBy(left).agg(F.min("m").alias("m"))
        jump = back.select(F.col(left).alias("_l"), F.col("m").alias("jump"))
        nxt = lookup(back, jump, {"m": "_l"}, [left])
        step = cut(labels.join(nxt, left).select(left, F.least("label", "m", "jump").alias("new"), "label"))
        labels = step.select(left, F.col("new").alias("label"))
        if step.filter("new <> label").limit(1).count() == 0:
            return labels
    raise RuntimeError("components did not settle; raise max_rounds")


def shared_device_cluster_size(txn: DataFrame) -> DataFrame:
    """Other users each user reaches through shared devices."""
    c = components(txn.filter(F.col("device").isNotNull()), "user_id", "device")
    size = c.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("shared_device_cluster_size"))
    return lookup(c, size, {"label": "label"}, ["user_id"]).select("user_id", "shared_device_cluster_size")


def network_risk_score(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Risk propagated over user edges (src, dst, weight)."""
    nodes, e = merchant_graph(edges)
    return propagate_risk(nodes, e, known).select(F.col("node").alias("user_id"), F.col("risk").alias("network_risk_score"))
