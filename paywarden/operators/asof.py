"""Lookups as of a transaction's own time, so that no vector sees what came later.

A profile or ratio that a plain join would take from a whole table is a running total of events here, or the newest of a
sequence of updates: events and asking rows share one timeline per key, cut into slices of fixed width, and a slice inherits
one summary row. Events of the same instant are not seen. A key that owns a third of all rows is spread over its slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import timeline as tl
from ..functions.constants import DAY
from ..functions.joins import lookup
from . import profiles


def totals(rows: DataFrame, events: DataFrame, keys: list[str], time: str, sums: list[str], slice_us: int = tl.SLICE) -> DataFrame:
    """``rows`` with the sums of the key's earlier ``events``; rows with a null key get 0."""
    known = None
    for k in keys:
        known = F.col(k).isNotNull() if known is None else known & F.col(k).isNotNull()
    zero = F.lit(0).cast("long")
    asking = rows.filter(known).select(F.struct(*rows.columns).alias("_row"), *keys, F.col(time).alias("_t"), *[zero.alias(s) for s in sums])
    adding = events.select(F.lit(None).cast(asking.schema["_row"].dataType).alias("_row"), *keys, F.col(time).alias("_t"), *[F.col(s).cast("long").alias(s) for s in sums])
    ran = tl.running(asking.unionByName(adding), keys, "_t", {f"_sum_{s}": F.col(s) for s in sums}, tl.slice_start(F.col("_t"), slice_us))
    out = ran.filter(F.col("_row").isNotNull()).select(*[F.col(f"_row.{c}").alias(c) for c in rows.columns], *[F.col(f"_sum_{s}").alias(s) for s in sums])
    return out.unionByName(rows.filter(~known).select(*rows.columns, *[zero.alias(s) for s in sums]))


def newest(rows: DataFrame, updates: DataFrame, keys: list[str], time: str, values: list[str], slice_us: int = DAY) -> DataFrame:
    """``rows`` with the ``values`` of the key's last update before each; nulls where there is none. Of updates of one instant the greatest counts."""
    held = F.struct(*values)
    kind = updates.select(held.alias("h")).schema["h"].dataType
    asking = rows.select(F.struct(*rows.columns).alias("_row"), *keys, F.col(time).alias("_t"), F.lit(None).cast(kind).alias("_new"))
    given = updates.groupBy(*keys, F.col(time).alias("_t")).agg(F.max(held).alias("_new")).select(F.lit(None).cast(asking.schema["_row"].dataType).alias("_row"), *keys, "_t", "_new")
    both = asking.unionByName(given).withColumn("_slice", tl.slice_start(F.col("_t"), slice_us))
    # at one instant asking rows come first
    before = Window.partitionBy(*keys, "_slice").orderBy("_t", F.col("_row").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("_near", F.last("_new", True).over(before)).filter(F.col("_row").isNotNull())
    ends = both.groupBy(*keys, "_slice").agg(F.max_by("_new", F.when(F.col("_new").isNotNull(), F.col("_t"))).alias("_end"))
    far = ends.withColumn("_far", F.last("_end", True).over(Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))).drop("_end")
    j = near.join(far, [*keys, "_slice"], "left").select("_row", F.coalesce("_near", "_far").alias("_got"))
    return j.select(*[F.col(f"_row.{c}").alias(c) for c in rows.columns], *[F.col(f"_got.{v}").alias(v) for v in values])


def first_use(txn: DataFrame, keys: list[str], time: str = "us") -> DataFrame:
    """First time of each combination of ``keys``."""
    return txn.dropna(subset=keys[:1]).groupBy(*keys).agg(F.min(time).alias(time))


def device_profile(txn: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Device columns of every transaction from what was known before it.

    Users are counted from their first use of the device, frauds from the arrival of their labels (``arrivals``: txn_id, label,
    us). No device: (0.5, 0, 1); one never seen before: (0.1, 0, 1).
    """
    users = first_use(txn, ["device", "user_id"]).select("device", "us", F.lit(1).alias("_users"), F.lit(0).alias("_frauds"))
    frauds = txn.select("txn_id", "device").dropna(subset=["device"]).join(arrivals.filter("label = 1").select("txn_id", "us"), "txn_id").select("device", "us", F.lit(0).alias("_users"), F.lit(1).alias("_frauds"))
    t = totals(txn, users.unionByName(frauds), ["device"], "us", ["_users", "_frauds"])
    risk = F.least(F.lit(1.0), F.col("_frauds") / 5.0) * 0.6 + F.least(F.lit(1.0), (F.col("_users") - 1) / 10.0) * 0.4
    seen = F.col("_users") > 0
    return t.select(
        *txn.columns, F.when(F.col("device").isNull(), 0.5).when(seen, F.round(risk, 4)).otherwise(0.1).alias("device_risk_score"),
        F.when(seen, F.col("_frauds")).otherwise(0).alias("device_fraud_count"), F.when(seen, F.col("_users")).otherwise(1).alias("distinct_user_count"))


def risk_level(milli: Column) -> Column:
    return F.when(milli >= 560, "CRITICAL").when(milli >= 520, "HIGH").when(milli >= 480, "MEDIUM").otherwise("LOW")


def merchant_ratios(txn: DataFrame, arrivals: DataFrame, scores: DataFrame) -> DataFrame:
    """Merchant ratios of every transaction from what was known before it.

    A customer counts once, from the first visit on, with the mean of the scores it had got by then (``scores``: user_id, us,
    milli, in whole thousandths); a customer without one has no level. Frauds count from the arrival of their labels, among
    all earlier transactions. Before anything is known all ratios are 0.
    """
    one, zero = F.lit(1), F.lit(0)
    names = ["_n", "_b", "_f", "_u", "_h", "_r", "_rn"]

    def events(df: DataFrame, **cols) -> DataFrame:
        return df.select("merchant_id", "us", *[cols.get(n, zero).cast("long").alias(n) for n in names])

    t = txn.filter(F.col("merchant_id").isNotNull())
    visits = totals(first_use(t, ["merchant_id", "user_id"]), scores.select("user_id", "us", F.lit(1).alias("_sn"), F.col("milli").alias("_ss")), ["user_id"], "us", ["_sn", "_ss"])
    rated, risk = F.col("_sn") > 0, F.expr("_ss div nullif(_sn, 0)")
    all_ = events(t, _n=one, _b=profiles.high_risk_country(F.col("country")))
    all_ = all_.unionByName(events(t.select("txn_id", "merchant_id").join(arrivals.filter("label = 1").select("txn_id", "us"), "txn_id"), _f=one))
    all_ = all_.unionByName(events(visits, _u=one, _h=F.when(rated & risk_level(risk).isin("HIGH", "CRITICAL"), 1).otherwise(0), _r=F.when(rated, risk).otherwise(0), _rn=rated.cast("int")))
    got = totals(txn, all_, ["merchant_id"], "us", names)

    def share(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return got.select(
        *txn.columns, share("_f", "_n").alias("fraud_transaction_rate"), share("_h", "_u").alias("high_risk_customer_ratio"),
        share("_b", "_n").alias("cross_border_ratio"), F.when(F.col("_rn") > 0, F.col("_r") / F.col("_rn") / 1000.0).otherwise(0.0).alias("avg_customer_risk_score"))


GRAPH = ["network_risk_score", "circular_transfer_flag", "shared_device_cluster_size"]


def user_graph(txn: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Graph features of every transaction from the newest snapshot before it (``snapshots``: user_id, us and the features); 0 without one."""
    got = newest(txn, snapshots, ["user_id"], "us", GRAPH)
    return got.select(*txn.columns, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in GRAPH])


def graph_snapshot(transfers: DataFrame, txn: DataFrame, edges: DataFrame, known: DataFrame, at_us: int, within_us: int = DAY) -> DataFrame:
    """Graph features of all users from transfers, device uses and edges before ``at_us``: one of the snapshots of :func:`user_graph`.

    ``transfers``: txn_id, sender, receiver, us; ``txn``: user_id, device, us; ``edges``: src, dst, weight, made of earlier
    transfers; ``known``: risks of listed users.
    """
    from . import graph

    rings = graph.circular_transfer_users(transfers.filter(F.col("us") < at_us), within_us).withColumn("circular_transfer_flag", F.lit(1))
    past = txn.filter(F.col("us") < at_us)
    clusters = graph.shared_device_cluster_size(past)
    risk = graph.network_risk_score(edges, known)
    users = past.select("user_id").union(risk.select("user_id")).distinct()
    j = users.join(risk, "user_id", "left").join(rings, "user_id", "left").join(clusters, "user_id", "left")
    return j.select("user_id", F.lit(at_us).cast("long").alias("us"), F.coalesce("network_risk_score", F.lit(0.0)).alias("network_risk_score"),
                    F.coalesce("circular_transfer_flag", F.lit(0)).alias("circular_transfer_flag"), F.coalesce("shared_device_cluster_size", F.lit(0)).cast("long").alias("shared_device_cluster_size"))
