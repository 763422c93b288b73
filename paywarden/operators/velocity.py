"""Per-transaction features from an entity's own past.

All windows leave out the current row: a counter is updated only after the decision. Rolling
windows leave out every row of the same microsecond; session counters order such rows by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import timeline as tl
from ..functions.constants import DAY, HIGH_RISK_COUNTRIES, HOUR
from ..functions.joins import lookup

def _zero() -> Column:
    return F.lit(0).cast("long")


def _n(flag: Column | None = None) -> Column:
    one = F.lit(1).cast("long")
    return one if flag is None else F.when(flag, one).otherwise(_zero())


def _mean(total: str, n: str) -> Column:
    """Mean in money units of a total in cents; 0 for no rows."""
    return F.when(F.col(n) > 0, F.col(total).cast("double") / F.col(n).cast("double") / 100.0).otherwise(0.0)


def _stddev(total: str, squares: str, n: str) -> Column:
    """Sample deviation from exact sums of cents; 0 below two rows."""
    s, q, c = F.col(total).cast("double"), F.col(squares).cast("double"), F.col(n).cast("double")
    var = (q - s * s / c) / (c - 1.0)
    return F.when(F.col(n) > 1, F.sqrt(F.greatest(var, F.lit(0.0))) / 100.0).otherwise(0.0)


def _specs(wanted: list[str]) -> dict:
    x = F.col("cents")
    sq = x.cast("decimal(19,0)") * x.cast("decimal(19,0)")
    risky = _n(F.col("country").isin(HIGH_RISK_COUNTRIES))
    every = {
        "n_1h": (HOUR, _n(), _n()), "n_24h": (DAY, _n(), _n()), "cents_24h": (DAY, x, x),
        "n_7d": (7 * DAY, _n(), _n()), "cents_7d": (7 * DAY, x, x),
        "n_30d": (30 * DAY, _n(), _n()), "cents_30d": (30 * DAY, x, x), "squares_30d": (30 * DAY, sq, sq),
        "risky_30d": (30 * DAY, risky, risky),
    }
    return {k: every[k] for k in wanted}


def user_avg_7d(txn: DataFrame) -> DataFrame:
    """Mean amount of the user's earlier transactions of the last 7 days, 0 if none."""
    t = tl.trailing(txn, ["user_id"], "us", _specs(["n_7d", "cents_7d"]))
    return t.withColumn("avg_transaction_amount_7d", _mean("cents_7d", "n_7d")).drop("n_7d", "cents_7d")


def velocity_session(txn: DataFrame, key: str = "user_id") -> DataFrame:
    """What hour and day counters that expire after a pause show before this transaction."""
    return tl.session_counters(txn, [key], "us", "txn_id", "cents", {"1h": HOUR, "24h": DAY})


def velocity_rolling(txn: DataFrame) -> DataFrame:
    """Counts of the last hour and day and the volume of the last day."""
    t = tl.trailing(txn, ["user_id"], "us", _specs(["n_1h", "n_24h", "cents_24h"]))
    return (t.withColumnRenamed("n_1h", "velocity_1h").withColumnRenamed("n_24h", "velocity_24h")
            .withColumn("total_volume_24h", F.col("cents_24h") / 100.0).drop("cents_24h"))


def merchant_velocity(txn: DataFrame) -> DataFrame:
    """Merchant session counters and distinct customers of the last day.

    Rows without a customer read the counters but do not move them.
    """
    narrow = txn.select("txn_id", "merchant_id", "user_id", "us", "cents")
    counted = tl.session_counters(narrow, ["merchant_id"], "us", "txn_id", "cents", {"1h": HOUR, "24h": DAY},
                                  moves=F.col("user_id").isNotNull())
    flagged = tl.presence(narrow.drop("cents"), ["merchant_id"], "user_id", "us", "txn_id", DAY, "_cust")
    distinct = tl.trailing(flagged, ["merchant_id"], "us", {"unique_customers_24h": (DAY, F.col("_cust_in"), F.col("_cust_out"))},
                           keep=["txn_id"], last=tl.last_time(txn))
    out = tl.attach(txn, counted.select("txn_id", "count_1h", "sum_1h", "count_24h", "sum_24h"),
                    distinct.select("txn_id", "unique_customers_24h"))
    return out.withColumn("transaction_volume_24h", F.col("sum_24h") / 100.0)


def failed_logins_24h(txn: DataFrame, auth: DataFrame) -> DataFrame:
    """Failed logins of the user in the day before each transaction; ``auth`` has user_id, us."""
    probes = txn.withColumn("_fact", F.lit(0).cast("long"))
    facts = auth.select("user_id", "us").withColumn("_fact", F.lit(1).cast("long"))
    both = probes.unionByName(facts, allowMissingColumns=True)
    t = tl.trailing(both, ["user_id"], "us", {"failed_login_attempts_24h": (DAY, F.col("_fact"), F.col("_fact"))})
    return t.filter("_fact = 0").drop("_fact")


def distinct_30d(txn: DataFrame, specs: dict | None = None) -> DataFrame:
    """Distinct devices and ips of the user's last 30 days per transaction, with ``specs`` in the same pass.

    Each transaction enters the timeline once with its device and once with its ip, so both counts
    share one plan; ``specs`` may name cents. Also says (``new_device_flag``) whether the device is new or unused for 30 days.
    """
    used = F.array(F.struct(F.lit("d").alias("kind"), F.col("device").alias("member")), F.struct(F.lit("i").alias("kind"), F.col("ip").alias("member")))
    two = txn.select("txn_id", "user_id", "us", "cents", F.explode(used).alias("m"))
    two = two.select("txn_id", "user_id", "us", F.when(F.col("m.kind") == "d", F.col("cents")).alias("cents"), "m.kind", "m.member")
    flagged = tl.presence(two, ["user_id", "kind"], "member", "us", "txn_id", 30 * DAY, "_d")
    device = F.col("kind") == "d"
    zero = _zero()

    def only(cond: Column, c: Column) -> Column:
        return F.when(cond, c).otherwise(zero)

    wanted = {n: (w, only(device, a), only(device, b)) for n, (w, a, b) in (specs or {}).items()}
    wanted["device_count_30d"] = (30 * DAY, only(device, F.col("_d_in")), only(device, F.col("_d_out")))
    wanted["ip_count_30d"] = (30 * DAY, only(~device, F.col("_d_in")), only(~device, F.col("_d_out")))
    t = tl.trailing(flagged, ["user_id"], "us", wanted, keep=["txn_id", "_d_known", "_d_fresh"], asking=device, last=tl.last_time(txn))
    return t.select("txn_id", *wanted, F.when(F.col("_d_known") == 1, F.col("_d_fresh")).otherwise(0).alias("new_device_flag"))


def amounts_30d() -> list[Column]:
    return [_mean("cents_30d", "n_30d").alias("avg_amount_30d"),
            F.round(_stddev("cents_30d", "squares_30d", "n_30d"), 4).alias("std_amount_30d")]


def aml_user_30d(txn: DataFrame) -> DataFrame:
    """Mean, sample deviation, count, volume, distinct devices and ips of the user's last 30 days."""
    t = tl.attach(txn, distinct_30d(txn, _specs(["n_30d", "cents_30d", "squares_30d"])))
    return t.select(
        *txn.columns, *amounts_30d(), F.col("n_30d").alias("transaction_count_30d"),
        (F.col("cents_30d") / 100.0).alias("total_volume_30d"), "device_count_30d", "ip_count_30d")


def new_device_flag(txn: DataFrame) -> DataFrame:
    """1 when the user has not used the device in the last 30 days; a null device gives 0.

    This looks back per device. The streaming form (``streaming.devices``) keeps one expiring set
    per user instead, whose expiry is renewed only when a device is added.
    """
    narrow = txn.select("txn_id", "user_id", "device", "us").filter(F.col("device").isNotNull())
    p = tl.neighbours(narrow, ["user_id", "device"], "us", "txn_id", {"_p": "us"})
    flag = F.when(F.col("_p").isNull() | (F.col("us") - F.col("_p") >= 30 * DAY), 1).otherwise(0)
    out = tl.attach(txn, p.select("txn_id", flag.alias("new_device_flag")))
    return out.withColumn("new_device_flag", F.coalesce("new_device_flag", F.lit(0)))


def geo_distance(txn: DataFrame) -> DataFrame:
    """(txn_id, distance) of the located rows: great-circle km from the user's previous located transaction, 0 when that is a day old or absent."""
    located = txn.select("txn_id", "user_id", "us", "lat", "lng").filter(F.col("lat").isNotNull() & F.col("lng").isNotNull())
    p = tl.neighbours(located, ["user_id"], "us", "txn_id", {"_pus": "us", "_plat": "lat", "_plng": "lng"})
    km = haversine(F.col("_plat"), F.col("_plng"), F.col("lat"), F.col("lng"))
    fresh = F.col("_pus").isNotNull() & (F.col("us") - F.col("_pus") < DAY)
    return p.select("txn_id", F.when(fresh, F.round(km, 4)).otherwise(0.0).alias("geo_distance_from_last_tx"))


def with_geo_distance(txn: DataFrame) -> DataFrame:
    out = tl.attach(txn, geo_distance(txn))
    return out.withColumn("geo_distance_from_last_tx", F.coalesce("geo_distance_from_last_tx", F.lit(0.0)))


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    a = F.least(F.lit(1.0), F.greatest(F.lit(0.0), a))
    return F.lit(6371.0) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def structuring_score() -> Column:
    """From session counters: many payments, each below the limit, that pass it together."""
    over = (F.col("sum_24h") + F.col("cents") > 100_000_000) & (F.col("cents") < 100_000_000)
    return F.when((F.col("count_24h") >= 5) & over, F.least(F.lit(1.0), F.col("count_24h") / 10.0)).otherwise(0.0)


def rapid_drain() -> Column:
    return F.when((F.col("sum_24h") > 0) & (F.col("cents") * 2 > F.col("sum_24h")), 1).otherwise(0)


def structuring(txn: DataFrame) -> DataFrame:
    """Structuring score, rapid drain, and whether an earlier payment of the user scored above 0.5."""
    narrow = txn.select("txn_id", "user_id", "us", "cents")
    s = velocity_session(narrow).select("*", structuring_score().alias("structuring_score_24h"), rapid_drain().alias("rapid_drain_flag"))
    hit = {"_h": _n(F.col("structuring_score_24h") > 0.5)}
    r = tl.running(s, ["user_id"], "us", hit, tl.slice_start(F.col("us"), tl.SLICE), tie="txn_id")
    return r.withColumn("historical_structuring_flag", (F.col("_h") > 0).cast("int")).drop("_h")


def high_risk_country_exposure(txn: DataFrame) -> DataFrame:
    """Transactions of the user in high-risk countries in the last 30 days."""
    return tl.trailing(txn, ["user_id"], "us", {"high_risk_country_exposure": _specs(["risky_30d"])["risky_30d"]})


def with_hourly_past(rows: DataFrame, txn: DataFrame, key: str) -> DataFrame:
    """``rows`` (with txn_id, the key and us) beside what the key did in earlier clock hours: past_n transactions in past_hours active hours.

    Counts are combined per hour before anything is ordered, so a key has at most one row per hour.
    """
    from pyspark.sql import Window

    hourly = txn.groupBy(key, tl.slice_start(F.col("us"), HOUR).alias("hour_us")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(key).orderBy("hour_us").rowsBetween(Window.unboundedPreceding, -1)
    past = hourly.select(key, "hour_us", F.sum("n").over(before).alias("past_n"), F.count(F.lit(1)).over(before).alias("past_hours"))
    at = rows.withColumn("hour_us", tl.slice_start(F.col("us"), HOUR))
    return lookup(at, past, {key: key, "hour_us": "hour_us"}, ["txn_id"]).drop("hour_us")


def spike_flag(count_1h: Column) -> Column:
    """1 when the hour counter before the transaction exceeds 3 x the mean of the key's earlier active hours."""
    spike = (F.col("past_hours") > 0) & (count_1h * F.col("past_hours") > 3 * F.col("past_n"))
    return F.coalesce(spike, F.lit(False)).cast("int")


def velocity_spike(txn: DataFrame, key: str = "user_id") -> DataFrame:
    """(txn_id, key, count_1h, velocity_spike_flag) of every transaction, from what was known before it."""
    counted = velocity_session(txn.select("txn_id", key, "us", "cents"), key).select("txn_id", key, "us", "count_1h")
    return with_hourly_past(counted, txn, key).select("txn_id", key, "count_1h", spike_flag(F.col("count_1h")).alias("velocity_spike_flag"))
