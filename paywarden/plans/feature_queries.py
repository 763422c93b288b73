"""Feature queries over the given tables."""

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.session import cut
from ..operators import profiles, vector, velocity
from ..sources.views import AS_OF, T0
from .registry import query
from .sqlviews import CCY_SQL, HIGH_RISK_SQL, TOD_SQL, bin_sql, over, using


@query("user_avg_7d", using("txn", f"""
  SELECT txn_id, CASE WHEN count(*) {over('7d')} > 0
                      THEN (sum(cents) {over('7d')})::DOUBLE / (count(*) {over('7d')})::DOUBLE / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS avg_transaction_amount_7d
  FROM txn"""))
def user_avg_7d(v):
    return velocity.user_avg_7d(v.txn).select("txn_id", "avg_transaction_amount_7d")


@query("velocity_session", using("dsess", "SELECT txn_id, count_1h, sum_1h, count_24h, sum_24h FROM dsess"))
def velocity_session(v):
    return velocity.velocity_session(v.dense).select("txn_id", "count_1h", "sum_1h", "count_24h", "sum_24h")


@query("velocity_rolling", using("dense", f"""
  SELECT txn_id, count(*) {over('1h')} AS velocity_1h, count(*) {over('24h')} AS velocity_24h,
         coalesce(sum(cents) {over('24h')}, 0) / 100.0::DOUBLE AS total_volume_24h FROM dense"""))
def velocity_rolling(v):
    return velocity.velocity_rolling(v.dense).select("txn_id", "velocity_1h", "velocity_24h", "total_volume_24h")


@query("session_windows", using("dense", """
  SELECT user_id, min(us) AS start_us, max(us) + 3600000000 AS end_us, count(*) AS n, sum(cents)::BIGINT AS cents
  FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY us, txn_id) AS g
        FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, txn_id) >= 3600000000 THEN 1 ELSE 0 END AS b FROM dense))
  GROUP BY user_id, g"""))
def session_windows(v):
    """Whole sessions per user (an hour of silence ends one), as the streaming form emits them."""
    from ..streaming.windows import session_totals

    t = v.dense.withColumn("ts", F.timestamp_micros("us"))
    s = session_totals(t, "1 hour")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", "cents")


@query("merchant_velocity", using("msess", f"""
  SELECT txn_id, count_1h, count_24h, sum_24h / 100.0::DOUBLE AS transaction_volume_24h,
         count(DISTINCT user_id) {over('24h', 'merchant_id')} AS unique_customers_24h FROM msess"""))
def merchant_velocity(v):
    return velocity.merchant_velocity(v.dense).select(
        "txn_id", "count_1h", "count_24h", "transaction_volume_24h", "unique_customers_24h")


@query("failed_logins_24h", using("dense", f"""
  SELECT txn_id, count(*) FILTER (type = 'ERROR') {over('24h')} AS failed_login_attempts_24h FROM dense"""))
def failed_logins_24h(v):
    return velocity.failed_logins_24h(v.dense, v.auth_failures).select("txn_id", "failed_login_attempts_24h")


@query("account_age_days", using("txn accounts", """
  SELECT txn_id, coalesce(((us - created_us) - ((us - created_us) % 86400000000 + 86400000000) % 86400000000) / 86400000000, 365)::DOUBLE AS account_age_days
  FROM txn LEFT JOIN accounts USING (user_id)"""))
def account_age_days(v):
    from ..functions.joins import lookup

    j = lookup(v.txn, v.accounts.select("user_id", "created_us"), {"user_id": "user_id"}, ["txn_id"])
    return j.select("txn_id", profiles.age_days(F.col("created_us"), F.col("us"), 365.0).alias("account_age_days"))


@query("device_profile", using("devices", """
  SELECT device, device_fraud_count, distinct_user_count, last_seen_us, device_risk_score FROM devices"""))
def device_profile(v):
    return profiles.device_profile(v.txn, v.fraud_labels)


@query("device_lookup", using("txn devices", """
  SELECT txn_id, CASE WHEN d IS NULL THEN 0.5 WHEN p.device IS NULL THEN 0.1 ELSE device_risk_score END::DOUBLE AS device_risk_score,
         coalesce(device_fraud_count, 0)::BIGINT AS device_fraud_count, coalesce(distinct_user_count, 1)::BIGINT AS distinct_user_count
  FROM (SELECT txn_id, CASE WHEN txn_id % 13 <> 0 THEN device END AS d FROM txn) t
  LEFT JOIN (SELECT * FROM devices WHERE device <> 'dev-7') p ON p.device = t.d"""))
def device_lookup(v):
    t = v.txn.withColumn("device", F.when(F.pmod("txn_id", F.lit(13)) != 0, F.col("device")))
    p = profiles.device_profile(v.txn, v.fraud_labels).filter("device <> 'dev-7'")
    return profiles.device_lookup(t, p).select("txn_id", "device_risk_score", "device_fraud_count", "distinct_user_count")


@query("geo_distance", using("geo", "SELECT * FROM geo"))
def geo_distance(v):
    return velocity.with_geo_distance(v.dense).select("txn_id", "geo_distance_from_last_tx")


@query("time_and_currency", using("txn", f"SELECT txn_id, {TOD_SQL} AS time_of_day, {CCY_SQL} AS currency_risk FROM txn"))
def time_and_currency(v):
    return v.txn.select("txn_id", profiles.time_of_day(F.col("us")).alias("time_of_day"),
                        profiles.currency_risk(F.col("currency")).alias("currency_risk"))


@query("aml_user_30d", using("txn", f"""
  SELECT txn_id, CASE WHEN n > 0 THEN s::DOUBLE / n::DOUBLE / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS avg_amount_30d,
         CASE WHEN n > 1 THEN round(sqrt(greatest((q::DOUBLE - s::DOUBLE * s::DOUBLE / n::DOUBLE) / (n::DOUBLE - 1.0), 0.0)) / 100.0::DOUBLE, 4) ELSE 0.0::DOUBLE END AS std_amount_30d,
         n AS transaction_count_30d, coalesce(s, 0) / 100.0::DOUBLE AS total_volume_30d, device_count_30d, ip_count_30d
  FROM (SELECT txn_id, count(*) {over('30d')} AS n, sum(cents) {over('30d')} AS s, sum(cents::HUGEINT * cents::HUGEINT) {over('30d')} AS q,
               count(DISTINCT device) {over('30d')} AS device_count_30d, count(DISTINCT ip) {over('30d')} AS ip_count_30d FROM txn)"""))
def aml_user_30d(v):
    return velocity.aml_user_30d(v.txn).select(
        "txn_id", "avg_amount_30d", "std_amount_30d", "transaction_count_30d",
        "total_volume_30d", "device_count_30d", "ip_count_30d")


@query("new_device_flag", using("txn", """
  SELECT txn_id, CASE WHEN us - lag(us) OVER (PARTITION BY user_id, device ORDER BY us, txn_id) < 2592000000000 THEN 0 ELSE 1 END::BIGINT AS new_device_flag FROM txn"""))
def new_device_flag(v):
    return velocity.new_device_flag(v.txn).select("txn_id", "new_device_flag")


@query("ip_country_mismatch", using("txn ip_geo", """
  SELECT txn_id, coalesce(ip_country <> country, false)::BIGINT AS ip_country_mismatch FROM txn LEFT JOIN ip_geo USING (ip)"""))
def ip_country_mismatch(v):
    return profiles.ip_country_mismatch(v.txn, v.ip_geo).select("txn_id", "ip_country_mismatch")


@query("country_risk", using("txn", f"""
  SELECT txn_id, (country IN {HIGH_RISK_SQL})::BIGINT AS high_risk_country_flag,
         CASE WHEN country IN ('IR','KP','SY','CU','VE') THEN 1.0 WHEN country IN {HIGH_RISK_SQL} THEN 0.5 ELSE 0.0 END::DOUBLE AS sanctions_proximity_score
  FROM txn"""))
def country_risk(v):
    return v.txn.select("txn_id", profiles.high_risk_country(F.col("country")).alias("high_risk_country_flag"),
                        profiles.sanctions_proximity(F.col("country")).alias("sanctions_proximity_score"))


@query("cross_border", using("txn", f"""
  SELECT txn_id, (txn_id % 7 <> 0 AND user_id <> merchant_id AND country IN {HIGH_RISK_SQL})::BIGINT AS is_cross_border FROM txn"""))
def cross_border(v):
    receiver = F.when(F.pmod("txn_id", F.lit(7)) != 0, F.col("merchant_id"))
    return v.txn.select("txn_id", profiles.cross_border(F.col("user_id"), receiver, F.col("country")).alias("is_cross_border"))


@query("structuring", using("structured", """
  SELECT txn_id, structuring_score_24h, rapid_drain_flag::BIGINT AS rapid_drain_flag, coalesce(hist, 0)::BIGINT AS historical_structuring_flag FROM structured"""))
def structuring(v):
    return velocity.structuring(v.dense).select("txn_id", "structuring_score_24h", "rapid_drain_flag", "historical_structuring_flag")


@query("high_risk_country_exposure", using("txn", f"""
  SELECT txn_id, count(*) FILTER (country IN {HIGH_RISK_SQL}) {over('30d')} AS high_risk_country_exposure FROM txn"""))
def high_risk_country_exposure(v):
    return velocity.high_risk_country_exposure(v.txn).select("txn_id", "high_risk_country_exposure")


@query("merchant_aggregates", using("magg", "SELECT * FROM magg"))
def merchant_aggregates(v):
    return profiles.merchant_aggregates(v.payments, AS_OF)


@query("merchant_risk_ratios", using("mratio", "SELECT * FROM mratio"))
def merchant_risk_ratios(v):
    return profiles.merchant_risk_ratios(v.txn, v.fraud_labels, v.customer_risk)


def _spike_sql(kind: str, key: str) -> str:
    return f"""
  SELECT '{kind}' AS kind, t.{key} AS entity, txn_id, count_1h, coalesce(count_1h * c > 3 * s, false)::BIGINT AS velocity_spike_flag
  FROM {"msess" if key == "merchant_id" else "dsess"} t LEFT JOIN
       (SELECT {key}, hour_us, sum(n) OVER w AS s, count(*) OVER w AS c
        FROM (SELECT {key}, us - us % 3600000000 AS hour_us, count(*) AS n FROM dense GROUP BY ALL)
        WINDOW w AS (PARTITION BY {key} ORDER BY hour_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) h
       ON h.{key} = t.{key} AND h.hour_us = t.us - t.us % 3600000000"""


@query("velocity_spike", using("dense msess dsess", _spike_sql("merchant", "merchant_id") + " UNION ALL " + _spike_sql("user", "user_id")))
def velocity_spike(v):
    m = velocity.velocity_spike(v.dense, "merchant_id").withColumnRenamed("merchant_id", "entity").withColumn("kind", F.lit("merchant"))
    u = velocity.velocity_spike(v.dense, "user_id").withColumnRenamed("user_id", "entity").withColumn("kind", F.lit("user"))
    return m.unionByName(u)


FRAUD_SQL = ", ".join(K.FRAUD_FEATURES)
AML_SQL = ", ".join(K.AML_FEATURES)
MERCHANT_SQL = ", ".join(K.MERCHANT_FEATURES)


def fraud_vector_of(v, keep=None, txn=None):
    devices = profiles.device_profile(v.txn, v.fraud_labels)
    return vector.fraud_vector(v.dense if txn is None else txn, v.auth_failures, v.accounts, v.confirmed_frauds, devices, keep)


def aml_vector_of(v, keep=None, txn=None):
    t = (v.dense if txn is None else txn).withColumn("sender_wallet", F.concat(F.lit("w"), "user_id")).withColumn("receiver_wallet", F.concat(F.lit("m"), "merchant_id"))
    return vector.aml_vector(t, v.accounts, v.ip_geo, v.user_graph, keep)


def merchant_vector_of(v, keep=None, txn=None):
    agg = profiles.merchant_aggregates(v.payments, AS_OF)
    ratios = profiles.merchant_risk_ratios(v.txn, v.fraud_labels, v.customer_risk)
    return vector.merchant_vector(v.dense if txn is None else txn, agg, ratios, v.merchant_accounts, v.mcc_table, keep)


@query("fraud_vector", using("fv", f"SELECT txn_id, {FRAUD_SQL} FROM fv"))
def fraud_vector(v):
    return fraud_vector_of(v).drop("user_id", "us")


@query("aml_vector", using("av", f"SELECT txn_id, {AML_SQL} FROM av"))
def aml_vector(v):
    return aml_vector_of(v).drop("user_id", "us")


@query("merchant_vector", using("mv", f"SELECT txn_id, {MERCHANT_SQL} FROM mv"))
def merchant_vector(v):
    return merchant_vector_of(v).drop("merchant_id", "us")


@query("vector_contract", using("fv", " UNION ALL ".join(
    f"""SELECT '{f}' AS feature, count(*) FILTER ({f'txn_id % 97 = 0' if f == 'amount' else f'txn_id % 89 = 0' if f == 'currency_risk' else 'false'}) AS bad_values,
        count(*) FILTER (txn_id % 97 = 0 OR txn_id % 89 = 0) AS invalid_rows, count(*) AS rows, '{vector.schema_hash('fraud')}' AS schema_hash FROM fv"""
    for f in K.FRAUD_FEATURES)))
def vector_contract(v):
    t = damaged(fraud_vector_of(v))
    return vector.vector_contract(t, "fraud")


def damaged(df):
    """Knock out a few values so that invalid vectors occur."""
    amount = F.when(F.pmod("txn_id", F.lit(97)) != 0, F.col("amount"))
    risk = F.when(F.pmod("txn_id", F.lit(89)) == 0, F.lit(float("nan"))).otherwise(F.col("currency_risk"))
    return df.withColumn("amount", amount).withColumn("currency_risk", risk)


def _priors_sql(source: str, features: list[str]) -> str:
    rows = " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value FROM recent" for f in features)
    return using(source, """
  SELECT feature, round(median, 4) AS median, round(mean, 4) AS mean, round(lo + (bin + 0.5) * (hi - lo) / bins, 4) AS mode, round(std, 4) AS std, n
  FROM stats JOIN (SELECT feature, arg_min(bin, (-c) * 1000 + bin) AS bin FROM
        (SELECT feature, """ + bin_sql('value', 'lo', 'hi', 'bins') + """ AS bin, count(*) AS c FROM long JOIN stats USING (feature) GROUP BY ALL)
        GROUP BY feature) USING (feature)""",
        recent=f"SELECT * FROM {source}", long=rows,
        stats="""SELECT feature, quantile_cont(value, 0.5) AS median, avg(value) AS mean, stddev_pop(value) AS std, count(value) AS n,
                 CASE WHEN min(value) = max(value) THEN min(value) - 0.5 ELSE min(value) END::DOUBLE AS lo,
                 CASE WHEN min(value) = max(value) THEN max(value) + 0.5 ELSE max(value) END::DOUBLE AS hi,
                 least(50, count(value) // 2 + 1)::BIGINT AS bins FROM long GROUP BY feature HAVING count(value) >= 5""")


@query("population_priors", _priors_sql("fv", K.FRAUD_FEATURES))
def population_priors(v):
    return vector.population_priors(cut(fraud_vector_of(v)), "fraud")


@query("blend_prior", using("sess", """
  SELECT txn_id, CASE WHEN count_24h <= 0 THEN 50.0::DOUBLE
                 ELSE (1.0::DOUBLE - count_24h / (count_24h + 10.0::DOUBLE)) * 50.0::DOUBLE + count_24h / (count_24h + 10.0::DOUBLE) * amount END AS blended FROM sess"""))
def blend_prior(v):
    s = velocity.velocity_session(v.txn)
    return s.select("txn_id", vector.blend_prior(F.lit(50.0), F.col("amount"), F.col("count_24h")).alias("blended"))


@query("impute_defaults", using("fv", f"""
  SELECT txn_id, {', '.join(f for f in K.FRAUD_FEATURES if f not in ('amount', 'currency_risk', 'time_of_day'))},
         CASE WHEN txn_id % 97 <> 0 THEN amount ELSE m END AS amount,
         CASE WHEN txn_id % 89 <> 0 THEN currency_risk ELSE 0.0::DOUBLE END AS currency_risk, time_of_day
  FROM fv, (SELECT round(quantile_cont(amount, 0.5), 4) AS m FROM fv)"""))
def impute_defaults(v):
    base = cut(fraud_vector_of(v))
    priors = vector.population_priors(base, "fraud").filter("feature = 'amount'")
    return vector.impute_defaults(damaged(base), priors, "fraud").drop("user_id", "us")


@query("feature_coverage", using("av", "SELECT txn_id, covered::BIGINT AS covered, covered / 22.0::DOUBLE AS coverage FROM (SELECT txn_id, "
       + " + ".join(f"(abs({f} - {d}::DOUBLE) > 1e-6)::INTEGER" for f, d in zip(K.AML_FEATURES, K.PRIOR_DEFAULTS["aml"])) + " AS covered FROM av)"))
def feature_coverage(v):
    return vector.feature_coverage(aml_vector_of(v), "aml").select("txn_id", "covered", "coverage")


PROFILE_NOW = T0 + 25 * K.DAY


@query("aml_user_risk_profile", using("txn p_aml", f"""
  SELECT t.user_id, last_transaction_us, velocity_1h, velocity_24h, coalesce(c24, 0) / 100.0::DOUBLE AS total_volume_24h,
         (t.user_id % 23 = 0)::BIGINT AS sanctions_flag, cum AS cumulative_risk_score,
         CASE WHEN cum >= 0.85 THEN 'CRITICAL' WHEN cum >= 0.70 THEN 'HIGH' WHEN cum >= 0.50 THEN 'MEDIUM' ELSE 'LOW' END AS risk_category,
         CASE WHEN c7 > 0 AND c14 > 0 AND s7 * c14 - s14 * c7 > 50 * c7 * c14 THEN 'INCREASING'
              WHEN c7 > 0 AND c14 > 0 AND s7 * c14 - s14 * c7 < -50 * c7 * c14 THEN 'DECREASING' ELSE 'STABLE' END AS risk_trend
  FROM (SELECT user_id, max(us) AS last_transaction_us, count(*) FILTER (us >= now - 3600000000) AS velocity_1h,
               count(*) FILTER (us >= now - 86400000000) AS velocity_24h, sum(cents) FILTER (us >= now - 86400000000) AS c24
        FROM (SELECT *, {PROFILE_NOW} AS now FROM txn) WHERE us < now GROUP BY user_id) t
  JOIN (SELECT *, coalesce(s30 / c30::DOUBLE / 1000.0::DOUBLE, 0) AS cum
        FROM (SELECT user_id, sum(m) FILTER (age <= 30 * 86400000000) AS s30, count(*) FILTER (age <= 30 * 86400000000) AS c30,
                     sum(m) FILTER (age <= 7 * 86400000000) AS s7, count(*) FILTER (age <= 7 * 86400000000) AS c7,
                     sum(m) FILTER (age > 7 * 86400000000 AND age <= 14 * 86400000000) AS s14, count(*) FILTER (age > 7 * 86400000000 AND age <= 14 * 86400000000) AS c14
              FROM (SELECT user_id, round(score * 1000)::BIGINT AS m, {PROFILE_NOW} - created_us AS age FROM p_aml WHERE created_us < {PROFILE_NOW})
              GROUP BY user_id)) p ON p.user_id = t.user_id"""))
def aml_user_risk_profile(v):
    flagged = v.txn.select("user_id").filter("user_id % 23 = 0")
    return profiles.aml_user_risk_profile(v.predictions("aml"), v.txn, flagged, PROFILE_NOW)


@query("mcc_risk", using("merchant_accounts mcc_table", """
  SELECT merchant_id, coalesce(mcc_risk_score, 0)::DOUBLE AS mcc_risk_score FROM merchant_accounts LEFT JOIN mcc_table USING (mcc)"""))
def mcc_risk(v):
    return profiles.mcc_risk(v.merchant_accounts, v.mcc_table).select("merchant_id", "mcc_risk_score")
