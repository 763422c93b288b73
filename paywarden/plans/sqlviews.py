"""The views of ``sources.views`` in SQL, for the checking side."""

HOUR = "3600000000"

VIEWS = {
    "txn": ([], """
      SELECT event_id AS txn_id, user_id, epoch_us(ts) AS us, round(value * 2500.0::DOUBLE, 2) AS amount,
             CAST(round(round(value * 2500.0::DOUBLE, 2) * 100.0::DOUBLE) AS BIGINT) AS cents, upper(event_type) AS type,
             k, (event_id * 7 + user_id) % 50 AS merchant_id, 'dev-' || (k % 30)::VARCHAR AS device,
             'ip-' || k::VARCHAR AS ip,
             list_extract(['KE','UG','TZ','NG','GH','ZA','IR','KP','SY','US','GB','VE'], ((user_id + k) % 12 + 1)) AS country,
             list_extract(['KES','NGN','UGX','USD','IRR','EUR'], (k % 6 + 1)) AS currency,
             (user_id % 180) - 90 + k / 100.0::DOUBLE AS lat, ((k * 3) % 360 - 180)::DOUBLE AS lng
      FROM (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k FROM events)"""),
    "dense": (["txn"], """
      SELECT * REPLACE (1704067200000000 + (us - 1704067200000000) // 24 AS us) FROM txn"""),
    "payments": ([], """
      SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS part, o_custkey AS user_id, l_suppkey AS merchant_id,
             epoch_us(o_orderdate) AS us, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
             l_returnflag = 'R' AS refund, l_returnflag = 'A' AND l_linestatus = 'F' AS chargeback
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""),
    "merchants": ([], """
      SELECT s_suppkey AS merchant_id, s_name AS name, n_name AS country FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
    "users": ([], """
      SELECT c_custkey AS user_id, c_name AS name, n_name AS country FROM customer JOIN nation ON c_nationkey = n_nationkey"""),
    "label_events": (["p_fraud"], """
      SELECT prediction_id * 2 + wave AS event_id,
             CASE WHEN prediction_id % 11 = 0 THEN -prediction_id ELSE prediction_id END AS prediction_id,
             CAST((prediction_id // 3 + wave) % 2 AS BIGINT) AS label,
             created_us + (prediction_id % 50 + 1 + wave * 60) * 3600000000 AS us,
             'analyst-' || (prediction_id % 7)::VARCHAR AS labeled_by,
             CASE WHEN prediction_id % 2 = 0 THEN 'MANUAL_REVIEW' ELSE 'CHARGEBACK' END AS source
      FROM p_fraud, (SELECT unnest([0, 1]) AS wave)
      WHERE prediction_id % 3 <> 1 AND (wave = 0 OR prediction_id % 5 = 0)"""),
    "cases": (["p_aml"], """
      SELECT prediction_id + 1000000000 AS case_id, transaction_id AS entity_id,
             CASE WHEN prediction_id % 5 <> 0 THEN prediction_id END AS prediction_id, user_id,
             list_extract(['OPEN','ASSIGNED','INVESTIGATING','ESCALATED','CLOSED_CONFIRMED','CLOSED_FALSE_POSITIVE'],
                          prediction_id % 6 + 1) AS status,
             level AS priority, 'HIGH_RISK_SCORE' AS trigger_reason, created_us, prediction_id % 9 = 0 AS propagated,
             CASE WHEN prediction_id % 4 = 0 THEN 'first note' END AS notes,
             CASE WHEN prediction_id % 3 = 0 THEN 'team-a' END AS assignee
      FROM p_aml WHERE score >= 0.70::DOUBLE"""),
    "transfers": (["txn"], """
      SELECT * FROM (SELECT txn_id, user_id AS sender, (user_id * 3 + k) % 101 + 1 AS receiver, us, cents FROM txn)
      WHERE sender <> receiver"""),
    "sanctions": (["merchants"], """
      SELECT ordinal, name, [upper(name), array_to_string(list_reverse(string_split(replace(name, '#', ' '), ' ')), ' ')] AS aliases,
             country, 'LIST-A' AS source
      FROM (SELECT n_nationkey::BIGINT AS ordinal, n_name AS name, n_name AS country FROM nation
            UNION ALL SELECT merchant_id + 1000, name, country FROM merchants WHERE merchant_id % 10 = 0)"""),
    "parties": (["users", "merchants"], """
      SELECT user_id AS party_id, name, country FROM users
      UNION ALL
      SELECT merchant_id + 10000000,
             CASE WHEN merchant_id % 3 = 0 THEN lower(name)
                  WHEN merchant_id % 3 = 1 THEN array_to_string(list_reverse(string_split(replace(name, '#', ' '), ' ')), ' ')
                  ELSE name END,
             CASE WHEN merchant_id % 4 = 0 THEN '' ELSE country END
      FROM merchants"""),
    "merchant_edges": ([], """
      SELECT src, dst, line AS ord, (q % 10 + 1)::DOUBLE AS weight
      FROM (SELECT src, dst, line, sum(q)::BIGINT AS q
            FROM (SELECT l_suppkey AS src, (l_suppkey * 7 + l_linenumber) % 100 + 1 AS dst, l_linenumber::BIGINT AS line,
                         trunc(l_quantity)::BIGINT AS q FROM lineitem)
            WHERE src <> dst GROUP BY ALL)"""),
    "eval_set": ([], """
      SELECT doc_id, toxic::INTEGER AS y, quality::INTEGER AS quality, ((n_chars * 7 + length(source)) % 1000) / 1000.0::DOUBLE AS score,
             lang, source
      FROM labels JOIN documents USING (doc_id)"""),
    "base_half": (["p_fraud"], "SELECT * FROM p_fraud WHERE created_us < 1705363200000000"),
    "cur_half": (["p_fraud"], "SELECT * FROM p_fraud WHERE created_us >= 1705363200000000"),
}

for _d, _f in (("fraud", 37), ("aml", 53), ("merchant", 71)):
    _entity = "merchant_id" if _d == "merchant" else "user_id"
    VIEWS[f"p_{_d}"] = (["txn"], f"""
      SELECT txn_id AS prediction_id, txn_id AS transaction_id, {_entity} AS entity_id, user_id, merchant_id, amount,
             us AS created_us, score,
             CASE WHEN score >= 0.9::DOUBLE THEN 'BLOCK' WHEN score >= 0.75::DOUBLE THEN 'REVIEW'
                  WHEN score >= 0.6::DOUBLE THEN 'MONITOR' ELSE 'APPROVE' END AS decision,
             CASE WHEN score >= 0.9::DOUBLE THEN 'CRITICAL' WHEN score >= 0.75::DOUBLE THEN 'HIGH'
                  WHEN score >= 0.6::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS level,
             CASE WHEN txn_id % 4 = 0 THEN (txn_id % 12 = 0)::INTEGER END AS label,
             CASE WHEN txn_id % 4 = 0 THEN us + (txn_id % 96) * {HOUR} END AS labeled_us
      FROM (SELECT *, ((txn_id * {_f}) % 1000) / 1000.0::DOUBLE AS score FROM txn)""")

VIEWS["p_all"] = (["p_fraud", "p_aml", "p_merchant"], """
      SELECT *, 'fraud' AS domain FROM p_fraud UNION ALL SELECT *, 'aml' FROM p_aml
      UNION ALL SELECT *, 'merchant' FROM p_merchant""")


def using(names: str, body: str, recursive: bool = False, **extra: str) -> str:
    """A statement with the named views, then ``extra`` ones, in front of ``body``."""
    order: list[str] = []

    def add(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            add(dep)
        order.append(n)

    for n in names.split():
        add(n)
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in order] + [f"{n} AS ({s})" for n, s in extra.items()]
    if not parts:
        return body
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + body


VIEWS["auth_failures"] = (["txn"], "SELECT user_id, us FROM txn WHERE type = 'ERROR'")
VIEWS["accounts"] = ([], """
      SELECT o_custkey AS user_id, epoch_us(min(o_orderdate)) + 10400 * 86400000000 AS created_us,
             (o_custkey % 10) / 10.0::DOUBLE AS kyc FROM orders GROUP BY o_custkey""")
VIEWS["merchant_accounts"] = (["txn"], """
      SELECT merchant_id, min(us) - ((merchant_id * 13) % 200) * 86400000000 AS created_us,
             'mcc-' || (merchant_id % 8)::VARCHAR AS mcc FROM txn GROUP BY merchant_id""")
VIEWS["mcc_table"] = (["merchant_accounts"], """
      SELECT DISTINCT mcc, substr(mcc, 5, 2)::DOUBLE / 8.0::DOUBLE AS mcc_risk_score FROM merchant_accounts
      WHERE mcc NOT IN ('mcc-3', 'mcc-7')""")
VIEWS["ip_geo"] = (["txn"], """
      SELECT DISTINCT ip, list_extract(['KE','UG','TZ','NG','GH','ZA','IR','KP','SY','US','GB','VE'], (k * 5) % 12 + 1) AS ip_country
      FROM txn WHERE k % 5 <> 4""")
VIEWS["customer_risk"] = (["p_aml"], """
      SELECT user_id, risk_milli, CASE WHEN risk_milli >= 560 THEN 'CRITICAL' WHEN risk_milli >= 520 THEN 'HIGH'
             WHEN risk_milli >= 480 THEN 'MEDIUM' ELSE 'LOW' END AS level
      FROM (SELECT user_id, (sum(round(score * 1000)::BIGINT) // count(*))::BIGINT AS risk_milli FROM p_aml GROUP BY user_id)""")
VIEWS["user_graph"] = (["txn"], """
      SELECT DISTINCT user_id, (user_id % 10) / 10.0::DOUBLE AS network_risk_score, (user_id % 17 = 0)::INTEGER AS circular_transfer_flag,
             user_id % 9 AS shared_device_cluster_size FROM txn""")


def session_counts(source: str, key: str) -> str:
    """Counters that expire after a pause of an hour / a day, before each row."""
    return f"""
      SELECT * EXCLUDE (b1, b24, g1, g24),
             count(*) OVER (PARTITION BY {key}, g1 ORDER BY us, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS count_1h,
             coalesce(sum(cents) OVER (PARTITION BY {key}, g1 ORDER BY us, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sum_1h,
             count(*) OVER (PARTITION BY {key}, g24 ORDER BY us, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS count_24h,
             coalesce(sum(cents) OVER (PARTITION BY {key}, g24 ORDER BY us, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sum_24h
      FROM (SELECT *, sum(b1) OVER (PARTITION BY {key} ORDER BY us, txn_id) AS g1, sum(b24) OVER (PARTITION BY {key} ORDER BY us, txn_id) AS g24
            FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY {key} ORDER BY us, txn_id) >= 3600000000 THEN 1 ELSE 0 END AS b1,
                         CASE WHEN us - lag(us) OVER (PARTITION BY {key} ORDER BY us, txn_id) >= 86400000000 THEN 1 ELSE 0 END AS b24
                  FROM {source}))"""


def over(width: str, key: str = "user_id", time: str = "us") -> str:
    """Frame of the trailing window without the current instant."""
    micros = {"1h": 3600000000, "24h": 86400000000, "7d": 604800000000, "30d": 2592000000000}[width]
    return f"OVER (PARTITION BY {key} ORDER BY {time} RANGE BETWEEN {micros} PRECEDING AND 1 PRECEDING)"


HIGH_RISK_SQL = "('IR','KP','MM','SY','YE','AF','PK','NG','AL','BB','BF','CM','CD','GH','HT','JM','JO','ML','MZ','PA','PH','SN','SS','TZ','TR','UG','VN','ZA')"
TOD_SQL = "((us // 3600000000) % 24) / 24.0::DOUBLE"
CCY_SQL = """CASE WHEN upper(currency) IN ('IRR','KPW','SYP','VEF','ZWD','SDG','MMK','CUP') THEN 0.9::DOUBLE
             WHEN upper(currency) IN ('NGN','GHS','TZS','UGX','ETB') THEN 0.4::DOUBLE ELSE 0.1::DOUBLE END"""

VIEWS["sess"] = (["txn"], session_counts("txn", "user_id"))
VIEWS["dsess"] = (["dense"], session_counts("dense", "user_id"))
VIEWS["structured"] = (["dsess"], """
      SELECT *, max(CASE WHEN structuring_score_24h > 0.5::DOUBLE THEN 1 ELSE 0 END)
                OVER (PARTITION BY user_id ORDER BY us, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hist
      FROM (SELECT *, CASE WHEN count_24h >= 5 AND cents < 100000000 AND sum_24h + cents > 100000000
                       THEN least(1.0::DOUBLE, count_24h / 10.0::DOUBLE) ELSE 0.0::DOUBLE END AS structuring_score_24h,
                   CASE WHEN sum_24h > 0 AND cents * 2 > sum_24h THEN 1 ELSE 0 END AS rapid_drain_flag
            FROM dsess)""")
VIEWS["devices"] = (["txn", "p_fraud"], """
      SELECT device, frauds AS device_fraud_count, users AS distinct_user_count, last_seen_us,
             round(least(1.0::DOUBLE, frauds / 5.0::DOUBLE) * 0.6::DOUBLE + least(1.0::DOUBLE, (users - 1) / 10.0::DOUBLE) * 0.4::DOUBLE, 4) AS device_risk_score
      FROM (SELECT device, count(*) FILTER (label = 1) AS frauds, count(DISTINCT t.user_id) AS users, max(us) AS last_seen_us
            FROM txn t LEFT JOIN p_fraud p ON p.prediction_id = t.txn_id GROUP BY device)""")
VIEWS["geo"] = (["dense"], """
      SELECT txn_id, CASE WHEN pus IS NULL OR us - pus >= 86400000000 THEN 0.0::DOUBLE
             ELSE round(6371.0::DOUBLE * 2 * atan2(sqrt(a), sqrt(1 - a)), 4) END AS geo_distance_from_last_tx
      FROM (SELECT *, least(1.0::DOUBLE, greatest(0.0::DOUBLE, pow(sin(radians(lat - plat) / 2), 2) + cos(radians(plat)) * cos(radians(lat)) * pow(sin(radians(lng - plng) / 2), 2))) AS a
            FROM (SELECT *, lag(us) OVER w AS pus, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM dense
                  WINDOW w AS (PARTITION BY user_id ORDER BY us, txn_id)))""")
VIEWS["confirmed"] = (["dense"], "SELECT user_id, us + (txn_id % 96) * 150000000 AS us FROM dense WHERE txn_id % 12 = 0")
VIEWS["fv"] = (["dense", "geo", "devices", "accounts", "confirmed"], f"""
      SELECT t.txn_id, t.user_id, t.us,
             CASE WHEN n7 > 0 THEN s7::DOUBLE / n7::DOUBLE / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS avg_transaction_amount_7d,
             n1::DOUBLE AS transaction_velocity_1h, n24::DOUBLE AS transaction_velocity_24h,
             fails::DOUBLE AS failed_login_attempts_24h,
             coalesce(((t.us - a.created_us) - ((t.us - a.created_us) % 86400000000 + 86400000000) % 86400000000) / 86400000000, 365.0)::DOUBLE AS account_age_days,
             coalesce(t.us > f.first_us, false)::INTEGER::DOUBLE AS historical_fraud_flag,
             coalesce(d.device_risk_score, 0.1)::DOUBLE AS device_risk_score, coalesce(d.device_fraud_count, 0)::DOUBLE AS device_fraud_count,
             coalesce(d.distinct_user_count, 1)::DOUBLE AS distinct_user_count, t.amount,
             g.geo_distance_from_last_tx, {TOD_SQL} AS time_of_day, {CCY_SQL} AS currency_risk,
             t.country, t.device, t.ip, t.cents, t.merchant_id, t.currency
      FROM (SELECT *, count(*) {over('7d')} AS n7, sum(cents) {over('7d')} AS s7, count(*) {over('1h')} AS n1, count(*) {over('24h')} AS n24,
                   count(*) FILTER (type = 'ERROR') {over('24h')} AS fails FROM dense) t
      LEFT JOIN geo g USING (txn_id) LEFT JOIN devices d USING (device) LEFT JOIN accounts a ON a.user_id = t.user_id
      LEFT JOIN (SELECT user_id, min(us) AS first_us FROM confirmed GROUP BY user_id) f ON f.user_id = t.user_id""")
VIEWS["av"] = (["structured", "accounts", "ip_geo", "user_graph"], f"""
      SELECT t.txn_id, t.user_id, t.us, t.amount, count_1h::DOUBLE AS velocity_1h, count_24h::DOUBLE AS velocity_24h,
             sum_24h / 100.0::DOUBLE AS total_volume_24h,
             CASE WHEN n30 > 0 THEN s30::DOUBLE / n30::DOUBLE / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS avg_amount_30d,
             CASE WHEN n30 > 1 THEN round(sqrt(greatest((q30::DOUBLE - s30::DOUBLE * s30::DOUBLE / n30::DOUBLE) / (n30::DOUBLE - 1.0), 0.0)) / 100.0::DOUBLE, 4) ELSE 0.0::DOUBLE END AS std_amount_30d,
             {TOD_SQL} AS time_of_day,
             CASE WHEN upper(t.country) IN {HIGH_RISK_SQL} THEN 1.0 ELSE 0.0 END::DOUBLE AS is_cross_border,
             coalesce(((t.us - a.created_us) - ((t.us - a.created_us) % 86400000000 + 86400000000) % 86400000000) / 86400000000, 365.0)::DOUBLE AS account_age_days,
             dev30::DOUBLE AS device_count_30d, ip30::DOUBLE AS ip_count_30d, newdev::DOUBLE AS new_device_flag,
             coalesce(a.kyc, 1.0)::DOUBLE AS kyc_completeness_score, coalesce(g.network_risk_score, 0)::DOUBLE AS network_risk_score,
             coalesce(g.circular_transfer_flag, 0)::DOUBLE AS circular_transfer_flag, coalesce(g.shared_device_cluster_size, 0)::DOUBLE AS shared_device_cluster_size,
             (CASE WHEN upper(t.country) IN {HIGH_RISK_SQL} THEN 1 ELSE 0 END)::DOUBLE AS high_risk_country_flag,
             (CASE WHEN upper(t.country) IN ('IR','KP','SY','CU','VE') THEN 1.0 WHEN upper(t.country) IN {HIGH_RISK_SQL} THEN 0.5 ELSE 0.0 END)::DOUBLE AS sanctions_proximity_score,
             coalesce(upper(i.ip_country) <> upper(t.country), false)::INTEGER::DOUBLE AS ip_country_mismatch,
             coalesce(hist, 0)::DOUBLE AS historical_structuring_flag, structuring_score_24h, rapid_drain_flag::DOUBLE AS rapid_drain_flag,
             t.country, t.device, t.ip, t.merchant_id
      FROM (SELECT *, count(*) {over('30d')} AS n30,
                   sum(cents) {over('30d')} AS s30, sum(cents::HUGEINT * cents::HUGEINT) {over('30d')} AS q30,
                   count(DISTINCT device) {over('30d')} AS dev30, count(DISTINCT ip) {over('30d')} AS ip30,
                   CASE WHEN us - lag(us) OVER (PARTITION BY user_id, device ORDER BY us, txn_id) < 2592000000000 THEN 0 ELSE 1 END AS newdev
            FROM structured) t
      LEFT JOIN accounts a ON a.user_id = t.user_id LEFT JOIN ip_geo i USING (ip) LEFT JOIN user_graph g ON g.user_id = t.user_id""")
VIEWS["msess"] = (["dense"], session_counts("dense", "merchant_id"))
VIEWS["mspike"] = (["dense"], """
      SELECT merchant_id, hour_us, s, c
      FROM (SELECT *, sum(n) OVER w AS s, count(*) OVER w AS c
            FROM (SELECT merchant_id, us - us % 3600000000 AS hour_us, count(*) AS n FROM dense GROUP BY ALL)
            WINDOW w AS (PARTITION BY merchant_id ORDER BY hour_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
VIEWS["mratio"] = (["txn", "p_fraud", "customer_risk"], f"""
      SELECT merchant_id, f / n::DOUBLE AS fraud_transaction_rate, h / u::DOUBLE AS high_risk_customer_ratio, b / n::DOUBLE AS cross_border_ratio,
             r / rn::DOUBLE / 1000.0::DOUBLE AS avg_customer_risk_score
      FROM (SELECT t.merchant_id, count(*) AS n, count(*) FILTER (p.label = 1) AS f, count(*) FILTER (upper(t.country) IN {HIGH_RISK_SQL}) AS b
            FROM txn t LEFT JOIN p_fraud p ON p.prediction_id = t.txn_id GROUP BY t.merchant_id)
      JOIN (SELECT merchant_id, count(*) AS u, count(*) FILTER (level IN ('HIGH', 'CRITICAL')) AS h, sum(risk_milli) AS r, count(risk_milli) AS rn
            FROM (SELECT DISTINCT merchant_id, user_id FROM txn) LEFT JOIN customer_risk USING (user_id) GROUP BY merchant_id) USING (merchant_id)""")
VIEWS["magg"] = (["payments"], """
      SELECT merchant_id, CASE WHEN n30 > 0 THEN s30::DOUBLE / n30::DOUBLE / 100.0::DOUBLE ELSE 0.0::DOUBLE END AS avg_transaction_amount_30d,
             CASE WHEN n30 > 1 THEN round(sqrt(greatest((q30::DOUBLE - s30::DOUBLE * s30::DOUBLE / n30::DOUBLE) / (n30::DOUBLE - 1.0), 0.0)) / 100.0::DOUBLE, 4) ELSE 0.0::DOUBLE END AS std_transaction_amount_30d,
             total_transactions, total_volume, unique_customers_30d,
             CASE WHEN n90 > 0 THEN c90 / n90::DOUBLE ELSE 0.0::DOUBLE END AS chargeback_rate_90d,
             CASE WHEN n90 > 0 THEN r90 / n90::DOUBLE ELSE 0.0::DOUBLE END AS refund_rate_90d
      FROM (SELECT merchant_id, count(*) AS total_transactions, sum(cents)::DOUBLE / 100.0::DOUBLE AS total_volume,
                   count(*) FILTER (d30) AS n30, coalesce(sum(cents) FILTER (d30), 0) AS s30, coalesce(sum(cents::HUGEINT * cents::HUGEINT) FILTER (d30), 0) AS q30,
                   count(DISTINCT user_id) FILTER (d30) AS unique_customers_30d, count(*) FILTER (d90) AS n90,
                   count(*) FILTER (d90 AND chargeback) AS c90, count(*) FILTER (d90 AND refund) AS r90
            FROM (SELECT *, us >= 996624000000000 - 30 * 86400000000 AS d30, us >= 996624000000000 - 90 * 86400000000 AS d90 FROM payments WHERE us < 996624000000000)
            GROUP BY merchant_id)""")
VIEWS["mv"] = (["msess", "mspike", "mratio", "magg", "merchant_accounts", "mcc_table"], f"""
      SELECT t.txn_id, t.merchant_id, t.us, count_1h::DOUBLE AS transaction_count_1h, count_24h::DOUBLE AS transaction_count_24h,
             sum_24h / 100.0::DOUBLE AS transaction_volume_24h, u24::DOUBLE AS unique_customers_24h,
             coalesce(avg_transaction_amount_30d, 0)::DOUBLE AS avg_transaction_amount_30d, coalesce(std_transaction_amount_30d, 0)::DOUBLE AS std_transaction_amount_30d,
             coalesce(chargeback_rate_90d, 0)::DOUBLE AS chargeback_rate_90d, coalesce(refund_rate_90d, 0)::DOUBLE AS refund_rate_90d,
             coalesce(((t.us - a.created_us) - ((t.us - a.created_us) % 86400000000 + 86400000000) % 86400000000) / 86400000000, 0.0)::DOUBLE AS account_age_days,
             coalesce(fraud_transaction_rate, 0)::DOUBLE AS fraud_transaction_rate, coalesce(high_risk_customer_ratio, 0)::DOUBLE AS high_risk_customer_ratio,
             coalesce(cross_border_ratio, 0)::DOUBLE AS cross_border_ratio, coalesce(count_1h * s.c > 3 * s.s, false)::INTEGER::DOUBLE AS velocity_spike_flag,
             coalesce(mcc_risk_score, 0)::DOUBLE AS mcc_risk_score, coalesce(avg_customer_risk_score, 0)::DOUBLE AS avg_customer_risk_score
      FROM (SELECT *, count(DISTINCT user_id) {over('24h', 'merchant_id')} AS u24 FROM msess) t
      LEFT JOIN mspike s ON s.merchant_id = t.merchant_id AND s.hour_us = t.us - t.us % 3600000000
      LEFT JOIN mratio r ON r.merchant_id = t.merchant_id LEFT JOIN magg g ON g.merchant_id = t.merchant_id
      LEFT JOIN merchant_accounts a ON a.merchant_id = t.merchant_id LEFT JOIN mcc_table c ON c.mcc = a.mcc""")


def bin_sql(v: str, lo: str, hi: str, bins: str) -> str:
    """Index of the equal-width bin with edges lo + i * step, as an expression over a value already inside [lo, hi]."""
    step = f"(({hi} - {lo}) / ({bins})::DOUBLE)"
    i = f"least(floor(({v} - {lo}) * {bins} / ({hi} - {lo})), {bins} - 1)"
    return f"(CASE WHEN {v} < {lo} + {i} * {step} THEN {i} - 1 WHEN {i} < {bins} - 1 AND {v} >= {lo} + ({i} + 1) * {step} THEN {i} + 1 ELSE {i} END)::BIGINT"
