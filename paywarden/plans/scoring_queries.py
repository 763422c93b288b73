"""Screening, scoring and decision queries over the given tables."""

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import decisions as D
from ..operators import profiles, scoring, screening, vector, velocity
from ..sources.views import _cycle
from .feature_queries import aml_vector_of, damaged, fraud_vector_of, merchant_vector_of
from .registry import query
from .sqlviews import VIEWS, using

MATURITIES = ["COLD", "WARMING", "WARM", "HOT"]
MATURITY_SQL = "list_extract(['COLD','WARMING','WARM','HOT'], txn_id % 4 + 1)"


def maturity_col():
    return _cycle(MATURITIES, F.pmod("txn_id", F.lit(4)))


def _hit(n):
    return F.pmod("txn_id", F.lit(n)) == 0


# ---- rule scores ---------------------------------------------------------------
def _b(c, *steps):
    return "CASE " + " ".join(f"WHEN {c} > {a} THEN {p}" for a, p in steps) + " ELSE 0 END"


FRAUD_TERMS_SQL = {
    "amount": "CASE WHEN r > 5 THEN 0.15 WHEN r > 3 THEN 0.08 WHEN r > 2 THEN 0.04 ELSE 0 END",
    "transaction_velocity_1h": "CASE WHEN transaction_velocity_1h > 10 THEN 0.15 WHEN transaction_velocity_1h > 5 THEN 0.08 ELSE 0 END",
    "transaction_velocity_24h": "CASE WHEN transaction_velocity_24h > 30 THEN 0.08 WHEN transaction_velocity_24h > 15 THEN 0.04 ELSE 0 END",
    "failed_login_attempts_24h": "CASE WHEN failed_login_attempts_24h > 5 THEN 0.10 WHEN failed_login_attempts_24h > 2 THEN 0.05 ELSE 0 END",
    "account_age_days": "CASE WHEN account_age_days < 7 AND amount > 500 THEN 0.15 WHEN account_age_days < 30 AND amount > 1000 THEN 0.08 ELSE 0 END",
    "historical_fraud_flag": "CASE WHEN historical_fraud_flag > 0 THEN 0.20 ELSE 0 END",
    "device_risk_score": "device_risk_score * 0.12::DOUBLE",
    "device_fraud_count": "least(device_fraud_count / 5.0::DOUBLE, 1.0::DOUBLE) * 0.10::DOUBLE",
    "distinct_user_count": "CASE WHEN distinct_user_count > 3 THEN 0.05 ELSE 0 END",
    "geo_distance_from_last_tx": "CASE WHEN geo_distance_from_last_tx > 2000 THEN 0.08 WHEN geo_distance_from_last_tx > 500 THEN 0.04 ELSE 0 END",
    "time_of_day": "CASE WHEN time_of_day < 0.21::DOUBLE OR time_of_day > 0.92::DOUBLE THEN 0.04 ELSE 0 END",
    "currency_risk": "currency_risk * 0.08::DOUBLE",
}
FRAUD_HEUR = "round(least(1.0, greatest(0.0, 0.10::DOUBLE + " + " + ".join(FRAUD_TERMS_SQL.values()) + ")), 4)"
FRAUD_RATIO = "amount / CASE WHEN avg_transaction_amount_7d > 0 THEN avg_transaction_amount_7d ELSE 100.0 END AS r"
AML_HEUR = """round(least(1.0, greatest(0.0, 0.08::DOUBLE
  + CASE WHEN r > 10 THEN 0.10 WHEN r > 5 THEN 0.05 ELSE 0 END
  + CASE WHEN velocity_1h > 15 THEN 0.12 WHEN velocity_1h > 8 THEN 0.06 ELSE 0 END
  + CASE WHEN total_volume_24h > 50000 THEN 0.10 WHEN total_volume_24h > 20000 THEN 0.05 ELSE 0 END
  + CASE WHEN is_cross_border > 0 THEN 0.08 ELSE 0 END
  + CASE WHEN account_age_days < 14 AND total_volume_24h > 5000 THEN 0.10 WHEN account_age_days < 30 THEN 0.03 ELSE 0 END
  + CASE WHEN device_count_30d > 5 THEN 0.05 ELSE 0 END + CASE WHEN ip_count_30d > 10 THEN 0.05 ELSE 0 END
  + CASE WHEN new_device_flag > 0 THEN 0.04 ELSE 0 END
  + CASE WHEN kyc_completeness_score < 0.3::DOUBLE THEN 0.10 WHEN kyc_completeness_score < 0.6::DOUBLE THEN 0.05 ELSE 0 END
  + network_risk_score * 0.10::DOUBLE + CASE WHEN circular_transfer_flag > 0 THEN 0.15 ELSE 0 END
  + CASE WHEN shared_device_cluster_size > 5 THEN 0.06 ELSE 0 END + CASE WHEN high_risk_country_flag > 0 THEN 0.15 ELSE 0 END
  + CASE WHEN sanctions_proximity_score > 0.7::DOUBLE THEN 0.20 WHEN sanctions_proximity_score > 0.3::DOUBLE THEN 0.10 ELSE 0 END
  + CASE WHEN ip_country_mismatch > 0 THEN 0.06 ELSE 0 END + CASE WHEN historical_structuring_flag > 0 THEN 0.12 ELSE 0 END
  + CASE WHEN structuring_score_24h > 0.7::DOUBLE THEN 0.15 WHEN structuring_score_24h > 0.4::DOUBLE THEN 0.08 ELSE 0 END
  + CASE WHEN rapid_drain_flag > 0 THEN 0.12 ELSE 0 END)), 4)"""
AML_RATIO = "amount / CASE WHEN avg_amount_30d > 0 THEN avg_amount_30d ELSE 200.0 END AS r"
MERCHANT_HEUR = """round(least(1.0, greatest(0.0, 0.10::DOUBLE
  + CASE WHEN chargeback_rate_90d > 0.018::DOUBLE THEN 0.25 WHEN chargeback_rate_90d > 0.009::DOUBLE THEN 0.15 WHEN chargeback_rate_90d > 0.005::DOUBLE THEN 0.08 ELSE 0 END
  + CASE WHEN refund_rate_90d > 0.15::DOUBLE THEN 0.12 WHEN refund_rate_90d > 0.08::DOUBLE THEN 0.06 ELSE 0 END
  + CASE WHEN fraud_transaction_rate > 0.05::DOUBLE THEN 0.20 WHEN fraud_transaction_rate > 0.02::DOUBLE THEN 0.12 WHEN fraud_transaction_rate > 0.01::DOUBLE THEN 0.06 ELSE 0 END
  + CASE WHEN account_age_days < 30 THEN 0.10 WHEN account_age_days < 90 THEN 0.05 ELSE 0 END
  + CASE WHEN velocity_spike_flag > 0 THEN 0.10 ELSE 0 END + CASE WHEN transaction_count_1h > 100 THEN 0.06 ELSE 0 END
  + CASE WHEN transaction_count_24h > 500 THEN 0.04 ELSE 0 END
  + CASE WHEN high_risk_customer_ratio > 0.25::DOUBLE THEN 0.10 WHEN high_risk_customer_ratio > 0.15::DOUBLE THEN 0.05 ELSE 0 END
  + CASE WHEN cross_border_ratio > 0.5::DOUBLE THEN 0.06 WHEN cross_border_ratio > 0.3::DOUBLE THEN 0.03 ELSE 0 END
  + mcc_risk_score * 0.08::DOUBLE + avg_customer_risk_score * 0.08::DOUBLE + CASE WHEN r > 3 THEN 0.05 ELSE 0 END)), 4)"""
MERCHANT_RATIO = "std_transaction_amount_30d / CASE WHEN avg_transaction_amount_30d > 0 THEN avg_transaction_amount_30d ELSE 100.0 END AS r"


@query("fraud_heuristic", using("fv", f"SELECT txn_id, {FRAUD_HEUR} AS score FROM (SELECT *, {FRAUD_RATIO} FROM fv)"))
def fraud_heuristic(v):
    return fraud_vector_of(v).select("txn_id", scoring.heuristic("fraud").alias("score"))


@query("aml_heuristic", using("av", f"SELECT txn_id, {AML_HEUR} AS score FROM (SELECT *, {AML_RATIO} FROM av)"))
def aml_heuristic(v):
    return aml_vector_of(v).select("txn_id", scoring.heuristic("aml").alias("score"))


@query("merchant_heuristic", using("mv", f"SELECT txn_id, {MERCHANT_HEUR} AS score FROM (SELECT *, {MERCHANT_RATIO} FROM mv)"))
def merchant_heuristic(v):
    return merchant_vector_of(v).select("txn_id", scoring.heuristic("merchant").alias("score"))


FRAUD_COLD = """least(1.0, greatest(0.0, 0.3::DOUBLE + CASE WHEN velocity_anomaly = 1 THEN 0.3 ELSE 0 END + CASE WHEN new_account_high_amount = 1 THEN 0.2 ELSE 0 END
  + CASE WHEN amount > CASE WHEN avg_transaction_amount_7d > 0 THEN avg_transaction_amount_7d ELSE 50.0 END * 5 THEN 0.2 ELSE 0 END
  + CASE WHEN transaction_velocity_1h > 10 THEN 0.15 ELSE 0 END + CASE WHEN historical_fraud_flag > 0 THEN 0.2 ELSE 0 END
  + CASE WHEN device_risk_score > 0.5::DOUBLE THEN 0.1 ELSE 0 END))"""
AML_COLD = """least(1.0, greatest(0.0, 0.2::DOUBLE + CASE WHEN velocity_1h > 10 THEN 0.2 ELSE 0 END + CASE WHEN high_risk_country_flag > 0 THEN 0.25 ELSE 0 END
  + CASE WHEN structuring_score_24h > 0.5::DOUBLE THEN 0.2 ELSE 0 END + CASE WHEN rapid_drain_flag > 0 THEN 0.15 ELSE 0 END
  + CASE WHEN circular_transfer_flag > 0 THEN 0.15 ELSE 0 END + CASE WHEN sanctions_proximity_score > 0.3::DOUBLE THEN 0.2 ELSE 0 END))"""
MERCHANT_COLD = """least(1.0, greatest(0.0, 0.2::DOUBLE + CASE WHEN chargeback_rate_90d > 0.03::DOUBLE THEN 0.3 ELSE 0 END + CASE WHEN fraud_transaction_rate > 0.02::DOUBLE THEN 0.25 ELSE 0 END
  + CASE WHEN velocity_spike_flag > 0 THEN 0.15 ELSE 0 END + CASE WHEN high_risk_customer_ratio > 0.15::DOUBLE THEN 0.1 ELSE 0 END
  + CASE WHEN account_age_days < 30 THEN 0.1 ELSE 0 END + CASE WHEN mcc_risk_score > 0.5::DOUBLE THEN 0.1 ELSE 0 END))"""


@query("aml_cold_score", using("av", f"SELECT txn_id, {AML_COLD} AS score FROM av"))
def aml_cold_score(v):
    return aml_vector_of(v).select("txn_id", scoring.aml_cold().alias("score"))


@query("merchant_cold_score", using("mv", f"SELECT txn_id, {MERCHANT_COLD} AS score FROM mv"))
def merchant_cold_score(v):
    return merchant_vector_of(v).select("txn_id", scoring.merchant_cold().alias("score"))


# ---- overrides and screening ------------------------------------------------------
def blacklists(v):
    """Lists derived from the transactions: every 29th user, 13th device number, 31st ip number."""
    users = v.txn.select("user_id").distinct().filter("user_id % 29 = 0")
    devices = v.txn.select("device", "k").filter("k % 30 = 13").select("device").distinct()
    ips = v.txn.select("ip", "k").filter("k % 31 = 30").select("ip").distinct()
    return users, devices, ips


VIEWS["blacklisted"] = (["dsess"], """
      SELECT *, (user_id % 29 = 0)::BIGINT AS blacklisted_user, (k % 30 = 13)::BIGINT AS blacklisted_device, (k % 31 = 30)::BIGINT AS blacklisted_ip,
             (country IN ('IR','KP','SY','CU'))::BIGINT AS sanctioned_country, (count_1h > 20)::BIGINT AS velocity_anomaly, 0::BIGINT AS new_account_high_amount FROM dsess""")


@query("blacklist_flags", using("blacklisted", "SELECT txn_id, blacklisted_user, blacklisted_device, blacklisted_ip FROM blacklisted"))
def blacklist_flags(v):
    return screening.blacklist_flags(v.txn, *blacklists(v)).select("txn_id", "blacklisted_user", "blacklisted_device", "blacklisted_ip")


def flagged_txn(v):
    s = velocity.velocity_session(v.dense.select("txn_id", "user_id", "us", "cents", "device", "ip", "country"))
    return vector.override_flags(screening.blacklist_flags(s, *blacklists(v)))


FLAG_NAMES = ["blacklisted_user", "blacklisted_device", "blacklisted_ip", "sanctioned_country", "velocity_anomaly", "new_account_high_amount"]


@query("override_flags", using("blacklisted", f"SELECT txn_id, {', '.join(FLAG_NAMES)} FROM blacklisted"))
def override_flags(v):
    return flagged_txn(v).select("txn_id", *FLAG_NAMES)


def fraud_input(v):
    return fraud_vector_of(v, ["merchant_id", "country"]).join(flagged_txn(v).select("txn_id", *FLAG_NAMES), "txn_id", "left")


VIEWS["fin"] = (["fv", "blacklisted"], f"SELECT fv.*, {', '.join(FLAG_NAMES)} FROM fv JOIN (SELECT txn_id, {', '.join(FLAG_NAMES)} FROM blacklisted) USING (txn_id)")


@query("fraud_cold_score", using("fin", f"SELECT txn_id, {FRAUD_COLD} AS score FROM fin"))
def fraud_cold_score(v):
    f = fraud_input(v)
    return f.select("txn_id", scoring.fraud_cold(F.col("velocity_anomaly") == 1, F.col("new_account_high_amount") == 1).alias("score"))


def _screened(finding, more):
    of = lambda c: finding.format(c)
    return f"""SELECT party_id, (p.party_id % 37 = 0 OR {of('match_type')} IS NOT NULL)::BIGINT AS matched,
                CASE WHEN p.party_id % 37 = 0 THEN 'BLACKLIST' ELSE coalesce({of('match_type')}, 'NONE') END AS match_type,
                CASE WHEN p.party_id % 37 = 0 THEN p.name ELSE {of('entity')} END AS entity,
                CASE WHEN p.party_id % 37 = 0 THEN 1.0 ELSE coalesce({of('confidence')}, 0.0) END::DOUBLE AS confidence,
                CASE WHEN p.party_id % 37 = 0 THEN 'BLACKLIST' ELSE {of('source')} END AS source
                FROM parties p LEFT JOIN exact e ON e.lname = lower(p.name) {more} LEFT JOIN bycountry c ON c.ucountry = upper(p.country) AND p.country <> ''"""


SCREEN_SQL = {
    "spelled": """SELECT lower(s) AS lname, ordinal, pos > 1 AS alias, name, source
                  FROM (SELECT *, unnest(list_concat([name], aliases)) AS s, generate_subscripts(list_concat([name], aliases), 1) AS pos FROM sanctions)""",
    "exact": """SELECT DISTINCT ON (lname) lname, CASE WHEN alias THEN 'ALIAS' ELSE 'EXACT' END AS match_type, s.name AS entity, 1.0::DOUBLE AS confidence, source
                FROM spelled s WHERE lname IN (SELECT lower(name) FROM parties) ORDER BY lname, ordinal, alias""",
    "bycountry": """SELECT DISTINCT ON (upper(s.country)) upper(s.country) AS ucountry, 'COUNTRY' AS match_type, s.name AS entity, 0.7::DOUBLE AS confidence, source
                FROM sanctions s WHERE upper(country) IN (SELECT upper(country) FROM parties WHERE country <> '') ORDER BY upper(s.country), ordinal""",
    "pairs": """SELECT * FROM (SELECT DISTINCT lower(name) AS a, length(name) AS la FROM parties WHERE length(name) > 0), (SELECT DISTINCT lower(name) AS b, length(name) AS lb FROM sanctions WHERE length(name) > 0)
                WHERE 2 * least(la, lb) >= 0.85 * (la + lb)
                  AND 2 * list_sum([least(la - length(replace(a, c, '')), lb - length(replace(b, c, ''))) for c in list_distinct(string_split(a, ''))]) >= 0.85 * (la + lb)""",
    # matching blocks: the longest common one, first in a, then in b; the same on its left and on its right
    "boxes": """SELECT a, b, la + lb AS letters, 1::BIGINT AS a0, la AS a1, 1::BIGINT AS b0, lb AS b1, 0::BIGINT AS k FROM pairs
                UNION ALL
                SELECT a, b, letters, CASE s WHEN 1 THEN a0 WHEN 2 THEN m.k - m.i END, CASE s WHEN 1 THEN -m.i - 1 WHEN 2 THEN a1 END,
                       CASE s WHEN 1 THEN b0 WHEN 2 THEN m.k - m.j END, CASE s WHEN 1 THEN -m.j - 1 WHEN 2 THEN b1 END, CASE s WHEN 3 THEN m.k ELSE 0 END
                FROM (SELECT *, list_max(flatten([[{'k': coalesce(list_max([n for n in range(1, least(a1 - i, b1 - j) + 2) if substr(a, i, n) = substr(b, j, n)]), 0), 'i': -i, 'j': -j}
                                                   for j in range(b0, b1 + 1)] for i in range(a0, a1 + 1)])) AS m
                      FROM boxes WHERE a0 <= a1 AND b0 <= b1), (VALUES (1), (2), (3)) AS t(s) WHERE m.k > 0""",
    "fuzzy": """SELECT DISTINCT ON (a) a AS lname, 'FUZZY' AS match_type, s.name AS entity, round(ratio, 4) AS confidence, source
                FROM (SELECT a, b, 2.0::DOUBLE * sum(k) / letters AS ratio FROM boxes GROUP BY a, b, letters) JOIN sanctions s ON lower(s.name) = b WHERE ratio >= 0.85 ORDER BY a, ordinal""",
    "screened": _screened("coalesce(e.{0}, c.{0})", ""),
    "fully": _screened("coalesce(e.{0}, f.{0}, c.{0})", "LEFT JOIN fuzzy f ON f.lname = lower(p.name)"),
}


def _screen_sql(body):
    views = {k: v for k, v in SCREEN_SQL.items() if "fuzzy" in body or "fully" in body or k not in ("pairs", "boxes", "fuzzy", "fully")}
    return using("sanctions parties", body, recursive=True, **views)


@query("screen_exact_alias", _screen_sql("SELECT * FROM exact"))
def screen_exact_alias(v):
    return screening.exact_alias(v.parties, v.sanctions)


@query("screen_fuzzy", _screen_sql("SELECT * FROM fuzzy"))
def screen_fuzzy(v):
    """First list entry at least 0.85 similar per name."""
    return screening.fuzzy(v.parties, v.sanctions)


@query("screen_country", _screen_sql("SELECT * FROM bycountry"))
def screen_country(v):
    return screening.country(v.parties, v.sanctions)


def _blacklisted_parties(v):
    return v.parties.filter("party_id % 37 = 0").select("party_id")


@query("screen_without_fuzzy", _screen_sql("SELECT * FROM screened"))
def screen_without_fuzzy(v):
    return screening.screen(v.parties, v.sanctions, _blacklisted_parties(v), with_fuzzy=False)


@query("screen_full", _screen_sql("SELECT * FROM fully"))
def screen_full(v):
    return screening.screen(v.parties, v.sanctions, _blacklisted_parties(v))


@query("screening_flags", _screen_sql("""
  SELECT party_id, match_type, (match_type IN ('EXACT', 'ALIAS'))::BIGINT AS sanctions_match, (matched = 1 AND confidence >= 0.95)::BIGINT AS watchlist_hit FROM fully"""))
def screening_flags(v):
    s = screening.screen(v.parties, v.sanctions, _blacklisted_parties(v))
    return screening.screening_flags(s).select("party_id", "match_type", "sanctions_match", "watchlist_hit")


# ---- blend, confidence, decisions ---------------------------------------------------
VIEWS["dq"] = (["txn"], f"""
      SELECT txn_id, ((txn_id * 37) % 1000) / 1000.0::DOUBLE AS s, (txn_id % 11) / 10.0::DOUBLE AS conf, {MATURITY_SQL} AS maturity,
             ((txn_id * 53) % 100) / 100.0::DOUBLE AS odd, country, txn_id % 41 = 0 AS f1, txn_id % 43 = 0 AS f2, txn_id % 47 = 0 AS f3,
             txn_id % 53 = 0 AS f4, txn_id % 5 = 0 AS f5, txn_id % 7 = 0 AS f6, (txn_id % 113) / 1000.0::DOUBLE AS cb, (txn_id % 59) / 1000.0::DOUBLE AS fr FROM txn""")


def decision_input(v):
    i = F.col("txn_id")
    return v.txn.select(
        "txn_id", (F.pmod(i * 37, F.lit(1000)) / 1000.0).alias("s"), (F.pmod(i, F.lit(11)) / 10.0).alias("conf"), maturity_col().alias("maturity"),
        (F.pmod(i * 53, F.lit(100)) / 100.0).alias("odd"), "country",
        *[_hit(n).alias(f"f{j}") for j, n in enumerate((41, 43, 47, 53, 5, 7), 1)],
        (F.pmod(i, F.lit(113)) / 1000.0).alias("cb"), (F.pmod(i, F.lit(59)) / 1000.0).alias("fr"))


@query("blend_by_maturity", using("dq", """
  SELECT txn_id, CASE maturity WHEN 'COLD' THEN 0.25::DOUBLE WHEN 'WARMING' THEN 0.3::DOUBLE * s + 0.7::DOUBLE * o WHEN 'WARM' THEN 0.7::DOUBLE * s + 0.3::DOUBLE * o
                 ELSE CASE WHEN f5 THEN odd ELSE s END END AS score,
         round(CASE maturity WHEN 'COLD' THEN 0.1 WHEN 'WARMING' THEN 0.3 WHEN 'WARM' THEN pow(0.7::DOUBLE * q, 1.0::DOUBLE / 3.0::DOUBLE)
                 ELSE CASE WHEN f5 THEN 0.95 ELSE pow(q, 1.0::DOUBLE / 3.0::DOUBLE) END END, 6) AS confidence
  FROM (SELECT *, CASE WHEN f6 THEN 0.5::DOUBLE ELSE odd END AS o, CASE WHEN txn_id % 3 = 0 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS q FROM dq)"""))
def blend_by_maturity(v):
    d = decision_input(v)
    none = F.lit(None).cast("double")
    s, c = scoring.blend_by_maturity(F.col("s"), F.when(~F.col("f6"), F.col("odd")), F.when(F.col("f5"), F.col("odd")).otherwise(none),
                                     F.lit(0.25), F.col("maturity"), _hit(3))
    return d.select("txn_id", s.alias("score"), F.round(c, 6).alias("confidence"))


@query("model_confidence", using("dq", """
  SELECT txn_id, round(least(1.0, greatest(0.0, pow(s * conf * CASE WHEN f5 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END, 1.0::DOUBLE / 3.0::DOUBLE))), 6) AS confidence FROM dq"""))
def model_confidence(v):
    d = decision_input(v)
    return d.select("txn_id", F.round(scoring.model_confidence(F.col("s"), F.col("conf"), F.col("f5")), 6).alias("confidence"))


@query("aml_country_bump", using("dq", """
  SELECT txn_id, CASE WHEN country IN ('IR','KP','SY','AF','YE') THEN least(1.0::DOUBLE, s + 0.15::DOUBLE) ELSE s END AS score FROM dq"""))
def aml_country_bump(v):
    d = decision_input(v)
    return d.select("txn_id", scoring.aml_country_bump(F.col("s"), F.col("country")).alias("score"))


FRAUD_DECIDE_SQL = """
  SELECT {keep}, split_part(dl, '/', 1) AS decision, split_part(dl, '/', 2) AS level,
         CASE WHEN hard <> '' THEN hard WHEN v AND s < 0.75 THEN 'VELOCITY_ANOMALY' WHEN n AND s < 0.75 THEN 'NEW_ACCOUNT_HIGH_AMOUNT'
              ELSE concat_ws('|', CASE WHEN v THEN 'VELOCITY_ANOMALY' END, CASE WHEN n THEN 'NEW_ACCOUNT_HIGH_AMOUNT' END, CASE WHEN dl = 'MONITOR/LOW' THEN 'LOW_CONFIDENCE_MONITOR' END) END AS overrides
  FROM (SELECT *, CASE WHEN hard <> '' THEN 'BLOCK/CRITICAL' WHEN (v OR n) AND s < 0.75 THEN 'REVIEW/MEDIUM' WHEN s >= tb THEN 'BLOCK/CRITICAL'
               WHEN s >= tr THEN CASE WHEN s >= 0.80 THEN 'REVIEW/HIGH' ELSE 'REVIEW/MEDIUM' END
               WHEN conf < 0.5 AND maturity IN ('COLD', 'WARMING') AND s >= ta * 0.7::DOUBLE THEN 'MONITOR/LOW' ELSE 'APPROVE/LOW' END AS dl
        FROM (SELECT *, CASE WHEN plain THEN 0.60 ELSE 0.60::DOUBLE * (1 - st * 0.2::DOUBLE) END::DOUBLE AS ta,
                     CASE WHEN plain THEN 0.75 ELSE 0.75::DOUBLE * (1 - st * 0.15::DOUBLE) END::DOUBLE AS tr,
                     CASE WHEN plain THEN 0.90 ELSE 0.90::DOUBLE * (1 - st * 0.1::DOUBLE) END::DOUBLE AS tb
              FROM (SELECT *, conf >= 0.8::DOUBLE AND maturity = 'HOT' AS plain,
                           CASE WHEN maturity IN ('COLD', 'WARMING') THEN least((1.0::DOUBLE - conf * 0.5::DOUBLE) * 1.3::DOUBLE, 1.0) ELSE 1.0::DOUBLE - conf * 0.5::DOUBLE END AS st,
                           CASE WHEN h1 THEN 'SANCTIONED_COUNTRY' WHEN h2 THEN 'BLACKLISTED_DEVICE' WHEN h3 THEN 'BLACKLISTED_IP' WHEN h4 THEN 'BLACKLISTED_USER' ELSE '' END AS hard
                    FROM {source})))"""
AML_DECIDE_SQL = """
  SELECT {keep}, split_part(dl, '/', 1) AS decision, split_part(dl, '/', 2) AS level,
         CASE WHEN hard <> '' THEN hard WHEN g AND s < lift THEN 'STRUCTURING_DETECTED' WHEN p AND s < lift THEN 'VELOCITY_SPIKE'
              ELSE concat_ws('|', CASE WHEN g THEN 'STRUCTURING_DETECTED' END, CASE WHEN p THEN 'VELOCITY_SPIKE' END, CASE WHEN dl = 'MONITOR/LOW' THEN 'LOW_CONFIDENCE_MONITOR' END) END AS overrides
  FROM (SELECT *, CASE WHEN hard <> '' THEN 'BLOCK/CRITICAL' WHEN g AND s < lift THEN 'REVIEW/HIGH' WHEN p AND s < lift THEN 'REVIEW/MEDIUM'
               WHEN s >= 0.85::DOUBLE * fa THEN 'BLOCK/CRITICAL' WHEN s >= 0.70::DOUBLE * fa THEN 'REVIEW/HIGH' WHEN s >= 0.50::DOUBLE * fa THEN 'MONITOR/MEDIUM'
               WHEN conf < 0.5 AND s >= 0.50::DOUBLE * fa * 0.7::DOUBLE THEN 'MONITOR/LOW' ELSE 'APPROVE/LOW' END AS dl
        FROM (SELECT *, CASE WHEN maturity IN ('COLD', 'WARMING') THEN 0.35::DOUBLE ELSE 0.70::DOUBLE END AS lift,
                     CASE WHEN conf < 0.5 AND maturity IN ('COLD', 'WARMING') THEN 0.85::DOUBLE WHEN conf >= 0.8::DOUBLE AND maturity = 'HOT' THEN 1.0::DOUBLE
                          ELSE 1.0::DOUBLE - (1.0::DOUBLE - conf) * 0.15::DOUBLE END AS fa,
                     CASE WHEN h1 THEN 'SANCTIONS_MATCH' WHEN h2 THEN 'WATCHLIST_HIT' WHEN h3 THEN 'BLACKLISTED_USER' WHEN h4 THEN 'BLACKLISTED_DEVICE' ELSE '' END AS hard
              FROM {source}))"""
MERCHANT_DECIDE_SQL = """
  SELECT {keep}, split_part(dl, '/', 1) AS decision, split_part(dl, '/', 2) AS level, split_part(dl, '/', 3) AS tier,
         CASE WHEN cb >= 0.10::DOUBLE THEN 'EXCESSIVE_CHARGEBACKS' WHEN fr >= 0.05::DOUBLE AND s < 0.65::DOUBLE THEN 'HIGH_FRAUD_RATE'
              ELSE concat_ws('|', CASE WHEN fr >= 0.05::DOUBLE THEN 'HIGH_FRAUD_RATE' END, CASE WHEN p THEN 'VELOCITY_SPIKE' END,
                             CASE WHEN dl = 'MONITOR/LOW/ENHANCED' THEN 'LOW_CONFIDENCE_MONITOR' END) END AS overrides
  FROM (SELECT *, CASE WHEN cb >= 0.10::DOUBLE THEN 'BLOCK/CRITICAL/BLOCKED' WHEN fr >= 0.05::DOUBLE AND s < 0.65::DOUBLE THEN 'REVIEW/HIGH/RESTRICTED'
               WHEN p AND s < 0.40::DOUBLE THEN 'REVIEW/MEDIUM/ENHANCED' WHEN s >= 0.85::DOUBLE * fa THEN 'BLOCK/CRITICAL/BLOCKED'
               WHEN s >= 0.65::DOUBLE * fa THEN 'REVIEW/HIGH/RESTRICTED' WHEN s >= 0.40::DOUBLE * fa THEN 'MONITOR/MEDIUM/ENHANCED'
               WHEN conf < 0.5 AND s >= 0.40::DOUBLE * fa * 0.7::DOUBLE THEN 'MONITOR/LOW/ENHANCED' ELSE 'APPROVE/LOW/STANDARD' END AS dl
        FROM (SELECT *, CASE WHEN conf < 0.5 AND maturity IN ('COLD', 'WARMING') THEN 0.85::DOUBLE WHEN conf >= 0.8::DOUBLE AND maturity = 'HOT' THEN 1.0::DOUBLE
                          ELSE 1.0::DOUBLE - (1.0::DOUBLE - conf) * 0.15::DOUBLE END AS fa FROM {source}))"""


@query("fraud_decide", using("dq", FRAUD_DECIDE_SQL.format(
    keep="txn_id", source="(SELECT *, f1 AS h1, f2 AS h2, f3 AS h3, f4 AS h4, f5 AS v, f6 AS n FROM dq)")))
def fraud_decide(v):
    names = ["sanctioned_country", "blacklisted_device", "blacklisted_ip", "blacklisted_user", "velocity_anomaly", "new_account_high_amount"]
    flags = {n: F.col(f"f{i}") for i, n in enumerate(names, 1)}
    d = decision_input(v).withColumn("_v", D.fraud_decide(F.col("s"), flags, F.col("conf"), F.col("maturity")))
    return d.select("txn_id", "_v.decision", "_v.level", "_v.overrides")


@query("aml_decide", using("dq", AML_DECIDE_SQL.format(
    keep="txn_id", source="(SELECT *, f1 AS h1, f2 AS h2, f3 AS h3, f4 AS h4, f5 AS g, f6 AS p FROM dq)")))
def aml_decide(v):
    names = ["sanctions_match", "watchlist_hit", "blacklisted_user", "blacklisted_device", "structuring_detected", "velocity_spike"]
    flags = {n: F.col(f"f{i}") for i, n in enumerate(names, 1)}
    d = decision_input(v).withColumn("_v", D.aml_decide(F.col("s"), flags, F.col("conf"), F.col("maturity")))
    return d.select("txn_id", "_v.decision", "_v.level", "_v.overrides")


@query("merchant_decide", using("dq", MERCHANT_DECIDE_SQL.format(keep="txn_id", source="(SELECT *, f6 AS p FROM dq)")))
def merchant_decide(v):
    d = decision_input(v).withColumn("_v", D.merchant_decide(F.col("s"), F.col("cb"), F.col("fr"), F.col("f6"), F.col("conf"), F.col("maturity")))
    return d.select("txn_id", "_v.decision", "_v.level", "_v.tier", "_v.overrides")


# ---- explanation ----------------------------------------------------------------------
def _impact_sql(source, terms, features, ratio):
    """Rows (txn_id, rank, feature, value, impact) of the ten largest contributions."""
    rows = " UNION ALL ".join(
        f"SELECT txn_id, {i} AS pos, '{f}' AS feature, {f}::DOUBLE AS value, ({terms.get(f, '0')})::DOUBLE AS impact FROM x" for i, f in enumerate(features))
    return using(source, """
  SELECT txn_id, rank, feature, value, impact FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY abs(impact) DESC, pos) AS rank FROM rows_) WHERE rank <= 10""",
                 x=f"SELECT *, {ratio} FROM {source}", rows_=rows)


FRAUD_IMPACT_SQL = dict(FRAUD_TERMS_SQL)
FRAUD_IMPACT_SQL["account_age_days"] = ("CASE WHEN account_age_days < 7 AND amount > 500 THEN 0.15 WHEN account_age_days < 30 AND amount > 1000 THEN 0.08 "
                                        "WHEN account_age_days > 365 THEN -0.02 ELSE 0 END")


def _impact_rows(df, domain):
    e = df.select("txn_id", F.posexplode(scoring.top_impacts(domain)).alias("rank", "e"))
    return e.select("txn_id", (F.col("rank") + 1).alias("rank"), "e.feature", "e.value", "e.impact")


@query("fraud_impacts", _impact_sql("fv", FRAUD_IMPACT_SQL, K.FRAUD_FEATURES, FRAUD_RATIO))
def fraud_impacts(v):
    return _impact_rows(fraud_vector_of(v), "fraud")


AML_IMPACT_SQL = {
    "amount": "CASE WHEN r > 10 THEN 0.10 WHEN r > 5 THEN 0.05 ELSE 0 END", "velocity_1h": "CASE WHEN velocity_1h > 15 THEN 0.12 WHEN velocity_1h > 8 THEN 0.06 ELSE 0 END",
    "total_volume_24h": "CASE WHEN total_volume_24h > 50000 THEN 0.10 WHEN total_volume_24h > 20000 THEN 0.05 ELSE 0 END",
    "is_cross_border": "CASE WHEN is_cross_border > 0 THEN 0.08 ELSE 0 END",
    "account_age_days": "CASE WHEN account_age_days < 14 AND total_volume_24h > 5000 THEN 0.10 WHEN account_age_days < 30 THEN 0.03 WHEN account_age_days > 365 THEN -0.02 ELSE 0 END",
    "device_count_30d": "CASE WHEN device_count_30d > 5 THEN 0.05 ELSE 0 END", "ip_count_30d": "CASE WHEN ip_count_30d > 10 THEN 0.05 ELSE 0 END",
    "new_device_flag": "CASE WHEN new_device_flag > 0 THEN 0.04 ELSE 0 END",
    "kyc_completeness_score": "CASE WHEN kyc_completeness_score < 0.3::DOUBLE THEN -0.10 WHEN kyc_completeness_score < 0.6::DOUBLE THEN -0.05 ELSE 0 END",
    "network_risk_score": "network_risk_score * 0.10::DOUBLE", "circular_transfer_flag": "CASE WHEN circular_transfer_flag > 0 THEN 0.15 ELSE 0 END",
    "shared_device_cluster_size": "CASE WHEN shared_device_cluster_size > 5 THEN 0.06 ELSE 0 END",
    "high_risk_country_flag": "CASE WHEN high_risk_country_flag > 0 THEN 0.15 ELSE 0 END",
    "sanctions_proximity_score": "CASE WHEN sanctions_proximity_score > 0.7::DOUBLE THEN 0.20 WHEN sanctions_proximity_score > 0.3::DOUBLE THEN 0.10 ELSE 0 END",
    "ip_country_mismatch": "CASE WHEN ip_country_mismatch > 0 THEN 0.06 ELSE 0 END", "historical_structuring_flag": "CASE WHEN historical_structuring_flag > 0 THEN 0.12 ELSE 0 END",
    "structuring_score_24h": "CASE WHEN structuring_score_24h > 0.7::DOUBLE THEN 0.15 WHEN structuring_score_24h > 0.4::DOUBLE THEN 0.08 ELSE 0 END",
    "rapid_drain_flag": "CASE WHEN rapid_drain_flag > 0 THEN 0.12 ELSE 0 END",
}


@query("aml_impacts", _impact_sql("av", AML_IMPACT_SQL, K.AML_FEATURES, AML_RATIO))
def aml_impacts(v):
    return _impact_rows(aml_vector_of(v), "aml")


MERCHANT_IMPACT_SQL = {
    "chargeback_rate_90d": "CASE WHEN chargeback_rate_90d > 0.018::DOUBLE THEN 0.25 WHEN chargeback_rate_90d > 0.009::DOUBLE THEN 0.15 WHEN chargeback_rate_90d > 0.005::DOUBLE THEN 0.08 ELSE 0 END",
    "refund_rate_90d": "CASE WHEN refund_rate_90d > 0.15::DOUBLE THEN 0.12 WHEN refund_rate_90d > 0.08::DOUBLE THEN 0.06 ELSE 0 END",
    "fraud_transaction_rate": "CASE WHEN fraud_transaction_rate > 0.05::DOUBLE THEN 0.20 WHEN fraud_transaction_rate > 0.02::DOUBLE THEN 0.12 WHEN fraud_transaction_rate > 0.01::DOUBLE THEN 0.06 ELSE 0 END",
    "account_age_days": "CASE WHEN account_age_days < 30 THEN 0.10 WHEN account_age_days < 90 THEN 0.05 WHEN account_age_days > 365 THEN -0.02 ELSE 0 END",
    "velocity_spike_flag": "CASE WHEN velocity_spike_flag > 0 THEN 0.10 ELSE 0 END", "transaction_count_1h": "CASE WHEN transaction_count_1h > 100 THEN 0.06 ELSE 0 END",
    "transaction_count_24h": "CASE WHEN transaction_count_24h > 500 THEN 0.04 ELSE 0 END",
    "high_risk_customer_ratio": "CASE WHEN high_risk_customer_ratio > 0.25::DOUBLE THEN 0.10 WHEN high_risk_customer_ratio > 0.15::DOUBLE THEN 0.05 ELSE 0 END",
    "cross_border_ratio": "CASE WHEN cross_border_ratio > 0.5::DOUBLE THEN 0.06 WHEN cross_border_ratio > 0.3::DOUBLE THEN 0.03 ELSE 0 END",
    "mcc_risk_score": "mcc_risk_score * 0.08::DOUBLE", "avg_customer_risk_score": "avg_customer_risk_score * 0.08::DOUBLE",
    "std_transaction_amount_30d": "CASE WHEN r > 3 THEN 0.05 ELSE 0 END",
}


@query("merchant_impacts", _impact_sql("mv", MERCHANT_IMPACT_SQL, K.MERCHANT_FEATURES, MERCHANT_RATIO))
def merchant_impacts(v):
    return _impact_rows(merchant_vector_of(v), "merchant")


@query("aml_risk_factors", using("av", """
  SELECT txn_id, concat_ws('|', CASE WHEN txn_id % 3 = 0 THEN 'STRUCTURING_DETECTED' END, CASE WHEN txn_id % 3 = 0 THEN 'VELOCITY_SPIKE' END,
         CASE WHEN velocity_1h > 5 THEN 'velocity_spike' END, CASE WHEN high_risk_country_flag > 0 THEN 'high_risk_country' END, CASE WHEN new_device_flag > 0 THEN 'new_device' END,
         CASE WHEN sanctions_proximity_score > 0.3 THEN 'sanctions_proximity' END, CASE WHEN structuring_score_24h > 0.3 THEN 'structuring_pattern' END,
         CASE WHEN network_risk_score > 0.5 THEN 'network_risk' END, CASE WHEN rapid_drain_flag > 0 THEN 'rapid_drain' END, CASE WHEN ip_country_mismatch > 0 THEN 'ip_country_mismatch' END) AS factors FROM av"""))
def aml_risk_factors(v):
    o = F.when(_hit(3), F.array(F.lit("STRUCTURING_DETECTED"), F.lit("VELOCITY_SPIKE"))).otherwise(F.array().cast("array<string>"))
    return aml_vector_of(v).select("txn_id", D.aml_risk_factors(o).alias("factors"))


@query("merchant_risk_factors", using("mv", """
  SELECT txn_id, concat_ws('|', CASE WHEN txn_id % 3 = 0 THEN 'HIGH_FRAUD_RATE' END,
         CASE WHEN chargeback_rate_90d > 0.03::DOUBLE THEN 'high_chargeback_rate' END, CASE WHEN fraud_transaction_rate > 0.02::DOUBLE THEN 'high_fraud_rate' END,
         CASE WHEN velocity_spike_flag > 0 THEN 'velocity_spike' END, CASE WHEN high_risk_customer_ratio > 0.15::DOUBLE THEN 'high_risk_customers' END,
         CASE WHEN cross_border_ratio > 0.3::DOUBLE THEN 'high_cross_border_ratio' END, CASE WHEN mcc_risk_score > 0.5 THEN 'high_risk_mcc' END,
         CASE WHEN account_age_days < 30 THEN 'new_merchant' END, CASE WHEN avg_customer_risk_score > 0.4::DOUBLE THEN 'risky_customer_base' END) AS factors FROM mv"""))
def merchant_risk_factors(v):
    o = F.when(_hit(3), F.array(F.lit("HIGH_FRAUD_RATE"))).otherwise(F.array().cast("array<string>"))
    return merchant_vector_of(v).select("txn_id", D.merchant_risk_factors(o).alias("factors"))


# ---- whole scoring runs ------------------------------------------------------------------
VIEWS["fdecided"] = (["fin"], FRAUD_DECIDE_SQL.format(keep="txn_id, s, conf, amount, merchant_id", source=f"""
   (SELECT *, CASE maturity WHEN 'COLD' THEN {FRAUD_COLD} WHEN 'WARMING' THEN 0.3::DOUBLE * ml + 0.7::DOUBLE * 0.5::DOUBLE WHEN 'WARM' THEN 0.7::DOUBLE * ml + 0.3::DOUBLE * 0.5::DOUBLE ELSE ml END AS s,
           CASE maturity WHEN 'COLD' THEN 0.1 WHEN 'WARMING' THEN 0.3 WHEN 'WARM' THEN pow(0.7::DOUBLE * 0.7::DOUBLE, 1.0::DOUBLE / 3.0::DOUBLE) ELSE pow(0.7::DOUBLE, 1.0::DOUBLE / 3.0::DOUBLE) END::DOUBLE AS conf,
           sanctioned_country = 1 AS h1, blacklisted_device = 1 AS h2, blacklisted_ip = 1 AS h3, blacklisted_user = 1 AS h4, velocity_anomaly = 1 AS v, new_account_high_amount = 1 AS n
    FROM (SELECT *, {MATURITY_SQL} AS maturity, {FRAUD_HEUR} AS ml FROM (SELECT *, {FRAUD_RATIO} FROM fin)))"""))


def fraud_scored(v):
    return D.fraud_score_batch(fraud_input(v), maturity_col())


@query("fraud_score_batch", using("fdecided", "SELECT txn_id, round(s, 6) AS score, round(conf, 6) AS confidence, decision, level, overrides FROM fdecided"))
def fraud_score_batch(v):
    return fraud_scored(v).select("txn_id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "decision", "level", "overrides")


@query("cold_fraud_decisions", using("fin", "SELECT decision, level, count(*) AS n FROM d GROUP BY ALL", d=FRAUD_DECIDE_SQL.format(keep="txn_id", source=f"""
   (SELECT *, 'COLD' AS maturity, {FRAUD_COLD} AS s, 0.1::DOUBLE AS conf, sanctioned_country = 1 AS h1, blacklisted_device = 1 AS h2, blacklisted_ip = 1 AS h3,
           blacklisted_user = 1 AS h4, velocity_anomaly = 1 AS v, new_account_high_amount = 1 AS n FROM fin)""")))
def cold_fraud_decisions(v):
    return D.fraud_score_batch(fraud_input(v), F.lit("COLD")).groupBy("decision", "level").agg(F.count(F.lit(1)).alias("n"))


VIEWS["ftrained"] = (["fin"], FRAUD_DECIDE_SQL.format(keep="txn_id, s, conf", source=f"""
   (SELECT *, CASE maturity WHEN 'COLD' THEN {FRAUD_COLD} WHEN 'WARMING' THEN 0.3::DOUBLE * ml + 0.7::DOUBLE * odd WHEN 'WARM' THEN 0.7::DOUBLE * ml + 0.3::DOUBLE * odd ELSE ml END AS s,
           CASE maturity WHEN 'COLD' THEN 0.1 WHEN 'WARMING' THEN 0.3 WHEN 'WARM' THEN pow(0.7::DOUBLE * quality, 1.0::DOUBLE / 3.0::DOUBLE) ELSE pow(quality, 1.0::DOUBLE / 3.0::DOUBLE) END::DOUBLE AS conf,
           sanctioned_country = 1 AS h1, blacklisted_device = 1 AS h2, blacklisted_ip = 1 AS h3, blacklisted_user = 1 AS h4, velocity_anomaly = 1 AS v, new_account_high_amount = 1 AS n
    FROM (SELECT *, {MATURITY_SQL} AS maturity, CASE WHEN txn_id % 10 = 0 THEN {FRAUD_HEUR} ELSE (txn_id * 37 % 1000) / 1000.0::DOUBLE END AS ml,
                 CASE WHEN txn_id % 7 = 0 THEN 0.5::DOUBLE ELSE (txn_id * 53 % 1000) / 1000.0::DOUBLE END AS odd,
                 CASE WHEN txn_id % 2 = 1 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END AS quality FROM (SELECT *, {FRAUD_RATIO} FROM fin)))"""))


@query("fraud_trained_batch", using("ftrained", "SELECT txn_id, round(s, 6) AS score, round(conf, 6) AS confidence, decision, level, overrides FROM ftrained"))
def fraud_trained_batch(v):
    """Decisions from stored model and anomaly scores in every maturity; some rows have none, odd ids are calibrated."""
    i = F.col("txn_id")
    ml = F.when(i % 10 != 0, i * 37 % 1000 / 1000.0)
    odd = F.when(i % 7 != 0, i * 53 % 1000 / 1000.0)
    s = D.fraud_score_batch(fraud_input(v), maturity_col(), anomaly=odd, ml=ml, calibrated=i % 2 == 1)
    return s.select("txn_id", F.round("score", 6).alias("score"), F.round("confidence", 6).alias("confidence"), "decision", "level", "overrides")


@query("fail_closed", using("fdecided", """
  SELECT txn_id, CASE WHEN bad THEN 1.0 ELSE round(s, 6) END::DOUBLE AS score, CASE WHEN bad THEN 'BLOCK' ELSE decision END AS decision,
         CASE WHEN bad THEN 'CRITICAL' ELSE level END AS level, CASE WHEN bad THEN 'MODEL_FAILURE_FAIL_CLOSED' ELSE overrides END AS overrides
  FROM (SELECT *, txn_id % 97 = 0 OR txn_id % 89 = 0 AS bad FROM fdecided)"""))
def fail_closed(v):
    s = D.fraud_score_batch(damaged(fraud_input(v)), maturity_col())
    return s.select("txn_id", F.round("score", 6).alias("score"), "decision", "level", "overrides")


@query("rescore_summary", using("txn", """
  SELECT 'fraud_rescore' AS job_type, count(*) AS total, count(*) - count(*) FILTER (bad) AS processed, count(*) FILTER (bad) AS failed, CASE WHEN count(*) > count(*) FILTER (bad) THEN 'COMPLETED' ELSE 'FAILED' END AS status
  FROM (SELECT txn_id % 97 = 0 OR txn_id % 89 = 0 AS bad FROM txn)"""))
def rescore_summary(v):
    return D.rescore_summary(D.fraud_score_batch(damaged(fraud_input(v)), maturity_col()), "fraud_rescore")


def aml_input(v):
    a = aml_vector_of(v, ["country"])
    a = velocity.with_hourly_past(a, v.dense, "user_id").withColumn("velocity_spike", velocity.spike_flag(F.col("velocity_1h"))).drop("past_n", "past_hours")
    keys = v.dense.select("txn_id", "user_id", "device", "ip")
    b = screening.blacklist_flags(keys, *blacklists(v)).select("txn_id", "blacklisted_user", "blacklisted_device")
    return (a.join(b, "txn_id", "left").withColumn("sanctions_match", _hit(41).cast("int")).withColumn("watchlist_hit", _hit(43).cast("int")))


VIEWS["uspike"] = (["dense"], """
      SELECT user_id, hour_us, s, c
      FROM (SELECT *, sum(n) OVER w AS s, count(*) OVER w AS c FROM (SELECT user_id, us - us % 3600000000 AS hour_us, count(*) AS n FROM dense GROUP BY ALL)
            WINDOW w AS (PARTITION BY user_id ORDER BY hour_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""")
VIEWS["adecided"] = (["av", "uspike", "blacklisted"], AML_DECIDE_SQL.format(keep="txn_id, s, conf, velocity_1h, user_id", source=f"""
   (SELECT *, CASE WHEN country IN ('IR','KP','SY','AF','YE') THEN least(1.0::DOUBLE, s0 + 0.15::DOUBLE) ELSE s0 END AS s
    FROM (SELECT x.*, CASE maturity WHEN 'COLD' THEN {AML_COLD} WHEN 'WARMING' THEN 0.3::DOUBLE * ml + 0.7::DOUBLE * 0.5::DOUBLE WHEN 'WARM' THEN 0.7::DOUBLE * ml + 0.3::DOUBLE * 0.5::DOUBLE ELSE ml END AS s0,
           CASE maturity WHEN 'COLD' THEN 0.1 WHEN 'WARMING' THEN 0.3 WHEN 'WARM' THEN pow(0.7::DOUBLE * 0.7::DOUBLE, 1.0::DOUBLE / 3.0::DOUBLE) ELSE pow(0.7::DOUBLE, 1.0::DOUBLE / 3.0::DOUBLE) END::DOUBLE AS conf,
           txn_id % 41 = 0 AS h1, txn_id % 43 = 0 AS h2, user_id % 29 = 0 AS h3, bd = 1 AS h4, structuring_score_24h > 0.5 AS g
    FROM (SELECT av.*, coalesce(velocity_1h * u.c > 3 * u.s, false) AS p, {MATURITY_SQL} AS maturity, bd, {AML_HEUR} AS ml
          FROM (SELECT *, {AML_RATIO} FROM av) av LEFT JOIN uspike u ON u.user_id = av.user_id AND u.hour_us = av.us - av.us % 3600000000
          JOIN (SELECT txn_id AS tid, blacklisted_device AS bd FROM blacklisted) ON tid = txn_id) x))"""))


@query("aml_score_batch", using("adecided", "SELECT txn_id, round(s, 6) AS score, decision, level, overrides FROM adecided"))
def aml_score_batch(v):
    return D.aml_score_batch(aml_input(v), maturity_col()).select("txn_id", F.round("score", 6).alias("score"), "decision", "level", "overrides")


@query("aml_cases", using("adecided", """
  SELECT 'TRANSACTION' AS entity_type, txn_id AS entity_id, CASE WHEN overrides = '' THEN 'HIGH_RISK_SCORE' ELSE split_part(overrides, '|', 1) END AS trigger_reason,
         round(s, 6) AS score, level AS priority, 'OPEN' AS status FROM adecided WHERE level IN ('HIGH', 'CRITICAL')"""))
def aml_cases(v):
    return D.aml_cases(D.aml_score_batch(aml_input(v), maturity_col())).withColumn("score", F.round("score", 6))


VIEWS["mdecided"] = (["mv"], MERCHANT_DECIDE_SQL.format(keep="txn_id, merchant_id, us, s, conf", source=f"""
   (SELECT *, chargeback_rate_90d AS cb, fraud_transaction_rate AS fr, velocity_spike_flag > 0 AS p,
           CASE maturity WHEN 'COLD' THEN {MERCHANT_COLD} WHEN 'WARMING' THEN 0.3::DOUBLE * ml + 0.7::DOUBLE * 0.5::DOUBLE WHEN 'WARM' THEN 0.7::DOUBLE * ml + 0.3::DOUBLE * 0.5::DOUBLE ELSE ml END AS s,
           CASE maturity WHEN 'COLD' THEN 0.1 WHEN 'WARMING' THEN 0.3 WHEN 'WARM' THEN pow(0.7::DOUBLE * 0.7::DOUBLE, 1.0::DOUBLE / 3.0::DOUBLE) ELSE pow(0.7::DOUBLE, 1.0::DOUBLE / 3.0::DOUBLE) END::DOUBLE AS conf
    FROM (SELECT *, {MATURITY_SQL} AS maturity, {MERCHANT_HEUR} AS ml FROM (SELECT *, {MERCHANT_RATIO} FROM mv)))"""))


def merchant_scored(v):
    return D.merchant_score_batch(merchant_vector_of(v), maturity_col())


@query("merchant_score_batch", using("mdecided", "SELECT txn_id, round(s, 6) AS score, decision, level, tier, overrides FROM mdecided"))
def merchant_score_batch(v):
    return merchant_scored(v).select("txn_id", F.round("score", 6).alias("score"), "decision", "level", "tier", "overrides")


@query("merchant_tier_changes", using("mdecided", """
  SELECT merchant_id, prev AS previous_tier, tier AS new_tier, us AS at_us
  FROM (SELECT *, lag(tier) OVER (PARTITION BY merchant_id ORDER BY us, txn_id) AS prev FROM mdecided) WHERE prev <> tier"""))
def merchant_tier_changes(v):
    return D.merchant_tier_changes(merchant_scored(v).select("merchant_id", "tier", "us", F.col("txn_id").alias("prediction_id")))


@query("explain", using("fv p_fraud", """
  SELECT txn_id AS transaction_id, prediction_id, score, string_agg(feature, '|' ORDER BY rank) AS top_features
  FROM (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY abs(impact) DESC, pos) AS rank FROM rows_) r
  JOIN (SELECT transaction_id, max(prediction_id) AS prediction_id, max(score) AS score FROM again WHERE copy = 1 GROUP BY transaction_id) a ON a.transaction_id = r.txn_id
  WHERE rank <= 10 GROUP BY ALL""",
       x=f"SELECT *, {FRAUD_RATIO} FROM fv",
       rows_=" UNION ALL ".join(f"SELECT txn_id, {i} AS pos, '{f}' AS feature, ({FRAUD_IMPACT_SQL.get(f, '0')})::DOUBLE AS impact FROM x" for i, f in enumerate(K.FRAUD_FEATURES)),
       again="""SELECT transaction_id, prediction_id + copy * 100000000 AS prediction_id, copy, CASE WHEN copy = 1 THEN 1.0 - score ELSE score END AS score
                FROM p_fraud, (SELECT unnest([0, 1]) AS copy)"""))
def explain(v):
    """Explanation of the newest of two predictions of every transaction."""
    p = v.predictions("fraud").select("transaction_id", "prediction_id", "created_us", "score", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    p = p.select("transaction_id", (F.col("prediction_id") + F.col("copy") * 100_000_000).alias("prediction_id"), (F.col("created_us") + F.col("copy")).alias("created_us"),
                 F.when(F.col("copy") == 1, 1.0 - F.col("score")).otherwise(F.col("score")).alias("score"))
    e = D.explain(v.txn.select(F.col("txn_id").alias("transaction_id")), p, fraud_vector_of(v), "fraud")
    return e.withColumn("top_features", F.transform("top_features", lambda x: x["feature"]))


def _importance_sql(source, terms, features, ratio, weights):
    rows = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, sum(round(abs(({terms.get(f, '0')})::DOUBLE) * 1000000)::BIGINT)::BIGINT / count(*) / 1e6::DOUBLE AS importance, {weights[f]}::DOUBLE AS fixed_weight FROM x"
        for f in features)
    return using(source, rows, x=f"SELECT *, {ratio} FROM {source}")


@query("feature_importance", _importance_sql("fv", FRAUD_IMPACT_SQL, K.FRAUD_FEATURES, FRAUD_RATIO, K.HEURISTIC_WEIGHTS["fraud"]))
def feature_importance(v):
    return scoring.feature_importance(fraud_vector_of(v), "fraud")


@query("scoring_rollup", using("p_fraud", "SELECT decision, level, count(*) AS n, "
       + ", ".join(f"count(*) FILTER (score <= {b / 10}::DOUBLE) AS le_{b:02d}" for b in range(1, 11)) + " FROM p_fraud GROUP BY CUBE (decision, level)"))
def scoring_rollup(v):
    return D.scoring_rollup(v.predictions("fraud"))


@query("latency_histogram", using("p_fraud", "SELECT decision, count(*) AS n, "
       + ", ".join(f"count(*) FILTER (l <= {b}) AS le_{b}" for b in (10, 25, 50, 100, 200, 500, 1000)) + " FROM (SELECT *, prediction_id * 31 % 1200 AS l FROM p_fraud) GROUP BY decision"))
def latency_histogram(v):
    p = v.predictions("fraud").withColumn("latency_ms", F.pmod(F.col("prediction_id") * 31, F.lit(1200)))
    return D.latency_histogram(p, "decision")
