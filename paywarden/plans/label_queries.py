"""Label feedback, case, active-learning, maturity and report queries over the given tables."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.session import settle
from ..operators import active, labels, maturity, reports, vector
from ..operators.drift import score_psi
from ..sources.views import T0, _cycle
from .feature_queries import aml_vector_of, fraud_vector_of, merchant_vector_of
from .registry import query
from .sqlviews import VIEWS, using

NOW = T0 + 29 * K.DAY
DAY_SQL = "86400000000"


@query("apply_labels", using("p_fraud label_events", """
  SELECT p.prediction_id, CASE WHEN e.event_id IS NOT NULL THEN e.label ELSE p.label END::BIGINT AS label,
         CASE WHEN e.event_id IS NOT NULL THEN e.us ELSE p.labeled_us END AS labeled_us, e.labeled_by, e.source AS label_source
  FROM p_fraud p LEFT JOIN (SELECT * FROM label_events QUALIFY row_number() OVER (PARTITION BY prediction_id ORDER BY us DESC, event_id DESC) = 1) e USING (prediction_id)"""))
def apply_labels(v):
    return labels.apply_labels(v.predictions("fraud"), v.label_events).select("prediction_id", "label", "labeled_us", "labeled_by", "label_source")


@query("label_audit", using("p_fraud label_events", """
  SELECT event_id, prediction_id, CASE WHEN rn > 1 THEN prev ELSE stored END::BIGINT AS previous_label, label AS new_label, labeled_by, source AS label_source, us
  FROM (SELECT e.*, p.label AS stored, lag(e.label) OVER w AS prev, row_number() OVER w AS rn FROM label_events e JOIN p_fraud p USING (prediction_id)
        WINDOW w AS (PARTITION BY prediction_id ORDER BY us, event_id))"""))
def label_audit(v):
    return labels.label_audit(v.predictions("fraud"), v.label_events)


@query("label_errors", using("p_fraud label_events", """
  SELECT event_id, prediction_id, 'Prediction ' || prediction_id::VARCHAR || ' not found' AS error FROM label_events WHERE prediction_id NOT IN (SELECT prediction_id FROM p_fraud)"""))
def label_errors(v):
    return labels.label_errors(v.predictions("fraud"), v.label_events)


@query("label_batch_summary", using("p_fraud label_events", """
  SELECT count(*) AS total, count(p.prediction_id) AS succeeded, count(*) - count(p.prediction_id) AS failed FROM label_events LEFT JOIN p_fraud p USING (prediction_id)"""))
def label_batch_summary(v):
    return labels.label_batch_summary(v.predictions("fraud"), v.label_events)


@query("propagate_case_labels", using("cases p_aml", """
  SELECT case_id, target AS prediction_id, (status = 'CLOSED_CONFIRMED')::BIGINT AS label, CASE WHEN status = 'CLOSED_CONFIRMED' THEN 'SAR_CONFIRMED' ELSE 'MANUAL_REVIEW' END AS source
  FROM (SELECT c.*, coalesce(c.prediction_id, n.pid) AS target FROM cases c
        LEFT JOIN (SELECT transaction_id, max(prediction_id + copy * 100000000) AS pid FROM p_aml, (SELECT unnest([0, 1]) AS copy) GROUP BY transaction_id) n ON n.transaction_id = c.entity_id)
  WHERE status IN ('CLOSED_CONFIRMED', 'CLOSED_FALSE_POSITIVE') AND NOT propagated AND target IS NOT NULL"""))
def propagate_case_labels(v):
    p = v.predictions("aml").withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    p = p.withColumn("prediction_id", F.col("prediction_id") + F.col("copy") * 100_000_000).withColumn("created_us", F.col("created_us") + F.col("copy"))
    return labels.propagate_case_labels(v.cases, p)


@query("auto_label_aged_reviews", using("p_fraud", f"""
  SELECT prediction_id, s AS score, created_us, CASE WHEN s > 0.9 THEN 1 WHEN s < 0.1 THEN 0 END::BIGINT AS label
  FROM (SELECT prediction_id, created_us, (prediction_id * 91 % 1000) / 1000.0::DOUBLE AS s FROM p_fraud
        WHERE decision = 'REVIEW' AND label IS NULL AND created_us < {NOW} - {DAY_SQL})
  WHERE s > 0.9::DOUBLE OR s < 0.1::DOUBLE"""))
def auto_label_aged_reviews(v):
    """Reviews come from the score; the labelling pass sees a rescored value."""
    p = v.predictions("fraud").withColumn("score", F.pmod(F.col("prediction_id") * 91, F.lit(1000)) / 1000.0)
    return labels.auto_label_aged_reviews(p, NOW)


@query("label_statistics", using("p_all", """
  SELECT coalesce(domain, 'ALL') AS domain, count(*) AS total, count(label) AS labelled, count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative,
         count(*) - count(label) AS unlabelled, round(count(label) / count(*)::DOUBLE, 4) AS label_rate,
         CASE WHEN count(label) < 100 THEN 'COLD' WHEN count(label) < 1000 THEN 'WARMING' WHEN count(label) < 10000 THEN 'WARM' ELSE 'HOT' END AS maturity
  FROM p_all GROUP BY ROLLUP (domain)"""))
def label_statistics(v):
    return labels.label_statistics(v.all_predictions)


def case_updates(v):
    """Two updates for every second case; some leave the text fields empty."""
    c = v.cases.filter(F.col("case_id") % 2 == 0).select("case_id", "created_us", F.explode(F.array(F.lit(0), F.lit(1))).alias("n"))
    i = F.col("case_id") + F.col("n")
    return c.select(
        (F.col("case_id") * 2 + F.col("n")).alias("update_id"), "case_id", (F.col("created_us") + (F.col("n") + 1) * K.HOUR).alias("us"),
        _cycle(["INVESTIGATING", "CLOSED_CONFIRMED", "CLOSED_FALSE_POSITIVE"], F.pmod(i, F.lit(3))).alias("status"),
        F.when(F.pmod(i, F.lit(4)) == 0, "team-b").alias("assignee"), F.when(F.pmod(i, F.lit(5)) == 0, "").otherwise("seen").alias("notes"),
        F.when(F.pmod(i, F.lit(3)) == 1, "confirmed by review").alias("resolution"))


VIEWS["updated"] = (["cases"], """
      SELECT c.* EXCLUDE (status, assignee, notes), coalesce(u.status, c.status) AS status, coalesce(u.assignee, c.assignee) AS assignee,
             coalesce(nullif(u.notes, ''), c.notes) AS notes, u.resolution, u.us AS updated_us
      FROM cases c LEFT JOIN (SELECT case_id, created_us + 2 * 3600000000 AS us,
                list_extract(['INVESTIGATING','CLOSED_CONFIRMED','CLOSED_FALSE_POSITIVE'], (case_id + 1) % 3 + 1) AS status,
                CASE WHEN (case_id + 1) % 4 = 0 THEN 'team-b' END AS assignee, CASE WHEN (case_id + 1) % 5 = 0 THEN '' ELSE 'seen' END AS notes,
                CASE WHEN (case_id + 1) % 3 = 1 THEN 'confirmed by review' END AS resolution FROM cases WHERE case_id % 2 = 0) u USING (case_id)""")


@query("case_update", using("updated", "SELECT case_id, status, assignee, notes, resolution, updated_us FROM updated"))
def case_update(v):
    return labels.case_update(v.cases, case_updates(v)).select("case_id", "status", "assignee", "notes", "resolution", "updated_us")


@query("closure_labels", using("updated", """
  SELECT case_id, prediction_id, (status = 'CLOSED_CONFIRMED')::BIGINT AS label, CASE WHEN status = 'CLOSED_CONFIRMED' THEN 'SAR_CONFIRMED' ELSE 'MANUAL_REVIEW' END AS source, updated_us AS us
  FROM updated WHERE updated_us IS NOT NULL AND status LIKE 'CLOSED%' AND prediction_id IS NOT NULL"""))
def closure_labels(v):
    return labels.closure_labels(labels.case_update(v.cases, case_updates(v)))


@query("case_page", using("cases", """
  SELECT case_id, entity_id, status, priority, created_us, (SELECT count(*) FROM cases WHERE status = 'OPEN') AS total
  FROM cases WHERE status = 'OPEN' ORDER BY created_us DESC, case_id DESC LIMIT 50 OFFSET 20"""))
def case_page(v):
    return labels.case_page(v.cases, status="OPEN", limit=50, offset=20).select("case_id", "entity_id", "status", "priority", "created_us", "total")


# ---- active learning -------------------------------------------------------------
STRATEGIES = ["UNCERTAINTY", "MARGIN", "ENTROPY", "DISAGREEMENT", "DENSITY_WEIGHTED"]


@query("informativeness", using("p_fraud", """
  SELECT prediction_id, u AS uncertainty, 1.0::DOUBLE - abs(2.0::DOUBLE * score - 1.0::DOUBLE) AS margin,
         round(-(p * log2(p) + (1.0::DOUBLE - p) * log2(1.0::DOUBLE - p)), 6) AS entropy,
         CASE WHEN prediction_id % 3 = 0 THEN u ELSE abs(score - o) END AS disagreement, u * (0.5::DOUBLE + 0.5::DOUBLE * (1.0::DOUBLE - 2.0::DOUBLE * abs(score - 0.5::DOUBLE))) AS density_weighted
  FROM (SELECT *, greatest(0.0, 1.0::DOUBLE - least(abs(score - 0.3::DOUBLE), abs(score - 0.7::DOUBLE), abs(score - 0.9::DOUBLE))) AS u,
               greatest(1e-10::DOUBLE, least(1.0::DOUBLE - 1e-10::DOUBLE, score)) AS p, (prediction_id * 53 % 100) / 100.0::DOUBLE AS o FROM p_fraud)"""))
def informativeness(v):
    s = F.col("score")
    odd = F.when(F.pmod("prediction_id", F.lit(3)) != 0, F.pmod(F.col("prediction_id") * 53, F.lit(100)) / 100.0)
    cols = [active.informativeness(s, "fraud", st, odd).alias(st.lower()) for st in STRATEGIES]
    return v.predictions("fraud").select("prediction_id", *cols).withColumn("entropy", F.round("entropy", 6))


def queue(v):
    """Queue rows for every seventeenth prediction of each domain, in every status."""
    i = F.col("prediction_id")
    return v.all_predictions.filter(F.pmod(i, F.lit(17)) == 3).select(
        "domain", "prediction_id", "entity_id", "score", (F.pmod(i * 29, F.lit(10000)) / 10000.0).alias("informativeness"),
        _cycle(["PENDING", "PENDING", "ASSIGNED", "LABELED", "EXPIRED"], F.pmod(i, F.lit(5))).alias("status"), (F.col("created_us") + 48 * K.HOUR).alias("expires_us"))


def al_events(v):
    return v.all_predictions.filter("labeled_us is not null").select("domain", F.col("labeled_us").alias("us"))


VIEWS["queue"] = (["p_all"], """
      SELECT domain, prediction_id, entity_id, score, (prediction_id * 29 % 10000) / 10000.0::DOUBLE AS informativeness,
             list_extract(['PENDING','PENDING','ASSIGNED','LABELED','EXPIRED'], prediction_id % 5 + 1) AS status, created_us + 48 * 3600000000 AS expires_us
      FROM p_all WHERE prediction_id % 17 = 3""")
VIEWS["al_events"] = (["p_all"], "SELECT domain, labeled_us AS us FROM p_all WHERE labeled_us IS NOT NULL")


def _refresh_sql(domain, info, strategy, top):
    return f"""(SELECT '{domain}' AS domain, prediction_id, entity_id, score, informativeness, '{strategy}' AS strategy, 'PENDING' AS status, {NOW + 48 * K.HOUR}::BIGINT AS expires_us
      FROM (SELECT *, round({info}, 4) AS informativeness FROM
           (SELECT *, greatest(1e-10::DOUBLE, least(1.0::DOUBLE - 1e-10::DOUBLE, score)) AS p FROM p_{domain} WHERE label IS NULL AND created_us > {NOW} - 30 * {DAY_SQL} AND created_us <= {NOW}
            AND prediction_id NOT IN (SELECT prediction_id FROM queue WHERE domain = '{domain}' AND status IN ('PENDING', 'ASSIGNED'))))
      ORDER BY informativeness DESC, prediction_id DESC LIMIT {top})"""


_NEAR = "greatest(0.0, 1.0::DOUBLE - least(abs(score - {}::DOUBLE), abs(score - {}::DOUBLE), abs(score - {}::DOUBLE)))"


@query("refresh_queue", using("queue", _refresh_sql("fraud", _NEAR.format(0.3, 0.7, 0.9), "DISAGREEMENT", 200) + " UNION ALL "
       + _refresh_sql("aml", _NEAR.format(0.4, 0.7, 0.85), "UNCERTAINTY", 160) + " UNION ALL "
       + _refresh_sql("merchant", "-(p * log2(p) + (1.0::DOUBLE - p) * log2(1.0::DOUBLE - p))", "ENTROPY", 100)))
def refresh_queue(v):
    q = queue(v)
    frames = [active.refresh_queue(v.predictions(d), q, d, NOW) for d in ("fraud", "aml", "merchant")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("queue_page", using("queue al_events", f"""
  SELECT prediction_id, score, informativeness, (SELECT count(*) FROM queue WHERE domain = 'aml' AND status = 'PENDING') AS total,
         greatest(0, 80 - (SELECT count(*) FROM al_events WHERE domain = 'aml' AND us >= {NOW - NOW % K.DAY} AND us < {NOW - NOW % K.DAY + K.DAY})) AS daily_budget_remaining
  FROM queue WHERE domain = 'aml' AND status = 'PENDING' ORDER BY informativeness DESC, prediction_id DESC LIMIT 30 OFFSET 10"""))
def queue_page(v):
    return active.queue_page(queue(v), al_events(v), "aml", NOW, 30, 10).select("prediction_id", "score", "informativeness", "total", "daily_budget_remaining")


@query("queue_to_cases", using("queue", """
  SELECT domain, prediction_id, entity_id, score, 'ACTIVE_LEARNING_QUEUE' AS trigger_reason, 'HIGH' AS priority
  FROM queue WHERE status = 'PENDING' ORDER BY informativeness DESC, prediction_id DESC, domain LIMIT 25"""))
def queue_to_cases(v):
    return active.queue_to_cases(queue(v), 25).select("domain", "prediction_id", "entity_id", "score", "trigger_reason", "priority")


@query("queue_after_cases", using("queue", """
  SELECT domain, prediction_id, CASE WHEN rn <= 25 AND status = 'PENDING' THEN 'ASSIGNED' ELSE status END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY informativeness DESC, prediction_id DESC, domain) AS rn FROM queue)"""))
def queue_after_cases(v):
    q = queue(v)
    return active.mark_assigned(q, active.queue_to_cases(q, 25)).select("domain", "prediction_id", "status")


@query("budget_usage", using("al_events", """
  SELECT domain, period, start_us, used, greatest(0, CASE period WHEN 'DAY' THEN CASE domain WHEN 'fraud' THEN 100 WHEN 'aml' THEN 80 ELSE 50 END
         ELSE CASE domain WHEN 'fraud' THEN 500 WHEN 'aml' THEN 400 ELSE 250 END END - used) AS remaining
  FROM (SELECT domain, 'DAY' AS period, epoch_us(date_trunc('day', make_timestamp(us))::TIMESTAMP) AS start_us, count(*) AS used FROM al_events GROUP BY ALL
        UNION ALL SELECT domain, 'WEEK', epoch_us(date_trunc('week', make_timestamp(us))::TIMESTAMP), count(*) FROM al_events GROUP BY ALL)"""))
def budget_usage(v):
    return active.budget_usage(al_events(v))


@query("al_metrics", using("queue", """
  SELECT domain, pending, labelled, CASE WHEN pending > 0 THEN s / pending::DOUBLE / 10000.0::DOUBLE ELSE 0.0 END::DOUBLE AS mean_informativeness, labelled / greatest(1, pending + labelled)::DOUBLE AS yield
  FROM (SELECT domain, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'LABELED') AS labelled,
               (sum(round(informativeness * 10000)::BIGINT) FILTER (status = 'PENDING'))::BIGINT AS s FROM queue GROUP BY domain)"""))
def al_metrics(v):
    return active.al_metrics(queue(v))


@query("expire_queue", using("queue", f"""
  SELECT domain, prediction_id, CASE WHEN status = 'PENDING' AND expires_us < {NOW} THEN 'EXPIRED' ELSE status END AS status FROM queue"""))
def expire_queue(v):
    return active.expire_queue(queue(v), NOW).select("domain", "prediction_id", "status")


@query("expired_count", using("queue", f"SELECT count(*) FILTER (status = 'PENDING' AND expires_us < {NOW}) AS expired FROM queue"))
def expired_count(v):
    return active.expired_count(queue(v), NOW)


# ---- maturity ----------------------------------------------------------------------
VIEWS["signals"] = (["p_all"], f"""
      SELECT domain, count(label) AS sample_count, coalesce(count(*) FILTER (label = 1) / nullif(count(label), 0)::DOUBLE, 0.0)::DOUBLE AS positive_rate,
             coalesce((sum(labeled_us - created_us) FILTER (created_us > {NOW} - 7 * {DAY_SQL} AND labeled_us IS NOT NULL))::DOUBLE
                      / nullif(count(*) FILTER (created_us > {NOW} - 7 * {DAY_SQL} AND labeled_us IS NOT NULL), 0)::DOUBLE / 3600000000::DOUBLE, 0.0)::DOUBLE AS label_delay_hours
      FROM p_all GROUP BY domain""")


@query("maturity_signals", using("signals", "SELECT * FROM signals"))
def maturity_signals(v):
    return maturity.maturity_signals(v.all_predictions, NOW)


VIEWS["stale"] = (["p_all"], f"""
      SELECT domain, quantile_cont(a, 0.5) / 60.0::DOUBLE AS feature_staleness_hours
      FROM (SELECT domain, (({NOW} + 2 * {DAY_SQL} - created_us) // 60000000)::DOUBLE AS a FROM p_all) GROUP BY domain""")


@query("feature_staleness", using("stale", "SELECT * FROM stale"))
def feature_staleness(v):
    return maturity.feature_staleness(v.all_predictions.select("domain", F.col("created_us").alias("us")), NOW + 2 * K.DAY)


LEVEL_SQL = """CASE WHEN n < 100 OR cov < 0.70::DOUBLE THEN 'COLD' WHEN n < 1000 OR cov < 0.90::DOUBLE THEN 'WARMING'
               WHEN n >= 10000 AND coalesce(psi, 1.0) <= 0.1 THEN 'HOT' ELSE 'WARM' END"""


@query("maturity_level", using("txn", f"""
  SELECT txn_id, {LEVEL_SQL} AS level FROM (SELECT txn_id, txn_id * 37 % 20000 AS n, (50 + txn_id % 51) / 100.0::DOUBLE AS cov,
         CASE WHEN txn_id % 5 <> 0 THEN (txn_id % 30) / 100.0::DOUBLE END AS psi FROM txn)"""))
def maturity_level(v):
    i = F.col("txn_id")
    psi = F.when(F.pmod(i, F.lit(5)) != 0, F.pmod(i, F.lit(30)) / 100.0)
    return v.txn.select("txn_id", maturity.maturity_level(F.pmod(i * 37, F.lit(20000)), (F.pmod(i, F.lit(51)) + 50) / 100.0, psi).alias("level"))


VIEWS["psi_fraud"] = (["base_half", "cur_half"], """
      SELECT sum((pc - pb) * ln(pc / pb)) AS psi FROM (SELECT (coalesce(b, 0) + 1) / (nb + 10)::DOUBLE AS pb, (coalesce(c, 0) + 1) / (nc + 10)::DOUBLE AS pc
      FROM range(10) r(bin) LEFT JOIN (SELECT bin, count(*) AS b FROM bh GROUP BY bin) USING (bin) LEFT JOIN (SELECT bin, count(*) AS c FROM ch GROUP BY bin) USING (bin),
           (SELECT count(*) AS nb FROM bh), (SELECT count(*) AS nc FROM ch))""")


def _coverage_sql(domain, view):
    features = K.REGISTRY[domain]
    covered = " + ".join(f"(abs({f} - {d}::DOUBLE) > 1e-6)::INTEGER" for f, d in zip(features, K.PRIOR_DEFAULTS[domain], strict=True))
    return f"SELECT '{domain}' AS domain, sum({covered})::BIGINT / count(*) / {len(features)}.0::DOUBLE AS cov FROM {view}"


@query("maturity_report", using("signals stale base_half cur_half fv av mv", f"""
  SELECT domain, level, sample_count, round(positive_rate, 6) AS positive_rate, round(cov, 6) AS feature_coverage, feature_staleness_hours, round(psi, 6) AS distribution_stability,
         round(label_delay_hours, 4) AS label_delay_hours, CASE level WHEN 'COLD' THEN 0.0 WHEN 'WARMING' THEN 0.3 WHEN 'WARM' THEN 0.7 ELSE 1.0 END::DOUBLE AS alpha,
         CASE level WHEN 'COLD' THEN 0.1 WHEN 'WARMING' THEN 0.3 WHEN 'WARM' THEN 0.6 ELSE 0.8 END::DOUBLE AS confidence_floor,
         concat_ws('|', CASE WHEN positive_rate < lo AND sample_count > 0 THEN format('Positive rate {{:.2f}}% below expected minimum {{:.2f}}%', positive_rate * 100, lo * 100)
                             WHEN positive_rate > hi THEN format('Positive rate {{:.2f}}% above expected maximum {{:.2f}}%', positive_rate * 100, hi * 100) END,
                   CASE WHEN label_delay_hours > 72 THEN format('Label delay {{:.1f}}h exceeds 72h target', label_delay_hours) END) AS warnings,
         concat_ws('|', CASE WHEN positive_rate < lo AND sample_count > 0 THEN 'Check that labels arrive' WHEN positive_rate > hi THEN 'Check for labelling bias or data quality issues' END,
                   CASE WHEN cov < 0.70 THEN 'Raise feature coverage' END, CASE WHEN label_delay_hours > 72 THEN 'Speed up label confirmation' END) AS recommendations
  FROM (SELECT *, {LEVEL_SQL} AS level FROM (SELECT s.*, feature_staleness_hours, sample_count AS n, cov,
               coalesce(CASE WHEN domain = 'fraud' THEN psi END, 1.0)::DOUBLE AS psi,
               CASE domain WHEN 'aml' THEN 0.005 ELSE 0.01 END::DOUBLE AS lo, CASE domain WHEN 'aml' THEN 0.08 ELSE 0.10 END::DOUBLE AS hi
        FROM signals s JOIN stale USING (domain) JOIN covered USING (domain), fraud_psi))""",
       covered=" UNION ALL ".join(_coverage_sql(*x) for x in (("fraud", "fv"), ("aml", "av"), ("merchant", "mv"))),
       bh="SELECT CASE WHEN score < i * 0.1::DOUBLE THEN i - 1 WHEN i < 9 AND score >= (i + 1) * 0.1::DOUBLE THEN i + 1 ELSE i END::BIGINT AS bin FROM (SELECT score, least(floor(score * 10), 9) AS i FROM base_half)",
       ch="SELECT CASE WHEN score < i * 0.1::DOUBLE THEN i - 1 WHEN i < 9 AND score >= (i + 1) * 0.1::DOUBLE THEN i + 1 ELSE i END::BIGINT AS bin FROM (SELECT score, least(floor(score * 10), 9) AS i FROM cur_half)",
       fraud_psi=VIEWS["psi_fraud"][1]))
def maturity_report(v):
    """Coverage is that of all vectors of a domain; the stability of the fraud domain is measured, that of the others unknown."""
    signals = maturity.maturity_signals(v.all_predictions, NOW)
    vectors = {"fraud": fraud_vector_of(v), "aml": aml_vector_of(v), "merchant": merchant_vector_of(v)}
    coverage = reduce(DataFrame.unionByName, [settle(vector.mean_coverage(x, d)) for d, x in vectors.items()]).withColumnRenamed("coverage", "feature_coverage")
    psi = score_psi(*v.halves).select(F.lit("fraud").alias("domain"), "psi")
    stale = maturity.feature_staleness(v.all_predictions.select("domain", F.col("created_us").alias("us")), NOW + 2 * K.DAY)
    return maturity.maturity_report(signals, coverage, psi, stale)


# ---- reports -----------------------------------------------------------------------------
START, END = T0 + 5 * K.DAY, T0 + 20 * K.DAY


@query("sar_report", using("p_aml cases", f"""
  SELECT p.prediction_id, p.transaction_id, p.user_id, score, level, decision, case_id, status AS case_status, trigger_reason, p.created_us
  FROM p_aml p LEFT JOIN (SELECT case_id, entity_id, status, trigger_reason FROM cases UNION ALL SELECT case_id + 500000000, entity_id, 'OPEN', 'SECOND' FROM cases WHERE case_id % 3 = 0) c
       ON c.entity_id = p.transaction_id WHERE score >= 0.70::DOUBLE AND p.created_us BETWEEN {START} AND {END}"""))
def sar_report(v):
    c = v.cases.select("case_id", "entity_id", "status", "trigger_reason")
    second = c.filter("case_id % 3 = 0").select((F.col("case_id") + 500_000_000).alias("case_id"), "entity_id", F.lit("OPEN").alias("status"), F.lit("SECOND").alias("trigger_reason"))
    return reports.sar_report(v.predictions("aml"), c.unionByName(second), START, END)


@query("str_report", using("p_aml", f"""
  SELECT prediction_id, transaction_id, user_id, score, level, decision, created_us FROM p_aml WHERE decision IN ('BLOCK', 'REVIEW') AND created_us BETWEEN {START} AND {END}"""))
def str_report(v):
    return reports.str_report(v.predictions("aml"), START, END)


# --- fixed values: amount bands (name, upper bound in money units) ---------------------
AMOUNT_BANDS = [("Under 5K", 5_000.0), ("5K-50K", 50_000.0), ("50K-500K", 500_000.0), ("Over 500K", None)]


@query("amount_bands", using("txn", """
  SELECT CASE WHEN amount < 5000 THEN 'Under 5K' WHEN amount < 50000 THEN '5K-50K' WHEN amount < 500000 THEN '50K-500K' ELSE 'Over 500K' END AS band, count(*) AS n,
         sum(cents)::BIGINT::DOUBLE / count(*) / 100.0::DOUBLE AS avg_amount, min(amount) AS min_amount, max(amount) AS max_amount FROM txn GROUP BY 1"""))
def amount_bands(v):
    return reports.amount_bands(v.txn, AMOUNT_BANDS)


@query("risk_distribution", using("p_fraud", """
  SELECT level, count(*) AS n, CASE level WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END::BIGINT AS position FROM p_fraud GROUP BY level"""))
def risk_distribution(v):
    return reports.risk_distribution(v.predictions("fraud"))


@query("channel_mix", using("txn", "SELECT type AS channel, count(*) AS n, round(count(*) * 100 / (SELECT count(*) FROM txn)::DOUBLE, 1) AS percent FROM txn GROUP BY type"))
def channel_mix(v):
    return reports.channel_mix(v.txn)


@query("entity_counts", using("txn cases", """
  SELECT 'transactions' AS entity, count(*) AS n FROM txn UNION ALL SELECT 'cases', count(*) FROM cases
  UNION ALL SELECT 'customers', count(*) FROM customer UNION ALL SELECT 'merchants', count(*) FROM supplier UNION ALL SELECT 'orders', count(*) FROM orders"""))
def entity_counts(v):
    return reports.entity_counts({"transactions": v.txn, "cases": v.cases, "customers": v.table("customer"), "merchants": v.table("supplier"), "orders": v.table("orders")})
