"""Drift, alert, fairness and validation queries over the given tables."""

from pyspark.sql import functions as F

from ..operators import alerts, drift, governance
from ..sources.views import T0, _cycle
from .registry import query
from .sqlviews import VIEWS, bin_sql, using

# ---- drift ----------------------------------------------------------------------
VIEWS["base_f"] = (["base_half"], "SELECT *, amount AS amount_f, (user_id % 40)::DOUBLE AS user_f, (prediction_id * 13 % 701) / 700.0::DOUBLE AS ratio_f FROM base_half")
VIEWS["cur_f"] = (["cur_half"], "SELECT *, amount * 1.5::DOUBLE AS amount_f, (user_id % 40)::DOUBLE AS user_f, (prediction_id * 17 % 701) / 900.0::DOUBLE AS ratio_f FROM cur_half")
FEATURES = ["amount_f", "user_f", "ratio_f", "score"]


def feature_halves(v):
    """Both halves of the month with features; the second half is shifted on purpose."""
    b, c = v.halves
    i = F.col("prediction_id")
    b = b.withColumn("amount_f", F.col("amount")).withColumn("user_f", F.pmod("user_id", F.lit(40)).cast("double")).withColumn("ratio_f", F.pmod(i * 13, F.lit(701)) / 700.0)
    c = c.withColumn("amount_f", F.col("amount") * 1.5).withColumn("user_f", F.pmod("user_id", F.lit(40)).cast("double")).withColumn("ratio_f", F.pmod(i * 17, F.lit(701)) / 900.0)
    conf = F.pmod(i * 7, F.lit(50)) / 100.0
    return b.withColumn("confidence", conf + 0.5), c.withColumn("confidence", conf + 0.35)


def _psi_sql(base, cur, add, bins=10):
    """PSI of column x over equal bins of [0, 1]."""
    hist = "SELECT " + bin_sql("x", "0.0::DOUBLE", "1.0::DOUBLE", str(bins)) + " AS bin, count(*) AS k FROM {} WHERE x BETWEEN 0 AND 1 GROUP BY 1"
    return f"""SELECT sum((pc - pb) * ln(pc / pb)) AS psi FROM (
      SELECT (coalesce(hb.k, 0) + {add}::DOUBLE) / ((SELECT sum(k) FROM ({hist.format(base)})) + {bins} * {add}::DOUBLE) AS pb,
             (coalesce(hc.k, 0) + {add}::DOUBLE) / ((SELECT sum(k) FROM ({hist.format(cur)})) + {bins} * {add}::DOUBLE) AS pc
      FROM range({bins}) r(bin) LEFT JOIN ({hist.format(base)}) hb USING (bin) LEFT JOIN ({hist.format(cur)}) hc USING (bin))"""


_XB, _XC = "(SELECT score AS x FROM base_f)", "(SELECT score * 1.1::DOUBLE AS x FROM cur_f)"


@query("score_psi", using("base_f cur_f", "SELECT round(psi, 6) AS psi FROM (" + _psi_sql(_XB, _XC, 1) + ")"))
def score_psi(v):
    b, c = feature_halves(v)
    return drift.score_psi(b, c.withColumn("score", F.col("score") * 1.1)).select(F.round("psi", 6).alias("psi"))


def _feature_psi_sql(f):
    b = bin_sql("v", "lo", "hi", "10")
    return f"""SELECT '{f}' AS feature, round(sum((pc - pb) * ln(pc / pb)), 6) AS psi FROM (
      SELECT (coalesce(max(k) FILTER (side = 'b'), 0) + 1) / ((SELECT count(*) FROM base_f) + 10)::DOUBLE AS pb, (coalesce(max(k) FILTER (side = 'c'), 0) + 1) / ((SELECT count(*) FROM cur_f) + 10)::DOUBLE AS pc
      FROM range(10) r(bin) LEFT JOIN (SELECT side, {b} AS bin, count(*) AS k FROM
        (SELECT *, min(v) OVER () AS lo, max(v) OVER () AS hi FROM (SELECT 'b' AS side, {f} AS v FROM base_f UNION ALL SELECT 'c', {f} FROM cur_f)) GROUP BY ALL) USING (bin) GROUP BY bin)"""


@query("feature_psi", using("base_f cur_f", " UNION ALL ".join(_feature_psi_sql(f) for f in FEATURES)))
def feature_psi(v):
    return drift.feature_psi(*feature_halves(v), FEATURES)


def _w_sql(f):
    return f"""SELECT sum(abs(fb / nb::DOUBLE - fc / nc::DOUBLE) * (nxt - v)) AS w FROM (
      SELECT v, sum(b) OVER (ORDER BY v) AS fb, sum(c) OVER (ORDER BY v) AS fc, lead(v) OVER (ORDER BY v) AS nxt
      FROM (SELECT v, sum(b) AS b, sum(1 - b) AS c FROM (SELECT {f} AS v, 1 AS b FROM base_f UNION ALL SELECT {f}, 0 FROM cur_f) GROUP BY v)),
      (SELECT count(*) AS nb FROM base_f), (SELECT count(*) AS nc FROM cur_f)"""


@query("wasserstein", using("base_f cur_f", f"SELECT round(w, 6) AS wasserstein FROM ({_w_sql('ratio_f')})"))
def wasserstein(v):
    return drift.wasserstein(*feature_halves(v), "ratio_f").select(F.round("wasserstein", 6).alias("wasserstein"))


@query("feature_wasserstein", using("base_f cur_f", " UNION ALL ".join(f"SELECT '{f}' AS feature, round(w, 4) AS wasserstein FROM ({_w_sql(f)})" for f in FEATURES)))
def feature_wasserstein(v):
    return drift.feature_wasserstein(*feature_halves(v), FEATURES, digits=4)


@query("confidence_drift", using("cur_f", """
  SELECT round(avg(c), 4) AS confidence_mean, round(stddev_pop(c), 4) AS confidence_std, round(0.745::DOUBLE - avg(c), 4) AS confidence_drop, (0.745 - avg(c) > 0.1)::BIGINT AS confidence_alert
  FROM (SELECT (prediction_id * 7 % 50) / 100.0::DOUBLE + 0.35::DOUBLE AS c FROM cur_f)"""))
def confidence_drift(v):
    return drift.confidence_drift(feature_halves(v)[1], 0.745)


VIEWS["rates"] = (["base_half", "cur_half"], """
      SELECT b.acc AS ba, b.rate AS br, c.acc AS ca, c.rate AS cr, c.delay FROM
      (SELECT avg((decision IN ('BLOCK', 'REVIEW'))::INTEGER = label) FILTER (label IS NOT NULL) AS acc, avg(label) AS rate FROM
         (SELECT decision, label FROM base_half)) b,
      (SELECT avg((decision IN ('BLOCK', 'REVIEW'))::INTEGER = label) FILTER (label IS NOT NULL) AS acc, avg(label) AS rate,
              (sum(labeled_us - created_us) FILTER (label IS NOT NULL))::DOUBLE / count(label)::DOUBLE / 3.6e9::DOUBLE AS delay FROM cur_half) c""".replace(
    "avg((decision IN ('BLOCK', 'REVIEW'))::INTEGER = label)", "avg(((decision IN ('BLOCK', 'REVIEW'))::INTEGER = label)::INTEGER)"))


@query("rate_and_accuracy_drift", using("rates", """
  SELECT round(ba - ca, 4) AS accuracy_drop, (ba - ca > 0.05)::BIGINT AS accuracy_alert, round(abs(cr - br) / greatest(br, 0.001), 4) AS rate_deviation,
         (abs(cr - br) / greatest(br, 0.001) > 0.15)::BIGINT AS rate_alert, round(delay, 2) AS label_delay_hours, (delay > 72)::BIGINT AS delay_alert FROM rates"""))
def rate_and_accuracy_drift(v):
    b, c = v.halves
    return drift.rate_and_accuracy_drift(b, c)


@query("drift_report", using("base_f cur_f rates", f"""
  SELECT 'v1' AS model_version, round(p, 4) AS psi, (p > 0.2)::BIGINT AS psi_alert, round(w, 4) AS wasserstein, (w > 0.1)::BIGINT AS wasserstein_alert,
         round(ba - ca, 4) AS accuracy_drop, round(abs(cr - br) / greatest(br, 0.001), 4) AS rate_deviation, round(delay, 2) AS label_delay_hours, round(0.745::DOUBLE - cm, 4) AS confidence_drop,
         (0.745 - cm > 0.1)::BIGINT AS confidence_alert, top AS top_drifting_features,
         (p > 0.2 OR w > 0.1 OR ba - ca > 0.05 OR abs(cr - br) / greatest(br, 0.001) > 0.15)::BIGINT AS retrain_recommended
  FROM (SELECT psi AS p FROM ({_psi_sql("(SELECT score AS x FROM base_f)", "(SELECT score AS x FROM cur_f)", 1)})), (SELECT w FROM ({_w_sql('score')})), rates,
       (SELECT avg((prediction_id * 7 % 50) / 100.0::DOUBLE + 0.35::DOUBLE) AS cm FROM cur_f),
       (SELECT coalesce(string_agg(feature, '|' ORDER BY psi DESC, feature), '') AS top FROM ({" UNION ALL ".join(_feature_psi_sql(f) for f in FEATURES)}) WHERE psi > 0.2)"""))
def drift_report(v):
    b, c = feature_halves(v)
    r = drift.drift_report(b, c, FEATURES, 0.745, "v1")
    return r.select("model_version", "psi", "psi_alert", "wasserstein", "wasserstein_alert", "accuracy_drop", "rate_deviation", "label_delay_hours", "confidence_drop",
                    "confidence_alert", "top_drifting_features", "retrain_recommended")


# ---- alerts ------------------------------------------------------------------------
def alert_log(v):
    """One alert per error event, severity by its number."""
    i = F.col("txn_id")
    return v.txn.filter("type = 'ERROR'").select(
        i.alias("alert_id"), "us", _cycle(["CRITICAL", "WARNING", "INFO"], F.pmod(i, F.lit(3))).alias("severity"),
        _cycle(["DRIFT", "LATENCY"], F.pmod(F.floor(i / 3), F.lit(2))).alias("alert_type"))


VIEWS["alert_log"] = (["txn"], """
      SELECT txn_id AS alert_id, us, list_extract(['CRITICAL','WARNING','INFO'], txn_id % 3 + 1) AS severity, list_extract(['DRIFT','LATENCY'], (txn_id // 3) % 2 + 1) AS alert_type
      FROM txn WHERE type = 'ERROR'""")


@query("alert_fanout", using("alert_log", """
  SELECT alert_id, severity, unnest(CASE severity WHEN 'CRITICAL' THEN ['SLACK','PAGERDUTY','KAFKA'] WHEN 'WARNING' THEN ['SLACK','KAFKA'] ELSE ['KAFKA'] END) AS channel FROM alert_log"""))
def alert_fanout(v):
    return alerts.alert_fanout(alert_log(v)).select("alert_id", "severity", "channel")


@query("alert_page", using("alert_log", """
  SELECT alert_id, us, severity, alert_type, (SELECT count(*) FROM alert_log WHERE alert_type = 'DRIFT' AND severity = 'CRITICAL') AS total
  FROM alert_log WHERE alert_type = 'DRIFT' AND severity = 'CRITICAL' ORDER BY us DESC, alert_id DESC LIMIT 50"""))
def alert_page(v):
    return alerts.alert_page(alert_log(v), "DRIFT", "CRITICAL")


def thresholds(v, shift):
    """Thresholds per merchant; with ``shift`` some move, and some of those break the order."""
    m = F.col("merchant_id")
    base = v.merchants.select(m.cast("string").alias("model_type"), (0.5 + F.pmod(m, F.lit(10)) / 100.0).alias("low"), F.lit(0.7).alias("mid"), F.lit(0.9).alias("high"), m)
    if shift:
        base = base.withColumn("low", F.when(m % 3 == 0, F.col("low") + 0.25).otherwise(F.col("low"))).withColumn(
            "high", F.when(m % 4 == 0, F.lit(0.95)).otherwise(F.col("high"))).withColumn("mid", F.when(m % 6 == 0, F.lit(0.85)).otherwise(F.col("mid")))
    return base.drop("merchant_id")


VIEWS["audit"] = (["merchants"], """
      SELECT model_type, threshold, old_value, new_value FROM (
        SELECT merchant_id::VARCHAR AS model_type, unnest(['low', 'mid', 'high']) AS threshold, unnest([l0, 0.7::DOUBLE, 0.9::DOUBLE]) AS old_value, unnest([l1, m1, h1]) AS new_value
        FROM (SELECT *, CASE WHEN merchant_id % 3 = 0 THEN l0 + 0.25::DOUBLE ELSE l0 END AS l1, CASE WHEN merchant_id % 6 = 0 THEN 0.85::DOUBLE ELSE 0.7::DOUBLE END AS m1,
                     CASE WHEN merchant_id % 4 = 0 THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END AS h1
              FROM (SELECT merchant_id, 0.5::DOUBLE + (merchant_id % 10) / 100.0::DOUBLE AS l0 FROM merchants)) WHERE l1 < m1 AND m1 < h1) WHERE old_value <> new_value""")


@query("threshold_audit", using("audit", "SELECT * FROM audit"))
def threshold_audit(v):
    return alerts.threshold_audit(thresholds(v, False), thresholds(v, True), ["low", "mid", "high"])


@query("threshold_history", using("audit", """
  SELECT model_type, threshold, new_value, T0 - model_type::BIGINT AS changed_us, (SELECT count(*) FROM audit WHERE model_type IN ('0', '6')) AS total
  FROM audit WHERE model_type IN ('0', '6') ORDER BY changed_us DESC, threshold LIMIT 50""".replace("T0", str(T0))))
def threshold_history(v):
    a = alerts.threshold_audit(thresholds(v, False), thresholds(v, True), ["low", "mid", "high"])
    a = a.withColumn("changed_us", F.lit(T0) - F.col("model_type").cast("long")).filter("model_type in ('0', '6')").withColumn("kind", F.lit("merchant"))
    return alerts.threshold_history(a.withColumnRenamed("model_type", "m").withColumnRenamed("kind", "model_type"), "merchant").select(
        F.col("m").alias("model_type"), "threshold", "new_value", "changed_us", "total")


# ---- fairness ---------------------------------------------------------------------------
VIEWS["preds"] = (["eval_set"], "SELECT *, (score >= 0.5::DOUBLE)::INTEGER AS pred, (doc_id // 50)::VARCHAR AS bucket FROM eval_set")


def preds(v):
    return v.eval_set.withColumn("pred", (F.col("score") >= 0.5).cast("int")).withColumn("bucket", F.floor(F.col("doc_id") / 50).cast("string"))


def _groups_sql(attr):
    return f"""SELECT {attr} AS "group", n, tp, fp, tn, fn, (tp + fp) / n::DOUBLE AS positive_rate, fp / greatest(fp + tn, 1)::DOUBLE AS fpr, fn / greatest(fn + tp, 1)::DOUBLE AS fnr,
         tp / greatest(tp + fn, 1)::DOUBLE AS tpr, tp / greatest(tp + fp, 1)::DOUBLE AS precision
      FROM (SELECT {attr}, count(*) AS n, count(*) FILTER (pred = 1 AND y = 1) AS tp, count(*) FILTER (pred = 1 AND y = 0) AS fp, count(*) FILTER (pred = 0 AND y = 0) AS tn,
                   count(*) FILTER (pred = 0 AND y = 1) AS fn FROM preds GROUP BY {attr})"""


VIEWS["g_lang"] = (["preds"], _groups_sql("lang"))
VIEWS["g_source"] = (["preds"], _groups_sql("source"))


def _ratios_sql(view):
    return f"""SELECT reference_group, least(1.0, coalesce(min(di), 1.0)) AS disparate_impact_ratio, least(1.0, coalesce(min(fp_), 1.0)) AS fpr_parity_ratio, least(1.0, coalesce(min(eo), 1.0)) AS equal_opportunity_ratio
      FROM (SELECT r."group" AS reference_group, CASE WHEN g."group" IS NULL THEN NULL WHEN r.n < 30 OR r.positive_rate = 0 THEN 1.0 WHEN g.positive_rate = 0 THEN 0.0 ELSE least(g.positive_rate / r.positive_rate, 1.0 / (g.positive_rate / r.positive_rate)) END AS di,
                   CASE WHEN g."group" IS NULL THEN NULL WHEN r.n < 30 OR greatest(g.fpr, r.fpr) = 0 THEN 1.0 ELSE least(g.fpr, r.fpr) / greatest(g.fpr, r.fpr) END AS fp_,
                   CASE WHEN g."group" IS NULL THEN NULL WHEN r.n < 30 OR r.tpr = 0 THEN 1.0 WHEN g.tpr = 0 THEN 0.0 ELSE least(g.tpr / r.tpr, 1.0 / (g.tpr / r.tpr)) END AS eo
            FROM (SELECT * FROM {view} ORDER BY n DESC, "group" LIMIT 1) r LEFT JOIN {view} g ON g.n >= 30 AND g."group" <> r."group") GROUP BY reference_group"""


@query("group_metrics", using("g_lang", "SELECT * FROM g_lang WHERE n >= 30"))
def group_metrics(v):
    return governance.group_metrics(preds(v), "lang")


@query("parity_ratios", using("g_lang", _ratios_sql("g_lang")))
def parity_ratios(v):
    return governance.parity_ratios(preds(v), "lang")


def _report_sql(attr):
    return f"""SELECT '{attr}' AS attribute, *, (disparate_impact_ratio >= 0.8 AND fpr_parity_ratio >= 0.8 AND equal_opportunity_ratio >= 0.8)::BIGINT AS passed,
      (SELECT count(*) FROM g_{attr} WHERE n < 30) AS small_groups,
      concat_ws('|',
                CASE WHEN disparate_impact_ratio < 0.8 THEN format('Disparate impact ratio {{:.3f}} below threshold 0.8', disparate_impact_ratio) END,
                CASE WHEN fpr_parity_ratio < 0.8 THEN format('FPR parity ratio {{:.3f}} below threshold 0.8', fpr_parity_ratio) END,
                CASE WHEN equal_opportunity_ratio < 0.8 THEN format('Equal opportunity ratio {{:.3f}} below threshold 0.8', equal_opportunity_ratio) END) AS warnings
      FROM ({_ratios_sql('g_' + attr)})"""


@query("bias_report", using("g_lang g_source", _report_sql("lang") + " UNION ALL " + _report_sql("source")))
def bias_report(v):
    return governance.bias_report(preds(v), ["lang", "source"])


def _small_sql(attr):
    return f"""SELECT '{attr}' AS attribute, "group", n, 'Group ''' || "group" || ''' has only ' || n || ' samples (min: 30)' AS warning FROM g_{attr} WHERE n < 30"""


VIEWS["g_bucket"] = (["preds"], _groups_sql("bucket"))


@query("bias_warnings", using("g_lang g_source g_bucket", " UNION ALL ".join(map(_small_sql, ("lang", "source", "bucket")))))
def bias_warnings(v):
    """Languages, sources, and a fine division that has small groups at every size."""
    return governance.bias_warnings(preds(v), ["lang", "source", "bucket"])


@query("bias_summary", using("g_lang g_source", f"""
  SELECT count(*) AS evaluations, min(passed) AS overall_pass, coalesce(string_agg(attribute, '|' ORDER BY attribute) FILTER (passed = 0), '') AS failing_attributes,
         sum(small_groups + CASE WHEN warnings = '' THEN 0 ELSE len(string_split(warnings, '|')) END)::BIGINT AS warnings
  FROM ({_report_sql("lang")} UNION ALL {_report_sql("source")})"""))
def bias_summary(v):
    return governance.bias_summary(governance.bias_report(preds(v), ["lang", "source"]))


# ---- validation ---------------------------------------------------------------------------
VIEWS["scored"] = (["p_fraud"], "SELECT *, label AS y, (score >= 0.5::DOUBLE)::INTEGER AS pred FROM p_fraud WHERE label IS NOT NULL")


def scored(v):
    return v.predictions("fraud").filter("label is not null").withColumn("y", F.col("label")).withColumn("pred", (F.col("score") >= 0.5).cast("int"))


AUC_SQL = """SELECT (SELECT sum(p * (2 * coalesce(below, 0) + q)) FROM (SELECT p, q, sum(q) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below
        FROM (SELECT score, count(*) FILTER (y = 1) AS p, count(*) FILTER (y = 0) AS q FROM scored GROUP BY score)))::DOUBLE / 2.0 / (positives::DOUBLE * negatives::DOUBLE) AS roc_auc, positives, negatives
      FROM (SELECT count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives FROM scored)"""


@query("roc_auc", using("scored", AUC_SQL))
def roc_auc(v):
    return governance.roc_auc(scored(v))


CLS_SQL = """SELECT n, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0.0)::DOUBLE AS precision, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0.0)::DOUBLE AS recall,
      coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0.0)::DOUBLE AS f1, (tp + tn) / n::DOUBLE AS accuracy
      FROM (SELECT count(*) AS n, count(*) FILTER (pred = 1 AND y = 1) AS tp, count(*) FILTER (pred = 1 AND y = 0) AS fp, count(*) FILTER (pred = 0 AND y = 0) AS tn,
                   count(*) FILTER (pred = 0 AND y = 1) AS fn FROM scored)"""


@query("classification_metrics", using("scored", CLS_SQL))
def classification_metrics(v):
    return governance.classification_metrics(scored(v))


@query("validation_psi", using("base_f cur_f", "SELECT round(psi, 6) AS psi, lo AS min_score, hi AS max_score, (lo >= 0 AND hi <= 1)::BIGINT AS in_range FROM ("
       + _psi_sql(_XB, _XC, "1e-6") + "), (SELECT min(score * 1.1::DOUBLE) AS lo, max(score * 1.1::DOUBLE) AS hi FROM cur_f)"))
def validation_psi(v):
    b, c = feature_halves(v)
    return governance.validation_psi(b, c.withColumn("score", F.col("score") * 1.1)).withColumn("psi", F.round("psi", 6))


VIEWS["quality"] = (["scored"], """
      SELECT count(*) AS n, (count(*) FILTER (prediction_id % 40 = 0))::DOUBLE / (count(*) * 3)::DOUBLE AS missing_rate, sum(y)::DOUBLE / count(*) AS positive_rate, 1::BIGINT AS constant_features FROM scored""")


def quality_input(v):
    return scored(v).withColumn("a", F.when(F.pmod("prediction_id", F.lit(40)) != 0, F.col("amount"))).withColumn("b", F.lit(1.0)).withColumn("c", F.col("score"))


@query("data_quality", using("quality", "SELECT n, missing_rate, round(positive_rate, 10) AS positive_rate, constant_features FROM quality"))
def data_quality(v):
    return governance.data_quality(quality_input(v), ["a", "b", "c"], "y").withColumn("positive_rate", F.round("positive_rate", 10))


@query("validation_report", using("scored quality base_f cur_f", """
  SELECT check_name, passed, round(actual, 6) AS actual, threshold, (SELECT min(passed) FROM checks) AS overall_pass FROM checks""",
  checks=f"""
    SELECT 'roc_auc' AS check_name, (roc_auc >= 0.90)::BIGINT AS passed, roc_auc AS actual, 0.90::DOUBLE AS threshold FROM ({AUC_SQL})
    UNION ALL SELECT 'precision', (precision >= 0.85)::BIGINT, precision, 0.85 FROM ({CLS_SQL}) UNION ALL SELECT 'recall', (recall >= 0.80)::BIGINT, recall, 0.80 FROM ({CLS_SQL})
    UNION ALL SELECT 'f1_score', 1, f1, NULL FROM ({CLS_SQL})
    UNION ALL SELECT 'sample_size', (n >= 1000)::BIGINT, n::DOUBLE, 1000.0 FROM quality UNION ALL SELECT 'missing_features', (missing_rate <= 0.05)::BIGINT, missing_rate, 0.05 FROM quality
    UNION ALL SELECT 'class_balance', (positive_rate > 0.001 AND positive_rate < 0.5)::BIGINT, positive_rate, NULL FROM quality UNION ALL SELECT 'feature_variance', (constant_features = 0)::BIGINT, constant_features::DOUBLE, NULL FROM quality
    UNION ALL SELECT 'score_drift_psi', (psi <= 0.20)::BIGINT, psi, 0.20 FROM ({_psi_sql("(SELECT score AS x FROM base_f)", "(SELECT score AS x FROM scored)", "1e-6")})
    UNION ALL SELECT 'score_range', 1, 1.0, NULL"""))
def validation_report(v):
    r = governance.validation_report(scored(v), feature_halves(v)[0], quality_input(v), ["a", "b", "c"])
    return r.withColumn("actual", F.round("actual", 6))


@query("deployment_gate", using("txn", """
  SELECT txn_id, (CASE job WHEN 'fraud' THEN roc_auc >= 0.92::DOUBLE AND precision >= 0.90::DOUBLE WHEN 'aml' THEN roc_auc >= 0.90::DOUBLE AND precision >= 0.88::DOUBLE ELSE roc_auc >= 0.90::DOUBLE END)::BIGINT AS accepted
  FROM (SELECT txn_id, list_extract(['fraud','aml','ssl'], txn_id % 3 + 1) AS job, (850 + txn_id % 150) / 1000.0::DOUBLE AS roc_auc, (800 + txn_id * 7 % 200) / 1000.0::DOUBLE AS precision FROM txn)"""))
def deployment_gate(v):
    i = F.col("txn_id")
    m = v.txn.select("txn_id", _cycle(["fraud", "aml", "ssl"], F.pmod(i, F.lit(3))).alias("job"), ((F.pmod(i, F.lit(150)) + 850) / 1000.0).alias("roc_auc"),
                     ((F.pmod(i * 7, F.lit(200)) + 800) / 1000.0).alias("precision"))
    return governance.deployment_gate(m).select("txn_id", "accepted")
