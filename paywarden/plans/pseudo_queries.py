"""Pseudo-label and co-training selection queries over the given tables."""

from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import pseudo
from ..sources.views import _cycle
from .feature_queries import fraud_vector_of
from ..sources import store as table_store
from .registry import query
from .source_queries import _scratch
from .sqlviews import VIEWS, using

I = "prediction_id"


def _p(n, m):
    return F.pmod(F.col(I) * n, F.lit(m)) / float(m)


@query("ssl_pool", using("p_fraud", """
  (SELECT 'labelled' AS part, prediction_id, label::BIGINT AS label FROM p_fraud WHERE label IS NOT NULL AND prediction_id % 6 <> 0 ORDER BY created_us DESC, prediction_id DESC LIMIT 50000)
  UNION ALL (SELECT 'unlabelled', prediction_id, NULL FROM p_fraud WHERE label IS NULL AND prediction_id % 6 <> 0)"""))
def ssl_pool(v):
    p = v.predictions("fraud")
    snaps = p.filter("prediction_id % 6 <> 0").select(I, "amount")
    a, b = pseudo.ssl_pool(p, snaps)
    cols = [I, "label"]
    return a.select(F.lit("labelled").alias("part"), *cols).unionByName(b.select(F.lit("unlabelled").alias("part"), *cols))


@query("select_confident", using("p_fraud", """
  SELECT prediction_id, (p >= 0.97::DOUBLE)::BIGINT AS pseudo_label, CASE WHEN p >= 0.97::DOUBLE THEN p ELSE 1.0::DOUBLE - p END AS confidence
  FROM (SELECT prediction_id, (prediction_id * 29 % 1000) / 1000.0::DOUBLE AS p FROM p_fraud) WHERE p >= 0.97::DOUBLE OR p <= 0.03::DOUBLE"""))
def select_confident(v):
    pos, neg = pseudo.thresholds_at(1)
    return pseudo.select_confident(v.predictions("fraud").select(I, _p(29, 1000).alias("p")), pos, round(neg, 10)).select(I, "pseudo_label", "confidence")


@query("flip_rate", using("p_fraud", """
  SELECT count(*) AS common, count(*) FILTER (prediction_id % 13 = 0) AS flipped, count(*) FILTER (prediction_id % 13 = 0) / count(*)::DOUBLE AS flip_rate FROM p_fraud WHERE prediction_id % 2 = 0 AND prediction_id % 3 = 0"""))
def flip_rate(v):
    p = v.predictions("fraud")
    a = p.filter("prediction_id % 2 = 0").select(I, F.lit(0).alias("pseudo_label"))
    b = p.filter("prediction_id % 3 = 0").select(I, (F.col(I) % 13 == 0).cast("int").alias("pseudo_label"))
    return pseudo.flip_rate(a, b)


@query("guardrails", using("txn", """
  SELECT txn_id, n_pseudo / greatest(n_labelled, 1)::DOUBLE AS ratio, (n_pseudo / greatest(n_labelled, 1)::DOUBLE <= 3.0 AND flip_rate <= 0.10::DOUBLE)::BIGINT AS safe
  FROM (SELECT txn_id, txn_id % 300 AS n_labelled, txn_id * 7 % 900 AS n_pseudo, (txn_id % 20) / 100.0::DOUBLE AS flip_rate FROM txn)"""))
def guardrails(v):
    i = F.col("txn_id")
    r = v.txn.select("txn_id", (i % 300).alias("n_labelled"), (i * 7 % 900).alias("n_pseudo"), (i % 20 / 100.0).alias("flip_rate"))
    return pseudo.guardrails(r).select("txn_id", "ratio", "safe")


@query("keep_most_confident", using("p_fraud", """
  SELECT prediction_id, confidence FROM (SELECT prediction_id, (prediction_id * 29 % 1000) / 1000.0::DOUBLE AS confidence FROM p_fraud) ORDER BY confidence DESC, prediction_id LIMIT 600"""))
def keep_most_confident(v):
    return pseudo.keep_most_confident(v.predictions("fraud").select(I, _p(29, 1000).alias("confidence")), 200)


VIEWS["noisy"] = (["p_fraud"], """
      SELECT prediction_id, p FROM (SELECT prediction_id, unnest([1, 2, 3, 4, 5]) AS copy FROM p_fraud), LATERAL (SELECT ((prediction_id * 31 + copy * copy * (prediction_id % 17)) % 256) / 256.0::DOUBLE AS p)""")


@query("consistency_select", using("noisy", """
  SELECT prediction_id, round(mean, 6) AS mean, variance, (mean >= 0.5)::BIGINT AS pseudo_label
  FROM (SELECT prediction_id, mean, variance, quantile_cont(variance, 0.5) OVER () AS m FROM (SELECT prediction_id, avg(p) AS mean, round(var_pop(p), 9) AS variance FROM noisy GROUP BY prediction_id))
  WHERE variance < m"""))
def consistency_select(v):
    """Scores of five copies, by arithmetic, with exact binary fractions."""
    c = v.predictions("fraud").select(I, F.explode(F.sequence(F.lit(1), F.lit(5))).alias("copy"))
    i, k = F.col(I), F.col("copy")
    return pseudo.consistency_select(c.select(I, "copy", (F.pmod(i * 31 + k * k * (i % 17), F.lit(256)) / 256.0).alias("p")))


@query("sharpen", using("p_fraud", "SELECT prediction_id, round(pow(score, 2.0) / (pow(score, 2.0) + pow(1.0::DOUBLE - score, 2.0)), 8) AS sharp FROM p_fraud"))
def sharpen(v):
    return v.predictions("fraud").select(I, F.round(pseudo.sharpen(F.col("score")), 8).alias("sharp"))


@query("feature_views", using("fv", " UNION ALL ".join(
    f"SELECT '{name}' AS view, txn_id, round({' + '.join(cols)}, 4) AS total, {len(cols)}::BIGINT AS width FROM fv" for name, cols in K.FEATURE_VIEWS["fraud"].items())))
def feature_views(v):
    """Each view reduced to the sum of its columns."""
    from functools import reduce

    out = []
    for name, df in pseudo.feature_views(fraud_vector_of(v), "fraud", ["txn_id"]).items():
        cols = [F.col(c) for c in df.columns if c != "txn_id"]
        out.append(df.select(F.lit(name).alias("view"), "txn_id", F.round(reduce(lambda a, b: a + b, cols), 4).alias("total"), F.lit(len(cols)).alias("width")))
    return reduce(lambda a, b: a.unionByName(b), out)


VIEWS["votes"] = (["p_fraud"], """
      SELECT prediction_id, a, CASE WHEN prediction_id % 4 = 0 THEN a * a ELSE a END AS b, CASE WHEN prediction_id % 7 = 0 THEN 1.0::DOUBLE - a ELSE a END AS c
      FROM (SELECT prediction_id, (prediction_id * 43 % 512) / 512.0::DOUBLE AS a FROM p_fraud)""")


def votes(v):
    i, a = F.col(I), F.col("a")
    return v.predictions("fraud").select(I, _p(43, 512).alias("a")).select(
        I, "a", F.when(i % 4 == 0, a * a).otherwise(a).alias("b"), F.when(i % 7 == 0, 1.0 - a).otherwise(a).alias("c"))


@query("multi_view_agreement", using("votes", """
  SELECT prediction_id, pseudo_label, rank FROM (SELECT *, row_number() OVER (PARTITION BY pseudo_label ORDER BY abs(mean - 0.5) DESC, prediction_id) AS rank
    FROM (SELECT *, CASE WHEN mean >= 0.9::DOUBLE THEN 1 WHEN mean <= 0.1::DOUBLE THEN 0 END::BIGINT AS pseudo_label,
                 sqrt((pow(a - mean, 2.0) + pow(b - mean, 2.0) + pow(c - mean, 2.0)) / 3.0::DOUBLE) AS std FROM (SELECT *, (a + b + c) / 3.0::DOUBLE AS mean FROM votes))
    WHERE std < 1.0::DOUBLE - 0.9::DOUBLE AND pseudo_label IS NOT NULL) WHERE rank <= 100"""))
def multi_view_agreement(v):
    return pseudo.multi_view_agreement(votes(v), ["a", "b", "c"], top=100).select(I, "pseudo_label", "rank")


def _tri(who, x, y):
    return f"SELECT '{who}' AS learner, prediction_id, ({x} + {y}) / 2.0::DOUBLE AS mean, ({x} >= 0.5)::BIGINT AS pseudo_label FROM votes WHERE ({x} >= 0.5) = ({y} >= 0.5)"


@query("tri_training_agreement", using("votes", f"""
  SELECT learner, prediction_id, pseudo_label, rank FROM (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY abs(mean - 0.5) DESC, prediction_id) AS rank
    FROM ({_tri('a', 'b', 'c')} UNION ALL {_tri('b', 'a', 'c')} UNION ALL {_tri('c', 'a', 'b')}) WHERE mean >= 0.8::DOUBLE OR mean <= 0.2::DOUBLE) WHERE rank <= 200"""))
def tri_training_agreement(v):
    return pseudo.tri_training_agreement(votes(v), ["a", "b", "c"], top=200).select("learner", I, "pseudo_label", "rank")


@query("view_disagreement", using("votes", "SELECT (count(*) FILTER ((a >= 0.5) <> (c >= 0.5))) / count(*)::DOUBLE AS disagreement FROM votes"))
def view_disagreement(v):
    return pseudo.disagreement(votes(v), "a", "c")


# ---- cross-domain transfer ---------------------------------------------------------------
def existing_transfers(v):
    f = v.predictions("fraud").filter("prediction_id % 36 = 0").select(F.lit("fraud").alias("source_domain"), F.lit("aml").alias("target_domain"), F.col(I).alias("source_id"))
    m = v.predictions("merchant").filter("prediction_id % 60 = 0").select(F.lit("merchant").alias("source_domain"), F.lit("fraud").alias("target_domain"), F.col(I).alias("source_id"))
    return f.unionByName(m)


VIEWS["existing"] = (["p_fraud", "p_merchant"], """
      SELECT 'fraud' AS source_domain, 'aml' AS target_domain, prediction_id AS source_id FROM p_fraud WHERE prediction_id % 36 = 0
      UNION ALL SELECT 'merchant', 'fraud', prediction_id FROM p_merchant WHERE prediction_id % 60 = 0""")


def _transfer_sql(s, t, decay):
    return f"""SELECT '{s}' AS source_domain, '{t}' AS target_domain, x.prediction_id AS source_id, y.prediction_id AS target_id, 1::BIGINT AS transferred_label, {decay}::DOUBLE AS confidence_decay
      FROM (SELECT *, row_number() OVER (ORDER BY labeled_us DESC NULLS LAST, prediction_id DESC) AS rn FROM p_{s} WHERE label = 1
            AND prediction_id NOT IN (SELECT source_id FROM existing WHERE target_domain = '{t}')) x
      JOIN (SELECT * FROM p_{t} WHERE label IS NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY created_us DESC, prediction_id DESC) = 1) y ON y.entity_id = x.entity_id
      WHERE rn <= (SELECT greatest(10, floor(count(label) * 0.20::DOUBLE)) FROM p_{t}) - (SELECT count(*) FROM existing WHERE source_domain = '{s}' AND target_domain = '{t}')"""


VIEWS["moved"] = (["existing", "p_aml"], " UNION ALL ".join(_transfer_sql(*r) for r in K.TRANSFER_RULES))


def transfers(v):
    return pseudo.cross_domain_transfer({d: v.predictions(d) for d in ("fraud", "aml", "merchant")}, existing_transfers(v))


@query("cross_domain_transfer", using("moved", "SELECT * FROM moved"))
def cross_domain_transfer(v):
    return transfers(v)


@query("transfer_training_rows", using("moved txn", """
  SELECT source_id, target_id, transferred_label AS label, confidence_decay AS weight, amount FROM moved JOIN txn ON txn_id = target_id WHERE target_domain = 'merchant'"""))
def transfer_training_rows(v):
    t = transfers(v).withColumn("created_us", F.col("source_id"))
    return pseudo.transfer_training_rows(t, v.predictions("merchant").select(I, "amount"), "merchant")


@query("transfer_stats", using("moved", """
  SELECT coalesce(source_domain, 'ALL') AS source_domain, coalesce(target_domain, 'ALL') AS target_domain, count(*) AS n,
         sum(round(confidence_decay * 1000)::BIGINT)::BIGINT / count(*) / 1000.0::DOUBLE AS avg_decay, max(source_id) AS last_us FROM moved GROUP BY GROUPING SETS ((source_domain, target_domain), ())"""))
def transfer_stats(v):
    return pseudo.transfer_stats(transfers(v).withColumn("created_us", F.col("source_id")))


# ---- pseudo-label store --------------------------------------------------------------------
def store(v):
    """Pseudo-labels of three techniques for most predictions."""
    i = F.col(I)
    p = v.all_predictions.filter(F.pmod(i, F.lit(3)) != 0)
    return p.select("domain", I, _cycle(["SELF_TRAINING", "MIXMATCH", "TRI_TRAINING"], F.pmod(F.floor(i / 3), F.lit(3))).alias("source"),
                    F.pmod(F.floor(i / 8), F.lit(2)).cast("int").alias("pseudo_label"), (F.pmod(i * 19, F.lit(5000)) / 10000.0 + 0.5).alias("confidence"), F.col("label").alias("human"))


VIEWS["store"] = (["p_all"], """
      SELECT domain, prediction_id, list_extract(['SELF_TRAINING','MIXMATCH','TRI_TRAINING'], (prediction_id // 3) % 3 + 1) AS source, (prediction_id // 8) % 2 AS label,
             round((prediction_id * 19 % 5000) / 10000.0::DOUBLE + 0.5::DOUBLE, 4) AS confidence, label AS human FROM p_all WHERE prediction_id % 3 <> 0""")


def stored(v):
    s = store(v)
    return s.select("domain", I, "source", F.col("pseudo_label").alias("label"), F.round("confidence", 4).alias("confidence"), "human")


@query("pseudo_label_read", using("store", """
  SELECT prediction_id, label, confidence FROM store WHERE domain = 'aml' AND source = 'MIXMATCH' AND confidence >= 0.9::DOUBLE"""))
def pseudo_label_read(v):
    """Rows as a training run would store them, read back by confidence."""
    s = store(v).filter("domain = 'aml'")
    rows = [pseudo.pseudo_label_rows(s.filter(F.col("source") == t), "aml", t, 1) for t in ("SELF_TRAINING", "MIXMATCH", "TRI_TRAINING")]
    return pseudo.pseudo_label_read(rows[0].unionByName(rows[1]).unionByName(rows[2]), "aml", "MIXMATCH", 0.9).select(I, "label", "confidence")


@query("validate_pseudo", using("store", """
  SELECT count(*) AS validated, count(*) FILTER (label = human) AS correct, count(*) - count(*) FILTER (label = human) AS incorrect, (count(*) FILTER (label = human)) / count(*)::DOUBLE AS accuracy
  FROM store WHERE human IS NOT NULL"""))
def validate_pseudo(v):
    human = v.all_predictions.filter("label is not null").select(I, "domain", "label")
    return pseudo.validation_counts(pseudo.validate_pseudo(stored(v).drop("human"), human))


def runs(v):
    """A training run for every fiftieth transaction."""
    i = F.col("txn_id")
    n = F.floor(i / 50)
    return v.txn.filter("txn_id % 50 = 0").select(
        i.alias("run_id"), _cycle(["fraud", "aml", "merchant"], F.pmod(n, F.lit(3))).alias("domain"), _cycle(["SELF_TRAINING", "MIXMATCH", "TRI_TRAINING", "MULTI_VIEW"], F.pmod(n, F.lit(4))).alias("technique"),
        "us", F.when(F.pmod(n, F.lit(5)) != 0, F.pmod(n * 7, F.lit(20)) / 100.0).alias("flip_rate"), ((F.pmod(n * 3, F.lit(100)) + 850) / 1000.0).alias("auc"))


VIEWS["runs"] = (["txn"], """
      SELECT txn_id AS run_id, list_extract(['fraud','aml','merchant'], n % 3 + 1) AS domain, list_extract(['SELF_TRAINING','MIXMATCH','TRI_TRAINING','MULTI_VIEW'], n % 4 + 1) AS technique, us,
             CASE WHEN n % 5 <> 0 THEN (n * 7 % 20) / 100.0::DOUBLE END AS flip_rate, (n * 3 % 100 + 850) / 1000.0::DOUBLE AS auc FROM (SELECT *, txn_id // 50 AS n FROM txn WHERE txn_id % 50 = 0)""")
VIEWS["pq"] = (["store", "runs"], """
      SELECT s.domain, total, validated, "right" / nullif(validated, 0)::DOUBLE AS validated_accuracy, s / total::DOUBLE / 10000.0::DOUBLE AS avg_confidence, technique_count,
             technique AS latest_technique, flip_rate AS latest_flip_rate, auc AS latest_auc
      FROM (SELECT domain, count(*) AS total, count(human) AS validated, count(*) FILTER (label = human) AS "right", sum(round(confidence * 10000)::BIGINT)::BIGINT AS s, count(DISTINCT source) AS technique_count FROM store GROUP BY domain) s
      LEFT JOIN (SELECT DISTINCT ON (domain) * FROM runs ORDER BY domain, us DESC, run_id DESC) r ON r.domain = s.domain""")


def quality(v):
    s = stored(v).withColumn("correct", F.when(F.col("human").isNotNull(), (F.col("label") == F.col("human")).cast("int")))
    return pseudo.pseudo_quality(s, runs(v))


@query("pseudo_quality", using("pq", "SELECT * FROM pq"))
def pseudo_quality(v):
    return quality(v)


@query("flip_trend", using("runs", """
  SELECT domain, technique, flip_rate, run_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY us DESC, run_id DESC) AS rank FROM runs WHERE flip_rate IS NOT NULL) WHERE rank <= 10"""))
def flip_trend(v):
    return pseudo.flip_trend(runs(v)).select("domain", "technique", "flip_rate", "run_id", "rank")


@query("technique_latest", using("runs", "SELECT DISTINCT ON (domain, technique) domain, technique, run_id, flip_rate, auc FROM runs ORDER BY domain, technique, us DESC, run_id DESC"))
def technique_latest(v):
    return pseudo.technique_latest(runs(v)).select("domain", "technique", "run_id", "flip_rate", "auc")


@query("ssl_alerts", using("pq", """
  SELECT domain, 'LOW_PSEUDO_LABEL_ACCURACY' AS alert, validated_accuracy AS value, 0.85::DOUBLE AS threshold FROM pq WHERE validated_accuracy < 0.85
  UNION ALL SELECT domain, 'HIGH_FLIP_RATE', latest_flip_rate, 0.10::DOUBLE FROM pq WHERE latest_flip_rate > 0.10::DOUBLE"""))
def ssl_alerts(v):
    return pseudo.ssl_alerts(quality(v))


@query("ssl_plan", using("p_all", """
  SELECT domain, level, unnest(list_concat(['SELF_TRAINING','LABEL_SPREADING','CONSISTENCY'], CASE WHEN any_warm THEN ['MIXMATCH'] ELSE [] END,
         CASE WHEN level IN ('WARM', 'HOT') THEN ['MULTI_VIEW','TRI_TRAINING','CROSS_DOMAIN'] ELSE [] END)) AS technique
  FROM (SELECT *, bool_or(level IN ('WARM', 'HOT')) OVER () AS any_warm FROM (SELECT domain, CASE WHEN n < 100 THEN 'COLD' WHEN n < 1000 THEN 'WARMING' WHEN n < 10000 THEN 'WARM' ELSE 'HOT' END AS level
        FROM (SELECT domain, count(label) FILTER (domain <> 'aml' OR prediction_id % 3 = 0) AS n FROM p_all GROUP BY domain))) WHERE level <> 'COLD'"""))
def ssl_plan(v):
    """AML labels are thinned out so that its level differs."""
    keep = (F.col("domain") != "aml") | (F.pmod(I, F.lit(3)) == 0)
    return pseudo.ssl_plan(v.all_predictions.withColumn("label", F.when(keep, F.col("label"))))


@query("pseudo_label_store", using("p_fraud", """
  SELECT prediction_id, source, label, confidence, iteration FROM (
    SELECT *, row_number() OVER (PARTITION BY prediction_id, source ORDER BY iteration DESC) AS latest FROM (
      SELECT prediction_id, 'self_training' AS source, (p >= 0.9::DOUBLE)::BIGINT AS label, round(CASE WHEN p >= 0.9::DOUBLE THEN p ELSE 1.0::DOUBLE - p END, 4) AS confidence, iteration
      FROM (SELECT prediction_id, (prediction_id * 29 % 1000) / 1000.0::DOUBLE AS p, 1 AS iteration FROM p_fraud UNION ALL
            SELECT prediction_id, (prediction_id * 31 % 1000) / 1000.0::DOUBLE, 2 FROM p_fraud WHERE prediction_id % 3 = 0) WHERE p >= 0.9::DOUBLE OR p <= 0.05::DOUBLE)) WHERE latest = 1"""))
def pseudo_label_store(v):
    """Pseudo-labels of two rounds, stored under their round and read back: the later round's replace the earlier one's. The second is written twice, as after a failure."""
    path = _scratch(v, "pseudo-labels")
    p = v.predictions("fraud")
    for round_, factor, part in ((1, 29, p), (2, 31, p.filter("prediction_id % 3 = 0")), (2, 31, p.filter("prediction_id % 3 = 0"))):
        chosen = pseudo.select_confident(part.select(I, _p(factor, 1000).alias("p")), 0.9, 0.05)
        rows = pseudo.pseudo_label_rows(chosen, "fraud", "self_training", round_).join(p.select(I, "created_us"), I)
        table_store.upsert(rows, path, ["domain", "source", I], round_)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return pseudo.pseudo_label_read(table_store.read(v.spark, path, schema), "fraud").select(I, "source", "label", "confidence", "iteration")
