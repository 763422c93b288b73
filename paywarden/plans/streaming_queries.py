"""Streams over the given tables, run to their end, and the change-detection queries."""

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.constants import DAY
from ..functions.session import cut, freeing
from ..operators import adwin
from ..sources.views import fast_clock
from ..streaming import devices as stream_devices
from ..streaming import drift as stream_drift
from ..streaming import windows
from .feature_queries import aml_vector_of, fraud_vector_of, merchant_vector_of
from .registry import query
from .source_queries import _scratch
from .sqlviews import using


def streamed(v, df, name, make, mode="append", order=()):
    """Write ``df`` to files in time order (rows inside a file in that of ``order``), read them as a stream, apply ``make`` and return what it wrote."""
    src, out, ck = _scratch(v, f"{name}-in"), _scratch(v, f"{name}-out"), _scratch(v, f"{name}-state")
    middle = df.approxQuantile("us", [0.5], 0.01)[0]
    for part in (F.col("us") < middle, F.col("us") >= middle):  # the later half arrives later
        with freeing(v.spark):
            ranged = df.filter(part).repartitionByRange(2, "us")
            (ranged.sortWithinPartitions(*order) if order else ranged).write.mode("append").parquet(src)
    stream = v.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(src)
    result = make(stream)
    q = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", ck).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return v.spark.read.schema(result.schema).parquet(out)


@query("velocity_windows_stream")
def velocity_windows_stream(v):
    """Session totals from a stream; sessions still open at the end stay in the state."""
    t = v.dense.select("user_id", "us", "cents", F.timestamp_micros("us").alias("ts"))
    s = streamed(v, t, "sessions", lambda x: windows.session_totals(x, "1 hour", windows.LATENESS))
    return s.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", "cents")


@query("sliding_windows_stream")
def sliding_windows_stream(v):
    t = v.txn.select("user_id", "us", "cents", F.timestamp_micros("us").alias("ts"))
    s = streamed(v, t, "sliding", lambda x: windows.sliding_totals(x, "24 hours", "6 hours", windows.LATENESS))
    return s.select("user_id", F.unix_micros("start").alias("start_us"), "n", "cents")


@query("sliding_windows", using("txn", """
  SELECT user_id, start_us, count(*) AS n, sum(cents)::BIGINT AS cents
  FROM (SELECT user_id, cents, us - us % 21600000000 - step * 21600000000 AS start_us FROM txn, (SELECT unnest([0, 1, 2, 3]) AS step)) GROUP BY ALL"""))
def sliding_windows(v):
    s = windows.sliding_totals(v.txn.withColumn("ts", F.timestamp_micros("us")), "24 hours", "6 hours")
    return s.select("user_id", F.unix_micros("start").alias("start_us"), "n", "cents")


@query("new_devices_stream", using("txn", "SELECT txn_id, flag AS new_device_flag FROM walk WHERE txn_id IS NOT NULL", recursive=True,
       seq="SELECT txn_id, user_id, us, device, row_number() OVER (PARTITION BY user_id ORDER BY us, txn_id) AS rn FROM txn",
       walk=f"""SELECT DISTINCT user_id, 0::BIGINT AS rn, []::VARCHAR[] AS known, 0::BIGINT AS until, NULL::BIGINT AS txn_id, 0::BIGINT AS flag FROM seq
         UNION ALL SELECT user_id, rn, CASE WHEN fresh THEN list_append(known, device) ELSE known END, CASE WHEN fresh THEN us + {30 * DAY} ELSE until END, txn_id, fresh::BIGINT
         FROM (SELECT *, device IS NOT NULL AND NOT list_contains(known, device) AS fresh
               FROM (SELECT s.user_id, s.rn, s.us, s.device, s.txn_id, w.until, CASE WHEN s.us >= w.until THEN []::VARCHAR[] ELSE w.known END AS known
                     FROM walk w JOIN seq s ON s.user_id = w.user_id AND s.rn = w.rn + 1))"""))
def new_devices_stream(v):
    return streamed(v, v.txn.select("txn_id", "user_id", "device", "us"), "devices", stream_devices.new_devices).select("txn_id", "new_device_flag")


def scored_events(v, domain="fraud"):
    """Scores whose level jumps in the second half, so that there is a change to find."""
    p = v.predictions(domain)
    late = F.col("created_us") >= 1_705_363_200_000_000
    return p.select(F.lit(domain).alias("domain"), F.col("created_us").alias("us"), F.col("prediction_id").alias("id"),
                    F.when(late, 0.5 + F.col("score") / 2.0).otherwise(F.col("score")).alias("score"), "decision",
                    (F.pmod("prediction_id", F.lit(10)) / 10.0).alias("confidence"), "amount")


@query("drift_signals", using("p_fraud", """
  SELECT prediction_id AS id, unnest(['score_distribution', 'confidence', 'positive_rate', 'feature:amount']) AS metric,
         unnest([CASE WHEN created_us >= 1705363200000000 THEN 0.5::DOUBLE + score / 2.0::DOUBLE ELSE score END, (prediction_id % 10) / 10.0::DOUBLE, (decision IN ('BLOCK', 'REVIEW'))::INTEGER::DOUBLE, amount]) AS value FROM p_fraud"""))
def drift_signals(v):
    return adwin.signals(scored_events(v), ["amount"]).select("id", "metric", "value")


@query("adwin")
def adwin_alerts(v):
    """Over means of five minutes; the amount is scaled to a range the bound suits."""
    s = scored_events(v).withColumn("amount", F.col("amount") / 1_225_000.0)
    return adwin.adwin_batch(adwin.signals(s, ["amount"]), 300_000_000)


def watched_features(v, domain):
    """Every feature of the domain's vectors, at the time at which its transaction was scored."""
    of = {"fraud": fraud_vector_of, "aml": aml_vector_of, "merchant": merchant_vector_of}[domain]
    x = of(v, ["scored_us"], fast_clock(v.txn.withColumn("scored_us", F.col("us"))))
    return adwin.feature_signals(x.select(F.lit(domain).alias("domain"), F.col("scored_us").alias("us"), F.col("txn_id").alias("id"), *K.REGISTRY[domain]), K.REGISTRY[domain])


@query("stream_monitor")
def stream_monitor(v):
    """Scores, confidences, decisions and all features of the three domains' vectors, one detector each."""
    at = _scratch(v, "drift-events")
    for d in K.REGISTRY:
        for events in (adwin.event_signals(scored_events(v, d)), watched_features(v, d)):
            with freeing(v.spark):
                events.write.mode("append").parquet(at)
    return streamed(v, v.spark.read.parquet(at), "drift", lambda x: stream_drift.stream_monitor(adwin.fan_out(x)), order=("us", "id"))


@query("monitor_status")
def monitor_status(v):
    values = adwin.signals(scored_events(v))
    return adwin.monitor_status(values, cut(adwin.adwin_batch(values, 300_000_000)))[0]


@query("recent_drift_alerts")
def recent_drift_alerts(v):
    values = adwin.signals(scored_events(v))
    return adwin.monitor_status(values, cut(adwin.adwin_batch(values, 300_000_000)))[1]
