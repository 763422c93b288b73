"""Alert fan-out, alert pages and the audit of thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .labels import page


def alert_fanout(alerts: DataFrame) -> DataFrame:
    """One row per channel that an alert's severity calls for."""
    channels = F.array(*[F.lit(c) for c in K.ALERT_CHANNELS_OTHER])
    for severity, names in K.ALERT_CHANNELS.items():
        channels = F.when(F.col("severity") == severity, F.array(*[F.lit(c) for c in names])).otherwise(channels)
    return alerts.select("*", F.explode(channels).alias("channel"))


def alert_page(log: DataFrame, alert_type: str | None = None, severity: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    if alert_type is not None:
        log = log.filter(F.col("alert_type") == alert_type)
    if severity is not None:
        log = log.filter(F.col("severity") == severity)
    return page(log, [F.col("us").desc(), F.col("alert_id").desc()], limit, offset)


def threshold_history(audit: DataFrame, model_type: str, limit: int = 50) -> DataFrame:
    return page(audit.filter(F.col("model_type") == model_type), [F.col("changed_us").desc(), "threshold"], limit)


def threshold_audit(old: DataFrame, new: DataFrame, names: list[str], key: str = "model_type") -> DataFrame:
    """Changed thresholds with old and new value, for rows whose new thresholds ascend in ``names`` order."""
    ordered = F.lit(True)
    for a, b in zip(names, names[1:]):
        ordered = ordered & (F.col(a) < F.col(b))
    before = old.select(key, *names).unpivot([key], names, "threshold", "old_value")
    after = new.filter(ordered).select(key, *names).unpivot([key], names, "threshold", "new_value")
    return before.join(after, [key, "threshold"]).filter(F.col("old_value") != F.col("new_value"))
