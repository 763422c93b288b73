"""Change detection on ordered values with a window that forgets what came before a change."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.joins import top_per_group

ALERT_SCHEMA = "domain string, metric string, us long, id long, window_size int, old_mean double, new_mean double, magnitude double"
MIN_WINDOW = 50
MIN_WINDOW_POSITIVE = 100
#: Values of a window that are looked at together.
BLOCK = 128


class Window:
    """Adaptive window: the first split whose halves differ by more than the bound drops the older half.

    The bound is sqrt((1/left + 1/right) / 2 * ln(4/delta)), so a lower ``delta`` reacts later.
    """

    def __init__(self, values=(), delta: float = 0.002, smallest: int = MIN_WINDOW, largest: int = 10_000):
        self.values = np.array(list(values), dtype=float)
        self.smallest, self.largest = smallest, largest
        self.bound = 0.5 * math.log(4.0 / delta)

    def add(self, value: float) -> bool:
        self.values = np.append(self.values, value)[-self.largest:]
        n = len(self.values)
        if n < 2 * self.smallest:
            return False
        left = np.arange(self.smallest, n - self.smallest)
        if len(left) == 0:
            return False
        sums = np.cumsum(self.values)
        right = n - left
        gap = np.abs(sums[left - 1] / left - (sums[-1] - sums[left - 1]) / right)
        hit = gap >= np.sqrt((1.0 / left + 1.0 / right) * self.bound)
        if not hit.any():
            return False
        self.values = self.values[left[int(np.argmax(hit))]:]
        return True

    def add_until(self, values: np.ndarray) -> tuple[int, bool]:
        """Add ``values`` in order up to the first that :meth:`add` answers with True: (values added, whether there was one).

        Blocks of values are added at once where no split can hit. A split far from both ends of the window hardly moves while
        a block passes, and how far it can is bounded by the block's own sums; only the others are tried after every value.
        What comes near the bound is left to :meth:`add`, so that the answers are the same.
        """
        i = 0
        while i < len(values):
            block = values[i:i + BLOCK]
            k = self._first_near(block)
            self.values = np.append(self.values, block[:k])[-self.largest:]
            i += k
            if k < len(block):
                i += 1
                if self.add(float(block[k])):
                    return i, True
        return i, False

    def _first_near(self, block: np.ndarray) -> int:
        """How many values of ``block`` can be added before one with which some split may hit."""
        n, j = len(self.values), np.arange(1, len(block) + 1)
        both = np.append(self.values, block)
        if not np.isfinite(both).all() or n > self.largest:
            return 0
        start, end = np.maximum(0, n + j - self.largest), n + j
        splits = np.arange(start[0] + self.smallest, end[-1] - self.smallest)
        if not len(splits):
            return len(block)
        sums = np.concatenate([[0.0], np.cumsum(both)])
        room = 1e-9 * max(1.0, float(np.abs(both).max()))
        gone, came = start[-1], len(block)
        middle = sums[n] / n if n else 0.0
        old = np.abs(sums[:gone + 1] - middle * np.arange(gone + 1)).max()
        new = np.abs(sums[end] - sums[n] - middle * j).max()
        inner = splits[(splits > gone) & (splits < n)]
        left, right = sums[inner] / inner, (sums[n] - sums[inner]) / (n - inner)
        most = np.abs(left - right) + (old + gone * np.abs(middle - left)) / (inner - gone) + (new + came * np.abs(middle - right)) / (n - inner + 1)
        safe = most < np.sqrt((1.0 / inner + 1.0 / (n - inner + came)) * self.bound) - room
        tried = np.setdiff1d(splits, inner[safe], assume_unique=True)
        for a in range(0, len(block), 32):
            s, e = start[a:a + 32, None], end[a:a + 32, None]
            left, right = tried - s, e - tried
            valid = (left >= self.smallest) & (right > self.smallest)
            left, right = np.maximum(left, 1), np.maximum(right, 1)
            gap = np.abs((sums[tried] - sums[s]) / left - (sums[e] - sums[tried]) / right)
            near = (valid & (gap >= np.sqrt((1.0 / left + 1.0 / right) * self.bound) - room)).any(1)
            if near.any():
                return a + int(near.argmax())
        return len(block)


def smallest_window(metric: str) -> int:
    return MIN_WINDOW_POSITIVE if metric == "positive_rate" else MIN_WINDOW


def detect(key: tuple, rows: pd.DataFrame, window: Window) -> pd.DataFrame:
    """Alerts raised by ``rows`` (ordered by us, id); ``old_mean`` is the value that raised the alert."""
    out, us, ids, values, at = [], rows["us"].to_numpy(), rows["id"].to_numpy(), rows["value"].to_numpy(float), 0
    while at < len(values):
        n, hit = window.add_until(values[at:])
        at += n
        if hit:
            mean, value = float(window.values.mean()), float(values[at - 1])
            out.append((key[0], key[1], int(us[at - 1]), int(ids[at - 1]), len(window.values), value, mean, abs(value - mean)))
    return pd.DataFrame(out, columns=["domain", "metric", "us", "id", "window_size", "old_mean", "new_mean", "magnitude"])


def event_signals(scored: DataFrame, features: list[str] = ()) -> DataFrame:
    """(domain, us, id, values): every scored row with its watched metrics as an array of (metric, value).

    ``scored``: domain, us, id, score, decision, confidence (may be null) and the features.
    """
    c = F.col
    entries = [F.struct(F.lit("score_distribution").alias("metric"), c("score").alias("value")),
               F.when(c("confidence").isNotNull(), F.struct(F.lit("confidence").alias("metric"), c("confidence").alias("value"))),
               F.struct(F.lit("positive_rate").alias("metric"), c("decision").isin("BLOCK", "REVIEW").cast("double").alias("value"))]
    return scored.select("domain", "us", "id", F.array_compact(F.array(*entries, *_features(features))).alias("values"))


def feature_signals(rows: DataFrame, features: list[str]) -> DataFrame:
    """As :func:`event_signals`, of the features alone; ``rows``: domain, us, id and the features."""
    return rows.select("domain", "us", "id", F.array(*_features(features)).alias("values"))


def _features(features: list[str]) -> list:
    return [F.struct(F.lit(f"feature:{f}").alias("metric"), F.col(f).cast("double").alias("value")) for f in features]


def fan_out(events: DataFrame) -> DataFrame:
    """(domain, metric, us, id, value): one row for each watched value of ``events`` from above."""
    return events.select("domain", "us", "id", F.explode("values").alias("e")).select("domain", "us", "id", "e.metric", "e.value")


def signals(scored: DataFrame, features: list[str] = ()) -> DataFrame:
    """(domain, metric, us, id, value): every scored row as one value per watched metric, ``scored`` as in :func:`event_signals`."""
    return fan_out(event_signals(scored, features))


def adwin_batch(values: DataFrame, bucket_us: int, delta: float = 0.002) -> DataFrame:
    """Alerts over a stored table. The detector is sequential per (domain, metric), so rows are first
    reduced to the mean of every ``bucket_us`` of time: a key then has at most one value per bucket,
    bounded by the clock and not by the row count. The streaming form sees every value.
    """
    us = F.col("us") - F.pmod(F.col("us"), F.lit(bucket_us))
    means = values.groupBy("domain", "metric", us.alias("us")).agg(F.avg("value").alias("value"), F.max("id").alias("id"))

    def run(key, pdf):
        return detect(key, pdf.sort_values(["us", "id"]), Window(delta=delta, smallest=smallest_window(key[1])))

    return means.groupBy("domain", "metric").applyInPandas(run, ALERT_SCHEMA)


def monitor_status(values: DataFrame, alerts: DataFrame, last: int = 10) -> tuple[DataFrame, DataFrame]:
    """(totals and means per domain and metric, the newest alerts per domain)."""
    totals = values.groupBy("domain", "metric").agg(F.count(F.lit(1)).alias("events"), F.round(F.avg("value"), 6).alias("mean"))
    raised = alerts.groupBy("domain", "metric").agg(F.count(F.lit(1)).alias("alerts"))
    t = totals.join(raised, ["domain", "metric"], "left").withColumn("alerts", F.coalesce("alerts", F.lit(0)))
    return t, top_per_group(alerts, ["domain"], [F.col("us").desc(), F.col("metric"), F.col("id").desc()], last)
