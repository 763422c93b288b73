"""Validity of requests and of stored predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K


def _len(c: str) -> Column:
    return F.length(F.col(c))


def request_problems(domain: str) -> Column:
    """Names of the fields that break a rule; missing optional fields are fine."""
    c = F.col
    amount = (c("amount") >= 0) if domain == "merchant" else (c("amount") > 0)
    rules: list[tuple[Column, str]] = [
        (~F.coalesce(amount, F.lit(False)), "amount"), (F.coalesce(_len("currency") != 3, F.lit(True)), "currency"),
    ]
    if domain == "fraud":
        rules.append((~F.coalesce(_len("type").between(1, 50), F.lit(False)), "type"))
    if domain == "merchant":
        rules.append((F.coalesce(_len("mcc") > 10, F.lit(False)), "mcc"))
    else:
        rules += [(~F.coalesce(_len("country").between(2, 3), F.lit(True)), "country"), (~F.coalesce(c("lat").between(-90, 90), F.lit(True)), "lat"),
                  (~F.coalesce(c("lng").between(-180, 180), F.lit(True)), "lng"), (F.coalesce(_len("device") > 255, F.lit(False)), "device"),
                  (F.coalesce(_len("ip") > 45, F.lit(False)), "ip")]
    return F.array_compact(F.array(*[F.when(bad, F.lit(n)) for bad, n in rules]))


def label_problems() -> Column:
    return F.array_compact(F.array(F.when(~F.coalesce(F.col("label").isin(0, 1), F.lit(False)), "label")))


def validate_requests(df: DataFrame, problems: Column) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reasons)."""
    checked = df.withColumn("reasons", problems)
    return checked.filter(F.size("reasons") == 0).drop("reasons"), checked.filter(F.size("reasons") > 0)


def contract_check(predictions: DataFrame, thresholds: DataFrame, edges: DataFrame) -> DataFrame:
    """Violations per rule. ``thresholds``: approve, review, block; ``edges``: src, dst, edge_type."""
    c = F.col

    def broken(ok: Column) -> Column:
        return F.count_if(~F.coalesce(ok, F.lit(False)))

    p = predictions.agg(broken(c("score").between(0, 1)).alias("score_range"), broken(c("level").isin(K.LEVELS)).alias("level_enum"),
                        broken(c("decision").isin(K.DECISIONS)).alias("decision_enum"), broken(c("label").isNull() | c("label").isin(0, 1)).alias("label_values"))
    t = thresholds.agg(broken((c("approve") < c("review")) & (c("review") < c("block"))).alias("threshold_order"))
    e = edges.groupBy("src", "dst", "edge_type").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(c("n") > 1).alias("edge_unique"))
    frames = [f.unpivot([], f.columns, "rule", "violations") for f in (p, t, e)]
    return reduce(DataFrame.unionByName, frames)
