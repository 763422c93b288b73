"""All registered queries."""

from . import asof_queries, feature_queries, graph_queries, job_queries, label_queries, monitoring_queries, pseudo_queries, scoring_queries, source_queries, streaming_queries, training_queries  # noqa: F401
from .registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLE)
