"""Every query with a SQL form equals it; every other query runs and has rows."""

import os

import pytest
from check import compare, connect

import __spark_entry__ as entry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()
MAY_BE_EMPTY = {"validate_requests", "ssl_alerts", "ssl_plan", "threshold_history", "adwin", "stream_monitor", "recent_drift_alerts", "case_page", "queue_page",
                "circular_transfer_users", "keep_most_confident", "refresh_queue", "label_audit"}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, con, name):
    said = compare(name, QUERIES[name](spark, FOLDER), con, ORACLE[name])
    if said and said.endswith(": empty") and name in MAY_BE_EMPTY:
        return
    assert said is None, said


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    rows = QUERIES[name](spark, FOLDER).count()
    assert rows > 0 or name in MAY_BE_EMPTY


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_oracle_names_are_queries():
    assert set(ORACLE) <= set(QUERIES)
