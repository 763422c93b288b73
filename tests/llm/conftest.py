import os

import pytest
from llm_cases import ROWS
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType()), T.StructField("bucket", T.StringType()), T.StructField("key", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ranges", T.StringType())])

@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, ties, repeats, very long texts, and columns whose names operators use themselves."""
    from paywarden.llm.common import ready

    return ready(spark).createDataFrame([(i, t, "en" if t else None, None if i == 6 else "s", None, "b", "k", 0.5, "r") for i, t in ROWS], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    from paywarden.llm.common import ready

    return ready(spark).createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def folder():
    return os.environ.get("TEST_SF_DIR", SF)


@pytest.fixture(scope="session")
def sample(spark, folder):
    from paywarden.llm.common import read

    return read(spark, folder, "documents")
