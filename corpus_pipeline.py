"""From raw documents to packed sequences, in stages that each read what the one before has written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paywarden.llm import pipeline_stages as stages

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.drop_toxic),
    ("ngram_jaccard_join", stages.drop_near_duplicates),
    ("benchmark_decontamination", stages.drop_contaminated),
    ("pii", stages.mask_personal_data),
    ("packing", stages.pack_documents),
]

#: The stages learn models and tokenise; SQL cannot express that, tests hold them against plain versions.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared one, or a local one where none is named."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='pipeline-')}/pipeline-{uuid.uuid4().hex}"


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written as Parquet and read again."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), _folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
    return docs
