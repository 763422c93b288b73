"""Session settings the operators rely on, and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings every operator assumes.

    Only settings that change meaning or skew handling are touched; memory,
    parallelism and shuffle width stay with whoever started the session.
    """
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    _reach_workers(spark)
    return spark


def _reach_workers(spark: SparkSession) -> None:
    """Let Python workers on this machine import the package; on a cluster ship it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, env.get("PYTHONPATH", "")) if p)


def checkpoint_folder(spark: SparkSession) -> str:
    """Folder for checkpoints: the cluster's own setting when there is one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if named:
        if current is None:
            sc.setCheckpointDir(named)
        return named
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        current = tempfile.mkdtemp(prefix="paywarden-ckpt-")
        sc.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the reliable checkpoint folder and forget its lineage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freeing(spark: SparkSession) -> Iterator[None]:
    """What is run and ended inside gives back its shuffle files at once (Spark 4.1; without effect before it).

    Otherwise they stay until the driver collects garbage. Only for frames that are not run again: their shuffles would be written again.
    """
    was = spark.conf.get(FREE, None)
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE) if was is None else spark.conf.set(FREE, was)


def settle(df: DataFrame) -> DataFrame:
    """:func:`cut` for a few rows that took much to make: gives back the shuffle files behind them."""
    with freeing(df.sparkSession):
        return cut(df.select("*"))  # a frame takes the setting when it is made
