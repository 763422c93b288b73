"""What the text operators share: reading tables, column selection, batches."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import cut, prepare

__all__ = ["batches", "by_worker", "cut", "cut_in", "draw", "folded", "held_out", "kept", "mark_bits", "marked", "pieces_of", "read", "ready", "release", "texts"]

#: Rows and bytes in an Arrow batch. Texts are long, and a Python worker shares its executor's memory.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the library, and batches that suit long texts."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{folder}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``, so that further columns cannot clash with those an operator adds."""
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def folded(id_col: str, folds: int):
    """The fold of a row: crc32 of the id as text, modulo ``folds``; 0 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")), F.lit(folds)), F.lit(0))


def held_out(id_col: str, folds: int, fold: int):
    return folded(id_col, folds) == F.lit(fold)


def draw(*columns: str):
    """A number in [0, 1) that depends on the columns alone, fine enough to sample a few rows of any table."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 52)).cast("double") / float(1 << 52)


def batches(df: DataFrame, fn: Callable[[pa.RecordBatch], list], schema: str, setup: Callable[[], object] | None = None, keeps: bool = False) -> DataFrame:
    """``fn`` gets each Arrow batch (and what ``setup`` made once per task) and returns the output columns in order. What the
    worker keeps from earlier tasks is given back first, unless ``keeps``."""
    flat = schema
    while "<" in flat:  # commas inside nested types separate no columns
        flat = re.sub("<[^<>]*>", "", flat)
    names = [x.split()[0] for x in flat.split(",")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            release()
        state = setup() if setup else None
        for part in parts:
            if part.num_rows:
                cols = fn(part, state) if setup else fn(part)
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)

    return df.mapInArrow(run, schema)


def kept(df: DataFrame, text_col: str, keep: Callable[[list, object], list[bool]], setup: Callable[[], object]) -> DataFrame:
    """Rows of ``df``, with all their columns, whose text ``keep`` keeps; nothing is shuffled."""
    at = df.columns.index(text_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = setup()
        for part in parts:
            if part.num_rows:
                yield part.filter(pa.array(keep(part.column(at).to_pylist(), state), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def pieces_of(values: list, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose texts have about ``most`` characters; a longer text stands alone."""
    start = size = 0
    for i, v in enumerate(values):
        n = len(v)
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(values):
        yield start, len(values)


def cut_in(df: DataFrame, parts: int) -> DataFrame:
    """``cut``, with shuffles into as many tasks as the data ask for, the session's setting at least: what a task reads does not grow."""
    conf, name = df.sparkSession.conf, "spark.sql.shuffle.partitions"
    before = conf.get(name)
    conf.set(name, str(max(int(before), parts)))
    try:
        return cut(df)
    finally:
        conf.set(name, before)


_WORKER: dict[object, object] = {}


def by_worker(key: object, build: Callable[[], object]):
    """What a Python worker keeps from task to task: one thing at a time, so that a stage does not carry what another one needed."""
    if key not in _WORKER:
        release()
        _WORKER[key] = build()
    return _WORKER[key]


def release() -> None:
    """Give back what earlier tasks of this worker kept: freed memory stays with the process unless it is told to return it."""
    _WORKER.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


#: Bits of marks for each id (one in so many others seems marked by chance), and the most there may be: more ids share bits instead.
BITS_EACH, MOST_BITS = 64, 1 << 27


def mark_bits(ids: DataFrame, most: int = MOST_BITS) -> np.ndarray:
    """Bits in which the column ``id`` is marked, ``BITS_EACH`` for each where ``most`` allows it."""
    n = ids.count()
    bits = min(most, 1 << max(10, (BITS_EACH * n - 1).bit_length())) if n else 1 << 10
    bit = F.pmod("id", F.lit(bits))
    found = ids.groupBy(F.floor(bit / 64).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int"))).alias("m")).toPandas()  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.int64)
    out[found["w"].to_numpy(np.int64)] = found["m"].to_numpy(np.int64)
    return out.view(np.uint8)


def marked(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    at = ids & np.uint64(8 * len(bits) - 1)
    return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 != 0
