"""Change detection on a stream of scored events."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import adwin

STATE = "window array<double>"
PACKED = "domain string, metric string, us long, id long, last_us long, last_id long, n int, rows binary"
#: Stands for a time or id that is not known; comes last.
MISSING = 2**63 - 1
#: Values that a task gathers before it packs them.
GATHER = 400_000


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values of a task as one row for each (domain, metric): times, ids and values in order, compressed."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= GATHER:
            yield from _blocks(held)
            held, n = [], 0
    if n:
        yield from _blocks(held)


def _blocks(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(batches)
    domain, metric = (t[c].combine_chunks().dictionary_encode(null_encoding="encode") for c in ("domain", "metric"))
    us, ids = (t[c].fill_null(MISSING).to_numpy() for c in ("us", "id"))
    value = t["value"].to_numpy()  # null is NaN
    d, m = (x.indices.to_numpy(zero_copy_only=False) for x in (domain, metric))
    order = np.lexsort((ids, us, m, d))
    cuts = np.flatnonzero((np.diff(d[order]) != 0) | (np.diff(m[order]) != 0)) + 1
    out = []
    for g in np.split(order, cuts):
        u, i = us[g], ids[g]
        body = b"".join(np.ascontiguousarray(x).tobytes() for x in (np.diff(u, prepend=np.int64(0)), np.diff(i, prepend=np.int64(0)), value[g].astype("float64")))
        out.append((domain.dictionary[int(d[g[0]])].as_py(), metric.dictionary[int(m[g[0]])].as_py(), int(u[0]), int(i[0]), int(u[-1]), int(i[-1]), len(g), zlib.compress(body, 1)))
    names = ["domain", "metric", "us", "id", "last_us", "last_id", "n", "rows"]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)


def _unpack(n: int, rows: bytes) -> pd.DataFrame:
    body = zlib.decompress(rows)
    us, ids = (np.cumsum(np.frombuffer(body, "int64", n, 8 * n * k)) for k in (0, 1))
    return pd.DataFrame({"us": us, "id": ids, "value": np.frombuffer(body, "float64", n, 16 * n)})


def _in_order(blocks: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Rows of the blocks in (us, id) order, a few blocks at a time: those that overlap are put together first."""
    held, until = [], None
    for b in blocks.sort_values(["us", "id", "last_us", "last_id"]).itertuples():
        if held and (b.us, b.id) > until:
            yield _merged(held)
            held = []
        until = max(until, (b.last_us, b.last_id)) if held else (b.last_us, b.last_id)
        held.append(_unpack(b.n, b.rows))
    if held:
        yield _merged(held)


def _merged(frames: list[pd.DataFrame]) -> pd.DataFrame:
    return frames[0] if len(frames) == 1 else pd.concat(frames).sort_values(["us", "id"], kind="stable")


def _watch(delta: float):
    def run(key, batches, state: GroupState):
        window = adwin.Window(state.get[0] if state.exists else (), delta, adwin.smallest_window(key[1]))
        for rows in _in_order(pd.concat(list(batches))):  # one metric's packed values of one micro-batch
            alerts = adwin.detect(key, rows, window)
            if len(alerts):
                yield alerts.assign(**{c: alerts[c].astype("Int64").mask(alerts[c] == MISSING) for c in ("us", "id")})
        state.update((window.values.tolist(),))

    return run


def stream_monitor(values: DataFrame, delta: float = 0.002) -> DataFrame:
    """Alerts per (domain, metric). State is one window of at most 10,000 values per key; the size of a
    micro-batch is set at the source. ``values`` as from ``adwin.signals``.

    Values are shuffled as packed blocks and unpacked a few blocks at a time, so that a task holds a metric's micro-batch compressed.
    """
    packed = values.select("domain", "metric", "us", "id", "value").mapInArrow(_pack, PACKED)
    return packed.groupBy("domain", "metric").applyInPandasWithState(_watch(delta), adwin.ALERT_SCHEMA, STATE, "append", GroupStateTimeout.NoTimeout)
