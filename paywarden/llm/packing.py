"""Packing by minimum bin slack.

A document's ids (with the end id) are cut into pieces of at most ``capacity``: full pieces, and a remainder. Full pieces
are sequences of their own. The rest is packed by minimum bin slack: the longest remaining piece opens a sequence, and a
subset-sum table over the remaining lengths (bitsets, bounded multiplicities) picks the multiset that fills it closest to
capacity; the counts are read back from the table. Lengths in the plan are counts, so a bucket costs the same however many
pieces have one length.

Scale: pieces are dealt by hash into buckets of about ``bucket`` pieces, packed alike and independently; a bucket is one
task's work and never grows. Only lengths and checksums are shuffled, never ids.

Edge cases: null and empty texts have the end id alone; repeated rows are packed each; texts longer than a sequence are cut
losslessly; an empty table gives no pieces; ties between pieces of one length go by doc_id, then start.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, texts
from .tokens import END_ID, encoder

CAPACITY = 4096
#: Pieces packed together.
BUCKET = 2048


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    return [(s, min(capacity, n - s)) for s in range(0, n, capacity)]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens."""
    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(part):
        e, row, out = encoder(path), [], []
        for i, ids in enumerate(e.encode_all(part.column(1).to_pylist())):
            ids += end
            n = len(ids) // 4
            for s, k in cuts(n, capacity):
                row.append(i)
                out.append((s, k, zlib.crc32(ids[4 * s:4 * (s + k)]), n))
        cols = np.array(out, np.int64).reshape(-1, 4)
        return [part.column(0).take(pa.array(row, pa.int64())), *(pa.array(cols[:, j]) for j in range(4))]

    return batches(rows, run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint", keeps=True)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Counts of lengths whose sum is the largest one up to ``capacity`` (not all zero unless nothing fits)."""
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= capacity), reverse=True):
        n, unit = min(counts[length], capacity // length), 1
        while n > 0:  # 1, 2, 4, ... copies together make every number of copies
            take = min(unit, n)
            steps.append((length, take, reach))
            reach |= (reach << (take * length)) & mask
            n, unit = n - take, unit * 2
        if reach >> capacity & 1:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            used[length] = used.get(length, 0) + take
            total -= take * length
    return used


def plan(lengths: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """Sequences as (counts of lengths, how often)."""
    values, n = np.unique(lengths, return_counts=True)
    left = dict(zip(values.tolist(), n.tolist(), strict=True))
    out = []
    while left:
        first = max(left)
        left[first] -= 1
        used = fill(left, capacity - first)
        left[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(left[x] // k for x, k in used.items())
        for x, k in used.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
        out.append((used, times))
    return out


def assign(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (numbered from 0) and offset of each piece, for pieces in their tie order."""
    order = np.argsort(lengths, kind="stable")
    values, begin = np.unique(lengths[order], return_index=True)
    at = dict(zip(values.tolist(), begin.tolist(), strict=True))
    sequence, offset, n = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for used, times in plan(lengths, capacity):
        place = 0
        for length in sorted(used, reverse=True):
            for _ in range(used[length]):
                i = order[at[length]:at[length] + times]
                sequence[i], offset[i] = np.arange(n, n + times), place
                at[length] += times
                place += length
        n += times
    return sequence, offset


def pack(found: DataFrame, capacity: int = CAPACITY, bucket: int = BUCKET) -> DataFrame:
    """``found`` (from ``pieces``) with sequence_id and offset."""
    kept = cut(found)  # tokenised once: it is counted, then packed
    parts = max(1, -(-kept.count() // bucket))
    dealt = kept.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)))
    kind = kept.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sequence, offset = assign(table.column("length").to_numpy(), capacity)
        return table.drop_columns(["bucket"]).append_column("sequence_id", pa.array(sequence + (table.column("bucket")[0].as_py() << 32))).append_column("offset", pa.array(offset))

    return dealt.groupBy("bucket").applyInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
