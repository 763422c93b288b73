"""Packed token-id matrices: best-fit decreasing with a segment tree over free capacity.

Each task packs the documents it reads in blocks of about ``block`` ids, so that nothing is shuffled and memory is bounded.
Within a block, pieces go longest first into the open sequence with the least room that still holds them; a segment tree
over the rooms (how many sequences have each free capacity) finds it in a logarithmic number of steps. Documents longer than
a sequence are cut losslessly. A row holds the ids of one sequence (little-endian, 16 bits where the vocabulary allows,
else 32), the documents and starts of its segments, cumulative lengths and where positions reset.

Edge cases: null and empty texts have the end id alone; repeated rows are packed each; ties go by arrival, which a scan of
the same files repeats; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import texts
from .packing import CAPACITY, cuts
from .tokens import END_ID, encoder

#: Ids packed together, four bytes each.
BLOCK = 2_000_000


class Rooms:
    """Segment tree over free capacities 0..capacity: finds the least room of at least a given size."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.at: dict[int, list[int]] = {}

    def _add(self, room: int, n: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += n
            i //= 2

    def put(self, room: int, sequence: int) -> None:
        self.at.setdefault(room, []).append(sequence)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Removes and returns (room, sequence) with the least room of at least ``least``."""
        i = least + self.size
        while not self.count[i]:
            while i & 1:  # a right child: everything to its right hangs further up
                i //= 2
            if not i:
                return None
            i += 1
            if i & (i - 1) == 0:  # past the last leaf of its level
                return None
        while i < self.size:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        self._add(room, -1)
        return room, self.at[room].pop()


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Sequences as lists of piece numbers."""
    rooms, out = Rooms(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if found := rooms.take(n):
            room, s = found
            out[s].append(i)
        else:
            room, s = capacity, len(out)
            out.append([i])
        rooms.put(room - n, s)
    return out


def positions(cumulative: list[int], starts: list[int] | None = None) -> np.ndarray:
    """Position ids of a row: from 0 (or the segment's start in its document) at each reset."""
    cu = np.asarray(cumulative)
    begin = np.repeat(cu[:-1], np.diff(cu))
    return np.arange(cu[-1]) - begin + (np.repeat(np.asarray(starts), np.diff(cu)) if starts is not None else 0)


def matrices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, end_id: int = END_ID, block: int = BLOCK, wide: bool = False) -> DataFrame:
    """Per sequence: sequence_id, n_tokens, ids (binary), doc_ids, starts, cu_seqlens, resets.

    ``starts`` are the segments' first positions in their documents, ``resets`` the offsets at which positions begin anew
    for another document. Ids take 16 bits, with ``wide`` 32; an id that does not fit raises an error.
    """
    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"sequence_id bigint, n_tokens bigint, ids binary, doc_ids array<{kind}>, starts array<bigint>, cu_seqlens array<bigint>, resets array<bigint>"
    names = ["sequence_id", "n_tokens", "ids", "doc_ids", "starts", "cu_seqlens", "resets"]
    end, width = int(end_id).to_bytes(4, "little"), "<u4" if wide else "<u2"

    def run(parts):
        e, base, made = encoder(path), TaskContext.get().partitionId() << 33, 0
        doc_type: list[pa.DataType] = []

        def packed(held):
            nonlocal made
            n, ids, docs_, starts, cu = [], [], [], [], []
            for seq in best_fit([len(h[2]) // 4 for h in held], capacity):
                n.append(sum(len(held[i][2]) for i in seq) // 4)
                own = np.frombuffer(b"".join(held[i][2] for i in seq), "<u4")
                if not wide and own.max() > 0xFFFF:
                    raise ValueError(f"id {own.max()} takes more than 16 bits: call with wide=True")
                ids.append(own.astype(width).tobytes())
                docs_.append([held[i][0] for i in seq])
                starts.append([held[i][1] for i in seq])
                cu.append(np.concatenate([[0], np.cumsum([len(held[i][2]) // 4 for i in seq])]).tolist())
            at = pa.array(range(base + made, base + made + len(n)), pa.int64())
            made += len(n)
            longs = pa.list_(pa.int64())
            return pa.RecordBatch.from_arrays([at, pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(docs_, pa.list_(doc_type[0])), pa.array(starts, longs), pa.array(cu, longs), pa.array([c[:-1] for c in cu], longs)], names=names)

        held, size = [], 0
        for part in parts:
            doc_type = [part.column(0).type]
            for doc, ids in zip(part.column(0).to_pylist(), e.encode_all(part.column(1).to_pylist()), strict=True):
                ids += end
                for s, k in cuts(len(ids) // 4, capacity):
                    held.append((doc, s, ids[4 * s:4 * (s + k)]))
                    size += k
                    if size >= block:
                        yield packed(held)
                        held, size = [], 0
        if held:
            yield packed(held)

    return rows.mapInArrow(run, schema)
