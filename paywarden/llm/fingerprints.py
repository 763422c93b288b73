"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for every length, the polynomial hash of its beginning modulo two primes. Any two spans
are compared from it in constant time, and binary search over lengths finds how far two texts agree from two places (the
longest common extension). The hash of a text made of spans of others follows from their arrays, without hashing it again.

A fingerprint holds the length, the hash of the whole text, the hashes of the beginnings and of the ends at lengths of a
fixed grid (each a sixth longer than the one before), and the least hashes of spans of ``SPAN`` characters (from the same
array). Likeness of two fingerprints is the larger of two shares: what the longest common beginning and end (binary search
over the grids) cover of the longer text, and the share of common spans that the least hashes estimate; it is 1 for
fingerprints that are equal.

Edge cases: null counts as empty; an empty text is like an empty one (1) and like no other (0); texts are hashed whole,
however long; repeated rows have equal fingerprints; the next document of the last is the first (of a single document:
itself); equal ids follow one another by text, null ids come last; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

PRIMES = (2147483629, 2147483587)
BASES = (1103515245, 1664525)
#: Characters of a sketched span, and how many of the least span hashes a fingerprint keeps.
SPAN, SKETCH = 24, 32
_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """base^0 .. base^n for both primes, kept and doubled as needed."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = 1 << max(14, n.bit_length())
        _POWERS.clear()
        for p, b in zip(PRIMES, BASES, strict=True):
            out = np.ones(1, np.uint64)
            step = b % p
            while len(out) <= size:  # a block times the next power
                out = np.concatenate([out, out * np.uint64(step) % np.uint64(p)])
                step = step * step % p
            _POWERS.append(out)
    return _POWERS


class Prefix:
    """Prefix arrays of a text: sums of (code point + 1) * base^place, modulo both primes."""

    def __init__(self, text: str | None, arrays: list[np.ndarray] | None = None):
        if arrays is None:
            codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
            arrays = []
            for p, w in zip(PRIMES, powers(len(codes)), strict=True):
                sums = np.zeros(len(codes) + 1, np.uint64)
                np.cumsum(codes * w[:len(codes)] % np.uint64(p), out=sums[1:])
                arrays.append(sums % np.uint64(p))
        self.arrays = arrays

    def __len__(self) -> int:
        return len(self.arrays[0]) - 1

    def replaced_end(self, other: Prefix, n: int) -> Prefix:
        """The array of this text with its last ``n`` characters replaced by the first ``n`` (or all) of the other's."""
        keep, take = len(self) - n, min(n, len(other))
        return Prefix(None, [np.concatenate([a[:keep + 1], (a[keep] + b[1:take + 1] * w[keep]) % np.uint64(p)]) for p, w, a, b in zip(PRIMES, powers(len(self)), self.arrays, other.arrays, strict=True)])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of spans, equal for equal texts wherever they stand (both residues in 64 bits)."""
        out = np.zeros(len(start), np.uint64)
        top = len(self)
        for i, (p, a) in enumerate(zip(PRIMES, self.arrays, strict=True)):
            w = powers(top)[i]
            aligned = (a[end] + np.uint64(p) - a[start]) % np.uint64(p) * w[top - start] % np.uint64(p)
            # every span is brought to place ``top``; taking that back makes texts of different lengths comparable
            out = (out << np.uint64(32)) | (aligned * np.uint64(pow(int(w[top]), -1, p)) % np.uint64(p))
        return out

    def equal(self, i: int, j: int, n: int) -> bool:
        """Whether the ``n`` characters from ``i`` and from ``j`` are the same."""
        h = self.spans(np.array([i, j]), np.array([i + n, j + n]))
        return bool(h[0] == h[1])


def common_extension(a: Prefix, i: int, b: Prefix, j: int) -> int:
    """Longest n with equal spans a[i:i+n] and b[j:j+n], by binary search."""
    low, high = 0, min(len(a) - i, len(b) - j)
    while low < high:
        mid = (low + high + 1) // 2
        if a.spans(np.array([i]), np.array([i + mid]))[0] == b.spans(np.array([j]), np.array([j + mid]))[0]:
            low = mid
        else:
            high = mid - 1
    return low


_GRID: list[int] = []


def grid(n: int) -> np.ndarray:
    """Lengths 1, 2, ... that grow by a sixth, up to n."""
    while not _GRID or _GRID[-1] < n:
        last = _GRID[-1] if _GRID else 0
        _GRID.append(max(last + 1, last * 7 // 6))
    g = np.array(_GRID)
    return g[:np.searchsorted(g, n, "right")]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def fingerprint(h: Prefix) -> str:
    """length.whole.beginnings.ends.spans, hexadecimal."""
    n = len(h)
    g = grid(n)
    zero = np.zeros(len(g), np.int64)
    heads = _mixed(h.spans(zero, g)) >> np.uint64(40)
    tails = _mixed(h.spans(n - g, zero + n)) >> np.uint64(40)
    start = np.arange(max(1, n - SPAN + 1)) if n else np.zeros(0, np.int64)
    v = _mixed(h.spans(start, np.minimum(start + SPAN, n)))
    least = np.unique(np.partition(v, SKETCH * 4)[:SKETCH * 4] if len(v) > SKETCH * 8 else v)
    if len(least) < SKETCH < len(v):
        least = np.unique(v)  # many repeated spans
    least = least[:SKETCH] >> np.uint64(24)
    whole = int(h.spans(np.array([0]), np.array([n]))[0]) if n else 0
    digits = lambda x, w: "".join(f"{int(i):0{w}x}" for i in x)
    return f"{n:x}.{whole:016x}.{digits(heads, 6)}.{digits(tails, 6)}.{digits(least, 10)}"


def _agree(a: str, b: str, lengths: np.ndarray) -> int:
    """Longest grid length at which both have the same hash, by binary search (longer agreement implies shorter)."""
    low, high = 0, min(len(a), len(b)) // 6
    while low < high:
        mid = (low + high + 1) // 2
        if a[6 * (mid - 1):6 * mid] == b[6 * (mid - 1):6 * mid]:
            low = mid
        else:
            high = mid - 1
    return int(lengths[low - 1]) if low else 0


def likeness(a: str, b: str) -> float:
    """0 to 1, from two fingerprints alone."""
    if a == b:
        return 1.0
    (n, _, head_a, tail_a, least_a), (m, _, head_b, tail_b, least_b) = a.split("."), b.split(".")
    n, m = int(n, 16), int(m, 16)
    if not n or not m:
        return 0.0
    g = grid(min(n, m))
    ends = min(min(n, m), _agree(head_a, head_b, g) + _agree(tail_a, tail_b, g)) / max(n, m)
    x, y = ({s[i:i + 10] for i in range(0, len(s), 10)} for s in (least_a, least_b))
    union = sorted(x | y)[:SKETCH]
    return min(1.0, max(ends, sum(u in x and u in y for u in union) / len(union)))


def _cuts(ids: DataFrame, parts: int) -> list[float]:
    """Ids, descending, at which buckets begin anew. They only spread the work; any cuts give the same result."""
    known = ids.where("doc_id is not null")
    return sorted(set(known.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts)), reverse=True)


def _bucket_of(ids: list[int | None], cuts: np.ndarray) -> np.ndarray:
    """Bucket 0 holds the largest ids, the last one the smallest and null ids."""
    return np.array([len(cuts) if i is None else int(np.searchsorted(-cuts, -i, "left")) for i in ids], np.int64)


def _dealt(rows: DataFrame, parts: int) -> DataFrame:
    """Rows (bucket, extra, doc_id, h, z) by ranges of ids, texts compressed; each bucket also has, marked ``extra``, the row that follows its last."""
    cuts = np.array(_cuts(rows.select("doc_id"), parts))
    heads = rows.select("doc_id").mapInArrow(lambda it: (_heads(p, cuts) for p in it if p.num_rows), "bucket bigint, doc_id bigint").groupBy("bucket").agg(F.max("doc_id").alias("doc_id")).collect()  # a row for each bucket
    filled = sorted((r["bucket"], r["doc_id"]) for r in heads)
    before = {h: filled[i - 1][0] for i, (_, h) in enumerate(filled)}

    def run(parts_):
        pack = zstandard.ZstdCompressor(level=1)
        for part in parts_:
            ids, hashes = part.column(0).to_pylist(), part.column(2).to_pylist()
            z = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()]
            bucket = _bucket_of(ids, cuts).tolist()
            again = [i for i, d in enumerate(ids) if d in before]
            take = [*range(len(ids)), *again]
            yield pa.RecordBatch.from_arrays([pa.array(bucket + [before[ids[i]] for i in again], pa.int64()), pa.array([0] * len(ids) + [1] * len(again), pa.int32()), pa.array([ids[i] for i in take], pa.int64()), pa.array([hashes[i] for i in take], pa.int64()), pa.array([z[i] for i in take], pa.binary())], names=["bucket", "extra", "doc_id", "h", "z"])

    return rows.withColumn("h", F.xxhash64("text")).mapInArrow(run, "bucket bigint, extra int, doc_id bigint, h bigint, z binary")


def _heads(part: pa.RecordBatch, cuts: np.ndarray) -> pa.RecordBatch:
    best: dict[int, int | None] = {}
    ids = part.column(0).to_pylist()
    for b, i in zip(_bucket_of(ids, cuts).tolist(), ids, strict=True):
        if b not in best or (i is not None and (best[b] is None or i > best[b])):
            best[b] = i
    return pa.RecordBatch.from_arrays([pa.array(best, pa.int64()), pa.array(best.values(), pa.int64())], names=["bucket", "doc_id"])


class _Text:
    def __init__(self, doc_id, z: bytes):
        self.doc_id, self.text = doc_id, zstandard.ZstdDecompressor().decompress(z).decode("utf-8", "surrogatepass")
        self.prefix = Prefix(self.text)
        self.print = fingerprint(self.prefix)


def _row(own: _Text, following: _Text) -> tuple:
    n = len(own.text)
    k = n // 3
    edited = own.text[:n - k] + following.text[:k]
    changed = fingerprint(own.prefix.replaced_end(following.prefix, k))
    return own.doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.print, changed, likeness(own.print, changed), likeness(own.print, following.print)


_NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
_TYPES = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _compared(parts):
    """Rows of a partition in order of bucket, then place: each is held against the one that follows."""
    bucket, before, rows = None, None, []
    for part in parts:
        for b, extra, doc, z in zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
            if b != bucket:
                bucket, before = b, None
            elif before is None:
                continue  # after the bucket's extra row
            now = _Text(doc, z)
            if before is not None:
                rows.append(_row(before, now))
            before = None if extra else now
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=list(_NAMES))
            rows = []


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by the beginning of the next document, by descending id.
    """
    rows = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.coalesce("text", F.lit("")))
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = _dealt(rows, parts).repartition(parts // 2, "bucket").sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), "h")
    return dealt.mapInArrow(_compared, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
