"""Similarity join on word shingles by PartEnum signatures, with connected groups of links.

Two texts link when their shingle sets have Jaccard similarity of at least ``percent`` / 100. Equal sets are one class; only
classes meet. The similarity bounds the number of shingles in which two linked sets of given sizes differ. Set sizes fall
into bands; each band splits the shingle domain into parts by hash (as many as its largest size; every shingle its own part
in the small bands), and a signature is a part with the hash of what the set has there. Linked sets differ in at most so many
parts, so of the non-empty parts, taken in one common order, the first ``differences + 1`` of each set must share a
signature: those subsets of parts are enumerated, none is left out. Sets near a band's upper end also sign for the next band.
The order puts parts that hold only shingles frequent in a sample last, which changes cost, never results.

Signatures travel as packed arrays dealt by hash (12 bytes each), each class once for a task however many copies it has. All
classes with one signature are a group. Each class also has a parity bitmap of a few bits a shingle: bits in which two
bitmaps differ bound from below the shingles in which the sets differ, so most chance meetings end there, without loss. A
group's members are first held against one of them: bitmaps, then exactly, by joining the sets. Groups that still lie in
several components are gone through pair by pair, on bitmaps (large ones in blocks, each two of which meet in a task), and what survives is joined and counted: first
the nearest pair of each two components, then whatever is still apart.
Components are found by alternating star contraction.

Edge cases: null and empty texts and texts without words have empty sets and link with nothing; texts of fewer words than a
shingle are one shingle; repeated rows and ids are kept (one row each); rows with a null id take part, but name no component
unless they are alone; an empty table gives no rows; only id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, cut_in, mark_bits, marked, pieces_of, release, texts
from .shingles import mix, shingle_sets

SHINGLE, PERCENT = 5, 75
#: Share of the documents in the sample that orders signatures, and how many of them make a shingle frequent. Frequent shingles
#: are marked in bits, as many as their number asks for (one shared by chance moves a signature back in the order, on both sides alike).
SAMPLE_SHARE, FREQUENT = 0.1, 2
#: Bytes of text behind one bucket of signatures (somewhat fewer bytes of signatures), and members of a group that meet in one task.
BUCKET, BLOCK = 6 << 20, 4000
#: Sets up to this size have one part for each shingle.
SMALL = 64
#: Characters hashed at once; signatures held by a task before they are sent.
CHUNK, HELD = 400_000, 500_000
#: Rows of ids that may be broadcast (16 bytes each).
MAX_BROADCAST = 500_000
#: Tasks for each bucket, at most, that write what is known of classes, groups and pairs.
TASKS = 2
#: Edges of a task while components are found: a round of few edges writes few files, however many partitions shuffles have.
EDGES = 100_000
#: 1.05 to the seventh is more than 100 / 75.
SIZE_REACH = 7
_U = np.uint64


def band_end(n: int) -> int:
    """First size beyond the band of size n."""
    end = SMALL
    while end <= n:
        end *= 4
    return end


def differences(n: int, most: int, percent: int) -> int:
    """The most shingles in which a set of n and a linked set of at most ``most`` differ."""
    other = min(most, n * 100 // percent)
    return (n + other) * (100 - percent) // (100 + percent)


def _band_signatures(s: np.ndarray, end: int, count: int, rare: np.ndarray) -> np.ndarray:
    """The first ``count`` signatures of a set in the band that ends at ``end``."""
    seed = _U(end * 0x632BE5AB & 0xFFFFFFFF) << _U(20)
    if end == SMALL:
        sig, common = mix(s ^ seed), ~rare
    else:
        part = s & _U(end - 1)
        order = np.argsort(part, kind="stable")
        part, held = part[order], mix(s[order] ^ _U(0x5851F42D4C957F2D))
        start = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sig = mix(np.add.reduceat(held, start) ^ (part[start] + seed))
        common = ~np.logical_or.reduceat(rare[order], start)
    if len(sig) <= count:
        return sig
    return sig[np.lexsort((sig, common))[:count]]


def signatures(s: np.ndarray, frequent: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """All signatures of a set; ``frequent`` are marks."""
    n = len(s)
    if not n:
        return s
    rare = ~marked(frequent, s)
    end = band_end(n)
    out = [_band_signatures(s, end, differences(n, end - 1, percent) + 1, rare)]
    if n * 100 // percent >= end:
        out.append(_band_signatures(s, end * 4, differences(n, end * 4 - 1, percent) + 1, rare))
    return np.concatenate(out)


def bitmap(s: np.ndarray) -> bytes:
    """Parity of the shingles in each of 2^k cells, two to four cells a shingle, 64 at least."""
    if not len(s):
        return b""
    cells = 1 << max(6, int(2 * len(s) - 1).bit_length())
    odd = np.bincount((mix(s ^ _U(0x2545F4914F6CDD1D)) & _U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def fold(m: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) with fewer cells: halves are added modulo two."""
    while m.shape[-1] > width:
        half = m.shape[-1] // 2
        m = m[..., :half] ^ m[..., half:]
    return m


def may_link(a: bytes, b: bytes, n: int, m: int, percent: int) -> bool:
    """False only if two sets of n and m shingles cannot link."""
    if min(n, m) * 100 < max(n, m) * percent:
        return False
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    width = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, width) ^ fold(y, width)).sum(dtype=np.int64)) * (100 + percent) <= (n + m) * (100 - percent)


def size_code(n: int) -> int:
    """Sizes in steps of a twentieth; linked sets are at most SIZE_REACH codes apart."""
    return min(255, int(np.log(n) / np.log(1.05)))


def class_key(s: np.ndarray) -> int:
    """One signed 64-bit key for equal sets: by chance, two of a billion different sets share one with probability 0.03."""
    with np.errstate(over="ignore"):
        x = mix(np.array([np.add.reduce(mix(s ^ _U(0xA0761D6478BD642F))) + _U(len(s))], _U))
    return int(x.view(np.int64)[0])


def _sets(values: list[str | None], size: int):
    for a, b in pieces_of([v or "" for v in values], CHUNK):
        yield from shingle_sets(values[a:b], size)


def marks(shingles: np.ndarray, bits: int = 1 << 20) -> np.ndarray:
    """A bit array in which the shingles are marked."""
    out = np.zeros(bits // 8, np.uint8)
    at = shingles & _U(bits - 1)
    np.bitwise_or.at(out, (at >> _U(3)).astype(np.int64), (1 << (at & _U(7)).astype(np.uint8)).astype(np.uint8))
    return out


def _frequent(rows: DataFrame, size: int) -> np.ndarray:
    """Marks of shingles that at least FREQUENT of the sampled documents have."""
    sample = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(SAMPLE_SHARE * 1_000_000))

    def run(part):
        values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *{class_key(s): s for s in _sets(part.column(0).to_pylist(), size)}.values()]), return_counts=True)
        return [pa.array(values.view(np.int64)), pa.array(counts.astype(np.int64))]

    found = batches(sample.select("text"), run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    return mark_bits(cut(found.select("id")))


def _sign(rows: DataFrame, size: int, percent: int, buckets: int) -> DataFrame:
    """Rows of members (doc_id, class, size, hash of the text; the bitmap as key) and blocks of signatures (signature, class), dealt over buckets."""
    sent = rows.sparkSession.sparkContext.broadcast(_frequent(rows, size))

    names = ["bucket", "member", "sig", "key", "code"]

    def run(parts):
        seen: set[int] = set()
        held, n = [], 0

        def signed():
            sig = np.concatenate([h[0] for h in held])
            key = np.repeat(np.array([h[1] for h in held], np.int64), [len(h[0]) for h in held])
            to = (sig >> _U(32)) % _U(buckets)
            order = np.argsort(to, kind="stable")
            code = np.repeat(np.array([h[2] for h in held], np.uint8), [len(h[0]) for h in held])[order]
            sig, key, to = (sig & _U(0xFFFFFFFF)).astype(np.uint32)[order], key[order], to[order]
            cuts = list(zip(at := np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist(), [*at[1:], len(to)], strict=True))
            packed = lambda x: pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([int(to[a]) for a, _ in cuts], pa.int64()), pa.nulls(len(cuts), pa.list_(pa.int64())), packed(sig), packed(key), packed(code)], names=names)

        release()
        for part in parts:
            members, maps = [], []
            for doc, s, text in zip(part.column(0).to_pylist(), _sets(part.column(1).to_pylist(), size), part.column(2).to_pylist(), strict=True):
                key = class_key(s)
                members.append([doc, key, len(s), text])
                maps.append(bitmap(s))
                if len(s) and key not in seen:
                    seen.add(key)
                    held.append((signatures(s, sent.value, percent), key, size_code(len(s))))
                    n += len(held[-1][0])
            yield pa.RecordBatch.from_arrays([pa.array([(m[1] ^ i) % buckets for i, m in enumerate(members)], pa.int64()), pa.array(members, pa.list_(pa.int64())), pa.nulls(len(members), pa.binary()), pa.array(maps, pa.binary()), pa.nulls(len(members), pa.binary())], names=names)
            if n >= HELD:
                yield signed()
                held, n = [], 0
        if held:
            yield signed()

    return rows.mapInArrow(run, "bucket bigint, member array<bigint>, sig binary, key binary, code binary")


def _groups(sig: np.ndarray, key: np.ndarray, code: np.ndarray):
    """Distinct groups of two classes or more with one signature, parted where sizes are too far apart: (group id, classes)."""
    order = np.lexsort((key, code, sig))
    sig, key, code = sig[order], key[order], code[order].astype(np.int64)
    keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])])  # copies met in several tasks
    sig, key, code = sig[keep], key[keep], code[keep]
    start = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (np.diff(code) > SIZE_REACH)]))
    size = np.diff(np.append(start, len(sig)))
    many = size > 1
    if not many.any():
        return
    ids = mix(np.add.reduceat(mix(key.view(np.uint64)), start))
    seen: set[int] = set()
    for a, n, g in zip(start[many].tolist(), size[many].tolist(), ids[many].tolist(), strict=True):
        if g not in seen:
            seen.add(g)
            yield g, key[a:a + n]


def _meet(blocks: DataFrame) -> DataFrame:
    """Rows of kind 0: (doc_id, class, size, hash of the text, bitmap); kind 1: (group, class)."""

    def run(table: pa.Table) -> pa.Table:
        release()
        is_member = pc.is_valid(table.column("member"))
        own = table.filter(is_member)
        members = own.column("member").to_pylist()
        other = table.filter(pc.invert(is_member))
        sig, key, code = (b"".join(other.column(c).to_pylist()) for c in ("sig", "key", "code"))
        found = list(_groups(np.frombuffer(sig, np.uint32), np.frombuffer(key, np.int64), np.frombuffer(code, np.uint8))) if sig else []
        gid = np.repeat(np.array([g for g, _ in found], np.uint64).view(np.int64), [len(k) for _, k in found])
        keys = np.concatenate([k for _, k in found]) if found else np.zeros(0, np.int64)
        return pa.table({
            "kind": pa.array([0] * len(members) + [1] * len(keys), pa.int64()),
            "a": pa.array([m[0] for m in members] + gid.tolist(), pa.int64()),
            "b": pa.array([m[1] for m in members] + keys.tolist(), pa.int64()),
            "n": pa.array([m[2] for m in members] + [0] * len(keys), pa.int64()),
            "text": pa.array([m[3] for m in members] + [0] * len(keys), pa.int64()),
            "map": pa.array(own.column("key").to_pylist() + [None] * len(keys), pa.binary()),
        })

    return blocks.groupBy("bucket").applyInArrow(run, "kind bigint, a bigint, b bigint, n bigint, text bigint, map binary")


def _plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) that sizes and bitmaps do not rule out."""
    one = lambda k: classes.select(F.col("key").alias(k), F.col("n").alias("n" + k), F.col("map").alias("m" + k))
    p = pairs.join(one("x"), "x").where("nx > 0").join(one("y"), "y").where(F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * percent).select("x", "y", "nx", "ny", "mx", "my")

    def run(part):
        nx, ny, mx, my = (part.column(i).to_pylist() for i in range(2, 6))
        ok = pa.array([may_link(a, b, n, m, percent) for a, b, n, m in zip(mx, my, nx, ny, strict=True)], pa.bool_())
        return [part.column(0).filter(ok), part.column(1).filter(ok)]

    return batches(p, run, "x bigint, y bigint")


def _class_sets(rows: DataFrame, wanted: DataFrame, size: int, tasks: int | None = None) -> DataFrame:
    """(class, sorted shingle hashes as bytes) of the wanted classes, from one document each. ``wanted``: doc_id, class."""
    wanted = cut(_few(wanted, tasks))
    side = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST else wanted
    texts_of = rows.join(side.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id"))).select("key", "text")

    def run(part):  # an id may stand on several rows: only the set that makes the class counts
        found = [(k, s.tobytes()) for k, s in zip(part.column(0).to_pylist(), _sets(part.column(1).to_pylist(), size), strict=True) if class_key(s) == k]
        return [pa.array([k for k, _ in found], pa.int64()), pa.array([s for _, s in found], pa.binary())]

    return batches(texts_of, run, "key bigint, s binary")


def _distances(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (x, y) with inter, nx, ny, counted on the sets."""
    p = pairs.join(sets.select(F.col("key").alias("y"), F.col("s").alias("sy")), "y").join(sets.select(F.col("key").alias("x"), F.col("s").alias("sx")), "x").select("x", "y", "sx", "sy")

    def run(part):
        a, b = part.column(2), part.column(3)
        out, nx, ny = [], [], []
        for i in range(part.num_rows):
            s, t = np.frombuffer(a[i].as_buffer(), np.uint64), np.frombuffer(b[i].as_buffer(), np.uint64)
            if len(s) > len(t):
                s, t = t, s
            out.append(int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()))
            nx.append(a[i].as_buffer().size // 8)
            ny.append(b[i].as_buffer().size // 8)
        return [part.column(0), part.column(1), pa.array(out, pa.int64()), pa.array(nx, pa.int64()), pa.array(ny, pa.int64())]

    return batches(p, run, "x bigint, y bigint, inter bigint, nx bigint, ny bigint")


def _few(df: DataFrame, tasks: int | None) -> DataFrame:
    """``df`` in at most so many tasks: every task writes files of its own to each shuffle and checkpoint, however few rows it has."""
    return df if tasks is None else df.coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(key, component) for every class on an edge; the component is its least class. Alternating star contraction.

    Each half of a round deals its edges once by the class they are grouped and joined on, from as many tasks as their number asks for.
    """
    e = cut(edges.select("x", "y").where("x <> y").distinct())
    n, before = e.count(), None
    while True:
        parts = max(1, -(-n // EDGES))
        e = e.coalesce(parts)
        both = e.union(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).repartition("x")
        low = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
        down = large.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).where("x <> y").coalesce(parts).repartition("x")
        low = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(low, "x").select(F.col("y").alias("x"), "m").where("x <> m").union(low.select("x", "m")).toDF("x", "y")
        e = cut(small.coalesce(parts).distinct().coalesce(parts))
        now = e.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("x", "y")), F.lit(0)).alias("h")).first()
        if now == before or not now["n"]:
            break
        n, before = now["n"], now
    return e.select(F.col("x").alias("key"), F.col("y").alias("component")).union(e.select(F.col("y").alias("key"), F.col("y").alias("component")).distinct())


def joined(comp: DataFrame, more: DataFrame, tasks: int | None = None) -> DataFrame:
    """``components`` after further edges: only those between components count, and few are left of them."""
    label = lambda k: comp.select(F.col("key").alias(k), F.col("component").alias("c" + k))
    between = cut(_few(more.join(label("x"), "x", "left").join(label("y"), "y", "left").select(F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y"), F.col("x").alias("a"), F.col("y").alias("b")), tasks))
    if not between.where("x <> y").limit(1).count():
        return comp
    top = cut(_few(components(between.select("x", "y")), tasks))
    old = comp.join(top.select(F.col("key").alias("component"), F.col("component").alias("top")), "component", "left").select("key", F.coalesce("top", "component").alias("component"))
    alone = between.select(F.col("x").alias("key"), F.col("a").alias("own")).union(between.select(F.col("y").alias("key"), F.col("b").alias("own"))).where("key = own").select("key").distinct()
    new = top.join(alone, "key").join(comp.select("key"), "key", "left_anti").select("key", "component")
    return cut(_few(old.union(new), tasks))


def close_pairs(keys: np.ndarray, comps: np.ndarray, sizes: np.ndarray, maps: list[bytes], percent: int, nearest: bool = False, blocks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (x, y) of different components that sizes and bitmaps do not rule out, and their number; of each two components only the ``nearest`` if asked. With ``blocks`` only pairs of different blocks."""
    order = np.lexsort((keys, sizes))
    keys, comps, sizes, blocks = keys[order], comps[order], sizes[order], None if blocks is None else blocks[order]
    widths = np.array([len(maps[i]) for i in order])
    rows, folded, found, n, total = {}, {}, [np.zeros((5, 0), np.int64)], 0, 0
    for w in np.unique(widths).tolist():
        at = np.flatnonzero(widths == w)
        rows[w] = (int(at[0]), np.frombuffer(b"".join(maps[i] for i in order[at]), np.uint8).reshape(len(at), w))
        folded[w // 2] = fold(rows[w][1], w // 2)
    stops = np.searchsorted(sizes, sizes * 100 // percent, "right")
    for i in range(len(keys) - 1):
        w = int(widths[i])
        first, own = rows[w]
        mine, stop, end = own[i - first], int(stops[i]), first + len(own)
        for begin, block in ((i + 1, own[i + 1 - first:max(i + 1, min(stop, end)) - first]), (end, folded[w][:stop - end] if stop > end and w in folded else own[:0])):
            for a in range(0, len(block), 4096):
                part = block[a:a + 4096]
                j = np.arange(begin + a, begin + a + len(part))
                differ = np.bitwise_count(part ^ mine).sum(1, dtype=np.int64)
                ok = (comps[j] != comps[i]) & (differ * (100 + percent) <= (sizes[j] + sizes[i]) * (100 - percent))
                if blocks is not None:
                    ok &= blocks[j] != blocks[i]
                if ok.any():
                    j = j[ok]
                    own_comp = np.full(len(j), comps[i])
                    found.append(np.stack([np.minimum(comps[j], own_comp), np.maximum(comps[j], own_comp), differ[ok] * 1_000_000 // (sizes[j] + sizes[i]), np.minimum(keys[j], keys[i]), np.maximum(keys[j], keys[i])]))
                    n, total = n + len(j), total + len(j)
                    if nearest and n > 500_000:
                        found, n = [_nearest(np.concatenate(found, 1))], 0
    out = np.concatenate(found, 1)
    out = _nearest(out) if nearest else out
    return out[3], out[4], total


def _nearest(found: np.ndarray) -> np.ndarray:
    """Of the columns (component, component, distance, x, y) the nearest of each two components."""
    found = found[:, np.lexsort(found[::-1])]
    return found[:, np.concatenate([[True], (found[:2, 1:] != found[:2, :-1]).any(0)])] if found.shape[1] else found


def _open(groups: DataFrame, classes: DataFrame, comp: DataFrame, percent: int, nearest: bool, tasks: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs still to be counted: of one group, in different components, not ruled out by bitmaps; all, or the nearest of each two components. And the groups that have more."""
    g = groups.join(comp, "key", "left").withColumn("component", F.coalesce("component", "key"))
    mixed = g.groupBy("gid").agg((F.min("component") != F.max("component")).alias("mixed"), F.count(F.lit(1)).alias("m")).where("mixed and m > 2").select("gid", F.ceil(F.col("m") / BLOCK).alias("parts"))
    own = F.pmod(F.xxhash64("key"), F.col("parts"))
    g = g.join(mixed, "gid").withColumn("block", own).join(classes.select("key", "n", "map"), "key")
    g = g.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))  # each two blocks of a group meet in a task
    g = g.select("gid", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "key", "component", "block", "n", "map")

    def run(table: pa.Table) -> pa.Table:
        key, comps, sizes, block = (table.column(c).to_numpy() for c in ("key", "component", "n", "block"))
        apart = table.column("low")[0].as_py() != table.column("high")[0].as_py()
        x, y, total = close_pairs(key, comps, sizes, table.column("map").to_pylist(), percent, nearest, block if apart else None)
        more = [table.column("gid")[0].as_py()] * int(total > len(x))
        return pa.table({"gid": pa.array(more + [None] * len(x), pa.int64()), "x": pa.array([None] * len(more) + x.tolist(), pa.int64()), "y": pa.array([None] * len(more) + y.tolist(), pa.int64())})

    found = cut(_few(g.groupBy("gid", "low", "high").applyInArrow(run, "gid bigint, x bigint, y bigint"), tasks))
    return found.where("x is not null").select("x", "y").distinct(), found.where("gid is not null").select("gid").distinct()


def similarity_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, n_shingles, key, component: the least doc_id of the component, group: its least class, text_hash: xxhash64 of the text) and links between classes (x, y, inter, nx, ny)."""
    rows = texts(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("hash"))
    buckets = max(1, -(-rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"] // BUCKET))
    tasks = TASKS * buckets
    met = cut_in(_few(_meet(_sign(rows, size, percent, buckets)), tasks), buckets)
    members = met.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("key"), F.col("n").alias("n_shingles"), F.col("text").alias("text_hash"))
    classes = cut(_few(met.where("kind = 0").select(F.col("b").alias("key"), F.col("a").alias("doc_id"), "n", "map").dropDuplicates(["key"]), tasks))
    groups = met.where("kind = 1").select(F.col("a").alias("gid"), F.col("b").alias("key")).distinct()
    like = F.col("inter") * 100 >= (F.col("nx") + F.col("ny") - F.col("inter")) * percent

    def counted(pairs: DataFrame) -> DataFrame:
        pairs = cut(_few(pairs, tasks))
        keys = pairs.select("x").union(pairs.select("y")).distinct().withColumnRenamed("x", "key")
        sets = cut(_few(_class_sets(rows, classes.join(keys, "key", "left_semi").select("doc_id", "key"), size, tasks).dropDuplicates(["key"]), tasks))
        return cut(_few(_distances(pairs, sets), tasks))

    least = groups.groupBy("gid").agg(F.min("key").alias("x"))
    first = counted(_plausible(groups.join(least, "gid").where("key <> x").select("x", F.col("key").alias("y")).distinct(), classes, percent))
    comp = cut(_few(components(first.where(like)), tasks))
    for nearest in (True, False):  # one link joins two components: the likeliest is tried before all
        pairs, more = _open(groups, classes, comp, percent, nearest, tasks)
        rest = counted(pairs.join(first.select("x", "y"), ["x", "y"], "left_anti"))
        first = first.union(rest)
        comp = joined(comp, rest.where(like), tasks)
        if not more.limit(1).count():
            break
        groups = groups.join(more, "gid", "left_semi")
    links = first.where(like)
    labels = comp.select("key", F.col("component"))
    named = members.join(labels, "key", "left").withColumn("component", F.when(F.col("n_shingles") > 0, F.coalesce("component", "key")))
    named = cut(_few(named, tasks))
    least = named.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("least"))
    out = named.join(least, "component", "left").select("doc_id", "n_shingles", "key", F.coalesce(F.when(F.col("n_shingles") > 0, F.col("least")), F.col("doc_id")).alias("component"), F.coalesce("component", "key").alias("group"), "text_hash")
    return out, links
