"""Removal of repeated byte strings by suffix arrays over shards.

A window is a string of ``length`` bytes. A byte goes if a window covers it that also starts earlier, in a document of smaller
id or further ahead in the same one. Windows are judged on the input.

Sharding: of each window the seed (a shorter string) with the least hash, the first of equals, names where it belongs; windows
next to each other that share their seed are one stretch, and equal windows lie at one distance from equal seeds, so they
meet. Tasks send for each stretch two hashes and its place (about 25 bytes for 27 of text); of equal stretches only the
earliest one goes further, all others are repeats. Different stretches with one seed are compared as strings: they are
dealt to shards by seed, each shard's suffix array is built by induced sorting, permuted common prefixes of ``length`` bytes
or more join equal windows, and all but the earliest are repeats. A seed of more than ``hot`` different stretches (a line that
very many documents share between other texts) would outgrow a shard: its windows are dealt by hash one by one instead, and
the earliest of each is an aggregate.

The order is that of (doc_id, start); rows with one id are one document for it, so of two that hold a window at the same
place neither is earlier. Rows with a null id come last, as one document.

Edge cases: null and empty texts, and those shorter than a window, keep all; repeated rows are judged alike; long texts are
read in parts that overlap, so nothing is cut; an empty table gives no rows; further columns are not read. A kept text may
end inside a character, so it is returned as bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, cut, cut_in, texts
from .shingles import mix, powers
from .suffixes import permuted_common_prefixes, suffix_array

LENGTH, SEED = 100, 48
#: Bytes hashed at once, stretches a task holds before it sends them, bytes of text behind one bucket of stretches.
SEGMENT, HELD, BUCKET = 1 << 20, 500_000, 16 << 20
#: Bytes of strings in one shard, and different stretches of one seed that a shard takes.
SHARD, HOT = 1 << 20, 2000
_PLACE = np.uint64((1 << 21) - 1)
_U = np.uint64
_LAST = (1 << 63) - 1
_END = 0xFF  # a byte that no text has


def stretches(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int = LENGTH, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """Stretches of windows that share their seed, in texts that lie at [begin, end) in ``buf``: text, first window, windows, hash of the seed, hash of the string."""
    n = len(buf) - length + 1
    if n <= 0 or not len(begin):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, _U, _U))
    p, q = powers(len(buf) + 1)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum((buf.astype(_U) + _U(1)) * p[:len(buf)])])
    own = mix((sums[seed:] - sums[:-seed]) * q[:len(buf) - seed + 1])
    least = (own & ~_PLACE) | np.arange(len(own), dtype=_U)  # of equal hashes the first
    reach, span = length - seed + 1, 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    at = (np.minimum(least[:n], least[reach - span:reach - span + n]) & _PLACE).astype(np.int64)
    inside = np.zeros(len(buf) + 1, np.int64)
    many = np.maximum(end - begin - length + 1, 0)
    np.add.at(inside, begin, many > 0)
    np.add.at(inside, begin + many, -(many > 0).astype(np.int64))
    window = np.flatnonzero(np.cumsum(inside)[:n])
    if not len(window):
        return stretches(buf[:0], begin, end, length, seed)
    start = np.flatnonzero(np.concatenate([[True], (at[window][1:] != at[window][:-1]) | (np.diff(window) != 1)]))
    first = window[start]
    count = np.diff(np.append(start, len(window)))
    stop = first + count - 1 + length
    string = mix((sums[stop] - sums[first]) * q[first] + count.astype(_U) * _U(0x9E3779B97F4A7C15))
    text = np.searchsorted(begin, first, "right") - 1
    return text, first - begin[text], count, own[at[first]], string


def _read(values: list[bytes], length: int, seed: int):
    """Stretches of many texts: (text, start, count, seed, string), a part at a time. Long texts are parted at places that depend on them alone."""
    parts, size = [], 0

    def done():
        buf = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        stop = np.cumsum([len(p[2]) for p in parts])
        text, start, count, own, string = stretches(buf, stop - [len(p[2]) for p in parts], stop, length, seed)
        return np.array([p[0] for p in parts], np.int64)[text], start + np.array([p[1] for p in parts], np.int64)[text], count, own, string

    for i, v in enumerate(values):
        for a in range(0, max(0, len(v) - length + 1), SEGMENT):
            part = v[a:a + SEGMENT + length - 1]
            if size and size + len(part) > SEGMENT:
                yield done()
                parts, size = [], 0
            parts.append((i, a, part))
            size += len(part)
    if parts:
        yield done()


def spans(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of numbers, sorted and joined where they touch."""
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate((start + count)[order])
    new = np.flatnonzero(np.concatenate([[True], start[1:] > stop[:-1]])) if len(start) else np.zeros(0, np.int64)
    return start[new], stop[np.append(new[1:], len(start)) - 1] - start[new] if len(start) else stop


_DEALT = "bucket bigint, docs binary, tags binary, many binary, seeds binary, strings binary, starts binary, counts binary"


def _classes(doc, tag, start, own, string):
    """Order by class, then place; where classes begin; which rows are later than the first of their class."""
    order = np.lexsort((tag, start, doc, string, own))
    own, string, doc, start = own[order], string[order], doc[order], start[order]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (string[1:] != string[:-1])])
    first = np.flatnonzero(new)
    at = first[np.cumsum(new) - 1]
    return order, new, (doc != doc[at]) | (start != start[at])


def _deal(rows: DataFrame, buckets: int, length: int, seed: int) -> DataFrame:
    """Stretches by bucket of their seed, packed. What repeats inside a task is sent as a repeat (no seeds), without its hashes."""

    def run(parts):
        held, n = [], 0

        def packed(bucket, doc, tag, start, count, own, string):
            new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]))
            many = np.diff(np.append(new, len(doc))).astype(np.uint32)
            return (bucket, *(x.tobytes() for x in (doc[new], tag[new], many, own, string, start.astype(np.uint32), count.astype(np.uint32))))

        def sent():
            doc, tag, start, count, own, string = (np.concatenate([h[j] for h in held]) for j in range(6))
            order, _, late = _classes(doc, tag, start, own, string)
            out, again, on = [], order[late], order[~late]
            again = again[np.lexsort((start[again], tag[again], doc[again]))]
            cuts = np.flatnonzero(np.concatenate([[True], (doc[again][1:] != doc[again][:-1]) | (tag[again][1:] != tag[again][:-1])])).tolist() if len(again) else []
            for a, b in zip(cuts, [*cuts[1:], len(again)], strict=True):
                rows = again[a:b]
                at, many = spans(start[rows], count[rows])
                one = np.repeat(rows[:1], len(at))
                out.append(packed(int(mix(doc[rows[:1]].view(_U))[0] >> _U(32)) % buckets, doc[one], tag[one], at, many, own[:0], string[:0]))
            to = (mix(own[on]) >> _U(32)) % _U(buckets)
            order = np.lexsort((start[on], tag[on], doc[on], to))
            on, to = on[order], to[order]
            cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist() if len(on) else []
            for a, b in zip(cuts, [*cuts[1:], len(on)], strict=True):
                rows = on[a:b]
                out.append(packed(int(to[a]), *(x[rows] for x in (doc, tag, start, count, own, string))))
            return pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], pa.int64() if not j else pa.binary()) for j in range(8)], names=[c.split()[0] for c in _DEALT.split(", ")])

        for part in parts:
            doc, tag = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False).astype(np.int32)
            values = [v or b"" for v in part.column(2).to_pylist()]
            for text, start, count, own, string in _read(values, length, seed):
                held.append((doc[text], tag[text], start, count, own, string))
                n += len(text)
                if n >= HELD:
                    yield sent()
                    held, n = [], 0
        if n:
            yield sent()

    return rows.mapInArrow(run, _DEALT)


_MET = "kind int, doc bigint, tag int, start bigint, n bigint, seed bigint"


def _meet(packed: DataFrame, hot: int) -> DataFrame:
    """Kind 0: windows [start, start + n) are repeats. Kinds 1 and 2: a stretch whose seed others have as well, at most ``hot`` of them or more."""

    def run(table: pa.Table) -> pa.Table:
        known = pc.greater(pc.binary_length(table.column("seeds")), 0)
        out = []
        for open_ in (False, True):
            own = table.filter(known if open_ else pc.invert(known))
            if not own.num_rows:
                continue
            read = lambda c, t: np.frombuffer(b"".join(own.column(c).to_pylist()), t)  # noqa: B023, E731
            many = read("many", np.uint32).astype(np.int64)
            doc, tag = np.repeat(read("docs", np.int64), many), np.repeat(read("tags", np.int32), many)
            start, count = read("starts", np.uint32).astype(np.int64), read("counts", np.uint32).astype(np.int64)
            if not open_:
                out.append((np.zeros(len(doc), np.int32), doc, tag, start, count, np.zeros(len(doc), np.int64)))
                continue
            seeds, strings = read("seeds", _U), read("strings", _U)
            order, new, late = _classes(doc, tag, start, seeds, strings)
            doc, tag, start, count, seeds = doc[order], tag[order], start[order], count[order], seeds[order]
            out.append((np.zeros(int(late.sum()), np.int32), doc[late], tag[late], start[late], count[late], np.zeros(int(late.sum()), np.int64)))
            group = np.cumsum(np.concatenate([[True], seeds[1:] != seeds[:-1]])) - 1
            classes = np.bincount(group, new)[group]
            on = ~late & (classes > 1)
            on[1:] &= ~((doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (start[1:] == start[:-1]))  # equal rows once
            out.append((np.where(classes[on] > hot, 2, 1).astype(np.int32), doc[on], tag[on], start[on], count[on], seeds[on].view(np.int64)))
        names = [c.split()[0] for c in _MET.split(", ")]
        return pa.table({c: pa.array(np.concatenate([o[j] for o in out]) if out else np.zeros(0, np.int32 if c in ("kind", "tag") else np.int64)) for j, c in enumerate(names)})

    return packed.groupBy("bucket").applyInArrow(run, _MET)


def repeated_windows(strings: list[bytes], doc: np.ndarray, start: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string the windows (numbers in it) that start earlier in another string, by suffix array and common prefixes."""
    data = bytes([_END]).join(strings) + bytes([_END])
    array = suffix_array(np.frombuffer(data, np.uint8))
    shared = permuted_common_prefixes(data, array)
    size = np.array([len(s) for s in strings], np.int64)
    begin = np.cumsum(size + 1) - size - 1
    of = np.repeat(np.arange(len(strings)), size + 1)
    at = np.arange(len(data)) - begin[of]
    array = array[(at + length <= size[of])[array]]  # windows lie inside a string; those between equal ones do as well
    group = np.cumsum(np.concatenate([[True], shared[array][1:] < length])) if len(array) else array
    order = np.lexsort((start[of[array]] + at[array], doc[of[array]], group))
    array, group = array[order], group[order]
    d, s = doc[of[array]], (start[of] + at)[array]
    new = np.concatenate([[True], group[1:] != group[:-1]]) if len(array) else np.zeros(0, bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    late = array[(d != d[first]) | (s != s[first])]
    late = late[np.argsort(of[late], kind="stable")]
    cuts = np.searchsorted(of[late], np.arange(len(strings) + 1))
    return [np.sort(at[late[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_SPANS = "doc bigint, tag int, start bigint, n bigint"


def _sorted_shards(strings: DataFrame, length: int) -> DataFrame:
    """Repeats among the strings of each shard."""

    def run(table: pa.Table) -> pa.Table:
        doc, tag, start = (table.column(c).to_numpy() for c in ("doc", "tag", "start"))
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, at in enumerate(repeated_windows(table.column("string").to_pylist(), doc, start, length)):
            first, many = spans(at, np.ones(len(at), np.int64))
            for o, x in zip(out, (np.full(len(first), i), first + start[i], many), strict=True):
                o.append(x)
        i, first, many = (np.concatenate(o) for o in out)
        return pa.table({"doc": pa.array(doc[i]), "tag": pa.array(tag[i].astype(np.int32)), "start": pa.array(first), "n": pa.array(many)})

    return strings.groupBy("shard").applyInArrow(run, _SPANS)


def _text_of(rows: DataFrame) -> DataFrame:
    """doc and tag (a row's place in joins), and the text's bytes, compressed as they will be shuffled."""
    import zstandard

    def run(part):
        press = zstandard.ZstdCompressor(level=1)
        return [part.column(0), part.column(1), part.column(2), pa.array([press.compress(v or b"") for v in part.column(3).to_pylist()], pa.binary())]

    kind = rows.schema["doc_id"].dataType.simpleString()
    return batches(rows.select("doc_id", "doc", "tag", "text"), run, f"doc_id {kind}, doc bigint, tag int, packed binary")


def _unpacked(column: pa.Array):
    import zstandard

    press = zstandard.ZstdDecompressor()
    return (press.decompress(v) for v in column.to_pylist())


def _strings(rows: DataFrame, open_: DataFrame, shards: int, length: int) -> DataFrame:
    """Kind 1: (shard, doc, tag, start, string) of each open stretch; kind 2: the hash of each window of a hot one as ``shard``, its seed as ``seed``."""
    wanted = open_.groupBy("doc", "tag").agg(F.collect_list(F.struct("kind", "start", "n", "seed")).alias("of"))
    joined = _text_of(rows).join(wanted, ["doc", "tag"]).select("doc", "tag", "packed", "of")

    def run(part):
        out = [[] for _ in range(7)]
        doc, tag = part.column(0).to_pylist(), part.column(1).to_pylist()
        for i, text in enumerate(_unpacked(part.column(2))):
            for w in part.column(3)[i].as_py():
                string = text[w["start"]:w["start"] + w["n"] + length - 1]
                if w["kind"] == 1:
                    rows = [(1, int(mix(np.array([w["seed"]], np.int64).view(_U))[0] >> _U(32)) % shards, doc[i], tag[i], w["start"], string, None)]
                else:
                    buf = np.frombuffer(string, np.uint8)
                    p, q = powers(len(buf) + 1)
                    sums = np.concatenate([np.zeros(1, _U), np.cumsum((buf.astype(_U) + _U(1)) * p[:len(buf)])])
                    window = mix((sums[length:] - sums[:-length]) * q[:w["n"]]).view(np.int64).tolist()
                    rows = [(2, h, doc[i], tag[i], w["start"] + k, None, w["seed"]) for k, h in enumerate(window)]
                for row in rows:
                    for o, x in zip(out, row, strict=True):
                        o.append(x)
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64())
        return [pa.array(o, t) for o, t in zip(out, kinds, strict=True)]

    return batches(joined, run, "kind int, shard bigint, doc bigint, tag int, start bigint, string binary, seed bigint")


def _hot_windows(found: DataFrame) -> DataFrame:
    """Repeats among windows that were dealt one by one: the earliest of each hash is an aggregate, combined in each task."""
    least = found.groupBy("seed", "shard").agg(F.min(F.struct("doc", "start")).alias("least"))
    return found.join(least, ["seed", "shard"]).where((F.col("doc") != F.col("least.doc")) | (F.col("start") != F.col("least.start"))).select("doc", "tag", "start", F.lit(1).cast("long").alias("n"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, doc, tag, text as bytes) and repeated windows (doc, tag, start, n); (doc, tag) tells rows apart."""
    named = texts(docs, id_col, text_col)
    tag = F.pmod(F.xxhash64("text"), F.lit((1 << 31) - 1)).cast("int")
    rows = named.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.coalesce(tag, F.lit(0)).alias("tag"), F.col("text").cast("binary").alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    buckets = max(1, -(-size // BUCKET))
    met = cut_in(_meet(_deal(rows.select("doc", "tag", "text"), buckets, length, seed), hot), buckets)
    open_ = met.where("kind > 0")
    some = open_.agg(F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("n") + length)), F.lit(0)).alias("cold"), F.count(F.when(F.col("kind") == 2, 1)).alias("hot")).first()
    found = met.where("kind = 0").select("doc", "tag", "start", "n")
    if some["cold"] or some["hot"]:
        shards = max(1, -(-some["cold"] // SHARD))
        strings = _strings(rows, open_, shards, length)
        strings = cut(strings) if some["cold"] and some["hot"] else strings
        if some["cold"]:
            found = found.union(cut_in(_sorted_shards(strings.where("kind = 1").select("shard", "doc", "tag", "start", "string"), length), shards))
        if some["hot"]:
            found = found.union(_hot_windows(strings.where("kind = 2")))
    return rows, found


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED, hot: int = HOT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, spans (removed ranges of bytes: start, stop), kept (the remaining bytes)."""
    rows, found = repeats(docs, id_col, text_col, length, seed, hot)
    gone = found.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "n")).alias("windows"))
    joined = _text_of(rows).join(gone, ["doc", "tag"], "left").select("doc_id", "packed", "windows")
    kind = rows.schema["doc_id"].dataType.simpleString()
    pair = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(part):
        n, removed, out, kept = [], [], [], []
        lists = part.column(2)
        for i, text in enumerate(_unpacked(part.column(1))):
            own = lists[i]
            own = own.values if own.is_valid else None
            start, many = spans(own.field("start").to_numpy(), own.field("n").to_numpy() + (length - 1)) if own is not None else (np.zeros(0, np.int64),) * 2
            stop = (start + many).tolist()
            start = start.tolist()
            n.append(len(text))
            removed.append(sum(stop) - sum(start))
            out.append([{"start": a, "stop": b} for a, b in zip(start, stop, strict=True)])
            kept.append(b"".join(text[a:b] for a, b in zip([0, *stop], [*start, len(text)], strict=True)))
        return [part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pair), pa.array(kept, pa.binary())]

    return batches(joined, run, f"doc_id {kind}, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
