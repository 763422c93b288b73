"""Alignment of two tokenizers by interval coalescing.

Tokens are byte ranges of a text. All A and B tokens are sorted by start, the running maximum of their ends is taken, and a
group breaks where a start reaches it: there, tokens of both sides end. Inside a group every A token is linked with every
B token. A pair of ids counts the documents that hold it linked; a link is best when no other B id counts more for its A id.

Neither tokenizer joins across the start of a blank or a line end that follows a visible character (the vocabulary of B is
checked for that when it is loaded), so texts are cut there, each different stretch is encoded and coalesced once while a
worker's bounded cache holds it, and all new stretches of a batch are coalesced in one pass.

Scale: texts are encoded once and never shuffled; each document's pairs are kept, packed, in the shared folder. Pairs are
counted from there (combined in each task), and documents scored. The pair table goes to the tasks up to ``most`` pairs (17
bytes each); beyond that, each different document's pairs are joined with it instead.

Edge cases: null and empty texts, and texts whose tokens do not spell them (a text with the sign that B writes for a blank),
have no tokens: zeros and an empty string. Special strings are plain text. Repeated rows count as documents each; null ids
are ids like others; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, by_worker, cut, pieces_of, texts

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Stretches a worker remembers (about 400 bytes each), characters coalesced at once, pairs a task holds before it sends them.
CACHE, CHUNK, HELD = 120_000, 2_000_000, 1_000_000
#: Longer stretches are not remembered.
LONGEST_KEPT = 200
#: Pairs that may be sent to every task.
MOST_PAIRS = 4_000_000
_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_BLANK = "▁"
_SHIFT = 15  # bits of a B id


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(FILE_A), public_tokenizers.path(FILE_B)


def coalesce(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Group number of each range; a group breaks where a start reaches the running maximum of the ends."""
    order = np.lexsort((end, start))
    reach = np.maximum.accumulate(end[order])
    group = np.empty(len(start), np.int64)
    group[order] = np.cumsum(np.concatenate([np.zeros(min(1, len(start)), np.int64), start[order][1:] >= reach[:-1]]))
    return group


def _byte_of() -> dict[str, int]:
    """The byte behind each printable sign of a byte-level vocabulary: printable bytes stand for themselves, the rest follow from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _fast(path: str, token: list[bytes]):
    """The same vocabulary in ``tiktoken``, which is three times as fast, if its ids follow its merges; else None."""
    import public_tokenizers
    import tiktoken

    file = json.load(open(path, encoding="utf-8"))
    parts, model = file["pre_tokenizer"] or {}, file["model"]
    if file["normalizer"] or parts.get("type") != "ByteLevel" or not parts.get("use_regex") or parts.get("add_prefix_space") or sorted(token[:256]) != [bytes([i]) for i in range(256)]:
        return None
    for i, m in enumerate(model["merges"]):
        if model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] != 256 + i:
            return None
    return tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks={token[i]: i for i in range(256 + len(model["merges"]))}, special_tokens={})


class Pair:
    """Both tokenizers, the bytes of their tokens, and the stretches met so far."""

    def __init__(self, path_a: str | None = None, path_b: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        path_a = path_a or default_paths()[0]
        path_b = path_b or default_paths()[1]
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        byte_of = _byte_of()
        self.bytes_a = [bytes(byte_of.get(c, 0xFF) for c in self.a.id_to_token(i) or "") for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_BLANK, " ").encode() for i, p in enumerate(pieces)]
        self.fast = _fast(path_a, self.bytes_a)
        #: Whether texts may be cut before blanks and line ends.
        self.cuts = not any("\n" in p or (_BLANK in p[1:] and set(p) != {_BLANK}) for p in pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.word_a, self.word_b = (np.array([str(i) for i in range(len(t))], object) for t in (self.bytes_a, self.bytes_b))
        self.known: dict[str, tuple] = {}

    def stretches(self, text: str) -> list[str]:
        return _CUT.split(" " + text) if self.cuts else [" " + text]

    def ids_a(self, text: str) -> list[int]:
        return self.fast.encode_ordinary(text) if self.fast else self.a.encode(text, add_special_tokens=False).ids

    def _ids_b(self, text: str) -> list[int]:
        """B puts a blank before what it encodes: the text's own, or one that is taken off again."""
        own = text[:1] == " "
        ids = self.b.encode(text[1:] if own else text)
        return ids if own or not ids or self.bytes_b[ids[0]] != b" " else ids[1:]

    def _encoded(self, found: list[str], data: list[bytes]) -> list[list[np.ndarray]] | None:
        """Per side the tokens of each stretch, from all stretches in one line; None if a stretch is not spelled in tokens of its own."""
        whole, out = "".join(found), []
        stops = np.cumsum([len(d) for d in data])
        for ids, size, token in ((self.ids_a(whole), self.size_a, self.bytes_a), (self._ids_b(whole), self.size_b, self.bytes_b)):
            if b"".join(map(token.__getitem__, ids)) != b"".join(data):
                return None
            ids = np.array(ids, np.int64)
            ends = np.cumsum(size[ids])
            at = np.searchsorted(ends, stops)
            if (ends[at] != stops).any():
                return None
            out.append((ids, np.diff(np.append(0, at + 1)), ends))
        return out

    def spell(self, found: list[str]) -> list[tuple | None]:
        """(n_a, n_b, n_groups, n_links, pairs, how often each is linked, groups as text) of each stretch; None if its tokens do not spell it."""
        apart = [i for i, f in enumerate(found) if f[-1:].isspace()]  # a text's end: what follows could join
        out: list[tuple | None] = [None] * len(found)
        if apart and len(found) > 1:
            together = sorted(set(range(len(found))).difference(apart))
            for i, e in zip(together, self.spell([found[i] for i in together]), strict=True):
                out[i] = e
            for i in apart:
                out[i] = self.spell([found[i]])[0]
            return out
        if not found:
            return out
        sides = self._encoded(found, [f.encode("utf-8", "surrogatepass") for f in found])
        if sides is None:
            half = len(found) // 2
            return self.spell(found[:half]) + self.spell(found[half:]) if half else out
        (a, na, end_a), (b, nb, end_b) = sides
        group = coalesce(np.concatenate([end_a - self.size_a[a], end_b - self.size_b[b]]), np.concatenate([end_a, end_b]))  # the ends of stretches are ends on both sides
        n, owners = int(group.max()) + 1, len(found)
        owner = np.concatenate([np.repeat(np.arange(owners), na), np.repeat(np.arange(owners), nb)])
        of = np.empty(n, np.int64)
        of[group] = owner
        n_links = np.zeros(owners, np.int64)
        np.add.at(n_links, of, np.bincount(group[:len(a)], minlength=n) * np.bincount(group[len(a):], minlength=n))
        codes, times, stops = self._pairs(a, b, group, of, n, owners)
        codes, times, stops = codes.tobytes(), times.tobytes(), stops.tolist()
        pairs = ([c[w * i:w * j] for i, j in itertools.pairwise(stops)] for c, w in ((codes, 4), (times, 8)))
        return list(zip(na.tolist(), nb.tolist(), np.bincount(of, minlength=owners).tolist(), n_links.tolist(), *pairs, self._lines(a, b, group, owner, owners), strict=True))

    @staticmethod
    def _pairs(a, b, group, of, n, owners):
        """Different pairs of each stretch, how often they are linked, and where the stretches' pairs begin."""
        sides = []
        for ids, g in ((a, group[:len(a)]), (b, group[len(a):])):  # equal tokens of a group are linked alike
            value, number = np.unique(g << 16 | ids, return_counts=True)
            sides.append((value >> 16, value & 0xFFFF, number, np.bincount(value >> 16, minlength=n)))
        (g, ids, number, _), (_, other, often, many) = sides
        first = np.concatenate([[0], np.cumsum(many)[:-1]])
        each = many[g]
        x = np.repeat(np.arange(len(g)), each)
        y = np.repeat(first[g] - (np.cumsum(each) - each), each) + np.arange(len(x))
        key = of[g[x]] << 31 | ids[x] << _SHIFT | other[y]
        order = np.argsort(key, kind="stable")
        key = key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.add.reduceat((number[x] * often[y])[order], start)
        key = key[start]
        return (key & 0x7FFFFFFF).astype(np.uint32), times, np.searchsorted(key >> 31, np.arange(owners + 1))

    def _lines(self, a, b, group, owner, owners) -> list[str]:
        """The groups of each stretch, written out."""
        side = np.repeat([0, 1], [len(a), len(b)])
        order = np.lexsort((np.arange(len(group)), side, group))
        word = np.concatenate([self.word_a[a], self.word_b[b]])[order]
        g, s, o = group[order], side[order], owner[order]
        mark = np.where(g[1:] != g[:-1], np.where(o[1:] != o[:-1], "", ";"), np.where(s[1:] != s[:-1], "|", ",")).astype(object)
        word = (word + np.append(mark, "")).tolist()
        at = np.searchsorted(o, np.arange(owners + 1)).tolist()
        return ["".join(word[i:j]) for i, j in itertools.pairwise(at)]

    def read(self, values: list[str | None]) -> tuple[list[list[int]], list[tuple]]:
        """For each text its stretches as numbers (none: no tokens), and what each number stands for."""
        split = [self.stretches(t) if t else [] for t in values]
        met = list(dict.fromkeys(itertools.chain.from_iterable(split)))
        if len(self.known) + len(met) > 2 * CACHE:  # those met first are the frequent ones
            self.known = dict(itertools.islice(self.known.items(), CACHE // 2))
        new = [s for s in met if s not in self.known]
        fresh: dict[str, tuple | None] = {}
        for i, j in pieces_of(new, 200_000):
            fresh.update(zip(new[i:j], self.spell(new[i:j]), strict=True))
        entries = [fresh[s] if s in fresh else self.known[s] for s in met]
        number = dict(zip(met, range(len(met)), strict=True))
        out = [list(map(number.__getitem__, stretches)) for stretches in split]
        broken = {k for k, e in enumerate(entries) if e is None}
        if broken:  # what one stretch lacks another might have too many of: the text as a whole decides
            for i, at in enumerate(out):
                if at and not broken.isdisjoint(at):
                    whole = self.spell([" " + values[i]])[0]
                    out[i] = [] if whole is None else [len(entries)]
                    entries.append(whole)
        room = max(0, CACHE - len(self.known))
        self.known.update(itertools.islice(((s, e) for s, e in fresh.items() if len(s) <= LONGEST_KEPT), room))
        return out, [e or (0, 0, 0, 0, b"", b"", "") for e in entries]


def pair(path_a: str | None = None, path_b: str | None = None) -> Pair:
    """The worker's tokenizers, kept between tasks."""
    return by_worker(("pair", path_a, path_b), lambda: Pair(path_a, path_b))


def _linked(read: list, entries: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, how often linked) for the texts that were read."""
    codes = np.frombuffer(b"".join([e[4] for e in entries]), np.uint32).astype(np.int64)
    times = np.frombuffer(b"".join([e[5] for e in entries]), np.int64)
    many = np.array([len(e[4]) // 4 for e in entries], np.int64)
    first = np.cumsum(many) - many
    doc = np.repeat(np.arange(len(read)), [len(x) for x in read])
    at = np.fromiter(itertools.chain.from_iterable(read), np.int64, len(doc))
    held, often = np.unique(doc << 32 | at, return_counts=True)
    doc, at = held >> 32, held & 0xFFFFFFFF
    each = many[at]
    x = np.repeat(np.arange(len(at)), each)
    y = np.repeat(first[at] - (np.cumsum(each) - each), each) + np.arange(len(x))
    key, weight = doc[x] << 31 | codes[y], times[y] * often[x]
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[start] >> 31, key[start] & 0x7FFFFFFF, np.add.reduceat(weight[order], start) if len(key) else weight


def _packed(codes: np.ndarray, times: np.ndarray) -> bytes:
    """A text's pairs (in order) and how often each is linked."""
    return np.diff(codes, prepend=0).astype(np.uint32).tobytes() + np.minimum(times, 0xFFFFFFFF).astype(np.uint32).tobytes()


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, how often) of a column of packed pairs."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    data = [press.decompress(x) if x else b"" for x in column.to_pylist()]
    both = [np.frombuffer(x, np.uint32).reshape(2, -1) for x in data]
    codes = np.concatenate([np.cumsum(b[0], dtype=np.int64) for b in both]) if both else np.zeros(0, np.int64)
    return np.repeat(np.arange(len(both)), [b.shape[1] for b in both]), codes, np.concatenate([b[1] for b in both]).astype(np.int64) if both else codes


_FIELDS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs binary"


def spelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, digest: bool = False) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, groups, and its pairs of ids, packed (null without tokens)."""
    import zstandard

    rows = texts(docs, id_col, text_col)

    def run(part):
        press, values, out = zstandard.ZstdCompressor(level=1), part.column(1).to_pylist(), []
        for i, j in pieces_of([v or "" for v in values], CHUNK):
            read, entries = pair(path_a, path_b).read(values[i:j])
            doc, code, times = _linked(read, entries)
            at = np.searchsorted(doc, np.arange(j - i + 1)).tolist()
            packed = [press.compress(_packed(code[a:b], times[a:b])) if b > a else None for a, b in itertools.pairwise(at)]
            out += [(*d, p) for d, p in zip(_described(read, entries, digest), packed, strict=True)]
        cols = list(zip(*out, strict=True))
        return [part.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.binary())]

    return batches(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {_FIELDS}", keeps=True)


def pair_counts(found: DataFrame) -> DataFrame:
    """(code, n): how many texts hold a pair of ids linked; ``code`` is the A id shifted by 15 bits and the B id."""

    def run(parts):
        held, n = [], 0

        def sent():
            code, at = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return code, np.bincount(at, np.concatenate([h[1] for h in held]).astype(np.float64)).astype(np.int64)

        for part in parts:
            held.append(np.unique(_unpacked(part.column(0))[1], return_counts=True))
            n += len(held[-1][0])
            if n >= HELD:
                held = [sent()]
                n = len(held[0][0])
                if n >= HELD:
                    yield _counts(*held[0])
                    held, n = [], 0
        if held:
            yield _counts(*sent())

    return found.where("pairs is not null").select("pairs").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def _counts(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["code", "n"])


def _described(read: list, entries: list, digest: bool) -> list[tuple]:
    doc = np.repeat(np.arange(len(read)), [len(x) for x in read])
    at = np.fromiter(itertools.chain.from_iterable(read), np.int64, len(doc))
    sums = np.zeros((4, len(read)), np.int64)
    for j in range(4):
        np.add.at(sums[j], doc, np.array([e[j] for e in entries], np.int64)[at])
    lines = [e[6] for e in entries]
    own = (";".join(map(lines.__getitem__, x)) for x in read)
    return list(zip(*sums.tolist(), [hashlib.sha256(x.encode()).hexdigest() if digest and x else x for x in own], strict=True))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, digest: bool = False, most: int = MOST_PAIRS) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (``a1,a2|b1;a3|b2,b3``, or its sha256 if ``digest``)."""
    found = cut(spelled(docs, id_col, text_col, path_a, path_b, digest))  # texts are encoded once
    counts = cut(pair_counts(found))
    top = counts.groupBy(F.shiftright("code", _SHIFT).alias("a")).agg(F.max("n").alias("top"))
    table = counts.join(top, F.shiftright("code", _SHIFT) == F.col("a")).select("code", "n", (F.col("n") == F.col("top")).alias("best"))
    return _with_table(found, table) if counts.count() <= most else _with_join(found, table)


_NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def _with_table(found: DataFrame, table: DataFrame) -> DataFrame:
    """The pair table is small enough to be sent to the tasks."""
    known = table.toPandas().sort_values("code")  # at most ``most`` rows
    sent = found.sparkSession.sparkContext.broadcast((known["code"].to_numpy(np.int64), known["n"].to_numpy(np.int64), known["best"].to_numpy(bool)))

    def run(part):
        codes, counts, best = sent.value
        row, code, times = _unpacked(part.column(6))
        at = np.searchsorted(codes, code)
        n_best, total = np.zeros(part.num_rows, np.int64), np.zeros(part.num_rows, np.int64)
        if len(row):
            np.add.at(n_best, row, times * best[at])
            np.add.at(total, row, times * counts[at])
        return [*part.columns[:5], pa.array(n_best), pa.array(total), part.column(5)]

    kind = found.schema["doc_id"].dataType.simpleString()
    return batches(found, run, f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups string")


def _with_join(found: DataFrame, table: DataFrame) -> DataFrame:
    """Different texts' pairs are joined with the pair table; a frequent pair is spread over salts."""
    from ..functions.joins import lookup

    rows = found.withColumn("h", F.xxhash64("pairs"))

    def linked(part):
        h = part.column(0).to_numpy()
        row, code, times = _unpacked(part.column(1))
        return [h[row], code, times]

    pairs = batches(rows.where("pairs is not null").select("h", "pairs").dropDuplicates(["h"]), linked, "h bigint, code bigint, times bigint")
    scored = lookup(pairs, table, {"code": "code"}, ["h"]).groupBy("h").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.when(F.col("pairs").isNotNull(), F.col(c)), F.lit(0)).cast("long").alias(c)
    return rows.join(scored, "h", "left").select(*(zero(c) if c in ("n_best", "count_sum") else c for c in _NAMES))
