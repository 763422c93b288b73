"""Personal data: patterns, and a linear-chain conditional random field over word shapes that adds what patterns miss.

Patterns give the base spans (e-mail and network addresses, card and phone numbers). The random field is trained by gradient
ascent on a small labelled table and decoded by Viterbi in numpy, many stretches at once. Tokens further than ``REACH`` from
any trigger (a digit, ``@``, the word ``dot``) are fixed to "outside": stretches between them are independent chains, and
only those are decoded. A found span is added if every token in it has a marginal of at least ``SURE``, its digits fit its
kind and it touches no base span.

Edge cases: null and empty texts have no spans; spans are code point offsets, end exclusive, ordered by start, then kind;
repeated rows are searched each; long texts are searched whole; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, texts

KINDS = ("email", "ip", "card", "phone")
REACH, SURE = 8, 0.95
#: Tokens whose features are in memory at once, and tokens (padding included) that are decoded together; a longer stretch is decoded alone.
BLOCK, TOGETHER = 400, 100_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive digits and the look-behind change no match: whatever starts inside digits also starts before them
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns' matches, by start, then kind."""
    if not text:
        return []
    found = [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m.group().split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start():
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append((m.start(), 3, m.end()))
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


# --- tokens and shapes ---

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|[\d_]")
_TRIGGER = re.compile(r"[0-9@]|\b[Dd][Oo][Tt]\b")
#: Words with a feature of their own; all others only have a shape.
CUES = ("at", "dot", "com", "org", "net", "mail", "email", "e", "phone", "tel", "call", "fax", "mobile", "card", "visa", "credit", "ip", "address", "host", "server", "on", "costs", "page", "version", "in", "of", "eur", "usd", "ext")
_CUE = {w: i for i, w in enumerate(CUES)}


def _shape(token: str, glued: bool) -> str:
    if token[0].isascii() and token[0].isdigit():
        n = len(token)
        kind = f"d{n if n < 6 else '6-9' if n < 10 else '10-13' if n < 14 else '14-19' if n < 20 else '20+'}" + ("b" if n < 4 and int(token) < 256 else "")
    elif token[0].isalpha():
        low = token.lower()
        kind = "w:" + low if low in _CUE else ("X" if token.isupper() else "Xx" if token[0].isupper() else "x") + ("1" if len(token) == 1 else "")
    else:
        kind = token if token in "@.-+()/:,=#_$%[]" else "?"
    return ("g" if glued else "s") + kind


def tokens(text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, len(text) if end is None else end)]


def observations(text: str, at: list[tuple[int, int]]) -> list[list[str]]:
    """Features of each token: its shape, those of its neighbours, and pairs."""
    shapes = [_shape(text[a:b], i > 0 and at[i - 1][1] == a) for i, (a, b) in enumerate(at)]
    padded = ["<", "<", *shapes, ">", ">"]
    return [["0" + padded[i], "-1" + padded[i - 1], "+1" + padded[i + 1], "-2" + padded[i - 2], "+2" + padded[i + 2], "-" + padded[i - 1] + "|" + padded[i], "+" + padded[i] + "|" + padded[i + 1]] for i in range(2, len(padded) - 2)]


LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_K = len(LABELS)
#: Transitions that are possible: inside follows begin or inside of its kind.
_ALLOWED = np.array([[not (b[0] == "I") or a[2:] == b[2:] for b in LABELS] for a in LABELS])
_START = np.array([x[0] != "I" for x in LABELS])


def labelled_table() -> list[tuple[str, list[tuple[str, str]]]]:
    """A small labelled table: (text, [(kind, the part of the text that is of that kind)]), written from templates."""
    names, hosts, ends = ("anna", "j.smith", "li_wei", "Omar"), ("mail", "example", "post"), ("com", "org", "net")
    rows: list[tuple[str, list[tuple[str, str]]]] = []
    for i, (n, h, e) in enumerate(itertools.product(names, hosts, ends)):
        for form in (f"{n} at {h} dot {e}", f"{n}(at){h}(dot){e}", f"{n} [at] {h} [dot] {e}", f"{n}@{h}.{e}", f"{n} @ {h} . {e}")[i % 2::2]:
            rows.append((("Please write to {} today.", "my email is {}", "contact: {}, thanks", "{} is my address")[i % 4].format(form), [("email", form)]))
    for i in range(24):
        a, b, c = 200 + 31 * i, 301 + 17 * i, 1000 + 331 * i
        form = (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{1 + i % 60} {a} {b} {c}", f"00{41 + i} {a} {b} {c}", f"+1 ({a}) {b}-{c}")[i % 6]
        rows.append((("call {} now", "phone: {}", "the tel is {} for you", "Fax {} or mail")[i % 4].format(form), [("phone", form)]))
        p = [(7 * i + 13 * j + 4) % 256 for j in range(4)]
        form = (f"{p[0]}.{p[1]}.{p[2]}.{p[3]}", f"{p[0]} . {p[1]} . {p[2]} . {p[3]}", f"{p[0]}[.]{p[1]}[.]{p[2]}[.]{p[3]}")[i % 3]
        rows.append((("from ip {} again", "host {} is down", "the server at {} said")[i % 3].format(form), [("ip", form)]))
        q = [(1111 * (i + 3) + 2357 * j) % 9000 + 1000 for j in range(4)]
        form = (f"{q[0]} {q[1]} {q[2]} {q[3]}", f"{q[0]}-{q[1]}-{q[2]}-{q[3]}", f"{q[0]}{q[1]}{q[2]}{q[3]}", f"{q[0]}.{q[1]}.{q[2]}.{q[3]}")[i % 4]
        rows.append((("my card {} please", "visa: {}", "credit card {} is mine")[i % 3].format(form), [("card", form)]))
    for i in range(16):
        y, m, d = 1970 + 3 * i, 1 + i % 12, 1 + i % 28
        for text in (f"on {d}.{m}.{y} it was of the", f"it costs {y} EUR in all", f"see page {d}, line {m}.", f"version {m}.{d} of it", f"{y}-{m:02d}-{d:02d} was a day", f"about {m} of {d} in {y}",
                     f"password={d}ab{y}cd{m}ef", f"key AKIA{d}XY{y}Z of", f"at {d} {m} and {d} more, {y} of {m}", f"the number {y}{m}{d} is {y}", f"{m}, {d}, {y} and {m}", f"{m}.{d}. the", f"a dot in {y} at home", f"{m}|{d}|{y} of"):
            if (i + len(text)) % 3 == 0:
                rows.append((text, []))
    return rows


def _gold(text: str, at: list[tuple[int, int]], spans: list[tuple[str, str]]) -> list[int]:
    out = [0] * len(at)
    for kind, part in spans:
        a = text.index(part)
        inside = [i for i, (s, e) in enumerate(at) if s >= a and e <= a + len(part)]
        for j, i in enumerate(inside):
            out[i] = LABELS.index(("B-" if j == 0 else "I-") + kind)
    return out


class Field:
    """Weights of a trained chain. ``ids`` maps a feature to its row of ``emit``."""

    def __init__(self, ids: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.ids, self.emit = ids, emit
        self.move = np.where(_ALLOWED, move, -1e4)
        self.start = np.where(_START, 0.0, -1e4)

    def scores_of(self, text: str, at: list[tuple[int, int]]) -> np.ndarray:
        """Scores of all tokens of a stretch. Features are made for ``BLOCK`` tokens at a time, with the neighbours they look at."""
        out = np.zeros((len(at), _K))
        for j in range(0, len(at), BLOCK):
            a = max(0, j - 3)
            out[j:j + BLOCK] = self.scores(observations(text, at[a:j + BLOCK + 2])[j - a:j - a + BLOCK])
        return out

    def scores(self, observed: list[list[str]]) -> np.ndarray:
        get, rows = self.ids.get, np.zeros((len(observed), _K))
        for i, features in enumerate(observed):
            known = [j for f in features if (j := get(f)) is not None]
            if known:
                rows[i] = self.emit[known].sum(0)
        return rows


def _padded(chains: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(c) for c in chains])
    out = np.zeros((len(chains), int(length.max()), _K))
    for i, c in enumerate(chains):
        out[i, :len(c)] = c
    return out, length


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def forward_backward(e: np.ndarray, length: np.ndarray, start: np.ndarray, move: np.ndarray, moves: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log partition, marginals (chains, places, labels) and expected transitions (summed over chains; zeros without ``moves``)."""
    n, t, k = e.shape
    alpha, beta = np.zeros((n, t, k)), np.zeros((n, t, k))
    alpha[:, 0] = start + e[:, 0]
    for i in range(1, t):
        step = _lse(alpha[:, i - 1, :, None] + move, 1) + e[:, i]
        alpha[:, i] = np.where((i < length)[:, None], step, alpha[:, i - 1])
    z = _lse(alpha[:, -1], 1)
    for i in range(t - 2, -1, -1):
        step = _lse(move + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        beta[:, i] = np.where((i + 1 < length)[:, None], step, 0.0)
    marginal = np.exp(np.clip(alpha + beta - z[:, None, None], -60, 0)) * (np.arange(t) < length[:, None])[:, :, None]
    pairs = np.zeros((k, k))
    for i in range(1, t if moves else 1):
        on = i < length
        if on.any():
            pairs += np.exp(np.clip(alpha[on, i - 1, :, None] + move + (e[on, i] + beta[on, i])[:, None, :] - z[on, None, None], -60, 0)).sum(0)
    return z, marginal, pairs


def viterbi(e: np.ndarray, length: np.ndarray, start: np.ndarray, move: np.ndarray) -> list[list[int]]:
    """The best labels of each chain of a padded batch."""
    n, t, _ = e.shape
    best, back = start + e[:, 0], np.zeros((n, t, _K), np.int8)
    for i in range(1, t):
        step = best[:, :, None] + move
        back[:, i] = step.argmax(1)
        best = np.where((i < length)[:, None], step.max(1) + e[:, i], best)
    last, out = best.argmax(1), np.zeros((n, t), np.int64)
    rows = np.arange(n)
    for i in range(t - 1, -1, -1):
        on = i < length
        out[on, i] = last[on]
        if i:
            last = np.where(on, back[rows, i, last], last)
    return [out[j, :length[j]].tolist() for j in range(n)]


def train(table: list[tuple[str, list[tuple[str, str]]]], rounds: int = 150, ridge: float = 0.02, rate: float = 0.2) -> Field:
    """Maximum likelihood with a ridge, by Adam on the whole table."""
    chains, gold = [], []
    for text, spans in table:
        at = tokens(text)
        if at:
            chains.append(observations(text, at))
            gold.append(_gold(text, at, spans))
    names = sorted({f for c in chains for o in c for f in o})
    ids = {f: i for i, f in enumerate(names)}
    index = [np.array([[ids[f] for f in o] for o in c]) for c in chains]
    emit, move = np.zeros((len(names), _K)), np.zeros((_K, _K))
    truth, pairs = np.zeros_like(emit), np.zeros_like(move)
    for c, g in zip(index, gold, strict=True):
        for o, y in zip(c, g, strict=True):
            truth[o, y] += 1
        for a, b in itertools.pairwise(g):
            pairs[a, b] += 1
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in (emit, move)]
    for r in range(1, rounds + 1):
        field = Field(ids, emit, move)
        e, length = _padded([emit[c].sum(1) for c in index])
        _, marginal, expected = forward_backward(e, length, field.start, field.move)
        model = np.zeros_like(emit)
        for i, c in enumerate(index):
            np.add.at(model, c, marginal[i, :len(c), None, :])
        for w, g, (m, v) in zip((emit, move), (truth - model - ridge * emit, (pairs - expected) * _ALLOWED - ridge * move), state, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9 ** r)) / (np.sqrt(v / (1 - 0.99 ** r)) + 1e-8)
    return Field(ids, emit, move)


# --- decoding of whole texts ---

def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Token runs within reach of a trigger."""
    out: list[list[tuple[int, int]]] = []
    reached = -1
    for m in _TRIGGER.finditer(text):
        if m.start() < reached:
            continue
        a = max(0, m.start() - 24 * REACH)
        left = [t for t in tokens(text, a, m.start()) if t[0] > a or a == 0][-REACH:]
        run = [t for t in left if not out or t[0] >= out[-1][-1][1]]
        quiet, at = 0, m.start()
        while quiet <= REACH and (t := _TOKEN.search(text, at)):
            run.append(t.span())
            at = t.end()
            quiet = 0 if _TRIGGER.search(text, *t.span()) else quiet + 1
        reached = at
        if run:
            out.append(run)
    return out


_DIGITS_OF = {"ip": (4, 12), "card": (13, 19), "phone": (7, 15)}


def _fits(kind: str, part: str) -> bool:
    n = sum(c.isdigit() for c in part)
    low, high = _DIGITS_OF.get(kind, (0, 99))
    return low <= n <= high and len(part) <= 80 and "\n" not in part


def added_spans(values: list[str | None], base: list[list[tuple[str, int, int]]], field: Field) -> list[list[tuple[str, int, int]]]:
    """Spans of the field that touch no base span, for each text."""
    chains, where = [], []
    for i, text in enumerate(values):
        for run in stretches(text) if text else ():
            chains.append(field.scores_of(text, run))
            where.append((i, run))
    out: list[list[tuple[str, int, int]]] = [[] for _ in values]
    order = sorted(range(len(chains)), key=lambda c: len(chains[c]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and b - a < 256 and (b - a + 1) * len(chains[order[b]]) <= TOGETHER:
            b += 1
        some, a = order[a:b], b
        e, length = _padded([chains[c] for c in some])
        paths = viterbi(e, length, field.start, field.move)
        hit = [j for j, p in enumerate(paths) if any(p)]
        if not hit:
            continue
        _, marginal, _ = forward_backward(e[hit], length[hit], field.start, field.move, moves=False)
        for k, j in enumerate(hit):
            i, at = where[some[j]]
            path, n = paths[j], 0
            while n < len(path):
                if path[n] == 0:
                    n += 1
                    continue
                kind, m = LABELS[path[n]][2:], n + 1
                while m < len(path) and LABELS[path[m]] == "I-" + kind:
                    m += 1
                start, end = at[n][0], at[m - 1][1]
                if marginal[k, np.arange(n, m), path[n:m]].min() >= SURE and _fits(kind, values[i][start:end]) and all(end <= s or start >= t for _, s, t in base[i]):
                    out[i].append((kind, start, end))
                n = m
    return out


def ordered(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with spans replaced by ``[KIND]``; overlapping spans become one, named after the first."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for kind, a, b in ordered(spans):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]])


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """Per document: doc_id, base and all spans as arrays of (kind, start, stop)."""
    rows = texts(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(field or train(labelled_table()))

    def run(part):
        values = part.column(1).to_pylist()
        base = [base_spans(t) for t in values]
        more = added_spans(values, base, sent.value)
        as_rows = lambda spans: [{"kind": k, "start": a, "stop": b} for k, a, b in spans]
        return [part.column(0), pa.array([as_rows(b) for b in base], _SPAN), pa.array([as_rows(ordered(b + m)) for b, m in zip(base, more, strict=True)], _SPAN)]

    span = "array<struct<kind:string,start:bigint,stop:bigint>>"
    return batches(rows, run, f"doc_id {kind}, base {span}, spans {span}")


def mask(docs: DataFrame, text_col: str = "text", field: Field | None = None) -> DataFrame:
    """``docs`` with all its columns, personal data in the text replaced by its kind."""
    sent = docs.sparkSession.sparkContext.broadcast(field or train(labelled_table()))
    at = docs.columns.index(text_col)

    def run(parts):
        for part in parts:
            values = part.column(at).to_pylist()
            base = [base_spans(t) for t in values]
            more = added_spans(values, base, sent.value)
            cols = list(part.columns)
            cols[at] = pa.array([masked(t, b + m) for t, b, m in zip(values, base, more, strict=True)], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    return docs.mapInArrow(run, docs.schema)


def joined(spans: str):
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
