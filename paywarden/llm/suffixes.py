"""Suffix arrays by induced sorting, and permuted common prefixes, of a shard's bytes."""

from __future__ import annotations

import itertools

import numpy as np


def _induced(first: list[int], size: list[int], smaller: list[int], larger: list[int], by_char: list[int], last: int, n: int, lms: list[int]) -> list[int]:
    """Suffixes in the order that ``lms``, leftmost-smaller positions in an order of their own, induces.

    ``first``: where each symbol's bucket begins; ``size``: where it ends; ``by_char``: where its smaller suffixes begin.
    ``smaller`` / ``larger``: symbol before a position if the suffix there is of that kind, else -1.
    """
    array, at = [-1] * n, by_char.copy()
    for v, c in lms:
        array[at[c]] = v
        at[c] += 1
    at = first.copy()
    array[at[last]] = n - 1
    at[last] += 1
    for v in array:  # sees what it writes further on
        c = larger[v]
        if c >= 0:
            array[at[c]] = v - 1
            at[c] += 1
    at = size.copy()
    for v in reversed(array):
        c = smaller[v]
        if c >= 0:
            at[c] -= 1
            array[at[c]] = v - 1
    return array


def _by_place(text: np.ndarray, small: np.ndarray, symbols: int):
    n = len(text)
    count = np.bincount(text, minlength=symbols)
    end = np.cumsum(count)
    middle = end - np.bincount(text[small], minlength=symbols)
    before = np.concatenate([[-1], text[:-1]])
    kind = np.concatenate([[False], small[:-1]])
    # the last entry answers for position -1, which stands for an empty place
    smaller = np.append(np.where(kind, before, -1), -1).tolist()
    larger = np.append(np.where(kind, -1, before), -1).tolist()
    first, size, by_char = (end - count).tolist(), end.tolist(), middle.tolist()

    def induced(order: np.ndarray) -> np.ndarray:
        return np.array(_induced(first, size, smaller, larger, by_char, int(text[-1]), n, list(zip(order.tolist(), text[order].tolist(), strict=True))), np.int64)

    return induced


def _by_bucket(text: np.ndarray, small: np.ndarray, symbols: int):
    return lambda order: _induced_by_bucket(text, small, symbols, order)


class _Buckets:
    """Positions by symbol, each bucket in the order of arrival."""

    def __init__(self, symbols: int):
        self.lists: list[list[np.ndarray]] = [[] for _ in range(symbols)]

    def add(self, at: np.ndarray, symbol: np.ndarray) -> None:
        order = np.argsort(symbol, kind="stable")
        at, symbol = at[order], symbol[order]
        cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
        for c, part in zip(symbol[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
            self.lists[c].append(part)

    def take(self, symbol: int) -> np.ndarray:
        return np.concatenate(self.lists[symbol]) if self.lists[symbol] else _NONE


_NONE = np.zeros(0, np.int64)


def _induced_by_bucket(text: np.ndarray, small: np.ndarray, symbols: int, lms: np.ndarray) -> np.ndarray:
    """The same, a bucket at a time, where buckets are few: what a bucket induces into itself comes in rounds, one for each symbol of a run."""
    text = text.astype(np.uint8)
    waiting, larger = _Buckets(symbols), []
    waiting.lists[text[-1]].append(np.array([len(text) - 1]))
    seeds = _Buckets(symbols)
    if len(lms):
        seeds.add(lms, text[lms])
    for c in range(symbols):
        part, rounds = waiting.take(c), []
        while len(part):
            rounds.append(part)
            at = part[part > 0] - 1
            at = at[~small[at]]
            symbol = text[at]
            own = symbol == c
            part = at[own]
            if len(part) < len(at):
                waiting.add(at[~own], symbol[~own])
        larger.append(np.concatenate(rounds) if rounds else _NONE)
        at = seeds.take(c) - 1
        if len(at):
            waiting.add(at, text[at])
    waiting, out = _Buckets(symbols), [_NONE] * symbols
    for c in range(symbols - 1, -1, -1):
        part, rounds = waiting.take(c), []
        while len(part):
            rounds.append(part)
            at = part[part > 0] - 1
            at = at[small[at]]
            symbol = text[at]
            own = symbol == c
            part = at[own]
            if len(part) < len(at):
                waiting.add(at[~own], symbol[~own])
        out[c] = np.concatenate([larger[c], *(r[::-1] for r in reversed(rounds))])
        at = larger[c][::-1]
        at = at[at > 0] - 1
        at = at[small[at]]
        if len(at):
            waiting.add(at, text[at])
    return np.concatenate(out)


#: Symbols up to which buckets are gone through whole.
FEW = 256


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of non-negative integers, in order; a suffix that begins another one comes first.

    Suffixes are classed as smaller or larger than the next one; the substrings between leftmost smaller ones are sorted by
    induction and named; the string of names is sorted by recursion unless all differ; its order induces that of all suffixes.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    text = text.astype(np.int64)
    step = np.sign(np.diff(text))
    known = np.flatnonzero(step)
    ahead = np.searchsorted(known, np.arange(n - 1))  # a run of equal symbols is of the kind of its end
    small = np.append(np.append(step[known], -1)[ahead] > 0, False)
    symbols = int(text.max()) + 1
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induced = _by_bucket(text, small, symbols) if symbols <= FEW else _by_place(text, small, symbols)
    array = induced(lms)
    if len(lms) < 2:
        return array
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    order = array[is_lms[array]]
    stop = np.empty(n, np.int64)
    stop[lms] = np.append(lms[1:] + 1, n + 1)  # the last one ends beyond the text and is like no other
    whole = text.astype(np.min_scalar_type(symbols)).tobytes()
    width = len(whole) // n
    spans = [whole[width * a:width * b] for a, b in zip(order.tolist(), stop[order].tolist(), strict=True)]
    longest = n + 1
    differ = [a != b for a, b in itertools.pairwise(spans)]
    tail = np.flatnonzero(stop[order] == longest)
    names = np.concatenate([[0], np.cumsum(np.array(differ, bool) | np.isin(np.arange(1, len(order)), [*tail, *(tail + 1)]))])
    if names[-1] + 1 < len(order):
        name_of = np.empty(n, np.int64)
        name_of[order] = names
        order = lms[suffix_array(name_of[lms])]
    return induced(order)


def permuted_common_prefixes(data: bytes, array: np.ndarray) -> np.ndarray:
    """For each position, in text order, how many bytes its suffix shares with the one before it in the suffix array.

    Eight bytes are compared at a time, for all positions that still agree.
    """
    n = len(data)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    padded = np.frombuffer(data + bytes(8), np.uint8)
    word = np.lib.stride_tricks.sliding_window_view(padded, 8)[:n + 1].copy().view(np.uint64).ravel()
    at, other, k = array[1:], array[:-1], 0
    while len(at):
        most = n - np.maximum(at, other)  # bytes left in the shorter one
        differ = word[np.minimum(at + k, n)] ^ word[np.minimum(other + k, n)]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, (np.bitwise_count(low - np.uint64(1)) >> 3).astype(np.int64))
        out[at] = np.minimum(k + same, most)
        go = (same == 8) & (k + 8 < most)
        at, other, k = at[go], other[go], k + 8
    return out
