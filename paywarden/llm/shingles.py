"""Word shingles of many texts at once, as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_P = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}
#: Entries of tables that a worker keeps (16 bytes each); longer ones, for one very long text, go with it.
KEPT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64; tables of up to KEPT are kept by the worker."""
    if "p" in _POWERS and len(_POWERS["p"]) >= n:
        return _POWERS["p"], _POWERS["q"]
    size, out = 1 << max(16, (n - 1).bit_length()), {}
    for name, base in (("p", _P), ("q", pow(_P, -1, 1 << 64))):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out[name] = np.multiply.accumulate(steps)
    if size <= KEPT:
        _POWERS.update(out)
    return out["p"], out["q"]


def shingle_sets(texts: list[str | None], size: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; with fewer words one hash of the whole sequence; empty without words.

    Words are runs of anything but blank and the ASCII control blanks; ASCII letters are lower-cased.
    """
    data = [t.encode("utf-8", "surrogatepass").translate(_TABLE) if t else b"" for t in texts]
    buf = np.frombuffer(b" " + b" ".join(data) + b" ", np.uint8)
    space = _SPACE[buf]
    edge = space[1:] != space[:-1]
    at = np.flatnonzero(edge) + 1
    first, last = at[0::2], at[1::2]
    ends = np.cumsum([1] + [len(d) + 1 for d in data])
    bounds = np.searchsorted(first, ends)
    p, q = powers(len(buf))
    sums = np.concatenate([[np.uint64(0)], np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[:len(buf)])])
    words = mix((sums[last] - sums[first]) * q[first] + (last - first).astype(np.uint64))
    weights = mix(np.arange(1, size + 1, dtype=np.uint64))
    n = max(0, len(words) - size + 1)
    runs = np.zeros(n, np.uint64)
    for j in range(size):
        runs += words[j:j + n] * (weights[j] | np.uint64(1))
    runs = mix(runs)
    out = []
    for i in range(len(data)):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= size:
            out.append(np.unique(runs[a:b - size + 1]))
        elif b > a:
            few = np.array([b - a], np.uint64)
            for j in range(a, b):
                few = mix(few * np.uint64(31) + words[j:j + 1])
            out.append(few)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
