"""Word shingles of many texts at once, as 64-bit hashes, and their minhashes."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_P_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers, one to one."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _P)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    held = _powers.get(int(base))
    if held is None or len(held) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        held = np.full(size, base, _U)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        if size <= 1 << 19:
            _powers[int(base)] = held
    return held[:n]


def word_hashes(texts: list[bytes], lower: bool = True) -> list[np.ndarray]:
    """Hashes of the words of each UTF-8 text: runs of bytes other than ASCII white space, with A-Z lower-cased or as they are."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    n = len(data)
    if not n:
        return []
    if lower:
        data = _LOWER[data]
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = turns[::2], turns[1::2]
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(_BYTE[data] * _power(_P, n))])
    hashes = mix((sums[end] - sums[begin]) * _power(_P_INVERSE, n + 1)[begin] + (end - begin).astype(_U))
    return np.split(hashes, np.searchsorted(begin, ends[:-1])) if len(texts) > 1 else [hashes]


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash per window of ``size`` words; the whole sequence if it has fewer, none if it is empty."""
    n = len(words)
    if n == 0:
        return words
    size = min(size, n)
    out = np.full(n - size + 1, size, _U)
    for k in range(size):
        out = mix(out * _P + words[k:n - size + 1 + k])
    return out


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of each text."""
    return [np.unique(windows(w, size)) for w in word_hashes(texts)]


class MinHasher:
    """Minhashes under odd multipliers, in two collections of ``tables`` keys of ``rows`` values each."""

    def __init__(self, rows: int, tables: int, seed: int = 1) -> None:
        self.rows, self.tables, n = rows, tables, 2 * rows * tables
        self.factors = mix(np.arange(seed << 20, (seed << 20) + n, dtype=_U) * _P) | _U(1)

    def values(self, shingles: np.ndarray) -> np.ndarray:
        """The smallest product per multiplier."""
        low = np.full(len(self.factors), ~_U(0))
        for at in range(0, len(shingles), 512):
            np.minimum(low, (shingles[at:at + 512, None] * self.factors).min(axis=0), out=low)
        return low

    def keys(self, values: np.ndarray) -> np.ndarray:
        """A key per group of ``rows`` values: the first ``tables`` of one collection, the rest of the other."""
        out = np.arange(2 * self.tables, dtype=_U)
        for column in values.reshape(2 * self.tables, self.rows).T:
            out = mix(out * _P + column)
        return out

    def sketch(self, values: np.ndarray) -> np.ndarray:
        """A byte per value."""
        return (mix(values) & _U(255)).astype(np.uint8)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum()) if len(b) else 0
