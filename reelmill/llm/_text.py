"""Vectorised word fingerprints over Arrow string arrays.

A word is a maximal run of bytes other than space and U+0009 to U+000D; UTF-8 never uses those bytes inside a character. Its
fingerprint is a polynomial hash mod 2**64 over random byte values, mixed with its length: equal words have equal fingerprints.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_SEGMENT = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (splitmix64's last steps)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


class Words:
    """Of the texts of a batch: word fingerprints, byte bounds in `data`, and the number of words before each text."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], "<i8", len(column) + 1, 8 * column.offset)
        base = int(offsets[0])
        raw = column.buffers()[2]
        self.data = np.frombuffer(raw, "u1")[base : int(offsets[-1])] if raw else np.zeros(0, "u1")
        self.offsets = offsets - base
        inside = ~_BLANK[self.data]
        edge = np.zeros(len(self.data) + 1, bool)
        edge[self.offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.before = np.searchsorted(self.starts, self.offsets)
        self.hashes = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(self.starts):
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + _SEGMENT, "right")))
            self.hashes[at:to] = self._hash(at, to)
            at = to

    def _hash(self, at: int, to: int) -> np.ndarray:
        low, high = int(self.starts[at]), int(self.ends[to - 1])
        up, down = _powers(max(_SEGMENT, high - low))
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(_BYTE[self.data[low:high]] * up[: high - low], out=total[1:])
        s, e = self.starts[at:to] - low, self.ends[at:to] - low
        return mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.before[i] : self.before[i + 1]]


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Fingerprint of each window of `size` consecutive symbols; none if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factors = np.random.default_rng(1000 + seed).integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += hashes[j : j + n] * factors[j]
    return mix(out)


def spans(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Fingerprint of each stretch [low, high) of symbols."""
    up, down = _powers(max(_SEGMENT, len(hashes)))
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes) * up[: len(hashes)], out=total[1:])
    return mix((total[high] - total[low]) * down[low] + (high - low).astype(np.uint64))
