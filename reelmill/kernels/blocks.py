"""Pixel and bit kernels: transforms, prediction scores, bit codes, quantizers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

_SUMS = np.array([[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]])


def wht4(blocks: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of 4x4 blocks (..., 4, 4), exact in integers."""
    return _SUMS @ blocks.astype(np.int64) @ _SUMS.T


def wht4_inverse(blocks: np.ndarray) -> np.ndarray:
    """Inverse of wht4: the same sums over 16, halves away from zero."""
    raw = wht4(blocks)
    return np.sign(raw) * ((np.abs(raw) + 8) // 16)


def quantize(values: np.ndarray, step: int, dead_zone: float = 0.0) -> np.ndarray:
    """Symmetric rounding to multiples of step; below dead_zone * step, zero."""
    v = np.asarray(values, np.int64)
    return np.where(np.abs(v) < dead_zone * step, 0, np.sign(v) * ((np.abs(v) + step // 2) // step))


class BitWriter:
    """Most significant bit first."""

    def __init__(self):
        self.value = self.bits = 0

    def put(self, value: int, count: int) -> BitWriter:
        if value >> count:
            raise ValueError("value needs more bits")
        self.value, self.bits = self.value << count | value, self.bits + count
        return self

    def ue(self, value: int) -> BitWriter:
        code = value + 1
        return self.put(0, code.bit_length() - 1).put(code, code.bit_length())

    def se(self, value: int) -> BitWriter:
        return self.ue(-2 * value if value <= 0 else 2 * value - 1)

    def bytes(self) -> bytes:
        pad = -self.bits % 8
        return (self.value << pad).to_bytes((self.bits + pad) // 8, "big")


class BitReader:
    def __init__(self, data: bytes, bits: int | None = None):
        self.value, self.total = int.from_bytes(data, "big"), 8 * len(data)
        self.left = self.total if bits is None else bits
        self.at = 0

    def get(self, count: int) -> int:
        if count > self.left:
            raise EOFError("bits")
        self.at, self.left = self.at + count, self.left - count
        return self.value >> (self.total - self.at) & ((1 << count) - 1)

    def ue(self) -> int:
        zeros = 0
        while not self.get(1):
            zeros += 1
            if zeros > 31:
                raise EOFError("code is too long")
        return (1 << zeros | self.get(zeros)) - 1

    def se(self) -> int:
        v = self.ue()
        return (v + 1) // 2 if v & 1 else -(v // 2)


def detail_score(luma: np.ndarray) -> float:
    """Mean of the horizontal and vertical differences at odd rows and columns."""
    y = luma.astype(np.int64)
    here = y[1::2, 1::2]
    if not here.size:
        return 0.0
    return float((np.abs(here - y[1::2, 0::2][:, : here.shape[1]]).sum() + np.abs(here - y[0::2, 1::2][: here.shape[0]]).sum()) / (2 * here.size))


def motion_score(before: np.ndarray, now: np.ndarray, radius: int, step: int = 4) -> tuple[float, float]:
    """(least mean difference over all shifts up to radius, difference without shift) on a grid of every step-th pixel."""
    h, w = now.shape
    radius = max(0, min(radius, min(h, w) // 8))
    rows, cols = np.arange(radius, h - radius, step), np.arange(radius, w - radius, step)
    here = now[np.ix_(rows, cols)].astype(np.int64)
    if not here.size:
        return 0.0, 0.0
    mads = {(dy, dx): float(np.abs(here - before[np.ix_(rows + dy, cols + dx)].astype(np.int64)).mean()) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)}
    return min(mads.values()), mads[0, 0]


def plane_errors(frames: DataFrame, other: DataFrame) -> DataFrame:
    """sse_y, sse_u, sse_v and sample counts of each frame that both sides have; a missing frame raises when counted by the caller."""
    ship(frames.sparkSession)

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            rows = []
            for y, u, v, y2, u2, v2 in zip(*cols, strict=True):
                row = []
                for a, b in ((y, y2), (u, u2), (v, v2)):
                    d = np.frombuffer(a, "u1").astype(np.int64) - np.frombuffer(b, "u1")
                    row += [int(d @ d), len(d)]
                rows.append(row)
            yield pd.DataFrame(rows, columns=["sse_y", "n_y", "sse_u", "n_u", "sse_v", "n_v"])

    udf = F.pandas_udf(run, "sse_y long, n_y long, sse_u long, n_u long, sse_v long, n_v long")
    right = other.select("frame", *[F.col(p).alias(f"{p}2") for p in "yuv"])
    return frames.select("frame", *"yuv").join(right, "frame").withColumn("e", udf("y", "u", "v", "y2", "u2", "v2")).select("frame", "e.*")
