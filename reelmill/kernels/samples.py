"""Packed rows of samples with fewer than eight bits, and their conversion to RGB565."""

from __future__ import annotations

import numpy as np

from ..functions.colour import FROM_YUV_256


def pack(samples: np.ndarray, bits: int) -> bytes:
    """8-bit samples as codes of `bits` bits, least significant first: half up, the last code taking what would pass it."""
    codes = np.minimum((samples.astype(np.int64) + (1 << (7 - bits))) >> (8 - bits), (1 << bits) - 1)
    return np.packbits((codes[:, None] >> np.arange(bits) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """`count` samples, each code in the high bits of a byte."""
    raw = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * bits).reshape(count, bits)
    return ((raw.astype(np.int64) << np.arange(bits)).sum(1) << (8 - bits)).astype(np.uint8)


def rgb565_row(y: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """RGB565 of a row of luma with chroma at half its width, BT.601 studio range in 256ths; luma under black is black."""
    c = np.maximum(y.astype(np.int64) - 16, 0)
    d, e = (np.repeat(p.astype(np.int64), 2)[: len(y)] - 128 for p in (u, v))
    r, g, b = (np.clip((k[0] * c + k[1] * d + k[2] * e + 128) >> 8, 0, 255) for k in FROM_YUV_256)
    return ((r >> 3) << 11 | (g >> 2) << 5 | b >> 3).astype(np.uint16)


def packed_rgb565_row(y: bytes, u: bytes, v: bytes, width: int) -> np.ndarray:
    """RGB565 of a row of 6-bit luma and 5-bit chroma, as packed."""
    half = (width + 1) // 2
    return rgb565_row(unpack(y, 6, width), unpack(u, 5, half), unpack(v, 5, half))
