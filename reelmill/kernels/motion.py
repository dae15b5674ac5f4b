"""Block motion: sums of absolute differences over whole and half pixels, searches in rings and by step, nearest palettes by colour bin."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.palettes import motion_rings
from ..session import ship


def predicted(before: np.ndarray, x: int, y: int, size: int, mvx: int, mvy: int, parts: int = 1) -> np.ndarray | None:
    """The block of the frame before at (x, y) moved by a vector in 1 / parts pixels, bilinear with halves up; None outside it."""
    (bx, fx), (by, fy) = divmod(x * parts + mvx, parts), divmod(y * parts + mvy, parts)
    if bx < 0 or by < 0 or bx + size + (fx > 0) > before.shape[1] or by + size + (fy > 0) > before.shape[0]:
        return None
    part = before[by : by + size + 1, bx : bx + size + 1].astype(np.int64)
    whole = np.pad(part, ((0, size + 1 - part.shape[0]), (0, size + 1 - part.shape[1])))
    if not fx and not fy:
        return whole[:size, :size]
    if not fy:
        return (whole[:size, :size] * (parts - fx) + whole[:size, 1:] * fx + parts // 2) // parts
    if not fx:
        return (whole[:size, :size] * (parts - fy) + whole[1:, :size] * fy + parts // 2) // parts
    across = whole[:, :size] * (parts - fx) + whole[:, 1:] * fx
    return (across[:size] * (parts - fy) + across[1:] * fy + parts * parts // 2) // (parts * parts)


def full_search(before: np.ndarray, now: np.ndarray, x: int, y: int, size: int, radius: int, parts: int = 1) -> tuple[int, int, int]:
    """(mvx, mvy, sad) of the least sum of absolute differences over all vectors up to radius pixels; ties to the shorter vector, then
    to the lower mvy and mvx."""
    here = now[y : y + size, x : x + size].astype(np.int64)
    best = None
    reach = range(-radius * parts, radius * parts + 1)
    for mvy in reach:
        for mvx in reach:
            p = predicted(before, x, y, size, mvx, mvy, parts)
            if p is not None:
                best = min(best or ((1 << 62),), (int(np.abs(here - p).sum()), mvx * mvx + mvy * mvy, mvy, mvx))
    return best[3], best[2], best[0]


def ring_search(before: np.ndarray, now: np.ndarray, x: int, y: int, size: int, radius: int) -> tuple[int, int, int] | None:
    """(dx, dy, error) of the least squared error over all channels of the shifts in rings from one pixel out; the first of equals.
    None if no shifted block lies inside the frame."""
    here = now[y : y + size, x : x + size].astype(np.int64)
    best = None
    for dy, dx in motion_rings(radius):
        top, left = y + dy, x + dx
        if top < 0 or left < 0 or top + size > before.shape[0] or left + size > before.shape[1]:
            continue
        error = int(((here - before[top : top + size, left : left + size].astype(np.int64)) ** 2).sum())
        if best is None or error < best[2]:
            best = (dx, dy, error)
    return best


def block_motion(frames: DataFrame, frame: str, width: int, height: int, luma: str, size: int = 16, radius: int = 4, parts: int = 1) -> DataFrame:
    """frame, x, y, mvx, mvy, sad of each block of each frame that has one before it (frame - 1): an equi-join of frames, a task works
    on pairs of them. Blocks that would pass the edge are left out; frames without luma too."""
    ship(frames.sparkSession)
    names = ["frame", "x", "y", "mvx", "mvy", "sad"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for n, now, before in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = (np.frombuffer(v, "u1").reshape(height, width) for v in (now, before))
                for y in range(0, height - size + 1, size):
                    made += [(n, x, y, *full_search(b, a, x, y, size, radius, parts)) for x in range(0, width - size + 1, size)]
            kinds = [pa.int64(), *[pa.int32()] * 4, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], k) for i, k in enumerate(kinds)], names=names)

    own = frames.where(F.col(luma).isNotNull()).select(F.col(frame).cast("long").alias("frame"), F.col(luma).alias("now"))
    before = own.select((F.col("frame") + 1).alias("frame"), F.col("now").alias("before"))
    return own.join(before, "frame").select("frame", "now", "before").mapInArrow(run, "frame long, x int, y int, mvx int, mvy int, sad long")


def palette_index(palettes: np.ndarray, bits: int = 4) -> np.ndarray:
    """Squared distance from the middle of each colour bin (red, green, blue of `bits` bits each) to the nearest colour of each palette:
    (2 ** (3 * bits), palettes)."""
    centre = (np.arange(1 << bits) << (8 - bits)) + (1 << (7 - bits))
    middles = np.stack(np.meshgrid(centre, centre, centre, indexing="ij"), -1).reshape(-1, 3)
    return ((middles[:, None, None] - palettes[None].astype(np.int64)) ** 2).sum(-1).min(-1)


def nearest_palettes(blocks: DataFrame, ident: str, pixels: str, palettes: np.ndarray, bits: int = 4) -> DataFrame:
    """ident, palette: of each block (packed colours) the palette whose binned distances sum least, ties to the lower number. The index
    is as large as the bank times 4096, and travels once a task."""
    ship(blocks.sparkSession)
    box = blocks.sparkSession.sparkContext.broadcast(palette_index(palettes, bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = box.value
        for batch in batches:
            best = []
            for p in batch.column(1).to_pylist():
                c = np.array(p, np.int64)
                r, g, b = ((c >> s & 255) >> (8 - bits) for s in (16, 8, 0))
                best.append(int(table[r << 2 * bits | g << bits | b].sum(0).argmin()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(best, pa.int32())], names=[ident, "palette"])

    kind = blocks.schema[ident].dataType.simpleString()
    return blocks.where(F.col(pixels).isNotNull()).select(ident, pixels).mapInArrow(run, f"`{ident}` {kind}, palette int")
