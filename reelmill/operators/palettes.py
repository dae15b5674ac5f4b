"""Palette operators: usage counts, block descriptors, two-level training, nearest palettes, greedy colour subsets.

Pixels are arrays of packed colours r << 16 | g << 8 | b; a block has sixteen.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship


def inside(across: str, down: str, width: int, height: int, size: int = 4) -> Column:
    """The places of a block (its column and row of blocks) that lie inside a frame: those past its edge are padding."""
    return F.filter(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda k: (F.col(across) * size + k % size < width) & (F.col(down) * size + F.floor(k / size) < height))


def usage(blocks: DataFrame, keys: list[str], colours: str, places: Column | None = None) -> DataFrame:
    """How many pixels use each colour number of each palette: keys, colour, pixels. places: which of a block's pixels count, all if
    not given. Counted in the JVM, combined before the shuffle; blocks without colours count for nothing."""
    colours_ = F.col(colours) if places is None else F.transform(places, lambda k: F.get(F.col(colours), k.cast("int")))
    return blocks.select(*keys, F.explode(colours_).alias("colour")).groupBy(*keys, "colour").agg(F.count("*").alias("pixels"))


def combined(bank: DataFrame, palette: str, weights: list[str]) -> DataFrame:
    """Equal palettes as one, their weights added and the sources counted."""
    return bank.groupBy(F.sha2(F.col(palette).cast("binary"), 256).alias("palette_sha256")).agg(F.count("*").alias("sources"), *[F.sum(w).alias(w) for w in weights])


def _rgb(pixels) -> np.ndarray:
    p = np.asarray(pixels, np.int64)
    return np.stack([p >> 16 & 255, p >> 8 & 255, p & 255], -1).astype(float)


def descriptor(pixels) -> np.ndarray:
    """Mean and population deviation of each channel of a block."""
    x = _rgb(pixels)
    return np.concatenate([x.mean(0), x.std(0)])


def centres_of(points: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Deterministic k-means of one task's points: farthest from the mean, then farthest first; ties to the lower index, an empty
    cluster keeps its centre."""
    distance = lambda c: ((points[:, None] - c[None]) ** 2).sum(2)
    centres = points[[int(distance(points.mean(0)[None])[:, 0].argmax())]]
    while len(centres) < min(k, len(points)):
        centres = np.vstack([centres, points[int(distance(centres).min(1).argmax())]])
    label = distance(centres).argmin(1)
    for _ in range(rounds):
        centres = np.array([points[label == i].mean(0) if (label == i).any() else c for i, c in enumerate(centres)])
        now = distance(centres).argmin(1)
        if np.array_equal(now, label):
            break
        label = now
    return centres, label


def by_luma(colours: np.ndarray) -> np.ndarray:
    """Colours in order of 77 r + 150 g + 29 b, then of their bytes."""
    c = np.rint(colours).astype(np.int64)
    return c[np.lexsort((c[:, 2], c[:, 1], c[:, 0], c @ [77, 150, 29]))]


def trained(blocks: DataFrame, group: str, ident: str, pixels: str, palettes: int = 64, colours: int = 16) -> DataFrame:
    """group, palette, colour, r, g, b: blocks of a group clustered by descriptor, then the pixels of a cluster into its colours.

    An empty place takes the group's overall colours. A group is one run of frames, sampled by its caller, and one task's work.
    """
    ship(blocks.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(ident)
        _, label = centres_of(np.array([descriptor(p) for p in part[pixels]]), palettes)
        every = [_rgb(p) for p in part[pixels]]
        overall = centres_of(np.concatenate(every), colours)[0]
        out = []
        for k in range(palettes):
            own = [every[i] for i in np.flatnonzero(label == k)]
            bank = by_luma(centres_of(np.concatenate(own), colours)[0] if own else overall)
            bank = np.vstack([bank, np.repeat(bank[-1:], colours - len(bank), 0)])
            out += [(part[group].iloc[0], k, c, *map(int, v)) for c, v in enumerate(bank)]
        return pd.DataFrame(out, columns=[group, "palette", "colour", "r", "g", "b"])

    kind = blocks.schema[group].dataType.simpleString()
    return blocks.select(group, ident, pixels).groupBy(group).applyInPandas(run, f"{group} {kind}, palette int, colour int, r int, g int, b int")


def subset(block, palette: np.ndarray, size: int) -> tuple[list[int], float]:
    """Greedy colour numbers for a block: again and again the one that lowers the summed distance most, ties to the lower; and the error."""
    d = ((_rgb(block)[:, None] - palette[None]) ** 2).sum(2)
    chosen: list[int] = []
    best = np.full(len(d), np.inf)
    while len(chosen) < min(size, len(palette)):
        gain = np.minimum(best[:, None], d).sum(0)
        gain[chosen] = np.inf
        k = int(gain.argmin())
        if chosen and gain[k] >= best.sum():
            break
        chosen.append(k)
        best = np.minimum(best, d[:, k])
    return chosen, float(best.sum())


def coded(blocks: DataFrame, ident: str, pixels: str, palette: list[tuple[int, int, int]], size: int = 4) -> DataFrame:
    """ident, colours (chosen numbers) and error of each block against one palette."""
    ship(blocks.sparkSession)
    bank = np.array(palette, float)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in batches:
            made = [subset(p, bank, size) for p in part]
            yield pd.DataFrame({"colours": [m[0] for m in made], "error": [m[1] for m in made]})

    udf = F.pandas_udf(run, "colours array<int>, error double")
    return blocks.withColumn("__c", udf(F.col(pixels))).select(ident, "__c.colours", "__c.error")


def motion_rings(radius: int) -> list[tuple[int, int]]:
    """Shifts (dy, dx) ring by ring from one pixel out, rows first: the order in which an exact match is looked for."""
    side = lambda r: [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1)]
    inner = [set(side(r)) for r in range(radius + 1)]
    return [s for small, r in zip((a for a, _ in pairwise([*inner, set()])), range(1, radius + 1), strict=False) for s in side(r) if s not in small]


def exact_motion(blocks: DataFrame, frame: str, across: str, down: str, content: str, radius: int) -> DataFrame:
    """The nearest block of the frame before with equal content: frame, across, down, dy, dx. An equi-join on the content, then the
    first by ring, dy and dx. Content that very many blocks share (flat areas) makes many pairs: bounded by shifts, not by the group."""
    before = blocks.select((F.col(frame) + 1).alias(frame), content, F.col(across).alias("__x"), F.col(down).alias("__y"))
    shifts = F.array(*[F.struct(F.lit(i).alias("ring"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for i, (dy, dx) in enumerate(motion_rings(radius))])
    asked = blocks.select(frame, across, down, content, F.explode(shifts).alias("s"))
    asked = asked.withColumn("__x", F.col(across) + F.col("s.dx")).withColumn("__y", F.col(down) + F.col("s.dy"))
    met = asked.join(before, [frame, content, "__x", "__y"])  # one block at a place, so at most one row a shift
    return met.groupBy(frame, across, down).agg(F.min("s").alias("s")).select(frame, across, down, "s.dy", "s.dx")
