"""Deterministic clustering and bank selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settled, ship
from .joins import bank_neighbours

#: Centres, small by their count and dimension, travel to every task.


def _vectors(batch: pa.RecordBatch, i: int) -> np.ndarray:
    return batch.column(i).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)


def _best(df: DataFrame, ident: str, vector: str, centres: np.ndarray, farthest: bool) -> tuple[int, np.ndarray] | None:
    """The row farthest from its nearest centre (or nearest to it), ties to the smaller id; each task sends one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ids = _vectors(batch, 1), batch.column(0).to_numpy()
            d = ((x[:, None, :] - centres[None]) ** 2).sum(2).min(1)
            d = -d if farthest else d
            i = np.lexsort((ids, d))[0]
            if top is None or (d[i], ids[i]) < top[:2]:
                top = (float(d[i]), int(ids[i]), x[i].tolist())
        if top:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in top], names=["d", "id", "v"])

    row = df.select(F.col(ident).cast("long"), vector).mapInArrow(run, "d double, id long, v array<double>").orderBy("d", "id").first()
    return (row.id, np.array(row.v)) if row else None


def _sums(df: DataFrame, vector: str, ident: str, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of each centre's rows. Sums are of integers (values scaled by 2**24), so no order of rows can change them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(centres), np.int64), [[0] * centres.shape[1] for _ in centres]
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch, 0)
                label = ((x[:, None, :] - centres[None]) ** 2).sum(2).argmin(1)
                whole = np.rint(x * (1 << 24)).astype(np.int64)
                for k in np.unique(label).tolist():
                    n[k] += (label == k).sum()
                    total[k] = [a + int(b) for a, b in zip(total[k], whole[label == k].sum(0), strict=True)]
        at = np.flatnonzero(n).tolist()
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array([[str(v) for v in total[k]] for k in at], pa.list_(pa.string()))], names=["k", "n", "s"])

    counts, sums = np.zeros(len(centres)), [[0] * centres.shape[1] for _ in centres]
    each = df.select(vector).mapInArrow(run, "k int, n long, s array<string>").select("k", "n", F.posexplode("s").alias("j", "s"))
    for r in each.groupBy("k", "j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():  # centres x dimension
        counts[r.k] = r.n
        sums[r.k][r.j] = int(r.s)
    return counts, np.array([[v / (1 << 24) for v in s] for s in sums])


def kmeans(df: DataFrame, ident: str, vector: str, k: int, rounds: int = 10) -> tuple[np.ndarray, DataFrame]:
    """Centres and label of each row. The first centre is the row farthest from the mean, each next the farthest from all chosen;
    an empty cluster keeps its centre; equal distances go to the lower label. The result doesn't depend on partitioning."""
    ship(df.sparkSession)
    df = settled(df.select(ident, vector), "points")
    first = df.limit(1).collect()
    if not first:
        return np.zeros((0, 0)), df.select(ident, F.lit(0).alias("label"))
    zero = np.zeros((1, len(first[0][vector])))
    n, total = _sums(df, vector, ident, zero)
    centres = _best(df, ident, vector, total / n[:, None], True)[1][None]
    while len(centres) < k:
        nxt = _best(df, ident, vector, centres, True)[1]
        if ((centres - nxt) ** 2).sum(1).min() == 0:
            break
        centres = np.vstack([centres, nxt])
    for _ in range(rounds):
        n, total = _sums(df, vector, ident, centres)
        moved = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
        if np.array_equal(moved, centres):
            break
        centres = moved
    bank = df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centres)], "slot int, vec array<double>")
    return centres, bank_neighbours(df, vector, ident, bank).select(ident, F.col("slot").alias("label"))


def kcenter(df: DataFrame, ident: str, vector: str, usage: str, size: int) -> list[int]:
    """Greedy bank of at most `size` rows: the most used, then again and again the row that the bank serves worst.

    Rows of equal vectors are one source, with their usage summed and the least ident. A source's error is its usage times the
    squared distance to the nearest chosen; ties go to the larger usage, then to the smaller vector in array order. A null usage is
    zero; rows without a vector take no part; an empty table gives an empty bank. Each step is one pass whose tasks send one row each.
    """
    ship(df.sparkSession)
    vec = F.col(vector).cast("array<double>")
    sources = df.where(vec.isNotNull()).groupBy(vec.alias("v")).agg(F.coalesce(F.sum(F.col(usage).cast("double")), F.lit(0.0)).alias("u"), F.min(F.col(ident).cast("long")).alias("id"))
    sources = settled(sources, "bank-sources")

    def worst(chosen: list[int], centres: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, use, ids = _vectors(batch, 0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
                error = use * ((x[:, None, :] - centres[None]) ** 2).sum(2).min(1)
                for i in np.lexsort((*x.T[::-1], -use, -error)).tolist():
                    if ids[i] not in chosen:
                        own = (-float(error[i]), -float(use[i]), x[i].tolist(), int(ids[i]))
                        top = own if top is None else min(top, own)
                        break
            if top:
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in top], names=["e", "u", "v", "id"])

        return sources.select("v", "u", "id").mapInArrow(run, "e double, u double, v array<double>, id long").orderBy("e", "u", "v").first()

    row = sources.orderBy(F.desc("u"), "v").first()
    chosen: list[int] = []
    while row is not None:
        chosen.append(row.id)
        centres = np.vstack([centres, row.v]) if len(chosen) > 1 else np.array([row.v], float)
        row = worst(chosen, centres) if len(chosen) < size else None
    return chosen
