"""Ordered operators within keys: carry-forward, runs, seek lookups, ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import small


def _w(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def carry_forward(df: DataFrame, keys: list[str], order: str, marker: Column, value: str, name: str) -> DataFrame:
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(F.when(marker, F.col(value)), ignorenulls=True).over(w))


def group_ids(df: DataFrame, keys: list[str], order: str, marker: Column, name: str = "group_id") -> DataFrame:
    """A count of markers so far: rows before the first are group 0."""
    w = _w(keys, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(marker, 1).otherwise(0)).over(w).cast("long"))


def scene_score(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """mafd, the change from the row before, and score = min(mafd, |mafd - mafd before|) / 100; the first change has 0 before it."""
    w = _w(keys, order)
    out = df.withColumn("mafd", F.abs(F.col(value) - F.lag(value).over(w)))
    return out.withColumn("score", F.least("mafd", F.abs(F.col("mafd") - F.coalesce(F.lag("mafd").over(w), F.lit(0.0)))) / 100)


def run_lengths(df: DataFrame, keys: list[str], order: str, on: Column, most: int = 17) -> DataFrame:
    """Runs of rows where `on` holds, cut at `most`; runs never cross keys: keys, first, length."""
    w = _w(keys, order)
    at = df.withColumn("__i", F.row_number().over(w)).where(on)
    at = at.withColumn("__run", F.col("__i") - F.row_number().over(w))
    at = at.withColumn("__part", F.floor((F.row_number().over(Window.partitionBy(*keys, "__run").orderBy(order)) - 1) / most))
    return at.groupBy(*keys, "__run", "__part").agg(F.min(order).alias("first"), F.count("*").alias("length")).drop("__run", "__part")


def repeats(df: DataFrame, keys: list[str], order: str, value: str, name: str = "repeat") -> DataFrame:
    """Whether a row's value equals that of the row before; false on the first."""
    return df.withColumn(name, F.coalesce(F.col(value) == F.lag(value).over(_w(keys, order)), F.lit(False)))


def late(df: DataFrame, keys: list[str], arrival: str, seq: str) -> DataFrame:
    """Rows whose sequence number is new: above all that arrived before; duplicates and stragglers go."""
    seen = F.max(seq).over(_w(keys, arrival).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("__seen", seen).where(F.col("__seen").isNull() | (F.col(seq) > F.col("__seen"))).drop("__seen")


def last_n(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The n newest rows of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return df.withColumn("__p", place).where(F.col("__p") <= n).drop("__p")


def seek(index: DataFrame, targets: DataFrame, key: str, start: str) -> DataFrame:
    """For each target, where decoding starts and how many rows to discard: an as-of lookup, clamped to the last row.

    index: key and start, the last keyframe at or before it. Targets beyond the end meet the last row.
    """
    last = index.agg(F.max(key).alias("__last"))
    asked = targets.crossJoin(small(last)).withColumn(key, F.least("target", "__last")).drop("__last")
    return asked.join(index.select(key, start), key).select("target", F.col(start).alias("start"), (F.col(key) - F.col(start)).alias("discard"))


def top_cost(df: DataFrame, cost: str, ident: list[str], n: int = 128) -> DataFrame:
    """The n dearest rows, rank from 1: sorted and cut in one operator, ranked after the cut."""
    order = [F.desc(cost), *[F.asc(c) for c in ident]]
    return df.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def acceptable(df: DataFrame, keys: list[str], quality: str, size: str, target: float, tolerance: float, ident: str) -> DataFrame:
    """The smallest trial of each key within tolerance of the target, ties to the nearer quality; else the one of best quality."""
    near = F.struct(F.col(size), F.abs(F.col(quality) - target), F.col(ident))
    good = F.col(quality) >= target - tolerance
    fields = F.struct(ident, size, quality)
    out = df.groupBy(*keys).agg(F.min_by(fields, F.when(good, near)).alias("__good"), F.min_by(fields, F.struct(-F.col(quality), F.col(ident))).alias("__best"), F.count_if(good).alias("__n"))
    pick = F.when(F.col("__n") > 0, F.col("__good")).otherwise(F.col("__best"))
    return out.select(*keys, *[pick[c].alias(c) for c in (ident, size, quality)], (F.col("__n") > 0).alias("met"))


def name_page(df: DataFrame, name: str, n: int, tail: bool = False) -> DataFrame:
    """The first or last n distinct names in case-folded order, names that differ in case alone apart."""
    order = [F.lower(name), F.col(name)]
    return df.select(name).distinct().orderBy(*[o.desc() if tail else o.asc() for o in order]).limit(n)


def argmin(df: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The row of the lexicographically least `order` of each key."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in columns])


def motion_predictor(df: DataFrame, keys: list[str], row: str, column: str, x: str, y: str, fallback: tuple[int, int]) -> DataFrame:
    """df with predict_x and predict_y: the median of the vectors to the left, above and above right; a neighbour outside the
    picture counts as the fallback. Neighbours above are met by an equi-join on (row, column), one row each."""
    vector = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    above = df.select(*keys, (F.col(row) + 1).alias(row), F.col(column).alias(column), vector.alias("__top"))
    right = df.select(*keys, (F.col(row) + 1).alias(row), (F.col(column) - 1).alias(column), vector.alias("__right"))
    left = df.select(*keys, F.col(row).alias(row), (F.col(column) + 1).alias(column), vector.alias("__left"))
    at = [*keys, row, column]
    out = df.join(left, at, "left").join(above, at, "left").join(right, at, "left")
    outside = F.struct(F.lit(fallback[0]).alias("x"), F.lit(fallback[1]).alias("y"))
    for name in ("x", "y"):
        near = [F.coalesce(F.col(c), outside)[name] for c in ("__left", "__top", "__right")]
        out = out.withColumn(f"predict_{name}", F.array_sort(F.array(*near))[1])
    return out.drop("__left", "__top", "__right")


def best_vectors(df: DataFrame, keys: list[str], vector: list[str], cost: str, arrival: str, k: int) -> DataFrame:
    """keys, vector, cost, rank: the k vectors of least cost of each key, each vector once at its least cost, ties to the first met."""
    each = df.groupBy(*keys, *vector).agg(F.min(F.struct(F.col(cost), F.col(arrival))).alias("__c"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("__c"))
    return each.withColumn("rank", place).where(F.col("rank") <= k).select(*keys, *vector, F.col(f"__c.{cost}").alias(cost), "rank")


def first_frames(df: DataFrame, frame: str, most: int) -> DataFrame:
    """Frames below a limit; zero is none."""
    return df.where(F.col(frame) < most) if most else df
