"""Joins: grids, resumption, nearest and interval matches, comparisons, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import error_percent, sse

#: A side up to this many rows may be broadcast; it is counted first.
BROADCAST_ROWS = 100_000
#: Entries of a bank at most: every row looks at them all.
BANK_ROWS = 4096


def small(df: DataFrame) -> DataFrame:
    """df marked for broadcast, once its count shows that it is small; else a ValueError, for callers that have no other way."""
    n = df.limit(BROADCAST_ROWS + 1).count()
    if n > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} rows to broadcast")
    return F.broadcast(df)


def grid(*axes: DataFrame) -> DataFrame:
    """All combinations of the rows of small tables: a parameter grid is the product by intent."""
    out = axes[0]
    for a in axes[1:]:
        out = out.crossJoin(small(a))
    return out


def resume(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is still to do."""
    return wanted.join(done.select(*key), key, "left_anti")


def positional_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, left, right of places that differ or exist on one side only."""
    a, b = left.select(key, F.col(value).alias("left_value")), right.select(key, F.col(value).alias("right_value"))
    return a.join(b, key, "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value")))


def nearest_match(targets: DataFrame, target: str, candidates: DataFrame, value: str, ident: str) -> DataFrame:
    """The candidate nearest to each target; of equal distances the larger value, then the smaller ident. Targets are a short list."""
    distance = F.abs(F.col(value) - F.col(target))
    best = F.min_by(F.struct(value, ident), F.struct(distance, -F.col(value), F.col(ident)))
    met = candidates.crossJoin(small(targets)).groupBy(target).agg(best.alias("__b"))
    return met.select(target, F.col(f"__b.{value}").alias(value), F.col(f"__b.{ident}").alias(ident))


def bank_neighbours(df: DataFrame, vector: str, ident: str, bank: DataFrame, n: int = 1) -> DataFrame:
    """The n entries of a small bank (slot, vec) nearest to each row, ties to the lower slot: ident, place, slot, error.

    The bank travels as one broadcast array, and each row ranks it by itself; nothing is shuffled. Its rows are counted before they
    become one; an empty bank gives no rows.
    """
    if bank.limit(BANK_ROWS + 1).count() > BANK_ROWS:
        raise ValueError(f"more than {BANK_ROWS} entries in a bank")
    whole = F.broadcast(bank.agg(F.array_sort(F.collect_list(F.struct("slot", "vec"))).alias("__bank")))
    scored = F.transform("__bank", lambda b: F.struct(F.round(sse(F.col(vector), b["vec"]), 6).alias("error"), b["slot"].alias("slot")))
    top = df.crossJoin(whole).select(ident, F.posexplode(F.slice(F.array_sort(scored), 1, n)).alias("place", "__s"))
    return top.select(ident, "place", F.col("__s.slot").alias("slot"), F.col("__s.error").alias("error"))


def interval_lookup(df: DataFrame, value: str, bands: DataFrame) -> DataFrame:
    """df with the band (low <= value < high) of a small table of bands."""
    return df.join(small(bands), (F.col(value) >= F.col("low")) & (F.col(value) < F.col("high")))


def ab_compare(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Both sides' values, one null where a side lacks the key, and the change in percent."""
    left, right = a.select(*key, F.col(value).alias("a")), b.select(*key, F.col(value).alias("b"))
    return left.join(right, key, "full_outer").withColumn("delta_percent", error_percent(F.col("b"), F.col("a")))


def differing_sizes(a: DataFrame, b: DataFrame, key: str, size: str) -> DataFrame:
    return a.select(key, F.col(size).alias("listed")).join(b.select(key, F.col(size).alias("found")), key).where("listed <> found")


def adjacent(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Each row beside the one of key + 1: an equi-join, so no global window. A row before a gap has no neighbour and is left out."""
    nxt = df.select((F.col(key) - 1).alias(key), *[F.col(c).alias(f"next_{c}") for c in columns])
    return df.select(key, *columns).join(nxt, key)


def override(df: DataFrame, key: str, baseline: Column, score: str, bounds: list[str], ident: str) -> DataFrame:
    """The best baseline row of each key, unless a challenger beats its score and exceeds none of its bounds.

    Both bests are found by aggregation: the first gives the bounds, the second looks at challengers within them.
    """
    row = F.struct(F.col(score), F.col(ident), *[F.col(b) for b in bounds])
    base = df.where(baseline).groupBy(key).agg(F.min(row).alias("__base"))
    inside = F.col(score) < F.col(f"__base.{score}")
    for b in bounds:
        inside = inside & (F.col(b) <= F.col(f"__base.{b}"))
    rivals = df.where(~baseline).join(base, key).where(inside).groupBy(key).agg(F.min(row).alias("__rival"))
    out = base.join(rivals, key, "left").withColumn("__w", F.coalesce("__rival", "__base"))
    return out.select(key, F.col(f"__w.{ident}").alias(ident), F.col(f"__w.{score}").alias(score), F.col("__rival").isNotNull().alias("overridden"))


def first_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The row of the least `order` of each key, by aggregation rather than a window."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def unknown(df: DataFrame, key: str, known: DataFrame) -> DataFrame:
    return df.select(key).distinct().join(known.select(key), key, "left_anti")
