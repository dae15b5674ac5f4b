"""Running values over one global order, in two levels.

A window without partitioning runs in one task. Here the order's key is cut into ranges of fixed width: ranges are summarised, the
summaries (one row a range) are accumulated, and rows are finished inside their range. Only the summaries meet in one task.

Rows with a null key come before all others, in no order among themselves. Repeated keys are in no order either, unless ties
are named. Empty tables give empty results. Columns whose names begin with two underscores are the operators' own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Width of a range of the key.
WIDTH = 100_000


def _cut(df: DataFrame, key: str, width: int) -> DataFrame:
    return df.withColumn("__range", F.floor(F.col(key) / width))


def _back(cut: DataFrame, summary: DataFrame) -> DataFrame:
    """Rows with what is known of their range; that of null keys is a range too."""
    right = summary.withColumnRenamed("__range", "__of")
    return cut.join(right, F.col("__range").eqNullSafe(F.col("__of"))).drop("__of")


def indexed(df: DataFrame, key: str, name: str = "idx", width: int = WIDTH, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with the 0-based place of each row in the order of `key`, then of `ties`."""
    cut = _cut(df, key, width)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(key, *ties)) - 1
    return _back(cut, starts).withColumn(name, (F.col("__start") + inside).cast("long")).drop("__range", "__start")


def prefix_sum(df: DataFrame, key: str, value: str, name: str, width: int = WIDTH) -> DataFrame:
    """df with the sum of `value` over all rows of smaller `key`; keys are distinct."""
    cut = _cut(df, key, width)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("__range").agg(F.sum(value).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _back(cut, starts).withColumn(name, F.col("__start") + inside).drop("__range", "__start")


def carried(df: DataFrame, key: str, value, name: str, width: int = WIDTH) -> DataFrame:
    """df with the last non-null `value` (a column expression) at or before each row."""
    cut = _cut(df, key, width).withColumn("__v", value)
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    last = cut.groupBy("__range").agg(F.max_by("__v", F.when(F.col("__v").isNotNull(), F.col(key))).alias("__l"))
    last = last.select("__range", F.last("__l", ignorenulls=True).over(before).alias("__from"))
    inside = F.last("__v", ignorenulls=True).over(Window.partitionBy("__range").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return _back(cut, last).withColumn(name, F.coalesce(inside, F.col("__from"))).drop("__range", "__v", "__from")


def lagged(df: DataFrame, key: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """df with the `value` (a column expression) of the row before, null on the first."""
    cut = _cut(df, key, width).withColumn("__v", F.struct(value.alias("v")))
    last = cut.groupBy("__range").agg(F.max_by("__v", F.coalesce(F.col(key), F.lit(0))).alias("__l"))
    last = last.select("__range", F.lag("__l").over(Window.orderBy("__range")).alias("__from"))
    inside = F.lag("__v").over(Window.partitionBy("__range").orderBy(key))
    return _back(cut, last).withColumn(name, F.coalesce(inside, F.col("__from"))["v"]).drop("__range", "__v", "__from")


def previous(df: DataFrame, key: str, name: str, width: int = WIDTH) -> DataFrame:
    """df with the key of the row before."""
    return lagged(df, key, F.col(key), name, width)


def cuts(df: DataFrame, key: str, value: str, every: int, threshold: float, width: int = WIDTH) -> DataFrame:
    """df with cut: whether a row begins a group, as the first row, at each multiple of `every`, or where `value` moves by the
    threshold or more from the row before. Keys may have gaps. A null value is no move."""
    out = lagged(df, key, F.struct(F.col(value).alias("w")), "__before", width)
    moved = F.coalesce(F.abs(F.col(value) - F.col("__before.w")) >= threshold, F.lit(False))
    return out.withColumn("cut", F.col("__before").isNull() | (F.coalesce(F.col(key) % every, F.lit(1)) == 0) | moved).drop("__before")


def gaps(df: DataFrame, key: str, width: int = WIDTH) -> DataFrame:
    """previous, next, missing of each place where the key doesn't go up by one."""
    out = previous(df.select(key), key, "previous", width).where(F.col(key) > F.col("previous") + 1)
    return out.select("previous", F.col(key).alias("next"), (F.col(key) - F.col("previous") - 1).alias("missing"))


def islands(df: DataFrame, key: str, *aggs, width: int = WIDTH) -> DataFrame:
    """first, last, rows and `aggs` of each run of consecutive keys; null keys are in no run."""
    run = indexed(df.where(F.col(key).isNotNull()), key, "__i", width).withColumn("__run", F.col(key) - F.col("__i"))
    return run.groupBy("__run").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n"), *aggs).drop("__run")


def systematic(df: DataFrame, key: str, most: int, width: int = WIDTH) -> DataFrame:
    """The rows at places floor(i * n / most), i < most, in integers: all rows if there are no more than `most`."""
    n = df.count()
    if n <= most:
        return df
    at = indexed(df, key, "__i", width).withColumn("__k", F.expr(f"(__i * {most} + {n - 1}) div {n}"))
    return at.where(F.expr(f"(__k * {n}) div {most} = __i")).drop("__i", "__k")


def three_windows(df: DataFrame, key: str, length: int, width: int = WIDTH) -> DataFrame:
    """Rows of the first, middle and last `length` places with column window; windows of a short input overlap."""
    n = df.count()
    size = min(length, n)
    starts = {"start": 0, "middle": (n - size) // 2, "end": n - size}
    at = indexed(df, key, "__i", width)
    inside = [F.when((F.col("__i") >= s) & (F.col("__i") < s + size), F.lit(w)) for w, s in starts.items()]
    return at.withColumn("window", F.explode(F.array_compact(F.array(*inside)))).drop("__i")


def within_budget(df: DataFrame, cost: str, ident: str, budget: float, parts: int = 64) -> DataFrame:
    """The rows of least cost, ties by `ident`, whose running cost stays within the budget, with that cost as running.

    Costs aren't negative and null ones are left out, so the first overflow ends it. Costs are cut into ranges at quantiles, and a
    range that holds one cost alone is cut again by ident, so a range is about a `parts`-th of the rows whatever their spread. Ranges
    that begin beyond the budget go before any row is ordered.
    """
    own = df.where(F.col(cost) <= budget)
    at = [i / parts for i in range(1, max(2, parts))]
    marks = own.agg(F.percentile_approx(cost, at, 10_000).alias("c"), F.percentile_approx(ident, at, 10_000).alias("i")).first()
    if marks.c is None:
        return own.withColumn("running", F.col(cost))

    def place(column: str, bounds: list) -> Column:
        """How many bounds lie below."""
        return F.size(F.filter(F.array(*[F.lit(b) for b in sorted(set(bounds))]), lambda b: b < F.col(column)))

    cut = own.withColumn("__c", place(cost, marks.c))
    single = [r["__c"] for r in cut.groupBy("__c").agg(F.min(cost).alias("a"), F.max(cost).alias("b")).where("a = b").collect()]  # `parts` rows
    cut = cut.withColumn("__range", F.struct("__c", F.when(F.col("__c").isin(single), place(ident, marks.i)).otherwise(0).alias("i")))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy("__range").agg(F.sum(cost).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.sum(cost).over(Window.partitionBy("__range").orderBy(cost, ident).rowsBetween(Window.unboundedPreceding, 0))
    out = _back(cut, starts.where(F.col("__start") <= budget)).withColumn("running", F.col("__start") + inside)
    return out.where(F.col("running") <= budget).drop("__range", "__start", "__c")
