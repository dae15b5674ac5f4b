"""Grouped summaries of experiment results and telemetry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import exact_sum, fixed, percent, psnr, ratio


def harmonic_mean(v, floor: float = 1e-9) -> Column:
    """n / sum(1 / max(v, floor)) over non-null values: the mean of rates over equal work."""
    v = F.col(v) if isinstance(v, str) else v
    return F.count(v) / F.sum(1 / F.greatest(v, F.lit(floor)))


def codec_summary(df: DataFrame, keys: list[str], means: dict[str, str], rates: dict[str, str]) -> DataFrame:
    """n, arithmetic means and harmonic mean rates of each key. means, rates: column -> name."""
    aggs = [(exact_sum(c) / F.count(c)).alias(n) for c, n in means.items()] + [harmonic_mean(c).alias(n) for c, n in rates.items()]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *aggs)


def metric_bundle(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Of the positive values: samples, avg_us (one digit, as text), min_us, max_us; and zeros, the records that have none."""
    good = F.when(F.col(value) > 0, F.col(value))
    return df.groupBy(*keys).agg(
        F.count(good).alias("samples"),
        fixed(exact_sum(good) / F.count(good), 1).alias("avg_us"),
        F.min(good).alias("min_us"),
        F.max(good).alias("max_us"),
        F.count_if(F.col(value) == 0).alias("zeros"),
    )


def window_rollup(df: DataFrame, keys: list[str], window: str, value: str) -> DataFrame:
    """A bundle for each key and window, and one of all windows together, `combined`, in one pass over grouping sets."""
    both = df.groupingSets([[*keys, window], keys], *keys, window)
    out = both.agg(F.grouping(window).alias("__all"), F.count("*").alias("records"), exact_sum(value).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.withColumn(window, F.when(F.col("__all") == 1, F.lit("combined")).otherwise(F.col(window))).drop("__all")


#: Ranges that the values of a key are cut into when they are ranked.
RANGES = 64


def _at_ranks(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable]) -> DataFrame:
    """keys, n and, by name, the value at 1-based rank(n) of each key's non-null values.

    Values are counted, then cut at quantiles of each key into ranges. Ranges are summed in order, and only inside a range are values
    ordered, so no task sorts a whole key. Null keys are keys like any other.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    key = F.struct(*[F.col(k) for k in keys])
    bounds = counts.groupBy(key.alias("__k")).agg(F.percentile_approx("__v", [i / RANGES for i in range(1, RANGES)], 1000).alias("__b"))
    cut = counts.join(bounds, key.eqNullSafe(F.col("__k"))).withColumn("__r", F.size(F.filter("__b", lambda b: b < F.col("__v")))).drop("__b")
    w = Window.partitionBy("__k")
    before = w.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = cut.groupBy("__k", "__r").agg(F.sum("__c").alias("__m"))
    ranges = ranges.select(F.col("__k").alias("__ok"), F.col("__r").alias("__or"), F.sum("__m").over(w).alias("__n"), F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__from"))
    upto = cut.join(ranges, F.col("__k").eqNullSafe(F.col("__ok")) & (F.col("__r") == F.col("__or")))
    upto = upto.withColumn("__upto", F.col("__from") + F.sum("__c").over(Window.partitionBy("__k", "__r").orderBy("__v")))
    return upto.groupBy(*keys).agg(F.max("__n").alias("n"), *[F.min(F.when(F.col("__upto") >= rank(F.col("__n")), F.col("__v"))).alias(name) for name, rank in ranks.items()])


def nearest_rank(df: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """Exact nearest-rank percentiles: sorted[max(0, ceil(n p / 100) - 1)]. Keys without a value have no row."""
    rank = lambda p: lambda n: F.greatest(F.lit(1), F.ceil(n * p / F.lit(100)))
    return _at_ranks(df, keys, value, {f"p{p}": rank(p) for p in percents})


def median_of_runs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """runs and the exact median of each key, the mean of the middle two where their number is even."""
    middle = _at_ranks(df, keys, value, {"__low": lambda n: F.floor((n + 1) / 2), "__high": lambda n: F.floor(n / 2) + 1})
    return middle.select(*keys, F.col("n").alias("runs"), ((F.col("__low") + F.col("__high")) / 2).alias("median"))


def consistency(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """How many distinct values each column has within a key, and whether all have one."""
    found = [F.count_distinct(c).alias(f"n_{c}") for c in columns]
    out = df.groupBy(*keys).agg(*found)
    same = F.lit(True)
    for c in columns:
        same = same & (F.col(f"n_{c}") <= 1)
    return out.withColumn("consistent", same)


def container_totals(df: DataFrame, keys: list[str], size: str, is_key: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("packets"), F.count_if(is_key).alias("keyframes"), F.sum(size).alias("bytes"), F.min(size).alias("smallest"), F.max(size).alias("largest"))


def mode_histogram(df: DataFrame, mode: str, names: dict[str, int]) -> DataFrame:
    """code, mode, count and percent for each known mode, zero where none occurs. The dimension is a literal, so no join is needed."""
    spark = df.sparkSession
    known = spark.createDataFrame(sorted((c, n) for n, c in names.items()), "code int, mode string")
    counts = df.groupBy(F.col(mode).alias("mode")).agg(F.count("*").alias("count"))
    out = known.join(counts, "mode", "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    return out.withColumn("percent", percent(F.col("count"), F.sum("count").over(Window.partitionBy())))


def mode_map(df: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """A map of mode to count for each key."""
    pairs = df.groupBy(*keys, mode).agg(F.count("*").alias("__n"))
    return pairs.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(mode, "__n")))).alias("modes"))


def counter_merge(df: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(*[exact_sum(c).alias(c) for c in counters])


def counter_delta(df: DataFrame, keys: list[str], order: str, counter: str) -> DataFrame:
    """The step of a cumulative counter from the record before, its own value on the first."""
    before = F.lag(counter).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("delta", F.col(counter) - F.coalesce(before, F.lit(0)))


def weighted_cost(df: DataFrame, keys: list[str], weights: dict[str, float], budget: float) -> DataFrame:
    """Linear combination of summed counters a record, and PASS or FAIL against a budget."""
    cost = F.lit(0.0)
    for c, w in weights.items():
        cost = cost + exact_sum(c) * F.lit(w)
    out = df.groupBy(*keys).agg(F.count("*").alias("n"), cost.alias("cost"))
    each = ratio(F.col("cost"), F.col("n"))
    return out.withColumn("cost_each", each).withColumn("verdict", F.when(each <= budget, "PASS").otherwise("FAIL"))


def plane_psnr(df: DataFrame, keys: list[str], squared: str, samples: str, on_zero: float | None = float("inf")) -> DataFrame:
    """Pools squared errors of planes and turns the pool into PSNR."""
    return df.groupBy(*keys).agg(F.sum(squared).alias("sse"), F.sum(samples).alias("samples")).withColumn("psnr", psnr(F.col("sse"), F.col("samples"), on_zero))


def distance_stats(df: DataFrame, keys: list[str], order: str, marker: Column, value: str, most: int) -> DataFrame:
    """Error statistics by distance from the last marker, distances from `most` together; records before any marker are left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    started = df.withColumn("__at", F.row_number().over(w))
    started = started.withColumn("__from", F.last(F.when(marker, F.col("__at")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    v = F.col(value).cast("decimal(18,2)")
    out = started.where(F.col("__from").isNotNull()).withColumn("distance", F.least(F.col("__at") - F.col("__from"), F.lit(most)))
    return out.groupBy("distance").agg(F.count("*").alias("n"), F.sum(v * v).cast("double").alias("sum_squares"), F.sum(v).cast("double").alias("bias"), F.max(F.abs(value)).alias("worst"))


def combine_duplicates(df: DataFrame, key: Column, weight: str, ident: str) -> DataFrame:
    """Rows of equal content as one: copies, summed weight, least ident."""
    return df.groupBy(key.alias("content")).agg(F.count("*").alias("copies"), F.sum(weight).alias("weight"), F.min(ident).alias("first"))


def slot_counts(df: DataFrame, key: Column, used: Column) -> DataFrame:
    """Slots, distinct contents, duplicates and slots used, by way of a count for each content."""
    each = df.groupBy(key.alias("__k")).agg(F.count("*").alias("__n"), F.count_if(used).alias("__u"))
    return each.agg(F.sum("__n").alias("slots"), F.count("*").alias("distinct_slots"), (F.sum("__n") - F.count("*")).alias("duplicates"), F.sum("__u").alias("used"))


def filtered_average(df: DataFrame, keys: list[str], value: str, kinds: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[(exact_sum(F.when(c, F.col(value))) / F.count(F.when(c, F.col(value)))).alias(n) for n, c in kinds.items()])


def duplicates(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("n")).where("n > 1")


def observed_rate(df: DataFrame, keys: list[str], micros: Column) -> DataFrame:
    """(n - 1) / (last - first) a second; null for one record."""
    span = F.max(micros) - F.min(micros)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.when(span > 0, (F.count("*") - 1) * 1e6 / span).alias("rate"))


def last_record(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.col(order)).alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in columns])


def report_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """One nested JSON document for each key with all its rows; for reports, so a key's rows are few."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct(*rest))).alias("results"))).alias("report"))
