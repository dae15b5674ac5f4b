"""Streaming forms: telemetry parsing, late records, stateful folds, windowed summaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..session import ship


def lines(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Telemetry text files as a stream with column value."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)


def collect(records: DataFrame, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Runs a stream over what is there now, and ends."""
    out = records.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True)
    return (out.option("checkpointLocation", checkpoint) if checkpoint else out).start()


def deduplicated(events: DataFrame, time: str, key: list[str], delay: str) -> DataFrame:
    """First arrivals of each key; state older than the watermark goes."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed(events: DataFrame, time: str, value: str, length: str, delay: str, keys: list[str]) -> DataFrame:
    """Event-time windows: count, sum and maximum a key; an extension, as the reference counts frames, not time."""
    grouped = events.withWatermark(time, delay).groupBy(F.window(time, length), *keys)
    return grouped.agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("worst")).select("window.start", *keys, "n", "total", "worst")


class _Folding(StatefulProcessor):
    """Runs one of reelmill.operators.state's classes for each key; its attributes are the state kept between batches."""

    def __init__(self, make: Callable, key: str, order: str, names: list[str]):
        self.make, self.key, self.order, self.names = make, key, order, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", T.StructType([T.StructField("pickled", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values=None) -> Iterator[pd.DataFrame]:
        import pickle

        fold = self.make()
        if self.state.exists():
            fold.__dict__.update(pickle.loads(bytes(self.state.get()[0])))
        for part in rows:
            part = part.sort_values(self.order)
            made = pd.DataFrame([fold.step(r) for r in part.to_dict("records")], columns=self.names)
            made.insert(0, self.order, part[self.order].to_numpy())
            made.insert(0, self.key, key[0])
            yield made
        self.state.update((pickle.dumps(fold.__dict__),))

    def close(self) -> None:
        pass


def fold(events: DataFrame, key: str, order: str, make: Callable, schema: str) -> DataFrame:
    """The streaming form of operators.state.fold: key, order and step()'s columns. Rows of one trigger are ordered; later ones
    continue from the state."""
    ship(events.sparkSession)
    extra = events.sparkSession.createDataFrame([], schema).schema
    full = T.StructType([events.schema[key], events.schema[order], *extra.fields])
    return events.groupBy(key).transformWithStateInPandas(_Folding(make, key, order, [f.name for f in extra]), full, "Append", "None")


def foreach_batch_summary(events: DataFrame, keys: list[str], value: str, path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that writes each batch's summary in a folder of its own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(*keys).agg(F.count("*").alias("n"), F.max(value).alias("worst")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write
