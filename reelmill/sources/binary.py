"""A common scan of binary files: Spark's binaryFile reader finds and reads files on any store; a parser turns each into rows.

A parser is a generator function bytes -> tuples. A file that breaks its format raises FormatError in strict scans; in lenient ones its
rows so far are kept and a last row carries the error. One file is one task's record, so a file must fit a worker's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship


class FormatError(ValueError):
    """What is wrong with a file, beginning with a kind: EOF, IO, FORMAT, CRC or RANGE."""


def need(ok, kind: str, what: str) -> None:
    if not ok:
        raise FormatError(f"{kind}: {what}")


def uint(data: bytes, at: int, size: int, kind: str = "IO") -> int:
    """A little-endian unsigned integer; past the end is an error."""
    need(at + size <= len(data), kind, f"{size} bytes at {at} of {len(data)}")
    return int.from_bytes(data[at : at + size], "little")


def big(data: bytes, at: int, size: int) -> int:
    need(at + size <= len(data), "IO", f"{size} bytes at {at} of {len(data)}")
    return int.from_bytes(data[at : at + size], "big")


def scan(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[tuple]], schema: str, strict: bool = True, suffix: str | None = None) -> DataFrame:
    """file, the columns of `schema` and, if lenient, error: the rows of all files under `path`."""
    ship(spark)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return rows(reader.load(path).select(F.col("path").alias("file"), "content"), parse, schema, strict)


def rows(files: DataFrame, parse: Callable[[bytes], Iterator[tuple]], schema: str, strict: bool = True) -> DataFrame:
    """The same over a DataFrame of file and content."""
    ship(files.sparkSession)
    fields = files.sparkSession.createDataFrame([], schema).schema.fields
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made, error = [], None
                try:
                    for row in parse(content or b""):
                        made.append(row)
                        if len(made) == 256:
                            yield out(file, made, [None] * len(made), kinds)
                            made = []
                except FormatError as e:
                    if strict:
                        raise FormatError(f"{file}: {e}") from e
                    made.append((None,) * len(names))
                    error = str(e)
                if made:
                    yield out(file, made, [None] * (len(made) - (error is not None)) + [error] * (error is not None), kinds)

    def out(file: str, made: list[tuple], errors: list, kinds: list) -> pa.RecordBatch:
        cols = [pa.array([file] * len(made), pa.string()), *(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds))]
        return pa.RecordBatch.from_arrays(cols + ([] if strict else [pa.array(errors, pa.string())]), names=["file", *names] + ([] if strict else ["error"]))

    full = T.StructType([T.StructField("file", T.StringType()), *fields])
    return files.mapInArrow(run, full if strict else full.add("error", T.StringType()))
