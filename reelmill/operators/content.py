"""Content operators: checksums of blocks, record scraping, ordered byte hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship


def block_hashes(df: DataFrame, ident: str, data: str, size: int) -> DataFrame:
    """ident, offset, size, sha256 and crc32 of each fixed-size block of binary `data`; the last may be short, an empty has none."""
    b = F.col(data).cast("binary")
    starts = F.when(F.length(b) > 0, F.sequence(F.lit(0), F.length(b) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    out = df.select(ident, b.alias("__b"), F.explode(starts).alias("offset"))
    part = F.substring("__b", F.col("offset") + 1, F.lit(size))
    return out.select(ident, F.col("offset").cast("long").alias("offset"), F.length(part).cast("long").alias("size"), F.sha2(part, 256).alias("sha256"), F.crc32(part).alias("crc32"))


def records(df: DataFrame, ident: str, text: str, pattern: str, groups: int = 1) -> DataFrame:
    """Every match of a pattern anywhere in a text, in order: ident, pos, value."""
    return df.select(ident, F.posexplode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(pattern), F.lit(groups))).alias("pos", "value"))


def last_match(text, pattern: str, group: int = 1):
    """The last match, as tool output repeats its progress; null if none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def ranges(df: DataFrame, ident: str, cell: str) -> DataFrame:
    """offset and length of each part of a cell `offset+length;offset+length`."""
    out = df.select(ident, F.posexplode(F.split(cell, ";")).alias("pos", "__p")).where(F.length(F.trim("__p")) > 0)
    return out.select(ident, "pos", F.split("__p", r"\+")[0].cast("long").alias("offset"), F.split("__p", r"\+")[1].cast("long").alias("length"))


def fnv1a(df: DataFrame, ident: str, data: str, bits: int = 64) -> DataFrame:
    """ident and the FNV-1a hash of binary `data` as lowercase hex. The fold is serial in a value, so a batch's values advance
    side by side, a byte a step."""
    basis, prime = {32: (2166136261, 16777619), 64: (14695981039346656037, 1099511628211)}[bits]
    mask = (1 << bits) - 1

    def run(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for v in values:
            raw = [bytes(b) if b is not None else b"" for b in v]
            size = np.array([len(r) for r in raw], np.int64)
            start = np.cumsum(size) - size
            data, h = np.frombuffer(b"".join(raw), "u1").astype(np.uint64), np.full(len(raw), basis, np.uint64)
            live, step = np.flatnonzero(size), 0
            while len(live):
                h[live] = (h[live] ^ data[start[live] + step]) * np.uint64(prime) & np.uint64(mask)
                step += 1
                live = live[size[live] > step]
            yield pd.Series([f"{int(x):0{bits // 4}x}" for x in h])

    ship(df.sparkSession)
    return df.select(ident, F.pandas_udf(run, "string")(F.col(data).cast("binary")).alias("fnv1a"))
