"""Packing by power-of-two decomposition.

Each document is cut into whole sequences of `length` tokens and then into the powers of two that sum to its remainder, largest
first. A piece is a sequence of its own, so no sequence crosses documents; sequences of equal length share a bucket and need
no padding. The plan is one narrow pass: no shuffle, nothing held but one batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import END_ID, encoder, vocabulary
from ._store import arrow_rows

LENGTH = 2048
_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32()), ("tokens", pa.binary())])
_SPARK = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, tokens binary"


def cuts(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of n tokens: whole sequences, then falling powers of two."""
    out = [(s, length) for s in range(0, n - length + 1, length)]
    at, rest = n - n % length, n % length
    while rest:
        size = 1 << (rest.bit_length() - 1)
        out.append((at, size))
        at, rest = at + size, rest - size
    return out


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, tokens: bool = True) -> DataFrame:
    """A row for each piece of docs (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, bucket, sequence_id, offset, tokens.

    Null or empty text: one piece, the end id. Null doc_id: kept as null. Repeated rows: packed each. Ties don't arise. Empty
    table: no rows. Other columns of docs are ignored, whatever their names. Very long texts: one batch at a time. tokens (little-
    endian unsigned 32-bit ids) is left out if `tokens` is false. bucket is log2 of the length; sequence_id is unique, its
    high part the input partition, and stays the same when a lost task runs again.
    """
    if length < 1 or length & (length - 1):
        raise ValueError("length must be a power of two")
    path = path or vocabulary("byte_bpe_50k.json")
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        enc = encoder(path)
        for batch in batches:
            cols: list[list] = [[] for _ in _OUT]
            doc, start, size, crc, total, bucket, ids = cols
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = enc.ids(text) + end
                n = len(data) // 4
                for s, k in cuts(n, length):
                    piece = data[4 * s : 4 * (s + k)]
                    doc.append(d)
                    start.append(s)
                    size.append(k)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    bucket.append(k.bit_length() - 1)
                    ids.append(piece if tokens else None)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)

    arrow_rows(docs.sparkSession)
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SPARK)
    out = out.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return out if tokens else out.drop("tokens")


def write_buckets(packed: DataFrame, path: str) -> None:
    """Parquet in a folder for each bucket, so that a reader takes batches of one length."""
    packed.write.partitionBy("bucket").parquet(path)


def unpack(packed: DataFrame) -> DataFrame:
    """doc_id, tokens of each document, its pieces joined in order; the inverse of pack() where doc_id is unique."""
    parts = F.array_sort(F.collect_list(F.struct("start", "tokens")))
    whole = F.aggregate(F.transform(parts, lambda p: p["tokens"]), F.lit(b""), lambda a, b: F.concat(a, b))
    return packed.groupBy("doc_id").agg(whole.alias("tokens"))
