"""The corpus pipeline: quality rules, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. Null text passes the later
stages as null and is rejected by the first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelmill.llm._store import settled
from reelmill.llm.near import representatives
from reelmill.llm.packing import pack
from reelmill.llm.quality import judge
from reelmill.llm.secrets import redacted
from reelmill.llm.substring import remove


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, n_chars again that of the text."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the compression bands keep.

    Null or empty text, or fewer than ten words: rejected. Nulls elsewhere: kept as they are. Repeated rows: judged each. Ties: a ratio
    on a band's edge is kept. Empty table: no rows. Very long texts: whole, chunk by chunk. Columns of any name pass.
    """
    keep = judge(docs).where("kept")
    return keep.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the smallest doc_id.

    Null doc_id: after all others, then by a hash of the text. Texts without words (null or empty) all stay. Repeated rows: one
    stays. Empty table: no rows. Very long texts: whole. Columns of any name pass.
    """
    return representatives(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of windows that begin in an earlier document too.

    Null text stays null, fewer words than a window stay. Null doc_id: after all others, such rows don't cut each other, nor do rows
    of one doc_id. Repeated rows: cut alike. Empty table: no rows. Very long texts: whole. Columns of any name pass; n_chars is counted again.
    """
    return _counted(remove(docs), docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each secret replaced by its kind in brackets.

    Null text stays null; null doc_id: a path like any other. Repeated rows: scanned once, redacted each. Ties: of overlapping spans the
    first names the stretch. Empty table: no rows. Very long texts: whole. Columns of any name pass; n_chars is counted again.
    """
    return _counted(redacted(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of power-of-two length, none across documents.

    Null or empty text: the end id alone. Null doc_id: kept as null. Repeated rows: packed each. Ties don't arise. Empty table: no
    rows. Very long texts: whole, one batch at a time. Other columns are left out.
    """
    return pack(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("secrets", secrets), ("packing", packing)]
#: SQL has no zstandard ratio and no tokenizer; tests hold the stages against plain Python versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
