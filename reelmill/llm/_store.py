"""Session settings and checked broadcasts for the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path, settled, ship

__all__ = ["arrow_rows", "fresh", "is_row", "most_frequent", "named", "narrow", "new_path", "settled", "spread"]

#: Bytes of input that one task of a packed exchange stands for.
TASK_BYTES = 128 << 20

#: Rows and bytes a row up to which a table may be broadcast; beyond either the join shuffles both sides.
BROADCAST_ROWS = 500_000
BROADCAST_ROW_BYTES = 64


def fresh(columns: list[str], name: str) -> str:
    """A name for a column of an operator's own that no column of its input has, whatever its case."""
    taken = {c.lower() for c in columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def _hash(text):
    return F.unhex(F.md5(text.cast("binary")))


def named(docs: DataFrame) -> DataFrame:
    """did (null where doc_id is), th (a 128-bit hash of the text) and text, null text as empty: rows that agree in both fare alike."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("did"), _hash(text).alias("th"), text.alias("text"))


def is_row(docs: DataFrame, did: str, th: str):
    """The condition that a row of docs (doc_id, text) is the one that columns did and th of another table name."""
    return F.col("doc_id").cast("long").eqNullSafe(F.col(did)) & (_hash(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col(th))


def narrow(df: DataFrame, keys: DataFrame, row_bytes: int) -> DataFrame:
    """keys, marked for broadcast if their counted rows and the stated width of a row stay within the bound."""
    return F.broadcast(keys) if row_bytes <= BROADCAST_ROW_BYTES and keys.count() <= BROADCAST_ROWS else keys


def arrow_rows(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Readies the session for Python operators.

    A batch for Python holds at most so many rows and about so many bytes, so that very long texts don't add up. Shuffle files
    go when the query that wrote them has ended; what later queries need is in settled tables.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def spread(df: DataFrame) -> int:
    """Tasks for an exchange of about as many bytes as df: its size by the optimizer's estimate, and no fewer than the session's.
    An estimate of a petabyte or more means that the size is unknown; then there are four tasks for each partition of df."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tasks = size // TASK_BYTES if size < 1 << 50 else 4 * df.rdd.getNumPartitions()
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), tasks)


def most_frequent(counted: DataFrame, item: str, k: int) -> DataFrame:
    """The k rows of the largest n, ties by item, of distinct items.

    A histogram of n (up to 65,536 rows) gives the least n that the k have; only rows that reach it are sorted, so that neither
    the driver nor the last task meets k rows from every partition.
    """
    width = 1 << 16
    sizes = {r.n: r["count"] for r in counted.groupBy(F.least("n", F.lit(width)).alias("n")).count().collect()}
    least, held = 1, 0
    for n in sorted(sizes, reverse=True):
        held += sizes[n]
        if held >= k:
            least = n
            break
    return counted.where(F.col("n") >= least).orderBy(F.desc("n"), item).limit(k)
