"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its UTF-8 text). The ledger holds a row for each blob and rule
version already scanned, with its findings; only pairs that it lacks are scanned, each once, and findings are joined back to
all paths that hold the blob.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import arrow_rows, fresh, narrow, new_path, settled

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("passw", "secret", "token", "api")
LEDGER = "blob string, rule_version string, spans array<struct<kind:string,start:int,end:int>>"


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind as listed.

    A greedy run that is too short holds no longer run, so the least length stands in the pattern of access and hex; a short
    value of assign still consumes its text, so that one is dropped afterwards.
    """
    out = []
    low = text.lower()
    if any(n in low for n in _NAMES):
        out += [(0, m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in _ACCESS.finditer(text)]
    out += [(2, m.start(), m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], s, e) for k, s, e in sorted(out, key=lambda x: (x[1], x[0]))]


#: The rules of each version that a ledger may name: text -> spans. A changed rule is a new version, under which old blobs are
#: scanned again; add it with add_rules() in the module that defines it, so that workers know it too.
RULE_VERSION = "base-1"
RULES: dict[str, Callable[[str], list[tuple[str, int, int]]]] = {RULE_VERSION: find}


def add_rules(version: str, rules: Callable[[str], list[tuple[str, int, int]]]) -> None:
    if RULES.setdefault(version, rules) is not rules:
        raise ValueError(f"rule version {version} has other rules")


class Ledger:
    """The ledger's table at `path`, a Parquet folder on a file system all executors share. Each update appends a batch; two that
    run at once may both hold a blob, which changes nothing: findings are read as one row for each blob and rule version."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "ledger")

    def read(self) -> DataFrame:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not fs.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(fs):
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.path)

    def update(self, versions: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
        """Scans what versions (path, blob, text) hold and the ledger lacks, appends it, and returns the rows appended.

        Of equal blobs the one with the smallest path is fetched, so copies cost a hash each and one scan together; texts of blobs
        that the ledger knows aren't shuffled where the new ones are few.
        """
        rules = RULES[rule_version]
        seen = self.read().where(F.col("rule_version") == rule_version).select("blob")
        first = versions.groupBy("blob").agg(F.min("path").alias("path")).join(seen, "blob", "left_anti")
        first = settled(first.select(F.col("blob").alias("b"), F.col("path").alias("p")), "unseen")
        texts = versions.join(narrow(versions, first, 80), (F.col("blob") == F.col("b")) & F.col("path").eqNullSafe(F.col("p")), "left_semi").select("blob", "text")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            for batch in batches:
                found = [[{"kind": k, "start": s, "end": e} for k, s, e in rules(t or "")] for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([rule_version] * len(found), pa.string()), pa.array(found, kind)], names=["blob", "rule_version", "spans"])

        batch_path = f"{self.path}/batch={new_path(self.spark, 'b').rsplit('-', 1)[1]}"
        texts.mapInArrow(run, LEDGER).dropDuplicates(["blob"]).write.parquet(batch_path)  # a path can repeat one version
        return self.spark.read.schema(LEDGER).parquet(batch_path)

    def findings(self, rule_version: str = RULE_VERSION) -> DataFrame:
        """blob, spans: a row for each blob with findings, however many batches hold it. Equal blobs have equal spans."""
        own = self.read().where((F.col("rule_version") == rule_version) & (F.size("spans") > 0))
        return own.groupBy("blob").agg(F.first("spans").alias("spans"))


def blob(text):
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)


def scan(docs: DataFrame, ledger: Ledger | None = None, rule_version: str = RULE_VERSION) -> DataFrame:
    """docs (doc_id as the path, text) with column spans: array<struct<kind,start,end>>, empty where nothing was found.

    Null text: empty. Null doc_id: a path like any other. Repeated rows: one blob, findings on each row. Ties between kinds at
    one start: in the order of KINDS. Empty table: no rows. Very long texts: whole. A column of docs named spans is replaced, others
    pass, whatever their names. An unknown rule_version raises a KeyError.
    """
    out, spans = _found(docs, ledger, rule_version)
    return out.drop("spans").withColumnRenamed(spans, "spans")


def _found(docs: DataFrame, ledger: Ledger | None, rule_version: str = RULE_VERSION) -> tuple[DataFrame, str]:
    """docs with a column of spans, and its name."""
    spark = docs.sparkSession
    arrow_rows(spark)
    ledger = ledger or Ledger(spark)
    ledger.update(docs.select(F.col("doc_id").alias("path"), blob(F.col("text")).alias("blob"), F.col("text").cast("string").alias("text")), rule_version)
    key, spans = fresh(docs.columns, "blob"), fresh(docs.columns, "spans")
    # settled, so that a hot blob's side of the join is a plain exchange that can be split
    found = settled(ledger.findings(rule_version), "findings").toDF(key, spans)
    none = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    out = docs.join(found, blob(F.col("text")) == F.col(key), "left").withColumn(spans, F.coalesce(spans, none)).drop(key)
    return out, spans


def _equals(kind: str):
    return lambda x: x == kind


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row of docs."""
    out = scan(docs.select("doc_id", "text"), ledger)
    n = [F.size(F.filter(F.transform("spans", lambda s: s["kind"]), _equals(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), *n, F.sha2(joined(F.col("spans")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(text: str, spans: list) -> str:
    """text with each stretch that findings cover replaced by its kind in brackets; of overlapping spans the first names it."""
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out += [text[at : s["start"]], f"[{s['kind']}]"]
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, ledger: Ledger | None = None) -> DataFrame:
    """docs with redact() applied to text; rows without findings, null text among them, as they were, other columns too.

    Nulls, ties, repeated rows, empty tables and long texts as in scan(). Columns may have any names.
    """

    def run(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else redact(t, s) for t, s in zip(texts, spans, strict=True)], dtype=object)

    cut = F.pandas_udf(run, "string")
    out, spans = _found(docs, ledger)
    found = F.size(spans) > 0
    out = out.withColumn("text", F.when(found, cut(F.when(found, F.col("text").cast("string")), F.col(spans))).otherwise(F.col("text")))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
