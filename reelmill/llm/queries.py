"""The queries opN_* and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(_docs(spark, sf_dir), tokens=False).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import report

    return report(_docs(spark, sf_dir))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near import similar

    return similar(_docs(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judge

    out = judge(_docs(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks", "n_chunks")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ann import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexicon import encode_decode

    return encode_decode(_docs(spark, sf_dir), contents=False)


def op10_rans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rans import read, write

    return read(*write(_docs(spark, sf_dir)), contents=False)


def op5_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tokencount import report

    return report(_docs(spark, sf_dir))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import report

    return report(_docs(spark, sf_dir))


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import dedup

    return dedup(_docs(spark, sf_dir)).drop("kept")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_secrets": op2_secrets,
    "op3_jaccard": op3_jaccard,
    "op4_quality": op4_quality,
    "op5_tokencount": op5_tokencount,
    "op6_langid": op6_langid,
    "op7_ann": op7_ann,
    "op8_bpe": op8_bpe,
    "op9_substrings": op9_substrings,
    "op10_rans": op10_rans,
}
_WORDS = r"d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)"
ORACLES: dict[str, str] = {
    "op3_jaccard": f"""WITH RECURSIVE {_WORDS},
 g AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
 z AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
 c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
 l AS (SELECT x, y FROM c JOIN z p ON p.doc_id = x JOIN z q ON q.doc_id = y WHERE 5 * c.n >= 4 * (p.n + q.n - c.n)),
 r(x, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.root FROM r JOIN l ON l.x = r.x),
 k AS (SELECT x, min(root) AS class_id FROM r GROUP BY 1), n AS (SELECT x, count(*) AS n_links FROM l GROUP BY 1)
 SELECT k.x AS doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM k LEFT JOIN n ON n.x = k.x""",
    "op9_substrings": f"""WITH {_WORDS},
 v AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM d, unnest(range(1, len(w) - 11)) AS u(i)),
 f AS (SELECT s, min(doc_id) AS m FROM v GROUP BY s),
 c AS (SELECT DISTINCT v.doc_id, i + k AS p FROM v JOIN f ON f.s = v.s CROSS JOIN range(0, 13) AS r(k) WHERE m < v.doc_id),
 x AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS u(p)),
 y AS (SELECT x.doc_id, count(*) AS n, count(c.p) AS gone, string_agg(word, ' ' ORDER BY x.p) FILTER (WHERE c.p IS NULL) AS kept FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.p = x.p GROUP BY 1)
 SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN y ON y.doc_id = d.doc_id""",
}
