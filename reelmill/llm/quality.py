"""Quality rules by compression bands.

zstandard ratios (bytes in over bytes out) of the whole document and of its fixed chunks must lie in a band that depends on
the length compressed: text above the band repeats itself, text below it is noise. One narrow pass, no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import arrow_rows, fresh

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
CHUNK = 4096
LEVEL = 3
#: (bytes up to, least ratio, most ratio): the band of a compressed length. The 0.001 and 0.999 quantiles of sf0.1's documents labelled
#: good that pass the base rules, their chunks and word-aligned cuts of them (over 16 KB: of different ones joined, near copies left
#: out), 1,600 to 4,700 ratios a band, then 2 % lower and 1 % higher. Up to 128 bytes, letters of any kind reach the ratio of prose.
BANDS = (
    (64, 0.82, 1.14), (96, 0.85, 1.33), (128, 0.98, 1.45), (192, 1.05, 1.55), (256, 1.17, 1.64), (384, 1.27, 1.76), (512, 1.31, 1.79),
    (768, 1.44, 1.91), (1024, 1.57, 1.99), (1536, 1.69, 2.1), (2048, 1.79, 2.19), (3072, 1.88, 2.22), (4096, 1.97, 2.27), (6144, 2.04, 2.34),
    (8192, 2.11, 2.37), (12288, 2.16, 2.42), (16384, 2.22, 2.45), (32768, 2.24, 2.54), (65536, 2.31, 2.6), (131072, 2.37, 2.66), (262144, 2.35, 2.65),
    (1 << 62, 2.47, 2.79),
)
#: Share of chunks that may leave their band.
CHUNK_SHARE = 0.1
#: Texts that bands are fitted to at most, about, ratios that a band needs, and classes of a ratio a unit.
FITTED, FEW, CLASSES = 20_000, 20, 1000
_OUT = pa.schema([(n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [("base_failed", pa.bool_()), ("ratio", pa.float64()), ("bad_chunks", pa.int64()), ("n_chunks", pa.int64()), ("kept", pa.bool_())])


def repeat_words(words: list[str], size: int = 5) -> int:
    """Words inside windows of `size` words that occur twice or more in the list, the first occurrence included."""
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    n = reach = 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + size - max(i, reach)
            reach = i + size
    return n


def counts(text: str) -> tuple[int, int, int, int, int]:
    words = WORD.findall(text)
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            if line in lines:
                dup += 1
            else:
                lines.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), dup, repeat_words(words)


def in_band(size: int, packed: int, bands=BANDS) -> bool:
    for upto, least, most in bands:
        if size <= upto:
            return least <= size / packed <= most
    return True


def fit_bands(good: DataFrame, rows: int = FITTED, outside: float = 0.001, below: float = 0.02, above: float = 0.01, level: int = LEVEL) -> tuple:
    """Bands for another corpus, from good (text): texts known to be good, of which about `rows` are looked at, by their hash.

    Ratios are taken of whole texts and of their word-aligned cuts at three lengths of each band, for long bands of texts joined one after
    the other. A band is the quantiles `outside` and 1 - `outside` of its ratios, `below` lower and `above` higher; of few
    ratios these are the least and the most, and a band with fewer than FEW takes its neighbour's limits. Equal texts count once; null and empty ones not at all; no texts:
    BANDS. Only counts by band and class of ratio reach the driver.
    """
    edges = [b[0] for b in BANDS]
    sizes = sorted({low + (high - low) * k // 3 for low, high in pairwise([32, *edges[:-1]]) for k in (1, 2, 3)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False).compress
        joined, seen = b"", Counter()

        def count(data: bytes) -> None:
            if data:
                seen[bisect_left(edges, len(data)), round(CLASSES * len(data) / len(pack(data)))] += 1

        for batch in batches:
            for text in batch.column(0).to_pylist():
                data = text.encode("utf-8", "surrogatepass")
                count(data)
                joined += data + b" "
                for size in sizes:
                    if size <= len(data):
                        end = data.rfind(b" ", size * 9 // 10, size)
                        count(data[: end if end > 0 else size])
                    elif size <= len(joined) <= 2 * size:
                        count(joined[:size])
                if len(joined) > edges[-2]:
                    count(joined)
                    joined = b""
        yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in seen], pa.int32()) for i in (0, 1)] + [pa.array(list(seen.values()), pa.int64())], names=["band", "step", "n"])

    arrow_rows(good.sparkSession)
    texts = good.where(F.length("text") > 0).select(F.col("text").cast("string").alias("text")).distinct()
    of = max(1, texts.count())
    texts = texts.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.ceil(F.lit(float(rows << 30)) / of))
    found: dict[int, list] = {}
    for r in texts.mapInArrow(run, "band int, step int, n long").groupBy("band", "step").agg(F.sum("n").alias("n")).orderBy("band", "step").collect():
        found.setdefault(r.band, []).append((r.step / CLASSES, r.n))
    limits = {}
    for band, own in found.items():
        total = sum(n for _, n in own)
        if total >= FEW:
            upto = list(accumulate(n for _, n in own))
            low, high = (own[bisect_left(upto, q * total)][0] for q in (outside, 1 - outside))
            limits[band] = (low * (1 - below), high * (1 + above))
    if not limits:
        return BANDS
    nearest = lambda i: limits[min(limits, key=lambda k: (abs(k - i), k))]
    return tuple((e, *nearest(i)) for i, e in enumerate(edges))


def judge(docs: DataFrame, chunk: int = CHUNK, level: int = LEVEL, bands=BANDS, chunk_share: float = CHUNK_SHARE) -> DataFrame:
    """docs (text, any other columns, whatever their names) with the columns of _OUT appended, a column of the same name replaced.

    Null or empty text: no words, so base_failed and not kept. Nulls in other columns pass through. Repeated rows: judged each.
    Empty table: no rows. Very long texts: whole, chunk by chunk. A ratio on a band's edge is inside it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False).compress
        for batch in batches:
            at = batch.num_columns - 1
            rows = []
            for text in batch.column(at).to_pylist():
                text = text or ""
                n, chars, symbols, dup, rep = counts(text)
                failed = n < 10 or 100 * rep > 20 * n
                data = text.encode("utf-8", "surrogatepass")
                size, bad, ratio = len(data), 0, 0.0
                n_chunks = max(1, size // chunk)  # the rest joins the last chunk
                good = not failed
                if data:
                    whole = len(pack(data))
                    ratio = size / whole
                    good = good and in_band(size, whole, bands)
                    if n_chunks > 1:
                        for i in range(n_chunks):
                            part = data[i * chunk : (i + 1) * chunk if i < n_chunks - 1 else size]
                            bad += not in_band(len(part), len(pack(part)), bands)
                        good = good and bad <= chunk_share * n_chunks
                rows.append((n, chars, symbols, dup, rep, failed, ratio, bad, n_chunks, good))
            made = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(_OUT)]
            keep = range(at)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + made, names=[batch.schema.names[i] for i in keep] + _OUT.names)

    arrow_rows(docs.sparkSession)
    rest = [c for c in docs.columns if c not in _OUT.names]
    schema = docs.select(*[F.col(f"`{c}`") for c in rest]).schema
    for name, kind in (*((n, "long") for n in _OUT.names[:5]), ("base_failed", "boolean"), ("ratio", "double"), ("bad_chunks", "long"), ("n_chunks", "long"), ("kept", "boolean")):
        schema = schema.add(name, kind)
    return docs.select(*[F.col(f"`{c}`") for c in rest], F.col("text").cast("string").alias(fresh(docs.columns, "text"))).mapInArrow(run, schema)
