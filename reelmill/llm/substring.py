"""Substring dedup by recompression.

Words are the first symbols. Each round renames every document's symbols alike: a run round gives each maximal run one name made from
the symbol and its length, a pair round gives one name to a pair of neighbours, left one from the left half of the alphabet and
right one from the right half. Names and halves come from hashes, so they are global without a dictionary, and equal stretches get
equal names inside, away from their ends. With each symbol goes the stretch of words that fixes it; every window of words that holds
such a stretch holds the symbol, wherever it stands. The least of these is the window's anchor; a window that holds none, as
inside a long run, is its own.

A window can repeat only if another text holds its anchor. One exchange of anchors finds those; a second compares the 128-bit
fingerprints of the windows so marked. Of copies of a text only the first takes part: the others lose every window. Both exchanges
carry packed arrays, and a key once for each chunk of documents: what a chunk settles by itself goes straight to the documents'
buckets. So a passage that a third of all documents share costs its key's bucket an entry a chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import arrow_rows, fresh, is_row, named, narrow, settled, spread
from ._text import Words, mix, spans, windows

WINDOW = 13
#: Rounds of recompression.
PLAN = ("run", "pair", "pair")
#: Entries that a task gathers before it hands a chunk on.
CHUNK = 1_000_000
#: Beyond any word of a document: a stretch that reaches so far lies in no window.
_FAR = 1 << 40


def _salt(n: int) -> np.uint64:
    return np.uint64(n * 0xA24BAED4963EE407 % (1 << 64))


def recompress(words: np.ndarray, plan: tuple[str, ...] = PLAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of one document after the rounds, and of each the words [low, high) that fix its name and its bounds."""
    names, low, high = words, np.arange(len(words)), np.arange(1, len(words) + 1)
    for level, kind in enumerate(plan):
        if not len(names):
            break
        if kind == "run":
            first = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            last = np.append(first[1:], len(names))
            size = last - first
            one = names[first]
            names = np.where(size > 1, mix(mix(one + _salt(200 + level)) + size.astype(np.uint64)), one)
            # a run is fixed by the symbols that end it
            low, high = np.append(-_FAR, low)[first], np.append(high, _FAR)[last]
        else:
            right = (mix(names + _salt(level + 1)) & np.uint64(1)).astype(bool)
            joins = np.zeros(len(names), bool)
            joins[:-1] = ~right[:-1] & right[1:]
            after = np.append(False, joins[:-1])
            made = mix(mix(names) * np.uint64(3) + np.append(names[1:], np.uint64(0)) + _salt(100 + level))
            # one of a pair, or alone on the left, is fixed by its next; alone on the right by the one before
            names = np.where(joins, made, names)
            low, high = np.where(right, np.append(-_FAR, low[:-1]), low), np.where(right, high, np.append(high[1:], _FAR))
            names, low, high = names[~after], low[~after], high[~after]
    return names, low, high


def anchors(words: np.ndarray, window: int = WINDOW, plan: tuple[str, ...] = PLAN) -> np.ndarray:
    """The key of each window's anchor: the least of the hashes of the symbols that the window fixes, of the whole window if none."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    names, low, high = recompress(words, plan)
    known = (low >= 0) & (high <= len(words)) & (high - low <= window)
    names, low, high = names[known], low[known], high[known]
    key = mix(spans(words, low, high) + mix(names))
    best = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    room = window - (high - low)
    for back in range(int(room.max()) + 1 if len(room) else 0):
        at = low - back
        ok = (room >= back) & (at >= 0) & (at < n)
        np.minimum.at(best, at[ok], key[ok])
    none = best == np.iinfo(np.uint64).max
    if none.any():
        best[none] = windows(words, window, 4)[none]
    return best


#: What a document is called in packed arrays: did, whether did is null, both halves of th.
_DOC = ("<i8", "u1", "<u8", "<u8")
_ROWS = "answer boolean, bucket int, n long, data binary"
_NAMES = ["answer", "bucket", "n", "data"]


def _names(docs: list[tuple]) -> list[np.ndarray]:
    half = np.frombuffer(b"".join(th for _, th in docs), "<u8").reshape(-1, 2)
    return [np.array([d or 0 for d, _ in docs], np.int64), np.array([d is None for d, _ in docs], np.uint8), half[:, 0], half[:, 1]]


def _packed(answer: bool, bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A row for each bucket with its part of the columns, one after the other; entries stay in order, which compresses well."""
    if not len(bucket):
        return
    by = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[by], prepend=-1))
    ends = np.append(cut[1:], len(by))
    columns = [c[by] for c in columns]
    data = [b"".join(c[a:b].tobytes() for c in columns) for a, b in zip(cut.tolist(), ends.tolist(), strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array([answer] * len(cut)), pa.array(bucket[by[cut]].astype(np.int32)), pa.array(ends - cut), pa.array(data, pa.binary())], names=_NAMES)


def _unpacked(rows: list[tuple[int, bytes]], kinds: tuple[str, ...]) -> list[np.ndarray]:
    out: list[list] = [[] for _ in kinds]
    for n, data in rows:
        at = 0
        for column, kind in zip(out, kinds, strict=True):
            column.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
    return [np.concatenate(c) if c else np.zeros(0, k) for c, k in zip(out, kinds, strict=True)]


def _key_bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(key) % np.uint64(buckets)).astype(np.int32)


def _doc_bucket(doc: list[np.ndarray], buckets: int) -> np.ndarray:
    return (mix(doc[2] + _salt(7)) % np.uint64(buckets)).astype(np.int32)


def _groups(*key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and the number of each row's group in that order."""
    by = np.lexsort(key)
    new = np.ones(len(by), bool)
    new[1:] = np.any([k[by[1:]] != k[by[:-1]] for k in key], 0)
    return by, np.cumsum(new) - 1


def _late(by: np.ndarray, group: np.ndarray, did: np.ndarray, none: np.ndarray) -> np.ndarray:
    """Which entries, in the order `by`, stand in a later document than another of their group; a null did is later than any."""
    did, none = did[by], none[by].astype(bool)
    least = np.full(group[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, group[~none], did[~none])
    numbered = np.zeros(group[-1] + 1, bool)
    numbered[group[~none]] = True
    return np.where(none, numbered[group], did > least[group])


def _exchanged(sent: DataFrame, answer, kinds: tuple[str, ...], buckets: int, value: str) -> DataFrame:
    """did, th, value: of each document the packed values of its answers. answer(*columns) gives (document, values) for the entries of a
    bucket; rows that are answers already pass through. A bucket of documents holds no more than their texts."""

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = []
        for batch in batches:
            there = batch.column(0)
            yield batch.filter(there)
            own = batch.filter(pa.compute.invert(there))
            asked += zip(own.column(2).to_pylist(), own.column(3).to_pylist(), strict=True)
        if asked:
            doc, found = answer(*_unpacked(asked, kinds))
            yield from _packed(True, _doc_bucket(doc, buckets), [*doc, found])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
        *doc, found = _unpacked(rows, (*_DOC, value))
        if not len(found):
            return
        by, group = _groups(*doc)
        cut = np.flatnonzero(np.diff(group, prepend=-1))
        ends, found = np.append(cut[1:], len(by)), found[by]
        did, none, a, b = (d[by[cut]] for d in doc)
        th = np.column_stack([a, b]).astype("<u8")
        for i in range(0, len(cut), 4096):
            part = slice(i, i + 4096)
            packed = [found[x:y].tobytes() for x, y in zip(cut[part].tolist(), ends[part].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(did[part], mask=none[part].astype(bool)), pa.array([t.tobytes() for t in th[part]], pa.binary()), pa.array(packed, pa.binary())], names=["did", "th", "value"])

    answers = sent.repartition(buckets, "bucket").mapInArrow(settle, _ROWS)
    return answers.repartition(buckets, "bucket").mapInArrow(gather, "did long, th binary, value binary")


def shared_anchors(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """did, th, value: the anchors (packed 64-bit keys) of a text that other texts hold too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: dict[tuple, int] = {}
        keys, owner, size = [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            key, who, names = np.concatenate(keys), np.concatenate(owner), _names(list(docs))
            by, group = _groups(key)
            # what several texts of the chunk hold needs no answer from others; the first of each still tells others
            local = np.empty(len(key), bool)
            local[by] = (np.bincount(group) > 1)[group]
            first = np.zeros(len(key), bool)
            first[by[np.diff(group, prepend=-1) > 0]] = True
            there = [n[who[local]] for n in names]
            yield from _packed(True, _doc_bucket(there, buckets), [*there, key[local]])
            at = np.flatnonzero(first)
            yield from _packed(False, _key_bucket(key[at], buckets), [key[at], local[at].astype(np.uint8), *(n[who[at]] for n in names)])

        for batch in batches:
            words = Words(batch.column(2))
            for i, doc in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                own = np.unique(anchors(words.of(i), window))
                if len(own) and doc not in docs:  # a repeated row is no other text
                    keys.append(own)
                    owner.append(np.full(len(own), len(docs), np.int32))
                    docs[doc] = len(docs)
                    size += len(own)
            if size > CHUNK:
                yield from out()
                docs, keys, owner, size = {}, [], [], 0
        if size:
            yield from out()

    def answer(key, several, *doc):
        """Keys that several texts hold: a chunk says so, or two entries name different texts."""
        by, group = _groups(key)
        starts = np.flatnonzero(np.diff(group, prepend=-1))
        other = np.logical_or.reduceat(several[by].astype(bool), starts)
        for half in doc[2:]:
            other |= np.minimum.reduceat(half[by], starts) != np.maximum.reduceat(half[by], starts)
        ask = by[other[group] & (several[by] == 0)]
        return [d[ask] for d in doc], key[ask]

    return _exchanged(texts.select("did", "th", "text").mapInArrow(send, _ROWS), answer, ("<u8", "u1", *_DOC), buckets, "<u8")


def repeated_windows(texts: DataFrame, marked: DataFrame, window: int, buckets: int) -> DataFrame:
    """did, th, value: the first words (packed 32-bit) of a document's windows that a document with a smaller did holds too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple] = []
        keys, owner, place, size = [], [], [], 0

        def out() -> Iterator[pa.RecordBatch]:
            key, who, at, names = np.concatenate(keys), np.concatenate(owner), np.concatenate(place), _names(docs)
            doc = [n[who] for n in names]
            by, group = _groups(key[:, 0], key[:, 1])
            late = np.empty(len(key), bool)
            late[by] = _late(by, group, doc[0], doc[1])
            there = [d[late] for d in doc]
            yield from _packed(True, _doc_bucket(there, buckets), [*there, at[late]])
            asks = [d[~late] for d in doc]
            yield from _packed(False, _key_bucket(key[~late, 0], buckets), [key[~late, 0], key[~late, 1], at[~late], *asks])

        for batch in batches:
            words = Words(batch.column(2))
            for i, (did, th, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                own = words.of(i)
                known = np.unique(np.frombuffer(value, "<u8"))
                a = anchors(own, window)
                at = np.flatnonzero(known[np.minimum(np.searchsorted(known, a), len(known) - 1)] == a)
                if len(at):
                    keys.append(np.column_stack([windows(own, window, 1)[at], windows(own, window, 2)[at]]))
                    owner.append(np.full(len(at), len(docs), np.int32))
                    place.append(at.astype("<i4"))
                    docs.append((did, th))
                    size += len(at)
            if size > CHUNK // 4:
                yield from out()
                docs, keys, owner, place, size = [], [], [], [], 0
        if size:
            yield from out()

    def answer(left, right, place, *doc):
        by, group = _groups(left, right)
        late = by[_late(by, group, doc[0], doc[1])]
        return [d[late] for d in doc], place[late]

    same = F.col("did").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
    found = marked.select(F.col("did").alias("d"), F.col("th").alias("t"), "value")
    text = texts.join(narrow(texts, found.select("d", "t"), 24), same, "left_semi")  # where few texts are marked, only those are shuffled
    with_marks = text.join(found, same).select("did", "th", "text", "value")
    return _exchanged(with_marks.mapInArrow(send, _ROWS), answer, ("<u8", "<u8", "<i4", *_DOC), buckets, "<i4")


def covered(n_words: int, value: bytes | None, whole: bool, window: int) -> np.ndarray:
    """Which words are covered: by all windows, or by those that begin at the packed places."""
    change = np.zeros(n_words + 1, np.int64)
    if whole and n_words >= window:
        change[0] = 1
    elif value:
        at = np.frombuffer(value, "<i4")
        np.add.at(change, at, 1)
        np.add.at(change, at + window, -1)
    return np.cumsum(change[:-1]) > 0


def marks(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """did, th, value, whole of each row with repeated windows, settled: whole if a smaller did has the same text, else their places."""
    arrow_rows(docs.sparkSession)
    rows, buckets = named(docs), spread(docs)
    keys = settled(rows.select("did", "th"), "texts")
    many = settled(keys.groupBy("th").agg(F.count(F.lit(1)).alias("n"), F.min("did").alias("first")).where("n > 1").select("th", "first"), "copied")
    later = keys.join(narrow(keys, many, 24), "th").where(~F.col("did").eqNullSafe(F.col("first"))).select("did", "th").distinct()
    later = settled(later, "copies")
    gone = later.select(F.col("did").alias("d"), F.col("th").alias("t"))
    texts = rows.join(narrow(rows, gone, 24), F.col("did").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left_anti")
    marked = settled(shared_anchors(texts, window, buckets), "anchors")
    found = repeated_windows(texts, marked, window, buckets).withColumn("whole", F.lit(False))
    return settled(found.unionByName(later.select("did", "th", F.lit(None).cast("binary").alias("value"), F.lit(True).alias("whole"))), "repeats")


def _with_marks(docs: DataFrame, window: int) -> tuple[DataFrame, str, str]:
    """docs with two columns, value and whole, and their names."""
    did, th, value, whole = (fresh(docs.columns, n) for n in ("did", "th", "value", "whole"))
    found = marks(docs, window).toDF(did, th, value, whole)
    return docs.join(found, is_row(docs, did, th), "left").drop(did, th).withColumn(whole, F.coalesce(whole, F.lit(False))), value, whole


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space), a row for each row of docs.

    Null or empty text, or fewer words than the window: nothing removed. Null doc_id: after all others; such rows lose words
    to any numbered document and to none of their own kind. Repeated doc_ids: don't remove from each other. Ties don't arise.
    Empty table: no rows. Very long texts: whole. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for text, value, whole in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = (text or b"").split()  # bytes are split at just the blanks that part words
                left = own
                if value or whole:
                    out = covered(len(own), value, whole, window)
                    left = [w for w, o in zip(own, out.tolist(), strict=True) if not o]
                gone.append(len(own) - len(left))
                n.append(len(own))
                kept.append(b" ".join(left))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array([k.decode() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    arrow_rows(docs.sparkSession)
    rows, value, whole = _with_marks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), window)
    return rows.select("doc_id", "text", value, whole).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated words cut from text; text of documents without any is left byte for byte, other columns as they are.

    Nulls, ties, repeated rows, empty tables and long texts as in dedup(); null text stays null. Columns may have any names.
    """

    def run(texts: pd.Series, values: pd.Series, wholes: pd.Series) -> pd.Series:
        words = Words(pa.array(texts, pa.string()))
        out = []
        for i, (t, v, whole) in enumerate(zip(texts, values, wholes, strict=True)):
            if t is None or not (v or whole):
                out.append(t)
                continue
            gone = covered(words.before[i + 1] - words.before[i], v, whole, window)
            raw, base = t.encode(), words.offsets[i]
            parts, at = [], 0
            for k in np.flatnonzero(gone).tolist():  # a word goes with the blanks after it
                w = words.before[i] + k
                parts.append(raw[at : words.starts[w] - base])
                at = int(words.starts[w + 1] - base) if w + 1 < words.before[i + 1] else len(raw)
            out.append(b"".join([*parts, raw[at:]]).decode())
        return pd.Series(out, dtype=object)

    arrow_rows(docs.sparkSession)
    cut = F.pandas_udf(run, "string")
    rows, value, whole = _with_marks(docs, window)
    hit = F.col(value).isNotNull() | F.col(whole)
    text = F.when(hit, cut(F.when(hit, F.col("text").cast("string")), F.col(value), F.col(whole))).otherwise(F.col("text"))
    return rows.withColumn("text", text).select(*[F.col(f"`{c}`") for c in docs.columns])
