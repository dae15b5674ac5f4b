"""N-gram Jaccard join with Bayesian candidate pruning.

A document is its set of word n-grams. Documents with equal sets form one node. Nodes that agree in a band of MinHash values
are candidates. Inside a band's group, and nowhere else, their MinHash values are compared a step at a time: with a uniform prior the
matches seen so far give the posterior that the similarity reaches the threshold, and a pair is dropped once that is below the
tolerance. Pairs that remain make classes of candidates; a class is cut into blocks, and block pairs are pruned again by other
values and verified exactly. Only links per document and spanning edges leave a task, never the pairs of a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import arrow_rows, fresh, is_row, named, narrow, settled, spread
from ._text import Words, mix, windows
from .components import connected_components

NGRAM = 5
#: The threshold as a fraction.
THRESHOLD = (4, 5)
#: Bands and values of a band: a pair at the threshold shares no band with probability (1 - 0.8**6)**48 < 5e-7.
BANDS, ROWS = 48, 6
#: Values compared, a step at a time, and the posterior below which a pair is dropped.
COMPARED, STEP, TOLERANCE = 128, 16, 1e-9
#: Nodes of a block and bytes of its n-grams, about; nodes of a block of a band's group.
BLOCK, BLOCK_BYTES, GROUP = 256, 32 << 20, 256


@lru_cache(4)
def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)


def shingles(words: np.ndarray, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct fingerprints of the n-grams; of fewer words than n, one of them all; of none, none."""
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(windows(words, min(n, len(words)), seed=min(n, len(words))))


def minhash(grams: np.ndarray, n: int, seed: int) -> np.ndarray:
    a, b = _permutations(n, seed)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        y = x[i : i + 1024, None] * a
        y += b
        np.minimum(out, y.min(0), out=out)
    return out


def band_keys(values: np.ndarray, bands: int = BANDS) -> np.ndarray:
    v = values.reshape(bands, -1).astype(np.uint64)
    out = mix(np.arange(bands, dtype=np.uint64))
    for j in range(v.shape[1]):
        out = mix(out + v[:, j] * np.uint64(0x9E3779B97F4A7C15))
    return out.view(np.int64)


@lru_cache(4)
def least_matches(compared: int = COMPARED, step: int = STEP, tolerance: float = TOLERANCE, threshold: tuple[int, int] = THRESHOLD) -> tuple[int, ...]:
    """After each step, the fewest matches that keep a pair: with a uniform prior, P(J >= t | m of n) = P(Bin(n + 1, t) <= m)."""
    t = threshold[0] / threshold[1]
    out = []
    for n in range(step, compared + 1, step):
        total, m = 0.0, 0
        while True:
            total += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def links(grams: list[np.ndarray], values: np.ndarray, left: np.ndarray, right: np.ndarray | None, threshold: tuple[int, int] = THRESHOLD) -> list[tuple[int, int]]:
    """Index pairs at the threshold: inside `left`, or between `left` and `right`."""
    p, q = threshold
    size = np.array([len(g) for g in grams], np.int64)
    need = least_matches(threshold=threshold)
    found_i, found_j = [], []
    for k, i in enumerate(left.tolist()):
        alive = left[k + 1 :] if right is None else right
        small, large = np.minimum(size[alive], size[i]), np.maximum(size[alive], size[i])
        alive = alive[q * small >= p * large]
        match = np.zeros(len(alive), np.int64)
        for s, least in enumerate(need):
            if not len(alive):
                break
            part = slice(s * STEP, (s + 1) * STEP)
            match += (values[alive, part] == values[i, part]).sum(1)
            keep = match >= least
            alive, match = alive[keep], match[keep]
        found_i += [i] * len(alive)
        found_j += alive.tolist()
    if not found_i:
        return []
    if len(found_i) > 2000:
        inner = _inner(grams, found_i, found_j)
    else:
        inner = [np.intersect1d(grams[i], grams[j], assume_unique=True).size for i, j in zip(found_i, found_j, strict=True)]
    return [(i, j) for i, j, n in zip(found_i, found_j, inner, strict=True) if q * n >= p * (size[i] + size[j] - n)]


def _inner(grams: list[np.ndarray], at: list[int], to: list[int]) -> np.ndarray:
    """Exact intersection sizes of many pairs, by products of 0/1 matrices over the n-grams that two or more nodes hold."""
    used = np.unique(np.array([at, to]))
    place = np.full(len(grams), -1)
    place[used] = np.arange(len(used))
    owner = np.repeat(np.arange(len(used)), [len(grams[k]) for k in used.tolist()])
    _, code, n = np.unique(np.concatenate([grams[k] for k in used.tolist()]), return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1
    keep = n[code] > 1
    owner, code = owner[keep], number[code[keep]]
    total, width = np.zeros((len(used), len(used)), np.float32), 4096
    by = np.argsort(code, kind="stable")
    owner, code = owner[by], code[by]
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, b = np.searchsorted(code, [low, low + width])
        x = np.zeros((len(used), width), np.float32)
        x[owner[a:b], code[a:b] - low] = 1
        total += x @ x.T
    return total[place[at], place[to]].astype(np.int64)


class Classes:
    """Disjoint sets of 0 .. n - 1, each named by its least member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, i: int, others: np.ndarray) -> None:
        labels = np.unique(self.label[np.append(others, i)])
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]


def survivors(values: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> np.ndarray:
    """The class of each row of values (low bytes of MinHash values): pairs inside `left`, or between it and `right`, that the
    posterior keeps are of one class. Pairs of one class already aren't compared. Equal low bytes of unequal values only keep more."""
    made = Classes(len(values))
    need = least_matches(compared=values.shape[1])
    for k, i in enumerate(left.tolist()):
        alive = left[k + 1 :] if right is None else right
        alive = alive[made.label[alive] != made.label[i]]
        match = np.zeros(len(alive), np.int64)
        for s, least in enumerate(need):
            if not len(alive):
                break
            part = slice(s * STEP, (s + 1) * STEP)
            match += (values[alive, part] == values[i, part]).sum(1)
            keep = match >= least
            alive, match = alive[keep], match[keep]
        if len(alive):
            made.join(i, alive)
    return made.label


def signed(rows: DataFrame) -> DataFrame:
    """did, th, sid (128-bit hash of the set of n-grams, null without words), keys (a hash of each band), low (the low bytes of the
    first COMPARED values of the bands), n (of the set). Values that agree by choice of the band can only keep a pair."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(2))
            sid, keys, low, n = [], [], [], []
            for i in range(batch.num_rows):
                grams = shingles(words.of(i))
                values = minhash(grams, BANDS * ROWS, 1) if len(grams) else None
                sid.append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest() if len(grams) else None)
                keys.append(band_keys(values) if len(grams) else None)
                low.append(values[:COMPARED].astype("u1").tobytes() if len(grams) else None)
                n.append(len(grams))
            cols = [pa.array(sid, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary()), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=["did", "th", "sid", "keys", "low", "n"])

    return rows.mapInArrow(run, "did long, th binary, sid binary, keys array<bigint>, low binary, n long")


def _dealt(pairs: DataFrame, group: str, parts: int) -> DataFrame:
    """Rows of a block pair (group, i, j; blocks) in one task, the pairs of a group one after the other over all tasks."""
    at = F.col("i").cast("long") * F.col("blocks") + F.col("j")
    return pairs.repartitionById(parts, F.pmod(F.xxhash64(group) + at, F.lit(parts)).cast("int")).sortWithinPartitions(group, "i", "j", "sid")


def _paired(members: DataFrame) -> DataFrame:
    """A row for each block pair that a row (blocks, sid) belongs to: i <= j, own is its block."""
    own = members.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return own.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Consecutive rows that agree in the first three columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:3] != held[0][:3]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _candidates(nodes: DataFrame, parts: int) -> DataFrame:
    """sid, root, size, bytes of each node that a band and the pruning put in a class with another.

    Bands whose groups have the same members count once. A group is compared in blocks, and sends on an edge for each node at most.
    """
    keyed = nodes.select("sid", F.explode("keys").alias("key"))
    members = [F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("sid")).alias("x"), F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("y")]
    groups = keyed.groupBy("key").agg(*members).where("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key"))
    groups = settled(groups.select("key", F.ceil(F.col("n") / GROUP).cast("int").alias("blocks")), "bands")
    own = settled(keyed.join(narrow(keyed, groups, 16), "key").join(nodes.select("sid", "low"), "sid").select("key", "blocks", "sid", "low"), "band-members")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches):
            block = np.array([r[3] for r in rows])
            values = np.frombuffer(b"".join(r[5] for r in rows), "u1").reshape(len(rows), -1)
            _, i, j = rows[0][:3]
            label = survivors(values, np.flatnonzero(block == i), None if i == j else np.flatnonzero(block == j))
            at = np.flatnonzero(label != np.arange(len(rows))).tolist()
            yield pa.RecordBatch.from_arrays([pa.array([rows[k][4] for k in at], pa.binary()), pa.array([rows[label[k]][4] for k in at], pa.binary())], names=["a", "b"])

    edges = _dealt(_paired(own).select("key", "i", "j", "own", "sid", "low", "blocks"), "key", parts).mapInArrow(compare, "a binary, b binary")
    tree = connected_components(edges)
    labels = settled(tree.select(F.col("node").alias("sid"), "root").unionByName(tree.select(F.col("root").alias("sid"), "root").distinct()), "candidates")
    sizes = settled(labels.join(nodes.select("sid", "n"), "sid").groupBy("root").agg(F.count(F.lit(1)).alias("size"), (F.sum("n") * 8).alias("bytes")), "candidate-sizes")
    return labels.join(sizes, "root")


def _verified(rows: DataFrame, nodes: DataFrame, candidates: DataFrame, parts: int) -> DataFrame:
    """sid, links (documents linked), parent (a linked node, the least that its task saw), whole (parent is final)."""
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    wanted = settled(candidates.join(nodes.select("sid", "did", "th", "copies"), "sid").withColumn("blocks", blocks).select("did", "th", "sid", "root", "blocks", "copies"), "wanted")
    right = wanted.select(F.col("did").alias("d"), F.col("th").alias("t"), "sid", "root", "blocks", "copies")
    same = F.col("did").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t"))
    texts = rows.join(narrow(rows, right.select("d", "t"), 24), same, "left_semi").join(right, same)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(4))
            grams = [shingles(words.of(i)) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([g.tobytes() for g in grams], pa.binary()), pa.array([minhash(g, COMPARED, 2).tobytes() for g in grams], pa.binary())], names=["sid", "root", "blocks", "copies", "grams", "hashes"])

    sketched = texts.select("sid", "root", "blocks", "copies", "text").mapInArrow(sketch, "sid binary, root binary, blocks int, copies long, grams binary, hashes binary")
    tasks = _dealt(_paired(sketched).select("root", "i", "j", "own", "blocks", "sid", "copies", "grams", "hashes"), "root", parts)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _runs(batches):
            rows = [r for k, r in enumerate(held) if not k or r[5] != held[k - 1][5]]  # repeated rows of one node
            _, i, j, _, blocks, *_ = rows[0]
            own = np.array([r[3] for r in rows])
            grams = [np.frombuffer(r[7], "<u8") for r in rows]
            values = np.frombuffer(b"".join(r[8] for r in rows), "<u4").reshape(len(rows), -1)
            left = np.flatnonzero(own == i)
            pairs = links(grams, values, left, None if i == j else np.flatnonzero(own == j))
            if not pairs:
                continue
            made, total = Classes(len(rows)), [0] * len(rows)
            for a, b in pairs:
                total[a] += rows[b][6]
                total[b] += rows[a][6]
                if made.label[a] != made.label[b]:
                    made.join(a, np.array([b]))
            at = [k for k, n in enumerate(total) if n]  # rows are in order of sid
            cols = [pa.array([rows[k][5] for k in at], pa.binary()), pa.array([total[k] for k in at], pa.int64()), pa.array([rows[made.label[k]][5] for k in at], pa.binary()), pa.array([blocks == 1] * len(at))]
            yield pa.RecordBatch.from_arrays(cols, names=["sid", "links", "parent", "whole"])

    return tasks.mapInArrow(verify, "sid binary, links long, parent binary, whole boolean")


def _order(*more: str):
    """What orders documents: numbered ones by id, then those without."""
    return F.struct(F.col("did").isNull().alias("none"), "did", *more)


def _classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id's did, th, sid), and of each node with copies or links: sid, root, class_id, n_links."""
    arrow_rows(docs.sparkSession, size=4 << 20)
    own, parts = named(docs), spread(docs)
    rows = settled(signed(own), "signatures")
    first = [F.first(c).alias(c) for c in ("keys", "low", "n")]
    nodes = rows.where(F.col("sid").isNotNull()).groupBy("sid").agg(F.min(_order("th")).alias("k"), F.count(F.lit(1)).alias("copies"), *first)
    nodes = settled(nodes.select("sid", "k.did", "k.th", "copies", "keys", "low", "n"), "nodes")
    found = settled(_verified(own, nodes, _candidates(nodes, parts), parts), "links")
    done = found.where("whole").select("sid", F.col("parent").alias("root"))
    open_ = connected_components(found.where("NOT whole").select(F.col("sid").alias("a"), F.col("parent").alias("b"))).select(F.col("node").alias("sid"), "root")
    roots = settled(done.unionByName(open_), "roots")
    total = settled(found.groupBy("sid").agg(F.sum("links").alias("links")), "link-counts")
    many = nodes.select("sid", "did", "copies").join(total, "sid", "left").join(roots, "sid", "left").where((F.col("copies") > 1) | F.col("links").isNotNull())
    many = settled(many.select("sid", "did", F.coalesce("root", "sid").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "linked")
    heads = settled(many.groupBy("root").agg(F.min("did").alias("class_id")), "classes")
    return rows.select("did", "th", "sid"), settled(many.join(heads, "root").select("sid", "root", "class_id", "n_links"), "members")


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (least doc_id of the connected class), n_links (other documents at the threshold), for each row of docs.

    Words are runs of characters other than space and U+0009 to U+000D, unchanged. Fewer words than five: one n-gram of them all.
    No words (null or empty text): linked to nothing. Null doc_id: after all others; a class of such rows only has a null
    class_id. Repeated rows: copies of each other. Ties don't arise. Empty table: no rows. Very long texts: whole. Other columns are
    ignored. Copies are counted as links, and never joined pair by pair.
    """
    rows, members = _classes(docs)
    known = rows.select("did", "sid").join(members.drop("root"), "sid", "left")
    return known.select(F.col("did").alias("doc_id"), F.coalesce("class_id", "did").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def representatives(docs: DataFrame) -> DataFrame:
    """docs without the rows whose class has an earlier one; of repeated rows one stays. Other columns pass, whatever their names.

    Earlier: smaller doc_id, null after all others, then by a hash of the text. Texts without words (null or empty) are in no class
    and all stay. Ties only arise between repeated rows. Empty table: no rows. Very long texts: whole.
    """
    rows, members = _classes(docs)
    d, t = fresh(docs.columns, "did"), fresh(docs.columns, "th")
    known = settled(rows.where(F.col("sid").isNotNull()).join(members.select("sid", "root"), "sid").select("did", "th", "root"), "class-rows")
    first = settled(known.groupBy("root").agg(F.min(_order("th")).alias("k")), "class-first")
    gone = known.join(first, "root").where(_order("th") != F.col("k")).select(F.col("did").alias(d), F.col("th").alias(t)).distinct()
    kept = docs.join(narrow(docs, settled(gone, "gone"), 32), is_row(docs, d, t), "left_anti")
    twice = known.groupBy("did", "th").count().where("count > 1").select(F.col("did").alias(d), F.col("th").alias(t))
    twice = settled(twice, "repeated")
    if not twice.limit(1).count():
        return kept
    once = kept.join(twice, is_row(docs, d, t))  # a row of docs meets one of twice
    once = once.dropDuplicates([d, t]).drop(d, t)
    return kept.join(twice, is_row(docs, d, t), "left_anti").unionByName(once)
