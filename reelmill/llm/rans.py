"""Token-id files: static range asymmetric numeral system (rANS) with shared frequency tables.

One pass turns texts into ids, ranges them by doc_id and settles them in blocks; a second counts every id of the corpus, which
gives one frequency table for all blocks; a third encodes each block by itself with interleaved lanes and writes the files. Each
block carries its checkpoints (document starts and lane states) and a checksum, so blocks decode in parallel and alone.

File: magic, then blocks; ids-<partition>-<block>.rans hold ascending doc_ids, partition by partition. A block: header of nine
little-endian 64-bit integers (magic, body bytes, crc32 of the body, first id's number, ids, documents, lanes, words, 0), then
the body: doc_ids, null flags, ids of each document, lane states, 32-bit words.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import END_ID, encoder, vocabulary
from ._store import arrow_rows, new_path, settled

MAGIC = 0x31534E4152  # "RANS1"
#: Frequencies sum to 2**SCALE; ids of a block; lanes of a block.
SCALE, BLOCK, LANES = 20, 1 << 18, 1024
_LOW = np.uint64(1 << 31)


def frequencies(counts: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Counts scaled to sum to 2**scale, at least 1 for each id counted; the most frequent ids take up the rounding."""
    total, goal = int(counts.sum()), 1 << scale
    if not total:
        return np.zeros(len(counts), np.uint64)
    if np.count_nonzero(counts) > goal:
        raise ValueError("more distinct ids than the scale can hold")
    freq = np.where(counts > 0, np.maximum(1, np.floor(counts * (goal / total))), 0).astype(np.int64)
    order = np.argsort(-freq, kind="stable")
    left = goal - int(freq.sum())
    for k in order:
        if not left:
            break
        step = left if left > 0 else -min(-left, int(freq[k]) // 2)
        freq[k] += step
        left -= step
    return freq.astype(np.uint64)


class Table:
    """Frequencies, their running sums and the id of each slot."""

    def __init__(self, freq: np.ndarray, scale: int = SCALE):
        self.freq, self.scale = freq.astype(np.uint64), scale
        self.low = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), self.freq.astype(np.int64))

    def encode(self, ids: np.ndarray, lanes: int = LANES) -> tuple[np.ndarray, np.ndarray]:
        """Lane states and words; id i belongs to lane i % lanes. Steps run backwards, so that decoding runs forwards."""
        lanes = max(1, min(lanes, len(ids)))
        steps = -(-len(ids) // lanes)
        full = np.full(steps * lanes, int(np.argmax(self.freq)), np.int64)
        full[: len(ids)] = ids
        full = full.reshape(steps, lanes)
        x = np.full(lanes, _LOW)
        out: list[np.ndarray] = []
        shift, scale, word = np.uint64(63 - self.scale), np.uint64(self.scale), np.uint64(32)
        for t in range(steps - 1, -1, -1):
            f = self.freq[full[t]]
            over = x >= f << shift
            out.append(x[over].astype("<u4"))
            x = np.where(over, x >> word, x)
            q = x // f
            x = (q << scale) + (x - q * f) + self.low[full[t]]
        return x, np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")

    def decode(self, n: int, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        lanes = len(states)
        steps = -(-n // lanes)
        out = np.empty((steps, lanes), np.uint32)
        x, at = states.copy(), 0
        mask, scale, word = np.uint64((1 << self.scale) - 1), np.uint64(self.scale), np.uint64(32)
        for t in range(steps):
            slot = x & mask
            s = self.slot[slot]
            out[t] = s
            x = self.freq[s] * (x >> scale) + slot - self.low[s]
            under = np.flatnonzero(x < _LOW)
            x[under] = x[under] << word | words[at : at + len(under)]
            at += len(under)
        if at != len(words) or not np.all(x == _LOW):
            raise ValueError("a block's words don't match its states")
        return out.reshape(-1)[:n]


def block_bytes(table: Table, doc_ids: np.ndarray, nulls: np.ndarray, sizes: np.ndarray, ids: np.ndarray, start: int) -> bytes:
    states, words = table.encode(ids)
    body = doc_ids.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + sizes.astype("<i8").tobytes() + states.astype("<u8").tobytes() + words.astype("<u4").tobytes()
    return np.array([MAGIC, len(body), zlib.crc32(body), start, len(ids), len(doc_ids), len(states), len(words), 0], "<i8").tobytes() + body


def read_block(table: Table, data: bytes, at: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(end, doc_ids, nulls, sizes, ids, first id's number) of the block at byte `at`; its checksum must hold."""
    magic, size, crc, start, n, docs, lanes, n_words, _ = (int(v) for v in np.frombuffer(data, "<i8", 9, at))
    at += 72
    if magic != MAGIC or at + size > len(data) or zlib.crc32(data[at : at + size]) != crc:
        raise ValueError("damaged block")
    doc_ids = np.frombuffer(data, "<i8", docs, at)
    nulls = np.frombuffer(data, "u1", docs, at + 8 * docs)
    sizes = np.frombuffer(data, "<i8", docs, at + 9 * docs)
    states = np.frombuffer(data, "<u8", lanes, at + 17 * docs)
    words = np.frombuffer(data, "<u4", n_words, at + 17 * docs + 8 * lanes).astype(np.uint64)
    return at + size, doc_ids, nulls, sizes, table.decode(n, states, words), start


def _open(uri: str):
    """(file system, path in it) of a URI in the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@lru_cache(2)
def _table(path: str) -> Table:
    where, name = _open(path)
    with where.open_input_stream(name) as f:
        return Table(np.frombuffer(f.read(), "<u8"))


def token_blocks(docs: DataFrame, path: str, end_id: int, block: int) -> DataFrame:
    """Settled rows part, block, before (ids of the part before this block), n, docs (packed), ids (packed), ascending doc_id.

    The bounds of the parts come from doc_id alone, so texts are tokenized once. Only ids are shuffled.
    """
    spark = docs.sparkSession
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    parts = max(1, docs.rdd.getNumPartitions())
    cut = [i / parts for i in range(1, parts)]
    bounds = sorted({int(b) for b in known.approxQuantile("doc_id", cut, 0.1 / parts)}) if cut else []
    wide = np.array(bounds, np.int64)
    end = np.array([end_id], "<u4").tobytes()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        enc, squeeze = encoder(path), zstandard.ZstdCompressor(level=1).compress
        small = enc.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
        for batch in batches:
            ids = batch.column(0)
            part = np.searchsorted(wide, ids.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right").astype(np.int32)
            raw = [enc.ids(t) + end for t in batch.column(1).to_pylist()]
            kept = [squeeze(np.frombuffer(r, "<u4").astype("<u2" if small else "<u4").tobytes()) for r in raw]
            yield pa.RecordBatch.from_arrays([ids, pa.array(part), pa.array([len(r) // 4 for r in raw], pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "part", "n", "ids"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before, held, count = None, 0, 0, [], 0

        def out() -> pa.RecordBatch:
            doc = np.array([h[0] or 0 for h in held], "<i8").tobytes(), np.array([h[0] is None for h in held], "u1").tobytes(), np.array([h[1] for h in held], "<i8").tobytes()
            rows = [pa.array([v], t) for v, t in ((part, pa.int32()), (seq, pa.int64()), (before, pa.int64()), (count, pa.int64()), (len(held), pa.int64()), (b"".join(doc), pa.binary()), ([h[2] for h in held], pa.list_(pa.binary())))]
            return pa.RecordBatch.from_arrays(rows, names=["part", "block", "before", "n", "n_docs", "docs", "ids"])

        for batch in batches:
            for d, p, n, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and (p != part or count >= block):
                    yield out()
                    seq, before = (seq + 1, before + count) if p == part else (0, 0)
                    held, count = [], 0
                part = p
                held.append((d, n, ids))
                count += n
        if held:
            yield out()

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tokenize, "doc_id long, part int, n long, ids binary")
    ranged = made.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "ids")
    return settled(ranged.mapInArrow(gather, "part int, block long, before long, n long, n_docs long, docs binary, ids array<binary>"), "token-blocks")


def _ids(blobs: list, size: int, wide: bool) -> np.ndarray:
    import zstandard

    grow = zstandard.ZstdDecompressor().decompress
    return np.concatenate([np.frombuffer(grow(b), "<u4" if wide else "<u2") for b in blobs]) if blobs else np.zeros(0, np.uint32)


def write(docs: DataFrame, path: str | None = None, end_id: int = END_ID, block: int = BLOCK, folder: str | None = None) -> tuple[str, DataFrame]:
    """Writes docs (doc_id, text) to files in `folder`, and returns it with the settled names of the files.

    Null or empty text: the end id alone. Null doc_id: first, flagged as null. Repeated doc_ids: by their ids. Empty table: a
    frequency table of zeros and no file. Very long texts: a document is never cut, its block grows by it. Other columns are ignored.
    A task that runs again writes the same bytes under the same name, by way of a rename.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    path = path or vocabulary("word_bpe_49k.json")
    folder = folder or new_path(spark, "ids")
    vocab = encoder(path).tokenizer.get_vocab_size(with_added_tokens=True)
    vocab = max(vocab, end_id + 1)
    wide = vocab > 1 << 16
    blocks = token_blocks(docs, path, end_id, block)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            for blobs, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total += np.bincount(_ids(blobs, n, wide), minlength=vocab)
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["id", "n"])

    counts = np.zeros(vocab, np.int64)  # as long as the vocabulary, whatever the corpus
    for r in blocks.select("ids", "n").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r.id] = r.n
    where, name = _open(folder)
    where.create_dir(name, recursive=True)
    table_path = f"{folder}/frequencies"
    with where.open_output_stream(f"{name}/frequencies") as f:
        f.write(frequencies(counts).astype("<u8").tobytes())
    sizes = {r.part: r.n for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # a row for each partition
    first, at = {}, 0
    for p in sorted(sizes):
        first[p], at = at, at + sizes[p]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        table, (where, root) = _table(table_path), _open(folder)
        stream = tmp = final = now = None
        done: list[str] = []

        def close() -> None:
            if stream is not None:
                stream.close()
                where.move(tmp, f"{root}/{final}")
                done.append(f"{folder}/{final}")

        for batch in batches:
            for part, seq, before, n, n_docs, packed, blobs in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if part != now:
                    close()
                    now, final = part, f"ids-{part:08d}-{seq:012d}.rans"
                    tmp = f"{root}/_{uuid.uuid4().hex}"
                    stream = where.open_output_stream(tmp)
                doc_ids, nulls, size = np.frombuffer(packed, "<i8", n_docs), np.frombuffer(packed, "u1", n_docs, 8 * n_docs), np.frombuffer(packed, "<i8", n_docs, 9 * n_docs)
                stream.write(block_bytes(table, doc_ids, nulls, size, _ids(blobs, n, wide), first[part] + before))
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], names=["file"])

    return folder, settled(blocks.mapInArrow(encode, "file string"), "id-files")


def read(folder: str, files: DataFrame, contents: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if `contents`, ids (little-endian unsigned 32-bit), decoded from the files.

    The blocks' heads are read first; then each block is decoded by itself, from its own states, wherever a task is free. A block
    whose checksum fails raises. No files: no rows. Null doc_ids come back as null, repeated rows a row each.
    """
    arrow_rows(files.sparkSession)
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                where, name = _open(file)
                places, sizes, at = [], [], 0
                with where.open_input_file(name) as f:
                    end = f.size()
                    while at < end:
                        size = 72 + int(np.frombuffer(f.read_at(72, at), "<i8", 2)[1])
                        places.append(at)
                        sizes.append(size)
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(places), pa.string()), pa.array(places, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "at", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(f"{folder}/frequencies")
        for batch in batches:
            for file, at, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                where, name = _open(file)
                with where.open_input_file(name) as f:
                    data = f.read_at(size, at)
                _, doc_ids, nulls, sizes, ids, start = read_block(table, data, 0)
                raw, ends = ids.astype("<u4").tobytes(), np.cumsum(sizes)
                own = [raw[4 * (e - s) : 4 * e] for e, s in zip(ends.tolist(), sizes.tolist(), strict=True)]
                cols = [pa.array(doc_ids, mask=nulls.astype(bool)), pa.array(start + ends - sizes), pa.array(sizes), pa.array(map(zlib.crc32, own), pa.int64()), pa.array(own if contents else [None] * len(own), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    tasks = max(files.sparkSession.sparkContext.defaultParallelism, files.count())
    blocks = files.repartition(tasks).mapInArrow(heads, "file string, at long, size long").repartition(tasks)
    out = blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")
    return out if contents else out.drop("ids")
