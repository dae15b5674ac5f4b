"""BPE encoding and decoding with a minimal acyclic transducer.

The most frequent words of the corpus are compiled into a minimal acyclic automaton (equal suffixes share states). Each arc carries
the number of words that precede it among its state's words; their sum along a path is the word's rank, which addresses its
ids. Workers memory-map the compiled arrays and walk all distinct words of a batch at once, a byte a step. Words outside the
lexicon are merged exactly by the tokenizer's own model.
"""

from __future__ import annotations

import hashlib
import mmap
import tempfile
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import encoder, vocabulary
from ._store import arrow_rows, most_frequent, settled

#: Words compiled, the most frequent first: this bounds the automaton to a few MB, whatever the corpus.
LEXICON_WORDS = 50_000
#: Distinct words counted before a task hands its partial counts on.
COUNTED = 200_000
_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.binary()), ("decoded", pa.string())])


def automaton(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimal acyclic automaton of sorted distinct words: arc keys (state * 256 + byte, ascending), targets, outputs, finals.

    Built in one pass over the sorted words: states beyond the prefix shared with the next word are final in form and are
    replaced by an equal registered state if there is one. State 0 is the root.
    """
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict = {}
    path = [0]

    def freeze(down_to: int, word: bytes) -> None:
        for i in range(len(path) - 1, down_to, -1):
            state = path[i]
            form = (final[state], tuple(arcs[state].items()))
            same = register.setdefault(form, state)
            if same != state:
                arcs[path[i - 1]][word[i - 1]] = same

    last = b""
    for word in words:
        k = 0
        while k < len(last) and k < len(word) and last[k] == word[k]:
            k += 1
        freeze(k, last)
        del path[k + 1 :]
        for b in word[k:]:
            arcs[path[-1]][b] = len(arcs)
            path.append(len(arcs))
            arcs.append({})
            final.append(False)
        final[path[-1]] = True
        last = word
    freeze(0, last)
    order, number = [0], {0: 0}
    for state in order:  # grows as it is walked
        for t in arcs[state].values():
            if t not in number:
                number[t] = len(order)
                order.append(t)
    below: dict[int, int] = {}
    stack = [(0, False)]
    while stack:  # words accepted from each state, children first
        state, done = stack.pop()
        if state in below:
            continue
        if done:
            below[state] = final[state] + sum(below[t] for t in arcs[state].values())
        else:
            stack.append((state, True))
            stack += [(t, False) for t in arcs[state].values() if t not in below]
    keys, targets, outputs = [], [], []
    for state in order:
        before = int(final[state])
        for b, t in sorted(arcs[state].items()):
            keys.append(number[state] << 8 | b)
            targets.append(number[t])
            outputs.append(before)
            before += below[t]
    return np.array(keys, "<i8"), np.array(targets, "<i4"), np.array(outputs, "<i4"), np.array([final[s] for s in order], "u1")


class Transducer:
    """Arrays over one memory-mapped buffer: arc keys, targets, outputs, finals, id offsets by rank, ids."""

    FIELDS = (("keys", "<i8"), ("targets", "<i4"), ("outputs", "<i4"), ("final", "u1"), ("starts", "<i8"), ("ids", "<u4"))

    def __init__(self, data):
        sizes = np.frombuffer(data, "<i8", len(self.FIELDS))
        at = 8 * len(self.FIELDS)
        for (name, kind), n in zip(self.FIELDS, sizes, strict=True):
            setattr(self, name, np.frombuffer(data, kind, n, at))
            at += int(n) * np.dtype(kind).itemsize
            at += -at % 8

    @classmethod
    def compile(cls, lexicon: dict[bytes, list[int]]) -> bytes:
        words = sorted(lexicon)
        parts = [*automaton(words), np.cumsum([0, *(len(lexicon[w]) for w in words)]).astype("<i8"), np.array([i for w in words for i in lexicon[w]], "<u4")]
        out = np.array([len(p) for p in parts], "<i8").tobytes()
        for p in parts:
            out += p.tobytes()
            out += bytes(-len(out) % 8)
        return out

    @classmethod
    def mapped(cls, data: bytes) -> Transducer:
        """The compiled bytes in a file of this worker, mapped and then unlinked: nothing is left behind, and pages leave memory first."""
        with tempfile.TemporaryFile() as f:
            f.write(data)
            f.flush()
            return cls(mmap.mmap(f.fileno(), 0, prot=mmap.PROT_READ))

    def ranks(self, words: pa.Array) -> np.ndarray:
        """Rank of each UTF-8 word of an Arrow string array, -1 where the automaton doesn't accept it."""
        offsets = np.frombuffer(words.buffers()[1], "<i4", len(words) + 1, 4 * words.offset)
        data = np.frombuffer(words.buffers()[2], "u1") if words.buffers()[2] else np.zeros(0, "u1")
        start, size = offsets[:-1].astype(np.int64), np.diff(offsets)
        rank = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return rank
        live, state, total, step = np.flatnonzero(size > 0), np.zeros(int((size > 0).sum()), np.int64), np.zeros(int((size > 0).sum()), np.int64), 0
        while len(live):
            key = state << 8 | data[start[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, arc = live[ok], arc[ok]
            state, total = self.targets[arc].astype(np.int64), total[ok] + self.outputs[arc]
            step += 1
            ended = size[live] == step
            hit = ended & (self.final[state] == 1)
            rank[live[hit]] = total[hit]
            live, state, total = live[~ended], state[~ended], total[~ended]
        return rank


def words_counted(docs: DataFrame, path: str) -> DataFrame:
    """word, n over all texts of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, seen = encoder(path), Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return made

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(enc.pieces(text or ""))
                if len(seen) > COUNTED:
                    yield out()
        yield out()

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compiled(docs: DataFrame, path: str, size: int = LEXICON_WORDS) -> bytes:
    """The transducer of the `size` most frequent words of docs, ties by word."""
    top = settled(most_frequent(settled(words_counted(docs, path), "word-counts"), "word", size).select("word"), "lexicon").collect()
    enc = encoder(path)
    return Transducer.compile({r.word.encode(): np.frombuffer(enc.words[r.word], "<u4").tolist() for r in top})


@lru_cache(2)
def _mapped(digest: str, box) -> Transducer:
    return Transducer.mapped(box.value)


class _Box:
    """A broadcast value that compares by its digest, so that a worker maps each lexicon once."""

    def __init__(self, broadcast, digest: str):
        self.broadcast, self.digest = broadcast, digest

    @property
    def value(self) -> bytes:
        return self.broadcast.value

    def __eq__(self, other) -> bool:
        return self.digest == other.digest

    def __hash__(self) -> int:
        return hash(self.digest)


def encode_batch(texts: list, enc, lexicon: Transducer) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, concatenated, and the number of ids before each text (one more at the end)."""
    words: list[str] = []
    ends = [0]
    for text in texts:
        words += enc.pieces(text or "")
        ends.append(len(words))
    coded = pa.array(words, pa.string()).dictionary_encode()
    codes, distinct = coded.indices, coded.dictionary
    ranks = lexicon.ranks(distinct)
    extra, at = [], len(lexicon.ids)
    begin, size = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    known = np.flatnonzero(ranks >= 0)
    begin[known] = lexicon.starts[ranks[known]]
    size[known] = lexicon.starts[ranks[known] + 1] - begin[known]
    for k in np.flatnonzero(ranks < 0).tolist():
        ids = enc.words[distinct[k].as_py()]
        extra.append(ids)
        begin[k], size[k] = at, len(ids) // 4
        at += len(ids) // 4
    rows = codes.to_numpy().astype(np.int64)
    begins, sizes = begin[rows], size[rows]
    pool = np.concatenate([lexicon.ids, np.frombuffer(b"".join(extra), "<u4")])
    until = np.concatenate([[0], np.cumsum(sizes)])
    ids = pool[np.arange(until[-1]) + np.repeat(begins - until[:-1], sizes)]
    return ids, until[ends]


def encode_decode(docs: DataFrame, path: str | None = None, size: int = LEXICON_WORDS, contents: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if `contents`, ids and decoded, a row for each row of docs.

    Null or empty text: no ids and the hash of nothing. Null doc_id: kept. Repeated rows: a row each. Empty table: no rows. Ties in
    frequency: the smaller word enters the lexicon. Other columns are ignored. Very long texts: whole, one batch at a time.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    path = path or vocabulary("word_bpe_49k.json")
    data = compiled(docs, path, size)
    box = _Box(spark.sparkContext.broadcast(data), hashlib.sha256(data).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, lexicon = encoder(path), _mapped(box.digest, box)
        tokens = [enc.tokenizer.id_to_token(i) or "" for i in range(enc.tokenizer.get_vocab_size(with_added_tokens=True))]
        if enc.tokenizer.decoder is None:
            decode = lambda ids: " ".join(map(tokens.__getitem__, ids.tolist()))
        else:
            decode = lambda ids: enc.tokenizer.decode(ids.tolist(), skip_special_tokens=False)
        for batch in batches:
            ids, ends = encode_batch(batch.column(1).to_pylist(), enc, lexicon)
            own = [ids[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
            raw, text = [x.tobytes() for x in own], [decode(x) for x in own]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            none = [None] * len(own)
            cols = [batch.column(0), pa.array(np.diff(ends)), pa.array(map(sha, raw)), pa.array([sha(t.encode()) for t in text]), pa.array(raw if contents else none), pa.array(text if contents else none)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(cols, _OUT, strict=True)], schema=_OUT)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, decoded string")
    return out if contents else out.drop("ids", "decoded")
