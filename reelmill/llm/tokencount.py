"""Edit-aware token counts.

A document's pre-tokens are grouped into leaves; a segment tree over the leaves sums characters and tokens. An edit descends
by character sums to the leaves it touches, re-cuts and re-encodes from a leaf before them until a cut falls on an old leaf
boundary behind the edit, and updates the sums on the paths to the root. Cutting depends on no character further left and on
few further right, so beyond that boundary the old leaves hold. All alphabets are cut alike, and only the stretch around an edit is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._bpe import Encoder, encoder, vocabulary
from ._store import arrow_rows, fresh

#: Pre-tokens of a leaf when a tree is built; a leaf that grows past GROWN times that is split into leaves of that size.
LEAF, GROWN = 8, 32
#: Characters of context that a cut may look at, besides those of a special token.
CONTEXT = 4


class Tree:
    """text, and a segment tree whose node i sums nodes 2i and 2i + 1; leaves are nodes `size` and up.

    cut and encoded count the characters that were cut into pre-tokens and encoded so far.
    """

    def __init__(self, enc: Encoder, text: str, nodes: tuple[list[int], list[int]] | None = None):
        if enc.lower:
            raise ValueError("a tree needs a vocabulary whose pre-tokens cover the text")
        self.enc, self.text, self.cut, self.encoded = enc, text, 0, 0
        self.context = CONTEXT + enc.reach
        if nodes:
            self.chars, self.tokens = map(list, nodes)
            self.size = len(self.chars) // 2
        else:
            self._fill(self._leaves(self._pieces(text)))

    def _pieces(self, text: str) -> list[str]:
        self.cut += len(text)
        return self.enc.pieces(text)

    def _count(self, pieces: list[str]) -> int:
        self.encoded += sum(map(len, pieces))
        return sum(len(self.enc.words[p]) for p in pieces) // 4

    def _leaves(self, pieces: list[str]) -> list[tuple[int, int]]:
        groups = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
        return [(sum(map(len, g)), self._count(g)) for g in groups]

    def _fill(self, leaves: list[tuple[int, int]]) -> None:
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.chars, self.tokens = ([0] * self.size + [x[k] for x in leaves] + [0] * (self.size - len(leaves)) for k in (0, 1))
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def leaves(self) -> list[tuple[int, int]]:
        """Characters and tokens of the leaves that hold any."""
        return [(self.chars[i], self.tokens[i]) for i in range(self.size, 2 * self.size) if self.chars[i]]

    @property
    def count(self) -> int:
        return self.tokens[1]

    def _set(self, i: int, chars: int, tokens: int) -> None:
        dc, dt = chars - self.chars[i], tokens - self.tokens[i]
        while i and (dc or dt):
            self.chars[i] += dc
            self.tokens[i] += dt
            i //= 2

    def _find(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, or the last, and the characters before it."""
        i, before = 1, 0
        while i < self.size:
            i *= 2
            if position >= before + self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i, before

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces text[start:end], bounds clipped to the text, and updates the sums."""
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        text = self.text[:start] + new + self.text[end:]
        leaf, before = self._find(max(0, start - self.context))
        if before:
            leaf, before = self._find(before - 1)
        last, behind = self._find(end + self.context)
        behind += self.chars[last]
        shift, reach = len(text) - len(self.text), 4 * self.context
        while True:
            upto = min(len(text), behind + shift + reach)
            pieces = self._pieces(text[before:upto])
            found = self._meets(pieces, before, upto if upto == len(text) else upto - self.context, last, behind, shift, upto == len(text))
            if found:
                break
            reach *= 4  # the cut passed all boundaries that the stretch can vouch for
        n, last = found
        self.text, own = text, pieces[:n]
        if n > GROWN * LEAF:
            kept = lambda a, b: [(self.chars[i], self.tokens[i]) for i in range(a, b) if self.chars[i]]
            self._fill(kept(self.size, leaf) + self._leaves(own) + kept(last + 1, 2 * self.size))
            return
        self._set(leaf, sum(map(len, own)), self._count(own))
        for i in range(leaf + 1, last + 1):
            self._set(i, 0, 0)

    def _meets(self, pieces: list[str], at: int, sure: int, last: int, behind: int, shift: int, whole: bool) -> tuple[int, int] | None:
        """How many pieces lead to an old leaf boundary at or after `behind`, and the last old leaf before it."""
        for n, piece in enumerate(pieces, 1):
            at += len(piece)
            if at > sure:
                return None
            while behind + shift < at and last < 2 * self.size - 1:
                last += 1
                behind += self.chars[last]
            if at == behind + shift and n < len(pieces):
                return n, last
        return (len(pieces), 2 * self.size - 1) if whole else None


def _checked(docs: DataFrame, path: str | None) -> str:
    arrow_rows(docs.sparkSession)
    return path or vocabulary("byte_bpe_50k.json")


def build(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs (text and any other columns) with n_tokens and tree: struct of the characters and of the tokens of all nodes.

    Null or empty text: no tokens. A column of docs named n_tokens or tree is replaced. Nulls elsewhere, repeated rows and
    ties pass through. Empty table: no rows. Very long texts: whole. Vocabularies that drop or change characters raise.
    """
    path = _checked(docs, path)

    def run(texts: pd.Series) -> pd.DataFrame:
        trees = [Tree(encoder(path), t or "") for t in texts]
        return pd.DataFrame({"n_tokens": [t.count for t in trees], "chars": [t.chars for t in trees], "tokens": [t.tokens for t in trees]})

    grown = F.pandas_udf(run, "n_tokens long, chars array<int>, tokens array<int>")
    out, name = docs.drop("n_tokens", "tree"), fresh(docs.columns, "grown")
    out = out.withColumn(name, grown(F.col("text").cast("string")))
    tree = F.struct(F.col(name)["chars"].alias("chars"), F.col(name)["tokens"].alias("tokens"))
    return out.withColumn("n_tokens", F.col(name)["n_tokens"]).withColumn("tree", tree).drop(name)


def update(trees: DataFrame, path: str | None = None) -> DataFrame:
    """Applies column edits (array<struct<start,end,new>>, in order, each on the text the ones before it left) of what build() gave.

    Returns the same columns with text, n_tokens and tree updated, edits gone, and cut and encoded added: the characters cut
    and encoded again. Null edits or null members of one: nothing is edited there. Null text is edited as if empty, and stays null
    without edits. Columns of trees named cut or encoded are replaced.
    """
    path = _checked(trees, path)
    rest = [c for c in trees.columns if c not in ("text", "tree", "n_tokens", "edits", "encoded", "cut")]
    chars, tokens = fresh(trees.columns, "chars"), fresh(trees.columns, "tokens")
    schema = trees.select(*[F.col(f"`{c}`") for c in rest]).schema.add("text", "string")
    for name in ("n_tokens", "cut", "encoded"):
        schema = schema.add(name, "long")
    for name in (chars, tokens):
        schema = schema.add(name, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, n = encoder(path), len(rest)
        for batch in batches:
            made = []
            for text, held, counted, edits in zip(*(batch.column(n + i).to_pylist() for i in range(4)), strict=True):
                tree = Tree(enc, text or "", (held, counted) if held else None)
                todo = [e for e in edits or () if e and None not in e.values()]
                for e in todo:
                    tree.edit(e["start"], e["end"], e["new"])
                made.append((tree.text if todo else text, tree.count, tree.cut, tree.encoded, tree.chars, tree.tokens))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array([m[i] for m in made], k) for i, k in enumerate(kinds))], names=[f.name for f in schema])

    own = [F.col("text").cast("string"), F.col("tree.chars"), F.col("tree.tokens"), F.col("edits")]
    out = trees.select(*[F.col(f"`{c}`") for c in rest], *[c.alias(fresh(trees.columns, f"in{i}")) for i, c in enumerate(own)]).mapInArrow(run, schema)
    return out.withColumn("tree", F.struct(F.col(chars).alias("chars"), F.col(tokens).alias("tokens"))).drop(chars, tokens)


def sample_edits(text):
    """Four edits that any text gets: an insertion at a quarter, a deletion at its middle, a replacement at three quarters, an end."""
    n = F.length(F.coalesce(text, F.lit("")))
    at = lambda k: F.floor(n * k / 4).cast("int")
    edit = lambda s, e, new: F.struct(s.alias("start"), e.alias("end"), F.lit(new).alias("new"))
    return F.array(edit(at(1), at(1), " inserted words, 42"), edit(at(2), at(2) + 9, ""), edit(at(3), at(3) + 5, "n't  "), edit(n + 64, n + 64, "\nThe end."))


def report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens before and n_edited after sample_edits(), and the characters cut and encoded again for it."""
    trees = build(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), path)
    out = update(trees.withColumn("before", F.col("n_tokens")).withColumn("edits", sample_edits(F.col("text"))), path)
    return out.select("doc_id", F.col("before").alias("n_tokens"), F.col("n_tokens").alias("n_edited"), "cut", "encoded")
