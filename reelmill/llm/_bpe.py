"""Token ids as the tokenizers library gives them, at several times its speed.

Text is parted at special tokens first. A part of the plain alphabet (ASCII, Latin letters to U+017F, general punctuation) is cut by
a pattern that equals the tokenizer's own on that alphabet, any other part by the library's own normalizer and pre-tokenizer. Each
piece's ids come from a bounded cache or from a merge loop over the same vocabulary. Tests hold the ids against the library's.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

END_ID = 1
_LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
_PLAIN = re.compile("[^\t\n\r\x0b\x0c\x20-\x7e¡-¬®-±´-¸º»¿-ſ‐-‧‰-⁞]")
_PIECES = {
    "byte": re.compile(f" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\\s{_LETTERS}0-9]+|\\s+(?!\\S)|\\s+"),
    "word": re.compile(f"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\\s{_LETTERS}0-9]+"),
}


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest
    follow from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out = {chr(b): b for b in own}
    return out | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def _merger(path: str):
    """piece -> ids, by tiktoken's merge loop over the file's vocabulary, or None if its ids don't rise with its merges.

    An end-of-word suffix is written as byte 0xFF, which UTF-8 never holds; the 256 ids of a byte with the suffix precede all
    merges, so the loop joins the two first, as the library starts from them.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, suffix, byte_of = model["vocab"], model["end_of_word_suffix"] or "", _byte_of()
    end = b"\xff" if suffix else b""

    def raw(token: str) -> bytes:
        tail = suffix and token.endswith(suffix)
        return bytes(byte_of[c] for c in (token[: -len(suffix)] if tail else token)) + (end if tail else b"")

    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab[a + b] for a, b in merges]
    ranks = {raw(t): vocab[t] for pair in merges for t in pair} | {raw(a + b): vocab[a + b] for a, b in merges}
    singles = [t + x for t in byte_of for x in {"", suffix}]
    if ids != sorted(set(ids)) or any(t not in vocab or vocab[t] >= ids[0] for t in singles) or model.get("dropout") or model.get("ignore_merges"):
        return None
    ranks |= {raw(t): vocab[t] for t in singles if t != suffix}
    if suffix:
        ranks[end] = 1 << 30
    single = tiktoken.Encoding("pieces", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
    return lambda piece: single(piece.encode() + end)


class _Words(dict):
    """Piece to its ids as little-endian unsigned 32-bit integers; takes in no more than `limit` pieces."""

    def __init__(self, encode, limit: int):
        super().__init__()
        self._encode, self._limit = encode, limit

    def __missing__(self, piece: str) -> bytes:
        ids = array("I", self._encode(piece)).tobytes()
        if len(self) < self._limit and len(piece) <= 32:
            self[piece] = ids
        return ids


class Encoder:
    """ids(text) -> bytes of little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, cache: int = 200_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.lower = self.tokenizer.normalizer is not None
        self._plain = _PIECES["word" if self.lower else "byte"].findall
        special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self._parts = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        #: Characters of the longest special token.
        self.reach = max(map(len, special), default=0)
        self._byte_of = _byte_of()
        self.merge = _merger(path) or self.library
        self.words = _Words(self.merge, cache)
        self.words.update({t: array("I", [i]).tobytes() for t, i in special.items()})

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _cut(self, text: str) -> list[str]:
        if not _PLAIN.search(text):
            return self._plain(text.lower() if self.lower else text)
        if self.lower:
            text = self.tokenizer.normalizer.normalize_str(text)
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return [bytes(map(self._byte_of.__getitem__, piece)).decode() for piece, _ in cut]

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text; a special token is one."""
        if "<|" not in text or not self._parts:
            return self._cut(text)
        out = []
        for i, part in enumerate(self._parts.split(text)):
            out += [part] if i & 1 else self._cut(part)
        return out

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.words.__getitem__, self.pieces(text))) if text else b""


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary file."""
    return Encoder(path)


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
