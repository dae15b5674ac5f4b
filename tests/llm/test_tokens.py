"""Packing, token counts, the lexicon and id files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from reelmill.llm import lexicon, packing, rans, tokencount
from reelmill.llm._bpe import Encoder, vocabulary

ODD = ["", " ", "a<|endoftext|>b", "it's  I'LL don't''s", "x\t\n y", "ÀÉ naïve ﬁ ½ ² ①", "日本語 text", "a\xa0b", "don't!! 's 're", "_x_ __ a1b22", "!!'s", "'S'T", "’s “q” — x", "İSTANBUL ſ K", "a\x1cb\x85c", "  lead", "trail  ", "\n\n\n a", "é"]


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def enc(request):
    return Encoder(vocabulary(request.param), cache=50)


def test_ids_equal_the_library(enc, texts):
    assert enc.merge is not enc.library
    for t in [*ODD, *(t for _, t in texts)]:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == enc.library(t), t


def test_cuts_cover_each_token_once():
    for n in [*range(1, 70), 2047, 2048, 2049, 5000]:
        parts = packing.cuts(n, 16)
        assert [s for s, _ in parts] == [sum(k for _, k in parts[:i]) for i in range(len(parts))] and sum(k for _, k in parts) == n
        assert all(k <= 16 and not k & (k - 1) for _, k in parts)


def packed(rows):
    enc = Encoder(vocabulary("byte_bpe_50k.json"))
    want = []
    for d, t in rows:
        ids = np.array([*enc.library(t or ""), 1], "<u4")
        want += [(d, s, k, zlib.crc32(ids[s : s + k].tobytes()), len(ids)) for s, k in packing.cuts(len(ids))]
    return sorted(want, key=repr)


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
def test_pack(request, table):
    df = request.getfixturevalue(table)
    out = packing.pack(df).collect()
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out), key=repr) == packed([(r.doc_id, r.text) for r in df.collect()])
    assert len({r.sequence_id for r in out}) == len(out) and all(r.offset == 0 and len(r.tokens) == 4 * r.length and 1 << r.bucket == r.length for r in out)


def test_buckets_and_unpack(spark, docs, tmp_path):
    packing.write_buckets(packing.pack(docs), str(tmp_path / "p"))
    back = {r.doc_id: bytes(r.tokens) for r in packing.unpack(spark.read.parquet(str(tmp_path / "p"))).collect()}
    enc = Encoder(vocabulary("byte_bpe_50k.json"))
    assert back == {r.doc_id: np.array([*enc.library(r.text), 1], "<u4").tobytes() for r in docs.collect()}


def test_edited_trees_count_as_recounted():
    enc, rng = Encoder(vocabulary("byte_bpe_50k.json")), random.Random(3)
    text = "Some words, isn't it?\n\n  And 12345 more words of the text. " * 40
    tree = tokencount.Tree(enc, text)
    for _ in range(300):
        start = rng.randint(0, len(tree.text))
        end, new = start + rng.choice([0, 0, 1, 2, 40]), rng.choice(["", " ", "  ", "x", "'s", "'", "n't  ", "\n\n", " word", "123", "-- !!", "é", " a b c d " * 30, "日", "<|endoftext|>"][: 13 if rng.random() < 0.97 else 15])
        want = tree.text[:start] + new + tree.text[end:]
        tree.edit(start, end, new)
        assert (tree.text, tree.count, sum(c for c, _ in tree.leaves())) == (want, len(enc.library(want)), len(want))


@pytest.mark.parametrize("words", ["some plain words here ", "日本 текст with ½ and <|endoftext|> 😀 "])
def test_an_edit_cuts_and_encodes_little(words):
    enc = Encoder(vocabulary("byte_bpe_50k.json"))
    text = words * 5000
    built = tokencount.Tree(enc, text)
    assert built.cut == built.encoded == len(text)
    tree = tokencount.Tree(enc, text, (built.chars, built.tokens))  # as stored
    tree.edit(50_000, 50_004, "other")
    assert 0 < tree.cut < 600 and 0 < tree.encoded < 600
    assert tree.count == len(enc.library(text[:50_000] + "other" + text[50_004:]))


def test_a_grown_leaf_is_split_without_cutting_the_rest():
    enc = Encoder(vocabulary("byte_bpe_50k.json"))
    tree = tokencount.Tree(enc, "some plain words here " * 5000)
    done = tree.cut
    tree.edit(50_000, 50_000, " more words" * 400)
    assert tree.cut - done < 6000 and tree.count == len(enc.library(tree.text))
    assert max(c for c, _ in tree.leaves()) < 200


def test_trees_need_whole_pre_tokens():
    with pytest.raises(ValueError):
        tokencount.Tree(Encoder(vocabulary("word_bpe_49k.json")), "a b")


def test_ids_of_odd_characters_equal_the_library(enc):
    rng = random.Random(5)
    parts = ["a", "B", " ", "  ", "\n", "'s", "'", "日", "e\u0301", "é", "İ", "ſ", "ẞ", "J\u030c", "\u0345", "Σ", "ﬁ", "½", "\u200d", "😀", "\xa0", "\u3000", "\x85", "и\u0306", "<|endoftext|>", "<|startoftext|>", "<|", "한", "ᄒ", "ᅡ", "Ω", "K", "ǅ", "!", "1", "\t"]
    for _ in range(3000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == enc.library(t), ascii(t)


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
def test_counts_after_edits(request, table):
    df = request.getfixturevalue(table)
    enc = Encoder(vocabulary("byte_bpe_50k.json"))

    def edited(t):
        n, t = len(t), t
        for s, e, new in ((n // 4, n // 4, " inserted words, 42"), (n * 2 // 4, n * 2 // 4 + 9, ""), (n * 3 // 4, n * 3 // 4 + 5, "n't  "), (n + 64, n + 64, "\nThe end.")):
            t = t[:s] + new + t[e:]
        return t

    got = sorted(((r.doc_id, r.n_tokens, r.n_edited) for r in tokencount.report(df).collect()), key=repr)
    assert got == sorted(((r.doc_id, len(enc.library(r.text or "")), len(enc.library(edited(r.text or "")))) for r in df.collect()), key=repr)


def test_null_edits_change_nothing(spark):
    rows = [(1, "plain text", [(0, 5, None), (None, 1, "x")]), (2, None, None), (3, None, [(0, 0, "new")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,end:int,new:string>>")
    out = {r.doc_id: r.text for r in tokencount.update(tokencount.build(df)).collect()}
    assert out == {1: "plain text", 2: None, 3: "new"}


def test_automaton_ranks_and_rejects():
    import pyarrow as pa

    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 6))).encode() for _ in range(400)})
    data = lexicon.Transducer.compile({w: [i, i + 1][: 1 + i % 2] for i, w in enumerate(words)})
    t = lexicon.Transducer.mapped(data)
    asked = [*(w.decode() for w in words), "", "abcd", "zzz", "a" * 30]
    want = [words.index(a.encode()) if a.encode() in words else -1 for a in asked]
    assert t.ranks(pa.array(asked)).tolist() == want and t.ranks(pa.array(asked).slice(3)).tolist() == want[3:]
    assert len(t.final) < len({w[:k] for w in words for k in range(len(w) + 1)})  # suffixes are shared
    assert lexicon.Transducer.mapped(lexicon.Transducer.compile({})).ranks(pa.array(["a"])).tolist() == [-1]


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
@pytest.mark.parametrize("size", [0, 40, 50_000])
def test_lexicon_round_trip(request, table, size):
    df = request.getfixturevalue(table)
    tk = Encoder(vocabulary("word_bpe_49k.json")).tokenizer
    want = []
    for r in df.collect():
        ids = tk.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        want.append((r.doc_id, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(tk.decode(ids, skip_special_tokens=False).encode())))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in lexicon.encode_decode(df, size=size).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_rans_round_trip():
    rng = np.random.default_rng(5)
    for n, spread in ((1, 1), (7, 3), (5000, 400), (70_000, 49_000)):
        ids = np.minimum(rng.zipf(1.3, n) - 1, spread - 1)
        table = rans.Table(rans.frequencies(np.bincount(ids, minlength=spread)))
        states, words = table.encode(ids)
        assert np.array_equal(table.decode(n, states, words), ids)
        assert int(table.freq.sum()) == 1 << rans.SCALE
    assert 4 * len(words) < 2 * n


def test_damaged_blocks_are_found():
    ids = np.arange(100)
    table = rans.Table(rans.frequencies(np.ones(100, np.int64)))
    data = rans.block_bytes(table, np.array([1]), np.array([0]), np.array([100]), ids, 0)
    assert rans.read_block(table, data, 0)[4].tolist() == ids.tolist()
    for at in (0, 80, len(data) - 1):
        with pytest.raises(ValueError):
            rans.read_block(table, data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :], 0)
    with pytest.raises(ValueError):
        rans.read_block(table, data[:-1], 0)


@pytest.mark.parametrize("table", ["docs", "odd", "empty"])
def test_id_files(request, table):
    df = request.getfixturevalue(table)
    enc = Encoder(vocabulary("word_bpe_49k.json"))
    got = sorted(((r.start, r.doc_id, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in rans.read(*rans.write(df, block=500)).collect()))
    want = sorted(((r.doc_id, np.array([*enc.library(r.text or ""), 1], "<u4").tobytes()) for r in df.collect()), key=repr)
    assert sorted(((d, ids) for _, d, _, _, ids in got), key=repr) == want
    ids = [d if d is not None else -1 for _, d, *_ in got]
    assert ids == sorted(ids) and [s for s, *_ in got] == [sum(n for _, _, n, *_ in got[:i]) for i in range(len(got))]
    assert all(n == len(b) // 4 and c == zlib.crc32(b) for _, _, n, c, b in got)
