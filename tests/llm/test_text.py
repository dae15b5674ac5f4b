"""Secrets, near duplicates, quality, languages, vectors, repeated passages and the pipeline against plain Python."""

import hashlib
import json
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from reelmill.llm import ann, components, langid, near, quality, secrets, substring
from reelmill.llm._text import Words

from .conftest import SCHEMA, WORD

TABLES = ["docs", "odd", "empty"]


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_words_are_split_alike(texts):
    column = pa.array([t for _, t in texts] + [None, "", " \x0b", "x" * 5_000_000, "é"])
    w = Words(column)
    seen = {}
    for i, t in enumerate(column.to_pylist()):
        own = WORD.findall(t or "")
        assert len(w.of(i)) == len(own)
        for h, word in zip(w.of(i).tolist(), own, strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
    assert np.array_equal(Words(column.slice(3)).of(0), w.of(3))


# Secrets


def plain_spans(text):
    base = {
        "assign": [m for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 6],
        "access": [m for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        "hex": [m for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24],
    }
    order = list(base)
    return sorted(((m.start(), order.index(k), k, m.end()) for k, found in base.items() for m in found))


@pytest.mark.parametrize("table", TABLES)
def test_secret_report(request, table):
    df = request.getfixturevalue(table)
    want = []
    for r in df.collect():
        spans = plain_spans(r.text or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
        want.append((r.doc_id, *(sum(k == x[2] for x in spans) for k in ("assign", "access", "hex")), hashlib.sha256(joined.encode()).hexdigest(), joined))
    assert rows(secrets.report(df), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans") == sorted(want, key=repr)


@pytest.mark.parametrize("text", ["token=abc password=longenough", "token=token:abcdefgh", "PassWord : 'abc.def/ghi'", "ſecret=abcdef", "AKIAAKIA" + "A" * 16, "AKIA" + "B" * 15, "a" * 23, "f" * 24 + "g" + "0" * 30, "api_key=\"x\" apikey=aaaaaaaa", "é token=ééé secret=\t123456"])
def test_secret_patterns(text):
    assert secrets.find(text) == [(k, s, e) for s, _, k, e in plain_spans(text)]


def test_ledger_scans_only_what_is_new(spark, docs):
    ledger = secrets.Ledger(spark)
    versions = docs.select(F.col("doc_id").alias("path"), secrets.blob(F.col("text")).alias("blob"), "text")
    distinct = versions.select("blob").distinct().count()
    assert ledger.update(versions).count() == distinct < versions.count()
    assert ledger.update(versions).count() == 0
    more = spark.createDataFrame([(1, "a new version, token=abcdefg")], "path long, text string").withColumn("blob", secrets.blob(F.col("text")))
    assert ledger.update(versions.unionByName(more.select("path", "blob", "text"))).count() == 1
    assert ledger.read().count() == distinct + 1


def digits(text):
    return [("hex", m.start(), m.end()) for m in re.finditer("[0-9]{3,}", text)]


def test_rules_go_by_their_version(spark, docs, monkeypatch):
    monkeypatch.setattr(secrets, "RULES", dict(secrets.RULES))
    secrets.add_rules("digits", digits)
    with pytest.raises(ValueError):
        secrets.add_rules("digits", secrets.find)
    ledger = secrets.Ledger(spark)
    df = spark.createDataFrame([(1, "token=abcdefg and 12345")], "doc_id long, text string")
    found = {v: [tuple(s) for s in secrets.scan(df, ledger, v).first().spans] for v in ("base-1", "digits", "base-1")}
    assert found == {"base-1": [("assign", 0, 13)], "digits": [("hex", 18, 23)]} and ledger.read().count() == 2
    with pytest.raises(KeyError):
        secrets.scan(df, ledger, "unheard of")


def test_a_blob_in_two_batches_is_found_once(spark):
    ledger = secrets.Ledger(spark)
    df = spark.createDataFrame([(1, "token=abcdefg"), (2, "token=abcdefg"), (3, "clean")], "doc_id long, text string")
    secrets.scan(df, ledger)
    ledger.read().write.parquet(f"{ledger.path}/batch=another")  # as a writer at the same time leaves it
    assert ledger.read().count() == 4
    assert rows(secrets.report(df, ledger), "doc_id", "n_assign") == [(1, 1), (2, 1), (3, 0)]


def test_history_is_scanned_once(spark, docs):
    """All versions of all paths go in; a later day's versions bring only what is new, and findings go to every path."""
    ledger = secrets.Ledger(spark)
    old = docs.withColumn("text", F.concat(F.lit("draft of "), "text"))
    secrets.scan(old, ledger).count()
    before = ledger.read().count()
    assert rows(secrets.report(docs, ledger), "doc_id", "spans") == rows(secrets.report(docs), "doc_id", "spans")
    assert ledger.read().count() == before + docs.select("text").distinct().count()


def test_scans_keep_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "token=abcdefg", "a", "b"), (2, "clean", "c", "d")], "doc_id long, text string, __blob string, __spans string")
    assert rows(secrets.redacted(df), "doc_id", "text", "__blob", "__spans") == [(1, "[assign]", "a", "b"), (2, "clean", "c", "d")]
    assert rows(secrets.scan(df), "doc_id", "__blob", "__spans") == [(1, "a", "b"), (2, "c", "d")]
    odd = quality.judge(df.withColumnRenamed("__blob", "__text"))
    assert rows(odd, "doc_id", "__text", "n_words") == [(1, "a", 1), (2, "c", 1)]


def test_redaction_leaves_clean_rows(docs):
    out = secrets.redacted(docs)
    assert out.columns == docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        spans = plain_spans(before[r.doc_id])
        assert (r.text == before[r.doc_id]) == (not spans) and not plain_spans(r.text)
        assert r.spans == "x"


# Near duplicates


def plain_classes(table):
    """(doc_id as sorted, text) rows -> class and links by comparing all pairs."""
    grams, parent, n = [], list(range(len(table))), [0] * len(table)
    for _, t in table:
        w = WORD.findall(t or "")
        grams.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            both = len(grams[i] & grams[j])
            if both and 5 * both >= 4 * len(grams[i] | grams[j]):
                n[i], n[j] = n[i] + 1, n[j] + 1
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(table))], n


def in_order(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0))


@pytest.mark.parametrize("table", TABLES)
@pytest.mark.parametrize("block", [256, 3])
def test_similar(request, monkeypatch, table, block):
    monkeypatch.setattr(near, "BLOCK", block)
    monkeypatch.setattr(near, "GROUP", block)
    df = request.getfixturevalue(table)
    own = in_order(df)
    label, n = plain_classes(own)
    want = sorted(((d, own[c][0], k) for (d, _), c, k in zip(own, label, n, strict=True)), key=repr)
    assert rows(near.similar(df), "doc_id", "class_id", "n_links") == want


@pytest.mark.parametrize("table", TABLES)
def test_one_of_each_class_stays(request, table):
    df = request.getfixturevalue(table)
    own = in_order(df)
    label, _ = plain_classes(own)
    classes = Counter(c for c, (_, t) in zip(label, own, strict=True) if WORD.search(t or ""))
    out = near.representatives(df)
    assert out.columns == df.columns
    kept = in_order(out)
    assert len(kept) == len(classes) + sum(not WORD.search(t or "") for _, t in own)
    assert {d for d, _ in kept} >= {own[c][0] for c in classes}


def test_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(120)]
    table = [(i, " ".join([*base[: i % 100], f"x{i}", *base[i % 100 + 1 :]])) for i in range(300)]
    got = near.similar(spark.createDataFrame(table, "doc_id long, text string")).collect()
    label, n = plain_classes(table)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(i, table[c][0], k) for (i, _), c, k in zip(table, label, n, strict=True)]
    assert max(n) > 250


def test_a_chain_of_bands_is_no_class(spark, monkeypatch):
    """Texts that overlap by half share bands with their neighbours, but no pair survives the pruning."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in rng.integers(0, 1 << 40, 3000)]
    table = [(i, " ".join(words[30 * i : 30 * i + 60])) for i in range(98)]
    monkeypatch.setattr(near, "ROWS", 2)  # then so much is enough to share a band
    seen = []
    links = near.connected_components
    monkeypatch.setattr(near, "connected_components", lambda edges: seen.append(edges.count()) or links(edges))
    nodes = near.settled(near.signed(near.named(spark.createDataFrame(table, "doc_id long, text string"))), "nodes")
    keyed = nodes.select("sid", F.explode("keys").alias("key"))
    assert keyed.groupBy("key").count().where("count > 1").count() > 200
    assert near._candidates(nodes, 4).count() == 0 and seen == [0]


def test_the_largest_id_is_an_id(spark):
    top = (1 << 63) - 1
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(top, text), (None, text), (None, "alone " * 3), (top - 1, "no copy here")], "doc_id long, text string")
    assert rows(near.similar(df), "doc_id", "class_id", "n_links") == sorted([(top, top, 1), (None, top, 1), (None, None, 0), (top - 1, top - 1, 0)], key=repr)


def test_representatives_keep_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "a", "b"), (2, text, "c", "d"), (3, "x y z", "e", "f"), (1, text, "a", "b")], "doc_id long, text string, __did string, __TH string")
    out = near.representatives(df)
    assert out.columns == df.columns and rows(out, "doc_id", "__did", "__TH") == [(1, "a", "b"), (3, "e", "f")]


def test_blocks_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_BYTES", 4000)
    base = [f"w{i}" for i in range(200)]
    table = [(i, " ".join([*base[: 5 * i], f"x{i}", *base[5 * i + 1 :]])) for i in range(20)]
    got = near.similar(spark.createDataFrame(table, "doc_id long, text string")).collect()
    label, n = plain_classes(table)
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got) == [(i, table[c][0], k) for (i, _), c, k in zip(table, label, n, strict=True)]


def test_exact_products_agree():
    rng = np.random.default_rng(4)
    grams = [np.unique(rng.integers(0, 900, 300).astype(np.uint64)) for _ in range(80)]
    at, to = map(list, zip(*[(i, j) for i in range(80) for j in range(i)], strict=True))
    assert near._inner(grams, at, to).tolist() == [len(np.intersect1d(grams[i], grams[j])) for i, j in zip(at, to, strict=True)]


def test_least_matches_keep_the_posterior():
    from math import comb

    for n, m in zip(range(near.STEP, near.COMPARED + 1, near.STEP), near.least_matches(), strict=True):
        tail = lambda k, n=n: sum(comb(n + 1, i) * 0.8**i * 0.2 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= near.TOLERANCE and (m == 0 or tail(m - 1) < near.TOLERANCE)


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    out = components.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert rows(out, "node", "root") == sorted(((x, top(x)) for x in parent if top(x) != x), key=repr)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Quality


@pytest.mark.parametrize("table", TABLES)
def test_quality(request, table):
    df = request.getfixturevalue(table)
    want = []
    pack = zstandard.ZstdCompressor(level=quality.LEVEL, write_content_size=False, write_checksum=False).compress
    for r in df.collect():
        t = r.text or ""
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
        raw = t.encode()
        chunks = [raw[i * 4096 : (i + 1) * 4096 if i < max(1, len(raw) // 4096) - 1 else len(raw)] for i in range(max(1, len(raw) // 4096))]
        inside = lambda b: next(lo <= len(b) / len(pack(b)) <= hi for upto, lo, hi in quality.BANDS if len(b) <= upto)
        good = not failed and inside(raw) and (len(chunks) == 1 or sum(not inside(c) for c in chunks) <= quality.CHUNK_SHARE * len(chunks))
        want.append((r.doc_id, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed, good))
    out = quality.judge(df)
    assert rows(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == sorted(want, key=repr)
    assert out.select("lang", "spans").count() == len(want)


def test_bands_reject_both_ends(spark):
    import base64
    import random

    rng = random.Random(0)
    noise = " ".join(base64.b64encode(rng.randbytes(24)).decode() for _ in range(200))
    loop = " ".join(f"{a} {b}" for a, b in zip("abcdefghij" * 300, map(str, range(3000)), strict=True))
    out = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(spark.createDataFrame([(1, noise), (2, loop)], "doc_id long, text string"), bands=((1 << 62, 1.5, 2.0),)).collect()}
    assert out == {1: (False, False), 2: (False, False)}


def test_default_bands_decide(spark):
    import random

    rng = random.Random(1)
    noise = {name: " ".join("".join(rng.choice(a) for _ in range(rng.randint(3, 9))) for _ in range(2400))[:16384] for name, a in (("hex", "0123456789abcdef"), ("letters", "abcdefghijklmnopqrstuvwxyz"), ("digits", "0123456789"))}
    made = [*noise.values(), noise["digits"][:200], " ".join(f"The The Fit {i}" for i in range(40)), " ".join(f"The The Fit {i}" for i in range(400))]
    out = quality.judge(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()
    assert not any(r.kept or r.base_failed for r in out)
    at = "/root/testdata/sf0.01"
    judged = quality.judge(spark.read.parquet(f"{at}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id")
    share = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    assert share[1] > 0.99 and share[0] < 0.4


def test_fitted_bands_keep_good_texts_and_reject_noise(spark):
    import random

    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet").join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id")
    good = quality.judge(docs).where("quality = 1 AND NOT base_failed").select("doc_id", "text")
    bands = quality.fit_bands(good, outside=0.002)
    assert [b[0] for b in bands] == [b[0] for b in quality.BANDS] and all(0 < lo < hi for _, lo, hi in bands)
    kept = quality.judge(good, bands=bands).agg(F.avg(F.col("kept").cast("double"))).first()[0]
    rng = random.Random(1)
    noise = [" ".join("".join(rng.choice("0123456789abcdef") for _ in range(rng.randint(3, 9))) for _ in range(n)) for n in (300, 2400)]
    assert kept > 0.97 and not any(r.kept for r in quality.judge(spark.createDataFrame([(t,) for t in noise], "text string"), bands=bands).collect())
    assert quality.fit_bands(good, outside=0.002) == bands and quality.fit_bands(good.where("doc_id < 0")) == quality.BANDS


# Languages


def languages(n=400):
    rng = np.random.default_rng(11)
    alphabet = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "mnopqréü"}
    return [(i, " ".join("".join(rng.choice(list(alphabet[lang]), rng.integers(2, 7))) for _ in range(rng.integers(5, 40))), lang) for i, lang in enumerate(rng.choice(list(alphabet), n))]


def test_languages_held_out(spark):
    df = spark.createDataFrame(languages(), "doc_id long, text string, lang string")
    out = langid.report(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang_pred == r.lang for r in held) > 0.97 * len(held) and all(0 <= r.score <= 1 for r in out)


def test_language_labels_of_held_out_rows_are_never_used(spark):
    df = spark.createDataFrame(languages(), "doc_id long, text string, lang string")
    changed = df.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    assert rows(langid.report(df), "doc_id", "lang_pred", "score") == rows(langid.report(changed), "doc_id", "lang_pred", "score")


@pytest.mark.parametrize("table", ["odd", "empty"])
def test_language_edge_cases(request, spark, table):
    df = request.getfixturevalue(table)
    model = langid.train(spark.createDataFrame(languages(), "doc_id long, text string, lang string"))
    out = langid.identify(df, model).collect()
    assert len(out) == df.count()
    assert sum(r.lang_pred == "und" for r in out) == sum(not any(c.isalpha() for c in r.text or "") for r in df.collect())
    assert all(r.lang_pred == "und" and r.score == 0 for r in langid.identify(df, {}).collect())


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    g = langid.Grams(3)
    g.add([langid.clean("".join(rng.choice(list("abc ")) for _ in range(400)), 3)])
    m = langid.Model(g.text, g.n)
    chars = sorted({int(c) for c in g.text.ravel()})
    for ctx in ((97, 98), (32, 97), (120, 121)):
        p = np.exp(m.score(np.array([[*ctx, c] for c in chars], np.uint32))).sum()
        assert 0.8 < p <= 1.0001


def plain_kneser_ney(texts, order):
    """Interpolated Kneser-Ney from its definition: history and character -> probability."""
    counts = {order: Counter()}
    for t in texts:
        c = tuple(langid.clean(t, order).tolist())
        counts[order].update(c[i : i + order] for i in range(len(c) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut, total, kinds = {}, defaultdict(int), defaultdict(int)
    for k, own in counts.items():
        once, twice = (sum(n == j for n in own.values()) for j in (1, 2))
        cut[k] = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
        for g, n in own.items():
            total[g[:-1], k] += n
            kinds[g[:-1], k] += 1

    def p(gram):
        k = len(gram)
        below = p(gram[1:]) if k > 1 else 1 / (len(counts[1]) + 1)
        if (gram[:-1], k) not in total:
            return below
        here = total[gram[:-1], k]
        return max(counts[k][gram] - cut[k], 0) / here + cut[k] * kinds[gram[:-1], k] / here * below

    return p


def test_cross_entropies_equal_kneser_ney(spark):
    table = [(t, lang) for _, t, lang in languages(90)]
    models = langid.train(spark.createDataFrame(table, "text string, lang string"), shard=300)
    asked = [t for t, _ in table[:20]] + ["abcmno xyz", "q", "Mix ABC éü zz"]
    got, size = langid.entropies(asked, models)
    for j, lang in enumerate(models.names):
        p = plain_kneser_ney([t for t, own in table if own == lang], langid.ORDER)
        for i, t in enumerate(asked):
            c = tuple(langid.clean(t).tolist())
            logs = [np.log(p(c[k : k + langid.ORDER])) for k in range(len(c) - langid.ORDER + 1)]
            assert len(logs) == size[i] and got[i, j] == pytest.approx(-np.mean(logs), abs=1e-6)


def test_strange_texts_are_rejected_and_own_ones_are_not(spark):
    rng = np.random.default_rng(5)
    own = [(i, t, lang) for i, t, lang in languages(3000)]
    strange = [(10_000 + i, " ".join("".join(rng.choice(list(a), 5)) for _ in range(20)), None) for i, a in enumerate(["xyz", "adgjmpsvy", "жзик", "aamm"])]
    out = {r.doc_id: r for r in langid.report(spark.createDataFrame(own + strange, "doc_id long, text string, lang string")).collect()}
    assert all(out[i].rejected for i, _, _ in strange)
    assert sum(out[i].rejected for i, _, _ in own if out[i].held_out) < 0.02 * sum(r.held_out for r in out.values())


def test_every_language_and_n_gram_is_kept(spark, monkeypatch):
    monkeypatch.setattr(langid, "HELD", 1000)  # fewer than two shards
    rng = np.random.default_rng(3)
    texts = [(f"l{i:02}", " ".join("".join(chr(0x4E00 + 40 * i + c) for c in rng.integers(0, 30, 8)) for _ in range(6))) for i in range(70) for _ in range(2)]
    models = langid.train(spark.createDataFrame(texts, "lang string, text string"), shard=500)
    assert len(models.names) == 70 and models.shards > langid.SHARDS
    got, _ = langid.entropies([t for _, t in texts], models)
    assert [models.names[j] for j in got.argmin(1)] == [lang for lang, _ in texts]
    for lang in ("l00", "l69"):  # as one model over all counts
        g = langid.Grams(langid.ORDER)
        g.add([langid.clean(t) for own, t in texts if own == lang])
        grams = np.concatenate([np.lib.stride_tricks.sliding_window_view(langid.clean(t), langid.ORDER) for _, t in texts[::35]])
        whole = langid.Model(g.text, g.n).score(grams)
        shard = langid._pair(grams) % models.shards
        assert np.allclose([models.shard(int(s))[lang].score(x[None])[0] for s, x in zip(shard, grams, strict=True)], whole, atol=1e-5)


def test_limits_cover_every_language_and_distinct_text(spark):
    common = [(text, lang) for _, text, lang in languages(2400)]
    copies = [common[0]] * 3000
    rare = [(" ".join("".join("tuvwxyz"[c] for c in np.random.default_rng(i).integers(0, 7, 5)) for _ in range(12)), "rare") for i in range(4)]
    df = spark.createDataFrame(common + rare, "text string, lang string")
    models = langid.train(df)
    limits = langid.calibrate(df, models)
    assert limits.keys() == set(models.names) and all(np.isfinite(v) for v in limits.values())
    assert limits == langid.calibrate(df.unionByName(spark.createDataFrame(copies, df.schema)), models)
    ent, _ = langid.entropies([t for t, _ in common + rare], models)
    for lang, limit in limits.items():
        own = [e for e, (_, l) in zip(ent[:, models.names.index(lang)], common + rare, strict=True) if l == lang]
        assert limit == pytest.approx(np.quantile(own, 0.999, method="inverted_cdf"), abs=0.002)


def test_limits_come_from_texts_left_out_of_the_counts(spark):
    common = [(text, lang) for _, text, lang in languages(1500)]
    alone = [("tuv wxy zzz", "few")]
    df = spark.createDataFrame(common + alone, "text string, lang string")
    got = langid.limits(df)
    apart = F.pmod(F.xxhash64("text"), F.lit(langid.ASIDE)) == 0
    models = langid.train(df.where(~apart | (F.col("lang") == "few")))
    for lang in ("aa", "bb", "cc"):
        own = [r.text for r in df.where(apart & (F.col("lang") == lang)).collect()]
        ent, _ = langid.entropies(own, models, [lang])
        assert len(own) > 20 and got[lang] == pytest.approx(ent.max(), abs=0.0011)
    assert got["few"] == pytest.approx(1.1 * langid.entropies([alone[0][0]], models, ["few"])[0][0, 0], abs=0.0022)


# Vectors


def vectors(n=1500, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(20, dim))[rng.integers(0, 20, n)] * 3 + rng.normal(size=(n, dim))
    x[200:700] = x[200]  # one common vector
    return x.astype(np.float32)


def plain_neighbours(table, k=10):
    ids, x = np.array([i for i, _ in table]), np.array([v for _, v in table], float)
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[ids == ids[i]] = np.inf
        by = [j for j in np.lexsort((ids, d)) if np.isfinite(d[j])][:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in by]
    return out


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 16, "ASKED": 2, "SPLIT": 40, "LEAF": 20, "LEAST": 4}])
def test_search_recall(spark, monkeypatch, sizes):
    for name, size in sizes.items():
        monkeypatch.setattr(ann, name, size)
    table = [(i, v.tolist()) for i, v in enumerate(vectors())]
    got = defaultdict(list)
    sample = 200 if sizes else ann.SAMPLE  # then trees are fitted on two levels and more
    for r in ann.search(spark.createDataFrame(table, "vec_id long, embedding array<float>"), sample=sample).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    want = plain_neighbours(table)
    assert got.keys() == want.keys() and all(len(v) == 10 for v in got.values())
    assert sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    assert got[300] == want[300]  # ties by vec_id, distance exactly zero
    for q in got:
        x = np.array(table[q][1])
        assert all(s == pytest.approx(float(np.sqrt(((np.array(table[a][1]) - x) ** 2).sum())), abs=1e-12) for a, s in got[q])


def test_search_edge_cases(spark):
    schema = "vec_id long, embedding array<float>, leaf int"
    assert ann.search(spark.createDataFrame([], schema)).count() == 0
    data = [(0, [1.0, 0.0], 1), (None, [1.0, 1.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, None], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [2.0, 0.0], 1), (6, [2.0, 0.0], 1), (7, [1.0, 2.0, 3.0], 1), (100, [1.0, 0.5], 1)]
    out = rows(ann.search(spark.createDataFrame(data, schema)), "query_id", "rank", "vec_id", "score")
    assert out == [(0, 1, 100, 0.5), (0, 2, 6, 1.0), (0, 3, 6, 1.0), (100, 1, 0, 0.5), (100, 2, 6, pytest.approx(1.118033988749895)), (100, 3, 6, pytest.approx(1.118033988749895))]


def test_repeated_queries_find_ten_rows(spark):
    x = vectors().astype(float)
    x[800] = 60.0
    table = [(i, v.tolist()) for i, v in enumerate(x)] + [(100, x[100].tolist())] * 2 + [(800, x[800].tolist())] * 60 + [(900, (x[900] + 900).tolist())]
    got = defaultdict(list)
    for r in ann.search(spark.createDataFrame(table, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for q in (100, 800, 900):  # other ids stand once each near them
        assert len({a for a, _ in got[q]}) == 10
        assert all(s == pytest.approx(float(np.sqrt(((x[a] - x[q]) ** 2).sum()))) for a, s in got[q])


def test_leaves_stay_bounded(spark, monkeypatch):
    for name, size in {"SPLIT": 60, "LEAF": 20, "LEAST": 4}.items():
        monkeypatch.setattr(ann, name, size)
    made = []
    met = ann._met
    monkeypatch.setattr(ann, "_met", lambda rows, pool, k: made.append((rows, pool)) or met(rows, pool, k))
    for n in (1000, 4000):
        rng = np.random.default_rng(n)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 6)))], "vec_id long, embedding array<double>")
        assert ann.search(df, sample=150).count() == 10 * n // 100
    for rows, pool in made:
        assert rows.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 60
        assert pool.groupBy("vec_id").count().agg(F.max("count")).first()[0] < 60
    assert max(leaf.count("/") for leaf in (r.leaf for r in made[1][0].select("leaf").distinct().collect())) > 1


def test_equal_vectors_keep_what_any_query_can_find(spark):
    rows = [(i, [1.0, 2.0]) for i in range(200)] * 2 + [(300, [1.0, 2.0])] * 30
    out = ann._few(spark.createDataFrame(rows, "vec_id long, v array<double>"), 10).collect()
    assert sorted(r.vec_id for r in out) == [i for i in range(10) for _ in range(2)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()
    assert {q: [r.vec_id for r in got if r.query_id == q] for q in (0, 100, 300)} == {0: [1, 1, 2, 2, 3, 3, 4, 4, 5, 5], 100: [0, 0, 1, 1, 2, 2, 3, 3, 4, 4], 300: [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]}


def test_each_length_is_a_space_of_its_own(spark):
    rows = [(i, [float(i), 1.0]) for i in range(1, 30)] + [(100, [3.0, 1.0]), (200, [1.0, 1.0, 1.0]), (201, [1.0, 1.0, 2.0])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in got if r.query_id == 200] == [(201, 1.0)]
    assert sum(r.query_id == 100 for r in got) == 10


def test_queries_among_rows_of_their_own_id_meet_all_rows(spark, monkeypatch):
    for name, size in {"SPLIT": 40, "LEAF": 20, "LEAST": 4}.items():
        monkeypatch.setattr(ann, name, size)
    rng = np.random.default_rng(2)
    rows = [(100, (50 + rng.normal(size=4)).tolist()) for _ in range(200)] + [(i + 1, rng.normal(size=4).tolist()) for i in range(50)]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), sample=100).collect()
    q = np.array(min(v for i, v in rows if i == 100))
    want = sorted((float(np.sqrt(((np.array(v) - q) ** 2).sum())), i) for i, v in rows if i != 100)[:10]
    assert [(r.vec_id, pytest.approx(r.score)) for r in sorted(got, key=lambda r: r["rank"])] == [(i, d) for d, i in want]


# Repeated passages


def plain_dedup(table, window=13):
    """table: (doc_id or None, text), any order -> (n_words, n_removed, kept words) of each row."""
    words = [WORD.findall(t or "") for _, t in table]
    key = [(d is None, d or 0) for d, _ in table]
    first = {}
    for d, w in zip(key, words, strict=True):
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, d), d)
    out = []
    for d, w in zip(key, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        out.append((len(w), len(gone), [x for i, x in enumerate(w) if i not in gone]))
    return out


@pytest.mark.parametrize("table", TABLES)
@pytest.mark.parametrize("window", [13, 30])
def test_dedup(request, table, window):
    df = request.getfixturevalue(table)
    own = [(r.doc_id, r.text) for r in df.collect()]
    want = sorted(((d, n, g, hashlib.sha256(" ".join(k).encode()).hexdigest()) for (d, _), (n, g, k) in zip(own, plain_dedup(own, window), strict=True)), key=repr)
    assert rows(substring.dedup(df, window), "doc_id", "n_words", "n_removed", "kept_sha256") == want


@pytest.mark.parametrize("seed", range(4))
def test_dedup_of_tiny_alphabets(spark, seed):
    """Runs and periods of every kind: few words, many repeats."""
    rng = np.random.default_rng(seed)
    table = [(i, " ".join(rng.choice(list("abc")[: 1 + seed % 3], rng.integers(5, 60)))) for i in range(40)]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept.split()) for r in substring.dedup(spark.createDataFrame(table, "doc_id long, text string").repartition(3)).collect()}
    assert got == {d: v for (d, _), v in zip(table, plain_dedup(table), strict=True)}


def test_removal_keeps_other_texts_byte_for_byte(docs):
    own = [(r.doc_id, r.text) for r in docs.collect()]
    out = {r.doc_id: r.text for r in substring.remove(docs).collect()}
    for (d, t), (_, gone, kept) in zip(own, plain_dedup(own), strict=True):
        assert WORD.findall(out[d]) == kept and (gone or out[d] == t)


@pytest.mark.parametrize("plan", [("pair",), ("run", "pair"), substring.PLAN, ("run", "pair", "run", "pair", "pair")])
def test_equal_windows_have_equal_anchors(plan):
    rng = np.random.default_rng(9)
    for window in (5, 13, 30):
        words = np.repeat(rng.integers(0, 1 << 62, 60, dtype=np.uint64), rng.integers(1, 4, 60))
        words[40:70] = words[40]
        a = substring.anchors(words, window, plan)
        assert len(a) == len(words) - window + 1
        for i in range(0, len(a), 3):  # the same window between other words
            around = rng.choice(np.append(rng.integers(0, 1 << 62, 10, dtype=np.uint64), [words[i], words[i + window - 1]]), 40)
            assert substring.anchors(np.concatenate([around[:20], words[i : i + window], around[20:]]), window, plan)[20] == a[i]


def test_symbols_carry_most_anchors():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 1 << 62, 20_000, dtype=np.uint64)
    a = substring.anchors(words)
    own = substring.windows(words, substring.WINDOW, 4)
    assert (a == own).mean() < 0.05 and len(np.unique(a)) < 0.4 * len(a)


def test_copies_cost_no_more_than_one_text(spark):
    """Thousands of copies, and thousands of texts around one passage: what is settled for a document stays within its words."""
    rng = np.random.default_rng(1)
    text = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 1 << 40, n))
    body, passage = text(200), text(40)
    table = [(i, body) for i in range(5000)] + [(10_000 + i, f"{text(5)} {passage} {text(5)}") for i in range(2000)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(8)
    found = substring.marks(df)
    assert found.where("whole").count() == 4999 and found.where("value IS NOT NULL").count() == 1999
    assert found.agg(F.max(F.length("value"))).first()[0] == 4 * (40 - 13 + 1)
    out = {r.doc_id: r.n_removed for r in substring.dedup(df).collect()}
    assert out == {i: 200 for i in range(1, 5000)} | {0: 0, 10_000: 0} | {10_000 + i: 40 for i in range(1, 2000)}


def test_the_largest_id_is_no_null(spark):
    body = " ".join(f"w{i}" for i in range(20))
    table = [((1 << 63) - 1, body), (None, body), (None, body + " more"), (-5, "another " + body + " end")]
    got = sorted(((r.doc_id, r.n_removed) for r in substring.dedup(spark.createDataFrame(table, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([((1 << 63) - 1, 20), (None, 20), (None, 20), (-5, 0)], key=repr)


def test_removal_keeps_columns_of_any_name(spark):
    body = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, body, "a", "b", "c", "d"), (2, body, "e", "f", "g", "h")], "doc_id long, text string, did string, __th string, __value string, whole string")
    out = {r.doc_id: (r.text, r["did"], r["__th"], r["__value"], r.whole) for r in substring.remove(df).collect()}
    assert out == {1: (body, "a", "b", "c", "d"), 2: ("", "e", "f", "g", "h")}


# Pipeline


@pytest.mark.parametrize("table", TABLES)
def test_pipeline(request, spark, tmp_path, table):
    import zlib

    import corpus_pipeline
    from reelmill.llm import packing
    from reelmill.llm._bpe import Encoder, vocabulary

    df = request.getfixturevalue(table)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    stages, current = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, current, str(tmp_path))
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert after.schema == current.schema
        stages[name], current = (current, after), after
    before, after = stages["quality"]
    good = rows(quality.judge(before).where("kept"), "doc_id", "text", "lang")
    assert rows(after, "doc_id", "text", "lang") == good
    own = in_order(after)
    label, _ = plain_classes(own)
    assert len(in_order(stages["near_duplicates"][1])) == len(set(label))
    own = [(r.doc_id, r.text) for r in stages["repeats"][0].collect()]
    assert sorted(WORD.findall(r.text) for r in stages["repeats"][1].collect()) == sorted(k for _, _, k in plain_dedup(own))
    assert all(r.n_chars == len(r.text) for r in stages["secrets"][1].collect())
    assert not any(plain_spans(r.text) for r in stages["secrets"][1].collect())
    enc, want = Encoder(vocabulary("byte_bpe_50k.json")), []
    for r in stages["secrets"][1].collect():
        ids = np.array([*enc.library(r.text), 1], "<u4")
        want += [(r.doc_id, s, k, zlib.crc32(ids[s : s + k].tobytes())) for s, k in packing.cuts(len(ids))]
    assert rows(stages["packing"][1], "doc_id", "start", "length", "ids_crc32") == sorted(want, key=repr)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert rows(whole, "doc_id", "start", "ids_crc32") == rows(stages["packing"][1], "doc_id", "start", "ids_crc32")


def test_stage_names():
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "secrets", "packing"]
    assert json.dumps(SCHEMA.jsonValue())
