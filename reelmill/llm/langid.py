"""Language identification with interpolated Kneser-Ney character models.

A model per language: character n-grams to order ORDER over lower-case letters, anything else one space. Highest-order counts
come from all training documents; lower orders use continuation counts. Each order is kept as a sorted array of n-gram hashes with
interpolated log-probabilities, and one of context hashes with log back-off weights. Every language and every n-gram is kept: all that
an n-gram's score looks up from order 3 on holds the two characters before its last, so the models are cut into shards by those two,
which are files in the shared folder; orders 1 and 2 are a file for all shards. A text belongs to the language of the lowest
cross-entropy a character; it is rejected if that exceeds the language's limit, which texts left out of the counts calibrate.
"""

from __future__ import annotations

import pickle
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import arrow_rows, new_path, settled
from ._text import mix

ORDER = 5
#: Highest-order n-grams that a shard of the models holds about, shards at least, n-grams of shards that a worker keeps loaded.
SHARD, SHARDS, HELD = 200_000, 8, 4_000_000
#: Distinct n-grams that a counting task holds before it hands them on, and languages scored at once.
COUNTED, SCORED = 600_000, 32
#: Share of a language's own texts that may be rejected, the width of a class of cross-entropies, and how many texts to one that
#: calibrates. What is added to limits of languages whose texts were all counted.
REJECTED, WIDTH, ASIDE, MARGIN = 0.001, 0.001, 10, 0.1
UNKNOWN = "und"
_FACTORS = np.random.default_rng(77).integers(0, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def clean(text: str, order: int = ORDER) -> np.ndarray:
    """Code points after `order` - 1 spaces: lower-case letters, each stretch of anything else one space; empty without letters."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[cp]
    if not letter.any():
        return np.zeros(0, np.uint32)
    cp = np.where(letter, cp, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a stretch without letters, its first
    return np.concatenate([np.full(order - 1, 32, np.uint32), cp[keep].astype(np.uint32), np.full(int(letter[-1]), 32, np.uint32)])


def hashes(grams: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of code points; no columns: zero."""
    out = np.zeros(len(grams), np.uint64)
    for j in range(grams.shape[1]):
        out += grams[:, j].astype(np.uint64) * _FACTORS[j]
    return mix(out)


def _sliding(cp: np.ndarray, order: int) -> np.ndarray:
    """The hash of the n-gram that ends at each position from order - 1."""
    n = len(cp) - order + 1
    out = np.zeros(max(n, 0), np.uint64)
    for j in range(order):
        out += cp[j : j + n].astype(np.uint64) * _FACTORS[j]
    return mix(out)


class Grams:
    """Counts of highest-order n-grams, by hash, with a place where each can be read."""

    def __init__(self, order: int):
        self.order, self.key, self.n, self.text = order, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, order), np.uint32)

    def add(self, texts: list[np.ndarray]) -> None:
        texts = [t for t in texts if len(t)]
        if not texts:
            return
        cp = np.concatenate(texts)
        starts = np.cumsum([0, *map(len, texts)])
        ok = np.ones(max(len(cp) - self.order + 1, 0), bool)
        for j in range(1, self.order):  # n-grams across two texts
            ok[starts[1:-1] - j] = False
        place = np.flatnonzero(ok)
        coded = pa.array(_sliding(cp, self.order)[place]).dictionary_encode()
        key, codes = coded.dictionary.to_numpy(), coded.indices.to_numpy()
        where = np.empty(len(key), np.int64)
        where[codes] = place
        text = cp[where[:, None] + np.arange(self.order)]
        both, first, inverse = np.unique(np.concatenate([self.key, key]), return_index=True, return_inverse=True)
        n = np.bincount(inverse, np.concatenate([self.n, np.bincount(codes, minlength=len(key))]), len(both))
        self.key, self.n, self.text = both, n.astype(np.int64), np.concatenate([self.text, text])[first]


class Model:
    """Sorted hash arrays of one language, or of its n-grams in one shard: then `low` is the model of orders 1 and 2, and `cuts` are
    the discounts of the higher orders over all shards."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, cuts: dict[int, float] | None = None, low: Model | None = None):
        order, least = grams.shape[1], low.order if low else 0
        levels = {order: (grams, counts.astype(float))}
        for k in range(order - 1, least, -1):  # continuation counts: distinct longer n-grams that end so
            longer = levels[k + 1][0][:, 1:]
            _, first, n = np.unique(hashes(longer), return_index=True, return_counts=True)
            levels[k] = (longer[first], n.astype(float))
        self.order, self.probs, self.backs = order, {}, {}
        self.unseen = low.unseen if low else 1.0 / (len(levels[1][0]) + 1)
        lower_key, lower_p = (low.probs[least][0], np.exp(low.probs[least][1].astype(float))) if low else (None, None)
        for k in range(least + 1, order + 1):
            g, c = levels[k]
            cut = cuts[k] if cuts else discount((c == 1).sum(), (c == 2).sum())
            ctx_key, at = np.unique(hashes(g[:, :-1]), return_inverse=True)
            total = np.bincount(at, c)
            weight = cut * np.bincount(at) / total
            below = np.full(len(g), self.unseen) if k == 1 else lower_p[np.searchsorted(lower_key, hashes(g[:, 1:]))]
            p = (c - cut) / total[at] + weight[at] * below
            key = hashes(g)
            by = np.argsort(key)
            lower_key, lower_p = key[by], p[by]
            self.probs[k] = (lower_key, np.log(lower_p).astype(np.float32))
            self.backs[k] = (ctx_key, np.log(weight).astype(np.float32))

    def over(self, low: Model) -> Model:
        """This model with the orders of `low`."""
        out = object.__new__(Model)
        out.order, out.unseen, out.probs, out.backs = self.order, low.unseen, low.probs | self.probs, low.backs | self.backs
        return out

    def score(self, grams: np.ndarray) -> np.ndarray:
        """Log-probability of the last code point of each row, given those before it."""
        out, todo = np.zeros(len(grams)), np.arange(len(grams))
        for k in sorted(self.probs, reverse=True):
            rest = grams[todo, grams.shape[1] - k :]
            hit, p = _lookup(*self.probs[k], hashes(rest))
            _, back = _lookup(*self.backs[k], hashes(rest[:, :-1]))
            out[todo] += np.where(hit, p, back)
            todo = todo[~hit]
        out[todo] += np.log(self.unseen)
        return out


def discount(once: int, twice: int) -> float:
    return min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, np.where(hit, values[at], 0.0)


def _pair(grams: np.ndarray) -> np.ndarray:
    """What deals n-grams out to shards: the hash of the two code points before the last."""
    return hashes(grams[:, -3:-1]).view(np.int64)


@dataclass(frozen=True)
class Models:
    """Where the shards of all languages' models are: the languages, those with more training rows first, and n-grams by shard."""

    folder: str
    order: int
    names: tuple[str, ...]
    shards: int
    held: dict[int, int]

    def shard(self, at: int) -> dict[str, Model]:
        """The models of one shard by language; a language without n-grams there has its low orders only."""
        low = _load(self.folder, "low", 0)
        own = _load(self.folder, str(at), self.held[at]) if at in self.held else {}
        return {lang: own[lang].over(m) if lang in own else m for lang, m in low.items()}


_loaded: OrderedDict[tuple[str, str], tuple[int, dict]] = OrderedDict()


def _load(folder: str, name: str, size: int) -> dict[str, Model]:
    """A file of models; the worker keeps those last used, of HELD n-grams together."""
    from pyarrow import fs

    key = (folder, name)
    if key not in _loaded:
        for old in [k for k in _loaded if k[0] != folder]:
            del _loaded[old]
        where, at = fs.FileSystem.from_uri(f"{folder}/{name}")
        with where.open_input_stream(at) as f:
            _loaded[key] = (size, pickle.loads(f.read()))
        while sum(n for n, _ in _loaded.values()) > HELD and (old := next((k for k in _loaded if k != key and k[1] != "low"), None)):
            del _loaded[old]
    _loaded.move_to_end(key)
    return _loaded[key][1]


def _save(folder: str, name: str, models: dict[str, Model]) -> None:
    from pyarrow import fs

    where, root = fs.FileSystem.from_uri(folder)
    where.create_dir(root, recursive=True)
    tmp = f"{root}/.{name}-{uuid.uuid4().hex}"
    with where.open_output_stream(tmp) as f:
        f.write(pickle.dumps(models))
    where.move(tmp, f"{root}/{name}")


def _rows(text: pa.ChunkedArray, order: int) -> np.ndarray:
    return np.frombuffer("".join(text.to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, order)


def _plain(docs: DataFrame, *more) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def train(docs: DataFrame, order: int = ORDER, shard: int = SHARD) -> Models | None:
    """A model for each lang of docs (text, lang), of all rows where neither is null, of order 3 at least; None without letters.

    Repeated rows count each; a language without letters in its texts has no model. Empty table: None. Very long texts: whole.
    """
    arrow_rows(docs.sparkSession, size=2 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Grams] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, g in seen.items():
                text = [r.tobytes().decode("utf-32-le", "surrogatepass") for r in g.text.astype("<u4")]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(text), pa.string()), pa.array(text, pa.string()), pa.array(_pair(g.text)), pa.array(g.n)], names=["lang", "gram", "pair", "n"])
            seen.clear()

        for batch in batches:
            texts: dict[str, list] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(clean(text, order))
            for lang, own in texts.items():
                seen.setdefault(lang, Grams(order)).add(own)
            if sum(len(g.key) for g in seen.values()) > COUNTED:
                yield from out()
        yield from out()

    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    own = own.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = own.mapInArrow(run, "lang string, gram string, pair long, n long").groupBy("lang", "gram", "pair").agg(F.sum("n").alias("n"))
    counted = settled(counted, "gram-counts")
    level, cuts = counted, {}
    for k in range(order, 2, -1):  # counts of counts: a row a language
        for r in level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect():
            cuts.setdefault(r.lang, {})[k] = discount(r.once, r.twice)
        level = level.groupBy("lang", F.substring("gram", 2, k - 1).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    pairs = level.toArrow()
    low = {lang: Model(_rows(part["gram"], 2), part["n"].to_numpy()) for lang in cuts for part in [pairs.filter(pa.compute.equal(pairs["lang"], lang))]}
    if not low:
        return None
    folder = new_path(docs.sparkSession, "models")
    _save(folder, "low", low)
    shards = max(SHARDS, -(-counted.count() // shard))

    def build(part: pa.Table) -> pa.Table:
        low, made = _load(folder, "low", 0), {}
        for lang in sorted(set(part["lang"].to_pylist())):
            rows = part.filter(pa.compute.equal(part["lang"], lang))
            made[lang] = Model(_rows(rows["gram"], order), rows["n"].to_numpy(), cuts[lang], low[lang])
        at = part["shard"][0].as_py()
        _save(folder, str(at), made)
        return pa.table({"shard": pa.array([at], pa.int64()), "n": pa.array([part.num_rows], pa.int64())})

    dealt = counted.withColumn("shard", F.pmod("pair", F.lit(shards)).cast("long")).select("shard", "lang", "gram", "n")
    held = {r.shard: r.n for r in dealt.groupBy("shard").applyInArrow(build, "shard long, n long").collect()}
    names = [r.lang for r in own.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect() if r.lang in low]
    return Models(folder, order, tuple(names), shards, held)


def entropies(texts: list, models: Models | None, names: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy a character of each text under each model, in the models' order or that of `names`, and the number of characters."""
    order = models.order if models else ORDER
    names = names or (models.names if models else [])
    cps = [clean(t or "", order) for t in texts]
    sizes = np.array([max(0, len(c) - order + 1) for c in cps], np.int64)
    out = np.zeros((len(texts), len(names)))
    if models and sizes.sum():
        cp = np.concatenate([c for c in cps if len(c)])
        starts = np.cumsum([0, *(len(c) for c in cps if len(c))])[:-1]
        place = np.concatenate([np.arange(s, s + n) for s, n in zip(starts.tolist(), sizes[sizes > 0].tolist(), strict=True)])
        coded = pa.array(_sliding(cp, order)[place]).dictionary_encode()
        codes = coded.indices.to_numpy()
        where = np.empty(len(coded.dictionary), np.int64)
        where[codes] = place
        grams = cp[where[:, None] + np.arange(order)]
        ends = np.cumsum(sizes)
        shard = _pair(grams) % models.shards
        by = np.argsort(shard, kind="stable")
        bounds = np.searchsorted(shard[by], np.arange(models.shards + 1))
        for first in range(0, len(names), SCORED):
            part = names[first : first + SCORED]
            scores = np.zeros((len(part), len(grams)))
            for s in np.flatnonzero(np.diff(bounds)).tolist():
                at, own = by[bounds[s] : bounds[s + 1]], models.shard(s)
                for j, lang in enumerate(part):
                    scores[j, at] = own[lang].score(grams[at])
            for j in range(len(part)):
                total = np.concatenate([[0.0], np.cumsum(scores[j][codes])])
                out[:, first + j] = -(total[ends] - total[ends - sizes]) / np.maximum(sizes, 1)
    return out, sizes


def calibrate(docs: DataFrame, models: Models | None, rejected: float = REJECTED) -> dict[str, float]:
    """Each language's limit: the cross-entropy that all but a share `rejected` of its distinct texts in docs (text, lang) stay under.

    docs should not be among the texts that were counted. Each text is scored under its own language; the share is taken over
    classes of WIDTH, whose upper bound is the limit. Null text or lang, texts without letters and languages that models lack: ignored.
    Repeated texts count once. No model or an empty table: no limits.
    """
    if not models:
        return {}
    arrow_rows(docs.sparkSession, size=2 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            out, known = np.zeros(len(texts)), np.zeros(len(texts), bool)
            for lang in set(langs.tolist()) & set(models.names):
                at = np.flatnonzero(langs == lang)
                ent, n = entropies([texts[i] for i in at], models, [lang])
                out[at], known[at] = ent[:, 0], n > 0
            step = pa.array(np.ceil(out / WIDTH).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), step], names=["lang", "h", "step"]).filter(pa.array(known))

    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    scored = own.withColumn("h", F.xxhash64("text")).mapInArrow(run, "lang string, h long, step long")
    steps: dict[str, list] = {}
    for r in scored.groupBy("lang", "h").agg(F.max("step").alias("step")).groupBy("lang", "step").count().orderBy("lang", "step").collect():
        steps.setdefault(r.lang, []).append((r.step, r["count"]))
    out = {}
    for lang, own in steps.items():
        n = np.cumsum([c for _, c in own])
        out[lang] = WIDTH * own[int(np.searchsorted(n, (1 - rejected) * n[-1]))][0]
    return out


def identify(docs: DataFrame, models: Models | None, limit: dict[str, float] | None = None) -> DataFrame:
    """doc_id, lang_pred, score, entropy, rejected, a row for each row of docs (doc_id, text).

    Null text, text without a letter, or no model: `und`, score 0. Null doc_id: kept. Ties: the language with more training rows.
    Repeated rows: a row each. Empty table: no rows. Very long texts: whole. Other columns are never looked at. score is the
    best language's share of the likelihoods over at most 100 characters; a rejected text keeps its nearest language.
    """
    spark = docs.sparkSession
    arrow_rows(spark, size=2 << 20)
    box = spark.sparkContext.broadcast((models, limit or {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, limit = box.value
        names = [*models.names] if models else []
        for batch in batches:
            ent, n = entropies(batch.column(1).to_pylist(), models)
            if names:
                best = ent.argmin(1)
                low = ent[np.arange(len(best)), best]
                share = 1 / np.exp(-(ent - low[:, None]) * np.minimum(n, 100)[:, None]).sum(1)
            else:
                best, low, share = np.zeros(len(n), np.int64), np.zeros(len(n)), np.zeros(len(n))
            known = (n > 0) & bool(names)
            pred = [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            over = [not k or e > limit.get(p, float("inf")) for p, e, k in zip(pred, low.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(np.where(known, share, 0.0)), pa.array(low), pa.array(over, pa.bool_())], names=["doc_id", "lang_pred", "score", "entropy", "rejected"])

    return _plain(docs).mapInArrow(run, "doc_id long, lang_pred string, score double, entropy double, rejected boolean")


def held_out(doc_id):
    """Whether crc32(doc_id as text) mod 3 is 1; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def limits(docs: DataFrame, rejected: float = REJECTED, aside: int = ASIDE) -> dict[str, float]:
    """Limits of the languages of docs (text, lang): one text in `aside`, by its hash, is scored by models counted without it.

    A language with no text set aside, or with no other, has its counted texts scored, and MARGIN added.
    """
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    apart = F.pmod(F.xxhash64("text"), F.lit(aside)) == 0
    sizes = own.groupBy("lang").agg(F.count_if(apart).alias("apart"), F.count_if(~apart).alias("rest")).collect()  # a row a language
    parted = F.col("lang").isin([r.lang for r in sizes if r.apart and r.rest])
    models = train(own.where(~(apart & parted)))
    found = {lang: (1 + MARGIN) * v for lang, v in calibrate(own.where(~parted), models, rejected).items()}
    return found | calibrate(own.where(apart & parted), models, rejected)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, entropy, rejected: counted over all that isn't held out, predicted for all rows."""
    own = docs.where(~held_out(F.col("doc_id"))).select("text", "lang")
    out = identify(docs.select("doc_id", "text"), train(own), limits(own))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "entropy", "rejected")
