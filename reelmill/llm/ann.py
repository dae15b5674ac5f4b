"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree grows level by level: each leaf that holds too many rows gets a k-means tree of its own, fitted on executors to a bounded
sample of its rows, until leaves hold about LEAF rows whatever the size of the table. A query walks best bin first: in each tree
that it meets a priority queue holds the branches not yet taken by distance to their centres, and each pop descends to the nearest
leaf below; of the leaves met in all trees of a level the nearest go on. How many is calibrated, level by level, against exact
neighbours of some queries, widening until the wanted recall is reached. A hot leaf is dealt out to several tasks by blocks of rows
and of queries. A task merges what it finds and sends on ten rows a query, however many leaves of it the query visits.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._store import arrow_rows, settled, spread

#: Rows that a tree is fitted to at most, about; rows that a leaf should hold, and beyond which it is split; children of a node, rounds.
SAMPLE, LEAF, SPLIT, BRANCH, ROUNDS = 20_000, 512, 2048, 16, 12
#: Leaves of one tree at most: rows of the sample that each stands for.
LEAST = 40
#: Calibration queries, neighbours sought, recall wanted of the calibration queries, levels at most.
CALIBRATED, K, RECALL, LEVELS = 200, 10, 0.97, 8
#: Rows, and queries, of a leaf that meet in one task at once; rows found that a task gathers before it merges them.
BLOCK, ASKED, GATHERED = 4096, 1024, 500_000


@dataclass
class Tree:
    """Nodes: the centres of a node's children, their numbers, and of a leaf its number (-1 inside)."""

    centres: list[np.ndarray]
    children: list[list[int]]
    leaf: list[int]

    def leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf that greedy descent leads each row to."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            if self.leaf[node] >= 0:
                out[rows] = self.leaf[node]
            elif len(rows):
                best = distances(x[rows], self.centres[node]).argmin(1)
                todo += [(c, rows[best == i]) for i, c in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray) -> Iterator[tuple[int, float]]:
        """Leaves in best-bin-first order, all of them in the end, with the largest squared distance that was taken up to each: it rises
        along the order, so leaves of several trees can be put in one."""
        heap, most = [(0.0, 0)], 0.0
        while heap:
            near, node = heapq.heappop(heap)
            while self.leaf[node] < 0:
                d = distances(q[None], self.centres[node])[0]
                order = d.argsort(kind="stable").tolist()
                for i in order[1:]:
                    heapq.heappush(heap, (float(d[i]), self.children[node][i]))
                near, node = float(d[order[0]]), self.children[node][order[0]]
            most = max(most, near)
            yield self.leaf[node], most


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances for choosing branches."""
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1), 0)


def fit(x: np.ndarray, leaf: int, branch: int = BRANCH, rounds: int = ROUNDS, seed: int = 0) -> Tree:
    """A tree whose leaves hold about `leaf` rows of x, one leaf if x can't be parted."""
    rng = np.random.default_rng(seed)
    tree = Tree([np.zeros((0, x.shape[1]))], [[]], [-1])
    todo, n = [(0, np.arange(len(x)))], 0
    while todo:
        node, rows = todo.pop(0)
        own = x[rows]
        distinct = np.unique(own, axis=0) if len(rows) > leaf else own[:1]
        used = np.zeros(0, np.int64)
        if len(distinct) > 1:
            centres = distinct[rng.choice(len(distinct), min(branch, len(distinct), max(2, len(rows) // leaf)), replace=False)]
            for _ in range(rounds):
                label = distances(own, centres).argmin(1)
                centres = np.array([own[label == i].mean(0) for i in range(len(centres)) if (label == i).any()])
            label = distances(own, centres).argmin(1)
            used = np.unique(label)
        if len(used) < 2:
            tree.leaf[node], n = n, n + 1
            continue
        tree.centres[node] = centres[used]
        for i in used:
            tree.children[node].append(len(tree.leaf))
            todo.append((len(tree.leaf), rows[label == i]))
            tree.centres.append(np.zeros((0, x.shape[1])))
            tree.children.append([])
            tree.leaf.append(-1)
    return tree


def _exact(q: np.ndarray, own: int, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distances of the k rows nearest to q, ties to the smaller id; a row with the query's own id is no candidate."""
    d = np.sqrt(((x - q) ** 2).sum(1))
    d[ids == own] = np.inf
    if len(d) > k:
        reach = np.partition(d, k - 1)[k - 1]
        near = np.flatnonzero(d <= reach)
    else:
        near = np.arange(len(d))
    near = near[np.isfinite(d[near])]
    near = near[np.lexsort((ids[near], d[near]))][:k]
    return ids[near], d[near]


def usable(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id long, v array<double>: rows with an id and a finite, non-zero vector without nulls."""
    v = F.col(vector).cast("array<double>")
    out = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    bad = F.exists("v", lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return out.where(~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda e: e != 0))


def _few(rows: DataFrame, k: int) -> DataFrame:
    """Of equal vectors the first 2k rows by id, k of one id at most: all that any query can find among them, since the rest are as far
    and have larger ids. Repeats are counted, and the order is cut, before anything is shuffled in full."""
    counted = rows.groupBy("v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    first = counted.withColumn("place", place).where(F.col("place") <= 2 * k)
    upto = F.coalesce(F.sum("n").over(Window.partitionBy("v").orderBy("vec_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("n", F.least(F.col("n"), F.lit(2 * k) - upto)).where("n > 0")
    return first.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("nth"))


_SIDE = ("leaf string", "row int", "ask int", "kind int", "vec_id long", "v array<double>", "nth int", "model binary")


def _side(df: DataFrame, kind: int, row=None, ask=None) -> DataFrame:
    """One side of a meeting: rows or a tree are kind 0 and come first, what meets them kind 1. row, ask: blocks, 0 if not given."""
    own = {"row": F.lit(0) if row is None else row, "ask": F.lit(0) if ask is None else ask, "kind": F.lit(kind)}
    names = [c.split(" ") for c in _SIDE]
    return df.select(*[own.get(n, F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in names])


def _blocks(n, size: int):
    return F.greatest(F.lit(1), F.ceil(F.col(n) / F.lit(size))).cast("int")


def _all(n):
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _meeting(first: DataFrame, second: DataFrame, parts: int, meet: Callable, schema: str, merge: Callable | None = None) -> DataFrame:
    """meet(leaf, rows of kind 0, batch of rows of kind 1) for each (leaf, row block, query block): a task holds one block's rows, and
    at most about GATHERED rows of what meet gives, if merge(batches) reduces them before they leave the task."""
    both = first.unionByName(second).repartition(parts, "leaf", "row", "ask").sortWithinPartitions("leaf", "row", "ask", "kind", "vec_id")

    def reduced(made: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in made:
            held.append(batch)
            n += batch.num_rows
            if n > GATHERED:
                held = [merge(held)]
                n = held[0].num_rows
                if n > GATHERED // 2:
                    yield held[0]
                    held, n = [], 0
        if held:
            yield merge(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return reduced(met(batches)) if merge else met(batches)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            leaf, row, ask, kind = (batch.column(i) for i in range(4))
            key = list(zip(leaf.to_pylist(), row.to_pylist(), ask.to_pylist(), strict=True))
            kinds = kind.to_numpy()
            at = 0
            while at < batch.num_rows:
                to = at + 1
                while to < batch.num_rows and key[to] == key[at] and kinds[to] == kinds[at]:
                    to += 1
                if key[at] != now:
                    now, held = key[at], []
                part = batch.slice(at, to - at)
                if kinds[at] == 0:
                    held.append(part)
                elif held:
                    if isinstance(held[0], pa.RecordBatch):
                        held = [_Held(held)]
                    yield from meet(now[0], held[0], part)
                at = to

    return both.mapInArrow(run, schema)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


class _Held:
    """The rows of kind 0 of one block, or its tree."""

    def __init__(self, parts: list[pa.RecordBatch]):
        table = pa.Table.from_batches(parts)
        self.ids = table["vec_id"].to_numpy()
        model = table["model"][0].as_py()
        self.tree = pickle.loads(model) if model else None
        self.x = None if model else _matrix(table["v"].combine_chunks(), table.num_rows)


def _share(wanted: int, of):
    """Whether a row's hash is among about `wanted` of `of` rows."""
    return F.pmod(F.xxhash64("v", "vec_id"), F.lit(1 << 30)) < F.ceil(F.lit(float(wanted << 30)) / of)


def _trees(big: DataFrame, rows: DataFrame, sample: int) -> DataFrame:
    """leaf, model: a tree for each leaf of big (leaf, n) that can be parted, fitted to about `sample` of its rows."""
    taken = rows.join(big, "leaf").where(_share(sample, F.col("n"))).select("leaf", "n", "v")

    def grow(part: pa.Table) -> pa.Table:
        x = _matrix(part["v"].combine_chunks(), part.num_rows)
        x = x[np.lexsort(x.T[::-1])]  # whatever the order of rows
        tree = fit(x, max(LEAST, LEAF * part.num_rows // part["n"][0].as_py()))
        return pa.table({"leaf": part["leaf"][:1], "model": pa.array([pickle.dumps(tree) if tree.leaves() > 1 else None], pa.binary())})

    return settled(taken.groupBy("leaf").applyInArrow(grow, "leaf string, model binary").where("model IS NOT NULL"), "trees")


def _placed(rows: DataFrame, trees: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows of the leaves that trees has, each in its leaf of the next level; a hot leaf's tree goes to several tasks."""
    many = trees.select("leaf").join(sizes, "leaf").select("leaf", _blocks("n", 16 * BLOCK).alias("blocks"))
    own = rows.join(many, "leaf")
    row = F.pmod(F.xxhash64("v", "vec_id"), F.col("blocks"))

    def assign(leaf: str, held: _Held, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        to = held.tree.assign(_matrix(part["v"], part.num_rows))
        yield pa.RecordBatch.from_arrays([pa.array([f"{leaf}/{t}" for t in to.tolist()], pa.string()), part["vec_id"], part["v"], part["nth"]], names=["leaf", "vec_id", "v", "nth"])

    return _meeting(_side(trees.join(many, "leaf").select("*", _all("blocks").alias("at")), 0, F.col("at")), _side(own, 1, row), spread(rows), assign, "leaf string, vec_id long, v array<double>, nth int")


def _walked(pool: DataFrame, trees: DataFrame, limit: int | None) -> DataFrame:
    """vec_id, v, leaf, near, step: of each tree that a query meets its leaves in best-bin-first order, `limit` at most."""
    asks = pool.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).select("leaf", _blocks("n", 16 * ASKED).alias("blocks"))
    own = pool.join(asks, "leaf").join(trees.select("leaf"), "leaf", "left_semi")
    models = trees.join(asks, "leaf").select("*", _all("blocks").alias("at"))

    def walk(leaf: str, held: _Held, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x, who, to, near, step = _matrix(part["v"], part.num_rows), [], [], [], []
        for i in range(part.num_rows):
            for n, (l, d) in enumerate(held.tree.visits(x[i])):
                if n == limit:
                    break
                who.append(i)
                to.append(f"{leaf}/{l}")
                near.append(d)
                step.append(n)
        own = part.take(pa.array(who, pa.int64()))
        yield pa.RecordBatch.from_arrays([own["vec_id"], own["v"], pa.array(to, pa.string()), pa.array(near, pa.float64()), pa.array(step, pa.int32())], names=["vec_id", "v", "leaf", "near", "step"])

    return _meeting(_side(models, 0, ask=F.col("at")), _side(own, 1, ask=F.pmod(F.xxhash64("vec_id"), F.col("blocks"))), spread(pool), walk, "vec_id long, v array<double>, leaf string, near double, step int")


def _ranked(pool: DataFrame) -> DataFrame:
    return pool.withColumn("rank", F.row_number().over(Window.partitionBy("vec_id").orderBy("near", "step", "leaf")))


def _next(pool: DataFrame, trees: DataFrame, limit: int | None) -> DataFrame:
    """The pool of the next level: leaves that were not split stay in it, the others give way to those of their trees."""
    stay = pool.join(trees.select("leaf"), "leaf", "left_anti").select("vec_id", "v", "leaf", "near", F.lit(0).alias("step"))
    return _ranked(stay.unionByName(_walked(pool, trees, limit)))


def _nearest(rows: DataFrame, asked: list, k: int) -> DataFrame:
    """leaf (the root), vec_id (the query's), v, nth of the exact k nearest rows of a few queries, in one pass over all rows."""
    box = rows.sparkSession.sparkContext.broadcast([(r.vec_id, np.array(r.v)) for r in asked])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple]] = [[] for _ in box.value]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), batch.num_rows)
            for n, (own, q) in enumerate(box.value):
                d = ((x - q) ** 2).sum(1)
                d[ids == own] = np.inf
                near = np.argpartition(d, min(k, len(d)) - 1)[:k]
                best[n] = sorted([*best[n], *((float(d[i]), int(ids[i]), x[i].tolist()) for i in near if np.isfinite(d[i]))])[:k]
        flat = [(box.value[n][0], *b) for n, own in enumerate(best) for b in own]
        yield pa.RecordBatch.from_arrays([pa.array([f[j] for f in flat], t) for j, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.float64())))], names=["vec_id", "d", "other", "v"])

    found = rows.select("vec_id", "v").mapInArrow(nearest, "vec_id long, d double, other long, v array<double>")
    place = F.row_number().over(Window.partitionBy("vec_id").orderBy("d", "other"))
    return found.withColumn("nth", place.cast("int")).where(F.col("nth") <= k).select(F.lit("").alias("leaf"), "vec_id", "v", "nth")


def _wanted(truth: DataFrame, pool: DataFrame, recall: float) -> int:
    """Leaves that a query must visit so that `recall` of the true neighbours lie in them."""
    met = truth.join(pool.select("vec_id", "leaf", F.col("rank").alias("at")), ["vec_id", "leaf"]).select("at")
    ranks = sorted(r["at"] for r in met.collect())  # k for each calibration query
    return ranks[min(len(ranks), int(np.ceil(recall * len(ranks)))) - 1] if ranks else 1


def _met(rows: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query (vec_id, v, leaf) in its leaves."""
    sizes = rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).join(pool.groupBy("leaf").agg(F.count(F.lit(1)).alias("q")), "leaf")
    shape = settled(sizes.select("leaf", _blocks("n", BLOCK).alias("blocks"), _blocks("q", ASKED).alias("groups")), "meetings")
    stored = rows.join(shape, "leaf").select("*", _all("groups").alias("at"))
    asked = pool.join(shape, "leaf").select("*", _all("blocks").alias("at"))
    stored = _side(stored, 0, F.pmod(F.xxhash64("v", "vec_id", "nth"), F.col("blocks")), F.col("at"))
    asked = _side(asked, 1, F.col("at"), F.pmod(F.xxhash64("vec_id"), F.col("groups")))

    def meet(leaf: str, held: _Held, part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        q, out = _matrix(part["v"], part.num_rows), []
        for i, own in enumerate(part["vec_id"].to_pylist()):
            out += [(own, int(a), float(b)) for a, b in zip(*_exact(q[i], own, held.ids, held.x, k), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    def merge(found: list[pa.RecordBatch]) -> pa.RecordBatch:
        q, ids, score = (np.concatenate([b.column(i).to_numpy() for b in found]) for i in range(3))
        by = np.lexsort((ids, score, q))
        begins = np.flatnonzero(np.append(True, q[by][1:] != q[by][:-1])) if len(by) else np.zeros(0, np.int64)
        place = np.arange(len(by)) - np.repeat(begins, np.diff(np.append(begins, len(by))))
        by = by[place < k]
        return pa.RecordBatch.from_arrays([pa.array(c[by]) for c in (q, ids, score)], names=["query_id", "vec_id", "score"])

    found = _meeting(stored, asked, spread(rows), meet, "query_id long, vec_id long, score double", merge)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _space(rows: DataFrame, queries: DataFrame, k: int, recall: float, sample: int) -> DataFrame:
    """search() among vectors of one length."""
    now = settled(_few(rows, k).withColumn("leaf", F.lit("")), "vectors")
    queries = settled(queries, "queries")
    of = queries.count()
    asked = queries.where(_share(CALIBRATED, F.lit(max(of, 1)))).collect()
    pool = queries.select("vec_id", "v", F.lit("").alias("leaf"), F.lit(0.0).alias("near"))
    tried = queries.where(_share(CALIBRATED, F.lit(max(of, 1)))).select(*pool.columns[:2], F.lit("").alias("leaf"), F.lit(0.0).alias("near"))
    truth, ready = None, []
    for level in range(LEVELS):
        sizes = settled(now.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "leaf-sizes")
        big = sizes.where(F.col("n") > SPLIT)
        if not big.limit(1).count():
            break
        trees = _trees(big, now, sample)
        truth = settled(_nearest(now, asked, k), "neighbours") if truth is None else truth
        ready.append(now.join(trees.select("leaf"), "leaf", "left_anti"))
        inside = truth.join(trees.select("leaf"), "leaf", "left_semi")
        truth = settled(truth.join(trees.select("leaf"), "leaf", "left_anti").unionByName(_placed(inside, trees, sizes)), "neighbours")
        now = settled(_placed(now, trees, sizes), "placed")
        whole = settled(_next(tried, trees, None), "tried")
        limit = _wanted(truth, whole, 1 - (1 - recall) / 2 ** (level + 1))
        tried = whole.where(F.col("rank") <= limit).select(*pool.columns)
        pool = settled(_next(pool, trees, limit).where(F.col("rank") <= limit).select(*pool.columns), "visits")
    for r in ready:
        now = now.unionByName(r.select(*now.columns))
    found = _met(now, pool, k)
    if not ready:
        return found  # each query met all rows
    found = settled(found, "found")
    short = settled(queries.join(found.groupBy("query_id").count().where(F.col("count") == k), F.col("vec_id") == F.col("query_id"), "left_anti"), "short")
    if not short.limit(1).count():
        return found
    # fewer than k rows of other ids in the leaves visited: these queries meet all rows, in blocks
    rest = _met(now.withColumn("leaf", F.lit("")), short.select("vec_id", "v", F.lit("").alias("leaf")), k)
    return found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti").unionByName(rest)


def search(df: DataFrame, every: int = 100, k: int = K, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose vec_id is divisible by `every`, among all other rows.

    df: vec_id, embedding; other columns are ignored. Rows without an id, and vectors null, zero, or holding null or non-finite
    components, take no part. Vectors of different lengths have no distance: each length is searched by itself, one after the
    other. Fewer than k candidates: all of them. Ties: the smaller vec_id. Repeated rows are candidates each, but never of a query
    with their id. A query id has one query, the least of its vectors in array order. Empty table: no rows. A tree is fitted to
    about `sample` rows; every row is indexed, and no leaf visited is cut short.
    """
    spark = df.sparkSession
    arrow_rows(spark)
    rows = usable(df)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for r in queries.select(F.size("v").alias("d")).distinct().orderBy("d").collect():  # lengths are few
        out = out.unionByName(_space(rows.where(F.size("v") == r.d), queries.where(F.size("v") == r.d), k, recall, sample))
    return out
