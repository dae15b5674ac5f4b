"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import settled


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of one orderable type -> node, root: each node that has an edge to another, and the least of its component.

    Every round is settled, so lineage stays short. The least neighbour of each node is settled too before the edges are joined
    with it: both sides of that join are then plain exchanges, and a hub's edges can be split among tasks. Loops and repeated
    edges don't matter; edges with a null end are ignored.
    """
    edges = settled(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settled(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m")), "large-least")
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settled(large.where(F.col("a") != F.col("b")).distinct(), "large")
        least = settled(edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")), "small-least")
        small = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
        edges = settled(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "small")
        now = _state(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
