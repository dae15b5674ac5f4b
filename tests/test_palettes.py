import numpy as np
from pyspark.sql import functions as F

from reelmill.operators import palettes as P


def test_usage_and_duplicates(spark):
    df = spark.createDataFrame([(0, [1, 1, 2]), (0, [2]), (1, [])], "gop int, c array<int>")
    assert sorted(map(tuple, P.usage(df, ["gop"], "c").collect())) == [(0, 1, 2), (0, 2, 2)]
    bank = spark.createDataFrame([("ab", 1), ("ab", 4), ("cd", 2)], "p string, n long")
    assert sorted((r.sources, r.n) for r in P.combined(bank, "p", ["n"]).collect()) == [(1, 2), (2, 5)]


def test_training_separates_blocks_and_ignores_partitions(spark):
    rng = np.random.default_rng(0)
    base = [0xFF0000, 0x00FF00, 0x0000FF]
    data = [(0, i, [int(base[i % 3] ^ rng.integers(0, 4)) for _ in range(16)]) for i in range(30)]
    df = spark.createDataFrame(data, "gop int, i int, px array<int>")
    runs = [sorted(map(tuple, P.trained(df.repartition(n), "gop", "i", "px", 4, 4).collect())) for n in (1, 3)]
    assert runs[0] == runs[1] and len(runs[0]) == 16
    first = {r[3:] for r in runs[0] if r[1] < 3}
    assert all(any(np.abs(np.subtract(c, t)).max() <= 4 for c in first) for t in ((255, 0, 0), (0, 255, 0), (0, 0, 255)))


def test_subset_is_greedy_and_stops():
    bank = np.array([[0, 0, 0], [255, 255, 255], [255, 0, 0]], float)
    assert P.subset([0] * 8 + [0xFFFFFF] * 8, bank, 3) == ([0, 1], 0.0)
    assert P.subset([0xFF0000] * 16, bank, 1) == ([2], 0.0)


def test_coded(spark):
    df = spark.createDataFrame([(1, [0] * 15 + [0xFF0000])], "i int, px array<int>")
    assert P.coded(df, "i", "px", [(0, 0, 0), (255, 0, 0)]).first()[:] == (1, [0, 1], 0.0)


def test_motion_takes_the_nearest_ring(spark):
    assert P.motion_rings(1) == [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)] and len(P.motion_rings(2)) == 24
    rows = [(0, x, y, "q" if (x, y) in ((3, 1), (0, 1)) else f"{x}{y}") for x in range(4) for y in range(3)] + [(1, 2, 1, "q")]
    out = P.exact_motion(spark.createDataFrame(rows, "f int, x int, y int, c string"), "f", "x", "y", "c", 2)
    assert [tuple(r) for r in out.collect()] == [(1, 2, 1, 0, 1)]
    assert out.where(F.col("dx") == 1).count() == 1
