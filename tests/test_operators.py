import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmill.functions import scalars as S
from reelmill.operators import aggregates as A
from reelmill.operators import cluster, content, joins, ordered, sequences, state


def values(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_nearest_rank_matches_its_definition(spark):
    data = [(g, float(v)) for g in range(3) for v in np.random.default_rng(g).integers(0, 40, 57 + g)]
    out = A.nearest_rank(spark.createDataFrame(data, "g int, v double"), ["g"], "v", [0, 50, 95, 99, 100]).collect()
    for r in out:
        own = sorted(v for g, v in data if g == r.g)
        for p in (0, 50, 95, 99, 100):
            assert r[f"p{p}"] == own[max(0, math.ceil(len(own) * p / 100) - 1)]


def test_psnr_conventions(spark):
    df = spark.createDataFrame([(0.0, 10), (650.25, 1)], "sse double, n int")
    assert [r[0] for r in df.select(S.psnr("sse", "n")).collect()] == [math.inf, 20.0]
    assert [r[0] for r in df.select(S.psnr("sse", "n", 99.0)).collect()][0] == 99.0
    assert [r[0] for r in df.select(S.psnr("sse", "n", None)).collect()][0] is None


def test_rounding_rules(spark):
    df = spark.createDataFrame([(2.5,), (3.5,)], "x double")
    assert [r[0] for r in df.select(S.cycles_to_us(F.col("x") * 240)).collect()] == [2, 4]
    assert [r[0] for r in df.select(S.floor_div(-F.col("x"), F.lit(2.0))).collect()] == [-2, -2]
    y, uv = S.quality_steps(F.lit(50.0))
    assert df.select(y, uv).first()[:] == (16, 22)


def test_rational_samples_have_no_drift(spark):
    df = spark.range(1001).select(S.rational_count("id", 16000, 30000, 1001).alias("n"))
    assert df.agg(F.sum("n")).first()[0] == 1001 * 16000 * 1001 // 30000


@pytest.mark.parametrize("width", [1, 7, 1000])
def test_global_order_in_ranges(spark, width):
    keys = [3, 4, 5, 9, 10, 20, 21, 22, 23, 40]
    df = spark.createDataFrame([(k, k * 2) for k in keys], "k long, v long").repartition(3)
    assert values(ordered.indexed(df, "k", "i", width), "k", "i") == [(k, i) for i, k in enumerate(keys)]
    assert values(ordered.prefix_sum(df, "k", "v", "s", width), "k", "s") == [(k, sum(2 * j for j in keys[:i])) for i, k in enumerate(keys)]
    assert values(ordered.gaps(df, "k", width), "previous", "next", "missing") == [(5, 9, 3), (10, 20, 9), (23, 40, 16)]
    assert values(ordered.islands(df, "k", width=width), "first", "last", "n") == [(3, 5, 3), (9, 10, 2), (20, 23, 4), (40, 40, 1)]
    marked = ordered.carried(df, "k", F.when(F.col("k") % 5 == 0, F.col("k")), "m", width)
    assert values(marked.where("k >= 5"), "k", "m") == [(5, 5), (9, 5), (10, 10), (20, 20), (21, 20), (22, 20), (23, 20), (40, 40)]


def test_mismatching_blocks_merge(spark):
    size = 4096
    left = spark.createDataFrame([(i * size, size, c) for i, c in enumerate("abcd")], "offset long, size long, crc string")
    right = spark.createDataFrame([(i * size, size, c) for i, c in enumerate("xycz")], "offset long, size long, crc string")
    bad = joins.positional_diff(left, right, "offset", "crc").select((F.col("offset") / size).cast("long").alias("block"))
    out = ordered.islands(bad, "block")
    assert [(a * size, n * size) for a, n in values(out, "first", "n")] == [(0, 8192), (12288, 4096)]


def test_block_hashes_of_the_vector(spark):
    data = bytes(range(256)) * 40
    out = content.block_hashes(spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray())], "id int, b binary"), "id", "b", 4096)
    import zlib

    assert values(out, "id", "offset", "size", "crc32") == [(1, o, len(data[o : o + 4096]), zlib.crc32(data[o : o + 4096])) for o in (0, 4096, 8192)]
    assert spark.range(1).select(F.crc32(F.lit("123456789").cast("binary"))).first()[0] == 0xCBF43926


def test_fnv1a(spark):
    def fnv(b, h=14695981039346656037):
        for x in b:
            h = (h ^ x) * 1099511628211 % (1 << 64)
        return f"{h:016x}"

    data = [b"", b"a", b"foobar", bytes(range(256))]
    out = content.fnv1a(spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "i int, b binary"), "i", "b")
    assert values(out, "i", "fnv1a") == [(i, fnv(d)) for i, d in enumerate(data)]


def test_acceptable_trial(spark):
    rows = [("a", 1, 39.95, 100), ("a", 2, 40.2, 90), ("a", 3, 41.0, 90), ("b", 1, 30.0, 10), ("b", 2, 35.0, 20)]
    df = spark.createDataFrame(rows, "v string, t int, q double, size int")
    out = sequences.acceptable(df, ["v"], "q", "size", 40.0, 0.1, "t")
    assert values(out, "v", "t", "met") == [("a", 2, True), ("b", 2, False)]


def test_nearest_match_ties_take_the_larger(spark):
    cand = spark.createDataFrame([(1, 90.0), (2, 110.0), (3, 110.0), (4, 300.0)], "i int, k double")
    out = joins.nearest_match(spark.createDataFrame([(100.0,), (1000.0,)], "t double"), "t", cand, "k", "i")
    assert values(out, "t", "k", "i") == [(100.0, 110.0, 2), (1000.0, 300.0, 4)]


def test_run_lengths_are_cut_at_17(spark):
    df = spark.createDataFrame([(r, c, not (r == 1 and c == 3)) for r in range(2) for c in range(40)], "r int, c int, s boolean")
    out = values(sequences.run_lengths(df, ["r"], "c", F.col("s")), "r", "first", "length")
    assert out == [(0, 0, 17), (0, 17, 17), (0, 34, 6), (1, 0, 3), (1, 4, 17), (1, 21, 17), (1, 38, 2)]


def test_seek_clamps_to_the_last_frame(spark):
    index = spark.createDataFrame([(i, i - i % 4) for i in range(10)], "frame long, start long")
    out = sequences.seek(index, spark.createDataFrame([(5,), (99,)], "target long"), "frame", "start")
    assert values(out, "target", "start", "discard") == [(5, 4, 1), (99, 8, 1)]


def test_folds_don_t_depend_on_partitions(spark):
    rng = np.random.default_rng(0)
    data = [(int(k), i, float(rng.integers(0, 120))) for i, k in enumerate(rng.integers(0, 5, 400))]
    df = spark.createDataFrame(data, "k int, i int, value double").withColumn("late", F.col("i") % 7 == 0)
    for make, schema in ((lambda: state.GopPlanner(3, 12, 80.0, "value"), "gop int, reason string"), (lambda: state.LeakyBucket(50.0, size="value", key="late"), "q_used long, buffer double, q_next long")):
        runs = [values(state.fold(df.repartition(n), ["k"], ["i"], ["value", "late"], make, schema).drop("reason"), "k", "i", schema.split(" ")[0]) for n in (1, 4)]
        assert runs[0] == runs[1] and len(runs[0]) == 400


def test_gop_planner():
    p = state.GopPlanner(2, 4, 10)
    out = [p.step({"score": s}) for s in (0, 99, 99, 0, 0, 0, 0, 0)]
    assert [o["gop"] for o in out] == [0, 0, 1, 1, 1, 1, 2, 2]
    assert [o["reason"] for o in out] == ["initial", None, "scene", None, None, None, "maximum", None]
    p = state.GopPlanner(1, 2, 10)
    assert [p.step({"score": v})["reason"] for v in (0, 0, 99, None, None)] == ["initial", None, "scene", None, "maximum"]  # both hold at the third


def test_leaky_bucket_by_hand():
    b = state.LeakyBucket(100.0)
    first = b.step({"size": 200, "key": True})  # 100 * 23 / 24; 32 * exp(0.06 * ln(201 / 101) + 0.22 * 95.833 / 2401) = 33.64
    assert first == {"q_used": 32, "buffer": pytest.approx(95.833333, abs=1e-6), "q_next": 34}
    second = b.step({"size": 0, "key": False})  # exp(0.16 * ln(1 / 101)) is below 0.8; 27.2
    assert second == {"q_used": 34, "buffer": pytest.approx(-3.993056, abs=1e-6), "q_next": 27}
    third = b.step({"size": 109, "key": False})  # 27.38 rounds to 27, but the excess is over 8
    assert third == {"q_used": 27, "buffer": pytest.approx(4.798322, abs=1e-6), "q_next": 28}


def test_catch_up_skips_until_a_keyframe():
    c = state.CatchUp(2)
    rows = [(True, False), (True, False), (False, False), (False, True), (True, False)]
    assert [c.step({"late": late, "key": key, "key_next": False})["action"] for late, key in rows] == ["show", "show", "skip", "show", "show"]


def test_catch_up_before_a_keyframe():
    c = state.CatchUp(3)
    rows = [(True, False, False), (True, False, True), (False, False, False), (True, True, False), (True, True, False), (True, False, False)]
    out = [c.step({"late": late, "key": key, "key_next": nxt}) for late, key, nxt in rows]
    assert [(o["action"], o["late_run"]) for o in out] == [("show", 1), ("skip", 0), ("skip", 0), ("show", 0), ("show", 0), ("show", 1)]


def test_fifo_slots_count_from_the_oldest():
    d = state.FifoDictionary(3)
    assert [d.step({"entry": e})["slot"] for e in "abcacbda"] == [None, None, None, 0, 2, 1, None, None]
    assert d.held == ["c", "d", "a"]


def test_fifo_dictionary_evicts_the_oldest():
    d = state.FifoDictionary(2)
    assert [d.step({"entry": e})["hit"] for e in "abcabcc"] == [False, False, False, False, False, False, True]


def test_slew_and_debt_bounds():
    s = state.SlewLimit()
    levels = [s.step({"value": v})["smoothed"] for v in (40, 30, None, 50)]
    assert levels == pytest.approx([40, 39.1, 39.1, 39.35])
    w = state.WindowDebt(100)
    out = [w.step({"size": 500}) for _ in range(3)]
    assert [o["target"] for o in out] == [100, 75, 75] and w.debt == 200
    assert out[1]["error"] == pytest.approx(400 / 101)  # against the nominal size


def test_reservoir_is_uniform_enough(spark):
    df = spark.range(2000).select((F.col("id") % 200).alias("k"), "id")
    out = state.fold(df, ["k"], ["id"], [], lambda: state.Reservoir(2), "place int, nth long").where("place IS NOT NULL")
    assert out.select("k", "place").distinct().count() == 400


def test_kmeans_is_deterministic(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.1, (40, 3)) for c in (0, 5, 9)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    runs = [cluster.kmeans(df.repartition(n), "id", "v", 3) for n in (1, 5)]
    assert np.array_equal(runs[0][0], runs[1][0]) and values(runs[0][1], "id", "label") == values(runs[1][1], "id", "label")
    assert sorted(r["count"] for r in runs[0][1].groupBy("label").count().collect()) == [40, 40, 40]


def test_kcenter_takes_the_worst_served(spark):
    df = spark.createDataFrame([(i, [float(v)], u) for i, (v, u) in enumerate([(0, 9), (1, 1), (10, 1), (4, 1)])], "id long, v array<double>, u long")
    assert cluster.kcenter(df, "id", "v", "u", 3) == [0, 2, 3]


def test_kcenter_weighs_and_combines(spark):
    data = [(7, [0.0, 0.0], 3), (5, [0.0, 0.0], 3), (1, [4.0, 0.0], 5), (2, [9.0, 0.0], 1), (3, [0.0, 5.0], None), (4, None, 99), (6, [2.0, 1.0], 4)]
    df = spark.createDataFrame(data, "id long, v array<double>, u long")
    # (0, 0) is used 6 times; errors then are 5 * 16, 81, 0 and 4 * 5; with (9, 0) chosen 80 and 20; then min(16, 5 * ...) for (2, 1)
    assert cluster.kcenter(df.repartition(3), "id", "v", "u", 4) == [5, 2, 1, 6]
    assert cluster.kcenter(df.where("id = 4"), "id", "v", "u", 4) == []


def test_adaptive_target_keeps_a_floor_on_cuts(spark):
    df = spark.createDataFrame([(0.0, 0.0, True), (12.0, 28.0, True), (12.0, 28.0, False), (0.0, 99.0, None)], "m double, d double, cut boolean")
    got = [r[0] for r in df.select(S.adaptive_target(40.0, 6.0, "m", "d", "cut")).collect()]
    assert got == pytest.approx([40.0, 37.6, 34.0, 40.0])  # 34 + 0.6 * 6 at least on a cut


def test_quality_is_clamped(spark):
    df = spark.createDataFrame([(-5.0,), (1.0,), (100.0,), (150.0,)], "q double")
    y, uv = S.quality_steps("q")
    assert [tuple(r) for r in df.select(y, uv).collect()] == [(242, 255), (242, 255), (1, 1), (1, 1)]


def test_signed_division_and_gcd(spark):
    df = spark.createDataFrame([(5, 2), (-5, 2), (7, 3), (-8, 3), (0, 9), (-12, 18)], "a long, b long")
    assert [tuple(r) for r in df.select(S.round_div("a", "b"), S.gcd("a", "b")).collect()] == [(3, 1), (-3, 1), (2, 1), (-3, 1), (0, 9), (-1, 6)]


@pytest.mark.parametrize("width", [3, 1000])
def test_null_keys_come_first(spark, width):
    df = spark.createDataFrame([(None, 5), (2, 1), (9, 2), (4, 3)], "k long, v long").repartition(3)
    assert sorted((r.i, r.k) for r in ordered.indexed(df, "k", "i", width).collect()) == [(0, None), (1, 2), (2, 4), (3, 9)]
    assert sorted(((r.s, r.k) for r in ordered.prefix_sum(df, "k", "v", "s", width).collect()), key=repr) == [(0, None), (5, 2), (6, 4), (9, 9)]
    assert {r.k: r.p for r in ordered.previous(df, "k", "p", width).collect()} == {None: None, 2: None, 4: 2, 9: 4}
    assert values(ordered.islands(df, "k", width=width), "first", "n") == [(2, 1), (4, 1), (9, 1)]
    empty = df.where("v > 9")
    assert ordered.indexed(empty, "k").count() == ordered.gaps(empty, "k").count() == ordered.cuts(empty, "k", "v", 4, 1.0).count() == 0


@pytest.mark.parametrize("width", [2, 1000])
def test_cuts_across_gaps(spark, width):
    df = spark.createDataFrame([(1, 0.0), (5, 500.0), (8, 499.0), (9, None), (11, 10.0), (16, 10.0)], "k long, v double").repartition(2)
    got = values(ordered.cuts(df, "k", "v", 8, 100.0, width), "k", "cut")
    assert got == [(1, True), (5, True), (8, True), (9, False), (11, False), (16, True)]


def test_budget_with_ties_and_skew(spark):
    rng = np.random.default_rng(6)
    cost = [7] * 900 + rng.integers(0, 30, 600).tolist()
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cost)] + [(5000, None)], "i long, c long").repartition(4)
    for budget in (0, 50, 4000, 10**6):
        want, total = [], 0
        for c, i in sorted((c, i) for i, c in enumerate(cost)):
            total += c
            if total > budget:
                break
            want.append((i, total))
        assert values(ordered.within_budget(df, "c", "i", budget), "i", "running") == sorted(want)
    assert ordered.within_budget(df.where("i < 0"), "c", "i", 5).count() == 0


def test_ranks_of_skewed_and_null_keys(spark):
    rng = np.random.default_rng(3)
    data = [("a", float(v)) for v in rng.normal(size=4000)] + [(None, 1.0), (None, 2.0), (None, 9.0), ("b", 5.0), ("c", None)]
    df = spark.createDataFrame(data, "k string, v double").repartition(5)
    own = {k: sorted(v for j, v in data if j == k and v is not None) for k in ("a", None, "b")}
    got = {r.k: (r.n, r.p50, r.p99) for r in A.nearest_rank(df, ["k"], "v", [50, 99]).collect()}
    assert got == {k: (len(v), v[max(0, math.ceil(len(v) * 0.5) - 1)], v[max(0, math.ceil(len(v) * 0.99) - 1)]) for k, v in own.items()}
    assert {r.k: (r.runs, r.median) for r in A.median_of_runs(df, ["k"], "v").collect()} == {k: (len(v), statistics.median(v)) for k, v in own.items()}


def test_a_bank_is_counted_first(spark, monkeypatch):
    bank = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "slot int, vec array<double>")
    df = spark.createDataFrame([(1, [2.2])], "id long, v array<double>")
    assert joins.bank_neighbours(df, "v", "id", bank).first().slot == 2
    monkeypatch.setattr(joins, "BANK_ROWS", 4)
    with pytest.raises(ValueError):
        joins.bank_neighbours(df, "v", "id", bank)


def test_a_cluster_must_name_a_shared_folder():
    from types import SimpleNamespace

    from reelmill import session

    conf = SimpleNamespace(get=lambda *_: None, set=lambda *_: None)
    with pytest.raises(ValueError):
        session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    assert session.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="local[2]"))).startswith("file://")


def test_override_needs_all_bounds(spark):
    rows = [(1, True, 10.0, "b", 5, 5), (1, False, 1.0, "x", 6, 1), (1, False, 9.0, "y", 5, 5), (2, True, 3.0, "b", 1, 1), (2, False, 4.0, "z", 0, 0)]
    df = spark.createDataFrame(rows, "k int, base boolean, score double, m string, bits int, err int")
    out = joins.override(df, "k", F.col("base"), "score", ["bits", "err"], "m")
    assert values(out, "k", "m", "overridden") == [(1, "y", True), (2, "b", False)]


def test_broadcast_side_is_checked(spark):
    with pytest.raises(ValueError):
        joins.small(spark.range(joins.BROADCAST_ROWS + 1))


def test_medians(spark):
    df = spark.createDataFrame([(1, float(v)) for v in (3, 1, 2, 10)], "k int, v double")
    assert A.median_of_runs(df, ["k"], "v").first()["median"] == statistics.median([3, 1, 2, 10])


@pytest.mark.parametrize("build", [lambda d: A.metric_bundle(d, ["k"], "v"), lambda d: A.nearest_rank(d, ["k"], "v", [50]), lambda d: ordered.gaps(d.select(F.col("k").cast("long").alias("k")), "k"), lambda d: A.codec_summary(d, ["k"], {"v": "m"}, {"v": "h"})])
def test_empty_tables(spark, build):
    assert build(spark.createDataFrame([], "k int, v double")).count() == 0


@pytest.mark.parametrize("parts", [1, 3, 100])
def test_budget_prefix_stops_at_the_first_overflow(spark, parts):
    rows = [(i, c) for i, c in enumerate([5, 0, 3, 3, 9, 1, 40, 0, 7])]
    out = ordered.within_budget(spark.createDataFrame(rows, "i long, c long").repartition(3), "c", "i", 13, parts)
    assert values(out, "i", "c", "running") == [(0, 5, 12), (1, 0, 0), (2, 3, 4), (3, 3, 7), (5, 1, 1), (7, 0, 0)]
