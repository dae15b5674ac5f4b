import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmill.functions import checks as K
from reelmill.functions import colour as C
from reelmill.functions import scalars as S
from reelmill.kernels import motion, samples
from reelmill.operators import palettes as P
from reelmill.operators import search
from reelmill.operators import sequences as Q
from reelmill.sources import containers, sinks
from reelmill.sources.binary import FormatError


def first(df, *cols):
    return df.select(*cols).first()[:]


def test_names_and_labels(spark):
    names = ["a.hlv", "A-1_b.c.MPEG", ".hlv", "-a.hlv", "a b.hlv", "a.mov", "é.hlv", "a.hlv\n", "x" * 44 + ".hlv", "x" * 45 + ".hlv", None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    good = {r.i: r.g for r in df.select("i", K.valid_name("n").alias("g")).collect()}
    assert [good[i] for i in range(len(names))] == [True, True, False, False, False, False, False, False, True, False, None]
    assert first(spark.range(1), K.short(F.lit(0.25)), K.short(F.lit(2.0)), K.short(F.lit(0.0)), K.short(F.lit(1234.5678))) == ("0.25", "2", "0", "1234.57")
    assert first(spark.range(1), K.clamped_duration(F.lit(9.0), F.lit(4.0)), K.clamped_duration(F.lit(9.0), F.lit(0.0))) == (4.0, 9.0)


def test_fixed_digits_round_ties_to_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.25,), (-2.75,), (1e30,), (float("inf"),), (None,)], "v double")
    assert [r[0] for r in df.select(S.fixed("v", 0)).collect()] == ["0", "2", "2", "-3", "1" + "0" * 30, "inf", None]
    assert [r[0] for r in df.select(S.fixed("v", 1)).collect()][:4] == ["0.5", "1.5", "2.2", "-2.8"]


def test_colour_round_trips(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([tuple(map(int, v)) for v in rng.integers(0, 256, (200, 3))], "r int, g int, b int")
    lab = df.withColumns(dict(zip(("l", "a", "bb"), C.srgb_to_oklab("r", "g", "b"), strict=True)))
    for r in lab.select("r", "g", "b", *[c.alias(n) for c, n in zip(C.oklab_to_srgb("l", "a", "bb"), "xyz", strict=True)]).collect():
        assert (r.r, r.g, r.b) == (r.x, r.y, r.z)
    white = spark.createDataFrame([(255, 255, 255)], "r int, g int, b int")
    assert first(white, *C.rgb_to_yuv("r", "g", "b")) == (235, 128, 128)
    assert first(spark.range(1), *C.yuv_to_rgb(F.lit(235), F.lit(128), F.lit(128)), *C.yuv_to_rgb_256(F.lit(0), F.lit(128), F.lit(128))) == (255, 255, 255, 0, 0, 0)


def test_dither_adds_up(spark):
    df = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"))
    for q4 in (-128, -17, -1, 0, 5, 16, 127):
        assert df.agg(F.sum(C.dithered(F.lit(q4), "x", "y"))).first()[0] == q4 * 4  # 64 samples of q4 sixteenths
    assert first(spark.range(1), C.sample_code(F.lit(255), 6), C.sample_code(F.lit(2), 6), C.correction_q4(F.lit(-6)), C.correction_q4(F.lit(9999))) == (63, 1, -2, 127)


def test_packed_rows():
    rng = np.random.default_rng(2)
    y, u = rng.integers(0, 256, 33).astype("u1"), rng.integers(0, 256, 17).astype("u1")
    assert len(samples.pack(y, 6)) == 25 and samples.pack(np.array([4, 0], "u1"), 6) == b"\x01\x00"
    row = samples.packed_rgb565_row(samples.pack(y, 6), samples.pack(u, 5), samples.pack(u, 5), 33)
    assert np.array_equal(row, samples.rgb565_row(samples.unpack(samples.pack(y, 6), 6, 33), *[samples.unpack(samples.pack(u, 5), 5, 17)] * 2))
    assert samples.rgb565_row(np.array([235], "u1"), np.array([128], "u1"), np.array([128], "u1"))[0] == 0xFFFF


def test_block_motion(spark):
    rng = np.random.default_rng(3)
    before = rng.integers(0, 256, (24, 32)).astype("u1")
    now = np.roll(before, (2, -1), (0, 1))
    assert motion.full_search(before, now, 8, 8, 8, 3) == (1, -2, 0)
    half = ((before[:, :-1].astype(int) + before[:, 1:] + 1) // 2).astype("u1")
    half = np.pad(half, ((0, 0), (0, 1)))
    assert motion.full_search(before, half, 8, 8, 8, 2, 2) == (1, 0, 0)
    assert motion.predicted(before, 24, 0, 8, 1, 0, 2) is None and motion.predicted(before, 24, 0, 8, 0, 0, 2) is not None
    flat = np.zeros((16, 16, 3), "u1")
    assert motion.ring_search(flat, flat, 4, 4, 4, 2) == (-1, -1, 0) and motion.ring_search(flat[:4, :4], flat[:4, :4], 0, 0, 4, 2) is None
    df = spark.createDataFrame([(0, bytearray(before.tobytes())), (1, bytearray(now.tobytes())), (2, None)], "f long, y binary")
    got = {(r.x, r.y): (r.mvx, r.mvy, r.sad) for r in motion.block_motion(df, "f", 32, 24, "y", 8, 3).collect()}
    assert len(got) == 12 and got[8, 8] == (1, -2, 0)


def test_palette_index_and_edges(spark):
    bank = np.array([[[8, 8, 8], [248, 8, 8]], [[120, 120, 120], [8, 248, 8]]])
    index = motion.palette_index(bank)
    assert index.shape == (4096, 2) and index[0].tolist() == [0, 3 * 112**2] and index[15 << 8].tolist()[0] == 0
    df = spark.createDataFrame([(0, 0, list(range(16))), (1, 1, list(range(16))), (2, 0, None)], "bx int, by int, c array<int>")
    got = {r.colour: r.pixels for r in P.usage(df, [], "c", P.inside("bx", "by", 6, 5)).collect()}
    assert got == {i: 1 + (i in (0, 1)) for i in range(16)}


def test_motion_predictor_and_candidates(spark):
    grid = spark.createDataFrame([(0, 0, 1, 5), (0, 1, 2, 6), (1, 0, 9, 9), (1, 1, 4, 4)], "r int, c int, x int, y int")
    got = {(r.r, r.c): (r.predict_x, r.predict_y) for r in Q.motion_predictor(grid, [], "r", "c", "x", "y", (0, 0)).collect()}
    assert got == {(0, 0): (0, 0), (0, 1): (0, 0), (1, 0): (1, 5), (1, 1): (2, 6)}
    rows = spark.createDataFrame([(1, 0, 0, 9, 0), (1, 0, 0, 3, 1), (1, 1, 0, 3, 2), (1, 2, 0, 4, 3), (1, 3, 0, 8, 4)], "k int, x int, y int, sad int, n int")
    assert [(r.x, r.sad, r["rank"]) for r in Q.best_vectors(rows, ["k"], ["x", "y"], "sad", "n", 3).orderBy("rank").collect()] == [(0, 3, 1), (1, 3, 2), (2, 4, 3)]
    assert Q.first_frames(rows, "n", 2).count() == 2 and Q.first_frames(rows, "n", 0).count() == 5


def test_nearest_control():
    rates = [10.0 * 1.3**i for i in range(40)]
    for target in (0.0, 10.0, 11.0, 57.3, 500.0, 1e9):
        i, trials = search.nearest_control(40, rates.__getitem__, target)
        assert abs(rates[i] - target) == min(abs(r - target) for r in rates) and trials <= 12
    assert search.nearest_control(3, [1.0, 3.0, 5.0].__getitem__, 2.0)[0] == 1  # ties to the larger rate
    bent = [1, 2, 3, 4, 9, 8, 7, 20]
    assert bent[search.nearest_control(8, bent.__getitem__, 7.9)[0]] == 8
    assert bent[search.nearest_control(8, bent.__getitem__, 3.2)[0]] == 3
    assert search.nearest_control(1, [5.0].__getitem__, 1.0) == (0, 1)


def test_weight_search():
    asked = []

    def trial(w):
        asked.append(w)
        return 50 - w / 10, 1000 - w

    best = search.weight_search(trial, 40.0, 0.1, 16.0, 256.0, 20)
    assert best[1] >= 39.9 and best[0] == pytest.approx(101, abs=0.05) and asked[:5] == [0.0, 16.0, 32.0, 64.0, 128.0] and len(asked) == len(set(asked))
    assert search.weight_search(lambda w: (30.0, 9), 40.0, 0.1, 16.0, 256.0, 8) == (0.0, 30.0, 9)
    assert search.weight_search(lambda w: (45.0, 300 - w), 40.0, 0.1, 16.0, 100.0, 8)[0] == 100.0  # never low enough


def test_quantizer_search():
    quality = lambda q, f: (60 - 2.0 * q, 1000 // q)
    best = search.quantizer_search(quality, 40.0, 30, 255, 8)
    assert best[:2] == (10, 40.0)
    assert search.quantizer_search(lambda q, f: (30.0 + (f < 0.1) * 11, 10), 40.0, 8, 255, 3)[3] == 0.0625  # only a relaxed weight helps
    assert search.quantizer_search(lambda q, f: (39.0 if q > 1 else 41.0, 10), 40.0, 200, 255, 2)[:2] == (1, 41.0)
    assert search.quantizer_search(lambda q, f: (20.0 - q, 10), 40.0, 9, 255, 2)[0] == 1


def test_go_back_n():
    s = search.GoBackN(5, window=3, attempts=2)
    assert s.step()["sent"] == [0, 1, 2]
    assert s.step({"kind": "ack", "seq": 0})["sent"] == [3]
    assert s.step({"kind": "nak", "seq": 2})["sent"] == [2, 3]
    assert s.step({"kind": "ack", "seq": 0})["sent"] == []  # late
    assert s.step({"kind": "ack", "seq": 2})["sent"] == [4]
    with pytest.raises(search.TransferError):
        s.step({"kind": "timeout", "seq": None})  # block 3 would be sent a third time
    s = search.GoBackN(1)
    s.step()
    assert s.step({"kind": "timeout", "seq": None})["sent"] == [0] and s.step({"kind": "ack", "seq": 0})["done"]
    with pytest.raises(search.TransferError):
        search.GoBackN(2).step({"kind": "nak", "seq": 1})


def test_listing():
    files = [("b.hlv", 3), ("A.avi", 2**32 - 1), ("ä", 0)]
    data = containers.listing_bytes(files)
    assert list(containers.listing(data)) == [("A.avi", 2**32 - 1), ("b.hlv", 3), ("ä", 0)]
    damaged = bytearray(data)
    damaged[20] ^= 1  # the first record; it comes again
    assert list(containers.listing(bytes(damaged) + data)) == [("A.avi", 2**32 - 1), ("b.hlv", 3), ("ä", 0)]
    with pytest.raises(FormatError):
        list(containers.listing(data[:-1]))


def test_avi_adapter(spark):
    names = [f.split(" ")[0] for f in containers.AVI_HEADER.split(", ")]
    base = dict.fromkeys(names) | {"compression": "div3", "format_tag": 1, "channels": 1, "sample_rate": 16000, "block_align": 1, "bits_per_sample": 8}
    made = [base, base | {"channels": 2}, base | {"format_tag": 85}, base | {"format_tag": 17, "bits_per_sample": 4, "block_align": 256, "samples_per_block": 505}, base | {"format_tag": 17, "bits_per_sample": 4, "block_align": 256, "samples_per_block": 504}, base | {"compression": "MJPG"}, base | {"format_tag": None}]
    df = spark.createDataFrame([tuple(m[n] for n in names) for m in made], containers.AVI_HEADER)
    got = [(r.audio, r.accepted, r.samples_per_block) for r in containers.avi_adapter(df, containers.DIVX3_CODES).collect()]
    assert got == [("pcm_u8", True, 1), ("pcm_u8", False, 1), ("none", True, None), ("ima_adpcm", True, 505), ("ima_adpcm", False, 504), ("none", True, None)]
    assert containers.avi_adapter(df, containers.MJPEG_CODES).count() == 1


def test_peak_frames(spark):
    df = spark.createDataFrame([(i, i - i % 4, i % 4 == 0, 10 * i, 100 if i != 2 else 900) for i in range(6)], "frame long, gop_start long, keyframe boolean, video_bytes long, host_cycles long")
    assert [tuple(r) for r in sinks.peak_frames(df, 2).orderBy("rank").collect()] == [(1, 2, 0, "P", 20, 900), (2, 0, 0, "K", 0, 100)]
