import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from reelmill.kernels import audio, blocks, bpv
from reelmill.sources import containers as C
from reelmill.sources import sinks, tabular, telemetry
from reelmill.sources.binary import FormatError, rows, scan

HEADER = {"width": 64, "height": 48, "fps_num": 24, "fps_den": 1, "audio_codec": "pcm_u8", "audio_rate": 16000}
PACKETS = [{"kind": "K", "q_y": 8, "q_uv": 9, "bit_length": 29, "payload": b"\1\2\3\4" + b"audio"}, {"kind": "R", "q_y": 8, "q_uv": 9, "payload": b"", "bit_length": 0}]


def test_hlv_round_trip(spark, tmp_path):
    (tmp_path / "a.hlv").write_bytes(C.write_hlv(HEADER, PACKETS))
    head = scan(spark, str(tmp_path), C.hlv_headers, C.HLV_HEADER, suffix=".hlv").first()
    assert (head.width, head.height, head.frame_count, head.audio_codec, head.version) == (64, 48, 2, "pcm_u8", 15)
    got = scan(spark, str(tmp_path), C.hlv_packets, C.HLV_PACKET).orderBy("packet").collect()
    assert [(r.kind, r.offset, r.video_bytes, r.audio_bytes) for r in got] == [("K", 28, 4, 5), ("R", 57, 0, 0)]
    assert bytes(got[0].payload) == PACKETS[0]["payload"]


@pytest.mark.parametrize("damage,kind", [(lambda b: b[:-1] if False else b[:50], "IO"), (lambda b: b[:52] + bytes([b[52] ^ 1]) + b[53:], "CRC"), (lambda b: bytes(28), "FORMAT"), (lambda b: b"", "EOF"), (lambda b: b + b"FRM1", "IO")])
def test_hlv_errors(spark, damage, kind):
    data = damage(C.write_hlv(HEADER, PACKETS))
    with pytest.raises(FormatError, match=kind):
        list(C.hlv_packets(data))
    files = spark.createDataFrame([("good", bytearray(C.write_hlv(HEADER, PACKETS))), ("bad", bytearray(data))], "file string, content binary")
    out = rows(files, C.hlv_packets, C.HLV_PACKET, strict=False)
    assert out.where("file = 'good' AND error IS NULL").count() == 2
    assert out.where(F.col("error").startswith(kind)).select("file").collect()[0].file == "bad"


def test_y4m_round_trip_and_errors(spark):
    y, x = np.mgrid[0:48, 0:64]
    frames = [(bytes(((3 * x + 5 * y + 7 * f) & 255).astype("u1").ravel()), bytes(768), bytes(768)) for f in range(3)]
    data = C.write_y4m(64, 48, 24, 1, frames)
    out = rows(spark.createDataFrame([("a", bytearray(data))], "file string, content binary"), C.y4m_frames, C.Y4M_FRAME)
    assert [bytes(r.y) for r in out.orderBy("frame").collect()] == [f[0] for f in frames]
    for bad in (data[:-1], data.replace(b"W64", b"W63"), data.replace(b"C420", b"C422"), b"nothing"):
        with pytest.raises(FormatError):
            list(C.y4m_frames(bad))
    errors = blocks.plane_errors(out, out.withColumn("y", F.lit(bytearray(64 * 48))))
    a = np.frombuffer(frames[1][0], "u1").astype(int)
    assert errors.where("frame = 1").first().sse_y == (a**2).sum()


def chunk(name, data):
    return name + len(data).to_bytes(4, "little") + data + b"\0" * (len(data) & 1)


def test_avi(spark):
    le = lambda *v: b"".join(int(x).to_bytes(4, "little") for x in v)
    video = chunk(b"LIST", b"strl" + chunk(b"strh", b"vidsMJPG" + le(0, 0, 0, 1001, 30000, 0, 3, 99, 0, 0, 0, 0)) + chunk(b"strf", le(40, 32, 24, 0) + b"MJPG" + bytes(20)))
    sound = chunk(b"LIST", b"strl" + chunk(b"strh", b"auds" + bytes(52)) + chunk(b"strf", (1).to_bytes(2, "little") + (1).to_bytes(2, "little") + le(8000, 8000) + (1).to_bytes(2, "little") + (8).to_bytes(2, "little")))
    movi = b"movi" + chunk(b"00dc", b"abc") + chunk(b"LIST", b"rec " + chunk(b"01wb", b"12")) + chunk(b"00dc", b"") + chunk(b"02dc", b"zz") + chunk(b"00db", b"defg")
    body = b"AVI " + chunk(b"LIST", b"hdrl" + chunk(b"avih", le(33367, 0, 0, 0, 3) + bytes(36)) + video + sound) + chunk(b"LIST", movi) + chunk(b"idx1", b"00dc" + le(16, 4, 3))
    data = chunk(b"RIFF", body)
    head = next(C.avi_headers(data))
    assert head[8:10] == (32, 24) and head[-2:] == (30000, 1001)
    assert [(r[2], r[3], data[r[1] : r[1] + r[2]]) for r in C.avi_packets(data)] == [(3, "V", b"abc"), (2, "A", b"12"), (4, "V", b"defg")]
    assert list(C.avi_index(data)) == [(0, "00dc", 16, 4, 3)]
    with pytest.raises(FormatError):
        C.avi_header(b"RIFF" + bytes(8))


def test_mp4_sample_tables():
    be = lambda *v: b"".join(int(x).to_bytes(4, "big") for x in v)
    box = lambda name, data: be(8 + len(data)) + name + data
    stbl = box(b"stbl", box(b"stsd", be(0, 1, 16) + b"s263") + box(b"stsz", be(0, 0, 3, 10, 20, 30)) + box(b"stco", be(0, 2, 100, 200)) + box(b"stsc", be(0, 2, 1, 2, 1, 2, 1, 1)) + box(b"stts", be(0, 1, 3, 1001)))
    data = box(b"ftyp", b"3gp4") + box(b"moov", box(b"trak", box(b"mdia", box(b"mdhd", be(0, 0, 0, 30000, 3003)) + box(b"hdlr", be(0, 0) + b"vide") + box(b"minf", stbl))))
    got = list(C.mp4_tables(data))
    assert [(r[3], *r[5:]) for r in got if r[3] in ("stsz", "chunk", "stsc", "stts")] == [
        ("stsz", 10, None, None), ("stsz", 20, None, None), ("stsz", 30, None, None), ("chunk", 100, None, None), ("chunk", 200, None, None), ("stsc", 1, 2, 1), ("stsc", 2, 1, 1), ("stts", 3, 1001, None)]
    assert got[0][:3] == (0, "vide", "s263")


def test_framed_records_in_noise():
    rec = lambda seq, p: b"SWPB" + seq.to_bytes(2, "little") + len(p).to_bytes(2, "little") + zlib.crc32(p).to_bytes(4, "little") + p
    good = rec(1, b"hello")
    bad = bytearray(rec(2, b"world"))
    bad[-1] ^= 1
    assert [(r[2], r[4]) for r in C.framed(b"noise" + good + bytes(bad) + b"x" + rec(3, b""))] == [(1, True), (2, False), (3, True)]


def raw(palette, colours, pattern=None):
    nib = lambda v: bytes(a << 4 | b for a, b in zip(v[::2], v[1::2], strict=True))
    if len(colours) == 16:
        return bytes([3 << 6 | palette]) + nib(colours)
    kind = {1: 0, 2: 1, 3: 2, 4: 2}[len(colours)]
    full = colours + [0] * ((2, 2, 4)[kind] - len(colours))
    bits = (0, 1, 2)[kind]
    word = int("".join(f"{v:0{bits}b}" for v in pattern), 2).to_bytes(2 * bits, "big") if bits else b""
    return bytes([kind << 6 | palette]) + nib(full) + word


def bpv_file(version=7):
    le = lambda v, n: v.to_bytes(n, "little")
    head = b"BPV1" + bytes([version]) + le(8, 2) + le(4, 2) + le(2, 4) + le(24, 2) + le(1, 2) + le(48, 2) + le(256, 2) + le(0, 2) + bytes([7, 0]) + le(0, 2) + bytes([0, 0])
    palette = bytes(i & 255 for i in range(3072))
    two = raw(1, [5, 6], [0, 1] * 8)
    first = palette + bytes([0b11110000]) + raw(0, [3]) + two
    second = bytes([0b00100000]) + le(1, 2)
    frame = lambda key, p: bytes([key]) + le(len(p), 4) + le(1, 4) + le(0, 4) + p
    return head + frame(1, first) + frame(0, second), palette


@pytest.mark.parametrize("version", [6, 7])
def test_bpv_decode(spark, version):
    data, palette = bpv_file(version)
    files = spark.createDataFrame([("a", bytearray(data))], "file string, content binary")
    frames = rows(files, C.bpv_frames, C.BPV_FRAME)
    assert [r.modes for r in frames.orderBy("frame").collect()] == [{"patternDictionary": 2}, {"skip": 1, "blockDictionary": 1}]
    out = [np.frombuffer(bytes(r.pixels), "<u2").reshape(4, 8) for r in bpv.decode(frames).orderBy("frame").collect()]
    colour = lambda p, c: (lambda r, g, b: (r & 0xF8) << 8 | (g & 0xFC) << 3 | b >> 3)(*palette[(p * 16 + c) * 3 : (p * 16 + c) * 3 + 3])
    assert (out[0][:, :4] == colour(0, 3)).all() and out[0][0, 4:].tolist() == [colour(1, 5), colour(1, 6)] * 2
    assert np.array_equal(out[0], out[1])
    for bad in (data[:-1], data + b"x", data[:4] + b"\x09" + data[5:]):
        with pytest.raises(FormatError):
            list(C.bpv_frames(bad))


def test_adpcm():
    t = np.arange(641)
    s = (8000 * np.sin(t / 9)).astype(np.int16)
    b = audio.encode_block(s)
    assert len(b) == 6 + 641 // 2
    out, silent, bad = audio.decode_blocks([b, audio.encode_block(np.zeros(5, np.int16)), b[:-1]])
    assert bad is None and not silent.any() and np.abs(out.astype(int) - s).mean() < 100
    assert np.abs(out[: audio.TRIED].astype(int) - s[: audio.TRIED]).max() < 400  # the first step fits at once
    assert [len(p) for p in audio.pcm_frames(b"\1" * 10, 24, 10, 1, 5)] == [2, 2, 3, 2, 3]
    assert list(audio.pcm_frames(b"\1" * 10, 24, 10, 1, 5))[-1] == b"\1\x80\x80"


def test_bits_and_transforms():
    rng = np.random.default_rng(1)
    w, wanted = blocks.BitWriter(), [int(v) for v in rng.integers(-500, 500, 200)]
    for v in wanted:
        w.se(v).ue(abs(v)).put(v & 7, 3)
    r = blocks.BitReader(w.bytes(), w.bits)
    assert [(r.se(), r.ue(), r.get(3)) for _ in wanted] == [(v, abs(v), v & 7) for v in wanted]
    with pytest.raises(EOFError):
        r.get(1)
    x = rng.integers(-255, 256, (50, 4, 4))
    assert np.array_equal(blocks.wht4_inverse(blocks.wht4(x)), x)
    assert blocks.quantize([-7, -3, 3, 7], 4).tolist() == [-2, -1, 1, 2] and blocks.quantize([3], 4, 1.0).tolist() == [0]


def test_scores():
    y = np.tile(np.arange(64, dtype=np.uint8) * 3, (48, 1))
    assert blocks.detail_score(y) == 1.5
    assert blocks.motion_score(y, np.roll(y, 2, 1), 3)[0] == 0.0


def test_telemetry(spark):
    lines = ["F,1,10,20,30,40,50", "noiseF,2,1,2,3,4,5,6,7,8,9,10junk", "A,1,2,3,4,0,0,0,1,1", "A,2,2,3,4,0,5,0,1,1,7,8,9", "A,1,2", "xxV,320,240,30,1,16000,99", "V,1,1,0,1,1,1", "S,Decode Error,bad", "H," + ",".join("1" * 11), "F,4,1,1,0,1,1"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    frames = telemetry.frames(df)
    assert [(r.frame, r.work_us, r.bpv_input_bytes) for r in frames.orderBy("frame").collect()] == [(1, 40, 0), (2, 4, 10), (4, 1, 0)]
    assert [(r.frame, r.convert_us) for r in telemetry.audio(df).orderBy("frame").collect()] == [(1, 0), (2, 9)]
    assert telemetry.video(df).collect()[0].fps_num == 30 and telemetry.video(df).count() == 1
    assert telemetry.profile(df).count() == 1 and telemetry.errors(df).first().title == "Decode Error"
    assert telemetry.missing_frames(frames).first()[:] == (2, 4, 1)
    assert telemetry.audio_accepted(telemetry.audio(df)).first().accepted is False
    assert telemetry.deadline_summary(frames, 30).first().late == 1


def test_tables_and_reports(spark, tmp_path):
    (tmp_path / "m.csv").write_bytes("﻿codec,source,filename,frames,fps,enabled,skip_reason\nA,s,f.hlv,30,29.97003, FALSE ,x\nB,s,g.hlv,30,24,true,\n".encode())
    m = tabular.manifest(spark, str(tmp_path / "m.csv"))
    assert [(r.codec, r.fps) for r in m.collect()] == [("B", 24.0)]
    for w in ("start", "middle", "end"):
        (tmp_path / f"g.hlv.{w}.csv").write_text("frame,decode_us\n1,5\n2,0\n")
    t = tabular.timings(spark, str(tmp_path / "g.hlv.*.csv"))
    assert tabular.joined_windows(m, t).groupBy("window").count().count() == 3
    with pytest.raises(Exception, match="no timing records"):
        tabular.joined_windows(m, t.where("window <> 'end'")).collect()
    assert tabular.results(spark, str(tmp_path / "none.json")).count() == 0
    row = {"source": "a", "duration_s": 1.0, "frames": 1, "codec": "c", "setting": "q", "bytes": 10, "bitrate_kbps": 1.0, "encode_s": 1.0, "encode_fps": 1.0, "decode_s": 1.0, "decode_fps": 1.0, "psnr_y": 1.0, "psnr_u": 1.0, "psnr_v": 1.0, "psnr_avg": 2.25}
    (tmp_path / "r.json").write_text(json.dumps([row, row | {"setting": "p"}]))
    r = tabular.results(spark, str(tmp_path / "r.json"), matched=True)
    assert r.count() == 2 and r.first().ssim_all == 0.0
    table = sinks.markdown(r.orderBy("setting").select("setting", F.lit(float("inf")).alias("v")), {"v": 2})
    assert table.splitlines()[2] == "| p | inf |"
    sinks.write_results(r, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/json")).count() == 2


def test_config(spark):
    text = "# c\nversion: 1\noutputDirectory: 'it''s'\nvideos:\n  - name: A  # note\n    fps: 24\n    toleranceDb: 0.10\n    audio: True\n\n  - name: \"B\"\n"
    c = tabular.transcode_config(text)
    assert c == {"version": 1, "outputDirectory": "it's", "videos": [{"name": "A", "fps": 24, "toleranceDb": 0.1, "audio": True}, {"name": "B"}]}
    assert tabular.config_frame(spark, c).where("audio").first().fps == 24.0
    for bad in ("version: 1\n", "bogus: 1\nvideos:\n  - name: A\n", "videos:\n\t- name: A\n", "videos:\n    fps: 1\n", "videos:\n  - zzz: 1\n", "version: 'x\nvideos:\n  - name: A\n"):
        with pytest.raises(ValueError):
            tabular.transcode_config(bad)
    quoted = tabular.transcode_config("videos:  # list\n  - name: 'a # b'  # note\n    input: it's # x\n    format: \"#1\"\n")
    assert quoted["videos"] == [{"name": "a # b", "input": "it's", "format": "#1"}]
    for text, want in (("12", 12), ("-3", -3), ("+.5", 0.5), ("5.", 5.0), ("1.5e3", 1500.0), ("1e5", "1e5"), ("1_0", "1_0"), ("inf", "inf"), ("TRUE", True), ("~", None), ("9" * 30, "9" * 30), ("-", "-"), ("a'b", "a'b")):
        assert tabular.scalar(text) == want and type(tabular.scalar(text)) is type(want)


def test_sources_and_reports_without_rows(spark, tmp_path):
    for name in ("b.json", "a.json", "c.txt"):
        (tmp_path / name).write_text("[]")
    assert [p.rsplit("/", 1)[1] for p in tabular.sources(spark, [f"{tmp_path}/c.txt", f"{tmp_path}/*.json", f"{tmp_path}/gone"])] == ["c.txt", "a.json", "b.json"]
    with pytest.raises(FileNotFoundError):
        tabular.sources(spark, [f"{tmp_path}/*.mov"])
    assert tabular.results(spark, f"{tmp_path}/gone").count() == 0
    for path in (f"{tmp_path}/gone", f"{tmp_path}/a.json"):
        with pytest.raises(ValueError):
            tabular.results(spark, path, report=True)


def test_measurement_lines(spark):
    df = spark.createDataFrame([(1, "MRP,1,2,x"), (2, "noise CRV,7,8"), (3, "noise MDP,1"), (4, "S,ok")], "i int, value string")
    assert sorted((r.i, r.kind, r.fields) for r in telemetry.measurements(df).collect()) == [(1, "MRP", [1, 2, None]), (2, "CRV", [7, 8])]
