"""Queries of files, checks, colours, kernels, logs and searches. Files are made from the tables, written to the shared folder and read back."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import checks as K
from ..functions import colour as C
from ..functions import scalars as S
from ..kernels import audio, blocks, motion, samples
from ..operators import palettes as P
from ..operators import search
from ..operators import sequences as Q
from ..session import new_path, ship
from ..sources import containers, sinks, tabular, telemetry
from ..sources import binary as B
from .registry import query

_OPTIONS = {"quality": "p_size * 3 - 20", "gop": "p_partkey % 400", "search": "p_size + 20", "min_key_interval": "p_size", "psnr_min": "15.0 + p_size", "psnr_max": "45.0", "threads": "p_partkey % 10", "rd_lambda_scale": "p_size / 2.0 - 1", "bitrate_kbps": "p_partkey % 3", "target_psnr": "p_size * 1.0"}


@query(f"""WITH o AS (SELECT p_partkey, {", ".join(f"{e} AS {n}" for n, e in _OPTIONS.items())} FROM part) SELECT p_partkey, concat_ws(',', CASE WHEN quality < 1 OR quality > 100 THEN 'quality' END, CASE WHEN gop < 1 THEN 'gop' END,
 CASE WHEN search < 0 OR search > 64 THEN 'search' END, CASE WHEN min_key_interval < 1 THEN 'min_key_interval' END, CASE WHEN psnr_min < 20 OR psnr_min > 60 THEN 'psnr_min' END, CASE WHEN psnr_max < 20 OR psnr_max > 60 THEN 'psnr_max' END,
 CASE WHEN threads < 1 OR threads > 8 THEN 'threads' END, CASE WHEN rd_lambda_scale <= 0 OR rd_lambda_scale > 16 THEN 'rd_lambda_scale' END, CASE WHEN bitrate_kbps < 0 OR bitrate_kbps > 100000 THEN 'bitrate_kbps' END, CASE WHEN target_psnr < 0 OR target_psnr > 70 THEN 'target_psnr' END,
 CASE WHEN min_key_interval >= gop THEN 'min_key_interval not below gop' END, CASE WHEN psnr_min > psnr_max THEN 'psnr_min above psnr_max' END, CASE WHEN bitrate_kbps <> 0 AND target_psnr > 0 THEN 'bitrate with target_psnr' END) AS faults FROM o""")
def option_check(t):
    return t.part.select("p_partkey", F.array_join(K.option_faults({n: F.expr(e) for n, e in _OPTIONS.items()}), ",").alias("faults"))


_NAME = "concat(CASE WHEN p_partkey % 5 = 0 THEN p_name ELSE replace(p_name, ' ', '_') END, '-', p_partkey, CASE p_partkey % 6 WHEN 0 THEN '.hlv' WHEN 1 THEN '.AVI' WHEN 2 THEN '.mov' WHEN 3 THEN '.Bpv1' WHEN 4 THEN '.a_very_long_name_with_dots_and_dashes_behind_it.mpeg' ELSE '' END)"


@query(f"""WITH n AS (SELECT p_partkey, {_NAME} AS name FROM part) SELECT p_partkey, name, regexp_matches(name, '^[0-9A-Za-z][0-9A-Za-z._-]*$') AND regexp_matches(lower(name), '[.](hlv|avi|bpv1|mpg|mpeg|txt)$') AND length(name) <= 48 AS valid,
 regexp_matches(lower(name), '[.](hlv|avi|bpv1|mpg|mpeg|txt)$') AS known FROM n""")
def name_check(t):
    names = t.part.select("p_partkey", F.expr(_NAME).alias("name"))
    return names.select("p_partkey", "name", K.valid_name("name").alias("valid"), K.has_suffix("name").alias("known"))


_HEAD = "concat(CASE p_size % 4 WHEN 0 THEN 'HLV1' WHEN 1 THEN 'BPV1' WHEN 2 THEN 'RIFF0000AVI ' ELSE 'none' END, p_name)"


@query(f"""WITH n AS (SELECT p_partkey, lower({_NAME}) AS name, {_HEAD} AS head FROM part) SELECT p_partkey, CASE WHEN name LIKE '%.hlv' THEN head LIKE 'HLV1%' WHEN name LIKE '%.bpv1' THEN head LIKE 'BPV1%'
 WHEN name LIKE '%.avi' THEN head LIKE 'RIFF____AVI %' WHEN name LIKE '%.mpeg' THEN false ELSE true END AS matches FROM n""")
def magic_check(t):
    return t.part.select("p_partkey", K.magic_matches(F.expr(_NAME), F.expr(_HEAD).cast("binary")).alias("matches"))


_CODEC = "CASE p_partkey % 4 WHEN 0 THEN 'bpv' WHEN 1 THEN 'mjpeg' WHEN 2 THEN 'h264' ELSE 'mpeg2' END"


@query(f"""SELECT p_partkey, concat(CASE p_partkey % 4 WHEN 0 THEN 'lambda' WHEN 2 THEN 'crf' ELSE 'q' END, '=', p_size) AS setting,
 concat('q=', p_size, ',fast,v=15,cs=', printf('%g', 0.25 + p_size / 8.0), ',lw=', printf('%g', p_size * 1.0), ',ls=', printf('%g', p_retailprice / 7), ',dz=', printf('%g', 0.5 + p_size / 300.0)) AS label FROM part""")
def setting_labels(t):
    label = K.encoder_label(F.concat(F.lit("q="), F.col("p_size").cast("string")), F.lit("fast"), F.lit(15), 0.25 + F.col("p_size") / 8.0, F.col("p_size") * 1.0, F.col("p_retailprice") / 7, 0.5 + F.col("p_size") / 300.0)
    return t.part.select("p_partkey", K.setting_label(F.expr(_CODEC), "p_size").alias("setting"), label.alias("label"))


@query("""WITH d AS (SELECT o_orderkey, o_totalprice / 1000 AS d, (o_orderkey % 3 - 1) * 100.0 AS l, -1.0 * (o_orderkey % 7) + 1.0 * (o_orderkey % 50) - 5 AS g FROM orders)
 SELECT o_orderkey, CASE WHEN l > 0 THEN least(d, l) ELSE d END AS duration, CAST(CASE WHEN g >= 0 AND g <= 20 * log10(64.0) THEN g END AS DOUBLE) AS gain FROM d""")
def clamp_and_gain(t):
    gain = K.peak_gain(0.0 - F.col("o_orderkey") % 7, 5.0 - F.col("o_orderkey") % 50)
    return t.orders.select("o_orderkey", K.clamped_duration(F.col("o_totalprice") / 1000, (F.col("o_orderkey") % 3 - 1) * 100.0).alias("duration"), gain.alias("gain"))


@query("""WITH a AS (SELECT o_custkey, count(*) AS frames, count(*) FILTER (WHERE o_orderstatus = 'F') AS keys FROM orders GROUP BY 1), b AS (SELECT o_custkey, count(*) AS frames, count(*) FILTER (WHERE o_orderstatus = 'F') AS keys FROM orders WHERE o_orderkey % 40 <> 0 GROUP BY 1)
 SELECT a.o_custkey, a.frames IS NOT DISTINCT FROM b.frames AND a.keys IS NOT DISTINCT FROM b.keys AS agree FROM a LEFT JOIN b ON b.o_custkey = a.o_custkey""")
def count_agreement(t):
    def counts(rows, side):
        return rows.groupBy("o_custkey").agg(F.count("*").alias(f"frames_{side}"), F.count_if(F.col("o_orderstatus") == "F").alias(f"keys_{side}"))

    both = counts(t.orders, "decoder").join(counts(t.orders.where("o_orderkey % 40 <> 0"), "probe"), "o_custkey", "left")
    return both.select("o_custkey", K.counts_agree(("frames_decoder", "frames_probe"), ("keys_decoder", "keys_probe")).alias("agree"))


_RGB = "SELECT p_partkey, CAST(p_partkey % 256 AS INTEGER) AS r, CAST((p_partkey * 7) % 256 AS INTEGER) AS g, CAST((p_partkey * 13) % 256 AS INTEGER) AS b FROM part"


def _rgb(t):
    return t.part.select("p_partkey", *[(F.col("p_partkey") * k % 256).cast("int").alias(n) for k, n in ((1, "r"), (7, "g"), (13, "b"))])


_UNIT = ", ".join(f"CASE WHEN {c} / 255.0 <= 0.04045 THEN {c} / 255.0 / 12.92 ELSE pow(({c} / 255.0 + 0.055) / 1.055, 2.4) END AS {c}l" for c in "rgb")


@query(f"""WITH c AS ({_RGB}), u AS (SELECT *, {_UNIT} FROM c),
 m AS (SELECT *, cbrt(0.4122214708 * rl + 0.5363325363 * gl + 0.0514459929 * bl) AS x, cbrt(0.2119034982 * rl + 0.6806995451 * gl + 0.1073969566 * bl) AS y, cbrt(0.0883024619 * rl + 0.2817188376 * gl + 0.6299787005 * bl) AS z FROM u)
 SELECT p_partkey, round(0.2104542553 * x + 0.7936177850 * y - 0.0040720468 * z, 6) AS lightness, round(1.9779984951 * x - 2.4285922050 * y + 0.4505937099 * z, 6) AS a, round(0.0259040371 * x + 0.7827717662 * y - 0.8086757660 * z, 6) AS b, r AS red, g AS green, b AS blue FROM m""")
def oklab(t):
    lab = _rgb(t).withColumns(dict(zip(("ll", "la", "lb"), C.srgb_to_oklab("r", "g", "b"), strict=True)))
    back = C.oklab_to_srgb("ll", "la", "lb")
    return lab.select("p_partkey", *[F.round(c, 6).alias(n) for c, n in (("ll", "lightness"), ("la", "a"), ("lb", "b"))], *[c.alias(n) for c, n in zip(back, ("red", "green", "blue"), strict=True)])


_BYTE = "CAST(greatest(0, least(255, floor({} + 0.5))) AS INTEGER)"


@query(f"""WITH c AS ({_RGB}), y AS (SELECT *, {_BYTE.format("16.0 + (0.256788 * r + 0.504129 * g + 0.097906 * b)")} AS y, {_BYTE.format("128.0 + (-0.148223 * r + -0.290993 * g + 0.439216 * b)")} AS u, {_BYTE.format("128.0 + (0.439216 * r + -0.367788 * g + -0.071427 * b)")} AS v FROM c)
 SELECT p_partkey, y, u, v, {_BYTE.format("1.164383 * (y - 16.0) + 1.596027 * (v - 128.0)")} AS red, {_BYTE.format("1.164383 * (y - 16.0) - 0.391762 * (u - 128.0) - 0.812968 * (v - 128.0)")} AS green, {_BYTE.format("1.164383 * (y - 16.0) + 2.017232 * (u - 128.0)")} AS blue,
 CAST(greatest(0, least(255, (298 * greatest(0, y - 16) + 409 * (v - 128) + 128) >> 8)) AS INTEGER) AS red_256 FROM y""")
def studio_range(t):
    yuv = _rgb(t).withColumns(dict(zip("yuv", C.rgb_to_yuv("r", "g", "b"), strict=True)))
    return yuv.select("p_partkey", "y", "u", "v", *[c.alias(n) for c, n in zip(C.yuv_to_rgb("y", "u", "v"), ("red", "green", "blue"), strict=True)], C.yuv_to_rgb_256("y", "u", "v")[0].alias("red_256"))


@query("""WITH e AS (SELECT event_id, CAST(event_id % 1500 - 750 AS INTEGER) AS s, CAST(event_id % 256 AS INTEGER) AS w, CAST(event_id % 9 AS INTEGER) AS x, CAST(event_id % 11 AS INTEGER) AS y FROM events),
 q AS (SELECT *, greatest(-128, least(127, CASE WHEN s >= 0 THEN (s + 2) // 4 ELSE -((2 - s) // 4) END)) AS q4 FROM e), f AS (SELECT *, CAST(floor(q4 / 16.0) AS INTEGER) AS whole FROM q)
 SELECT event_id, least((w + 2) // 4, 63) AS code, q4, whole + CASE WHEN [0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5][(y % 4) * 4 + x % 4 + 1] < q4 - whole * 16 THEN 1 ELSE 0 END AS change FROM f""")
def dither(t):
    q4 = C.correction_q4(F.col("event_id") % 1500 - 750)
    rows = t.events.withColumn("q4", q4)
    return rows.select("event_id", C.sample_code(F.col("event_id") % 256, 6).alias("code"), "q4", C.dithered("q4", F.col("event_id") % 9, F.col("event_id") % 11).alias("change"))


_MODES = ("SKIP", "INTER", "GLOBAL", "SPLIT_INTER", "RECT_SPLIT", "FILL", "INTRA_DC", "GRADIENT", "PALETTE", "LITERAL", "VECTOR")


@query(f"""WITH m AS (SELECT p_partkey, [{", ".join(f"'{m}'" for m in _MODES)}][CAST(p_partkey % {len(_MODES)} AS INTEGER) + 1] AS mode, p_partkey % 700 AS bits, p_partkey % 9 - 4 AS x, p_size % 7 - 3 AS y, 1 + p_size % 4 AS colours, p_size % 5 = 0 AS direct FROM part)
 SELECT p_partkey, CASE WHEN direct THEN 72 WHEN colours = 1 THEN 16 WHEN colours = 2 THEN 32 ELSE 56 END AS payload, CAST(100 + CASE WHEN mode = 'LITERAL' THEN 544 ELSE (bits + 7) // 8 * 8 END
 + 384 * CASE WHEN mode IN ('SKIP', 'FILL') THEN 2 WHEN mode IN ('INTER', 'GLOBAL') THEN CASE WHEN x % 2 = 0 AND y % 2 = 0 THEN 2 WHEN x % 2 <> 0 AND y % 2 <> 0 THEN 14 ELSE 8 END WHEN mode = 'SPLIT_INTER' THEN 14 WHEN mode = 'RECT_SPLIT' THEN 10 WHEN mode IN ('INTRA_DC', 'GRADIENT') THEN 4 WHEN mode = 'PALETTE' THEN 3 ELSE 0 END
 + CASE WHEN mode IN ('SKIP', 'PALETTE', 'LITERAL') THEN 0 ELSE 5 * greatest(0, bits - CASE mode WHEN 'FILL' THEN 32 WHEN 'INTRA_DC' THEN 8 WHEN 'GRADIENT' THEN 80 ELSE 0 END) END AS BIGINT) AS cycles FROM m""")
def block_costs(t):
    mode = F.element_at(F.array(*[F.lit(m) for m in _MODES]), (F.col("p_partkey") % len(_MODES)).cast("int") + 1)
    return t.part.select("p_partkey", C.payload_bits(1 + F.col("p_size") % 4, F.col("p_size") % 5 == 0).alias("payload"), C.decode_cycles(mode, F.col("p_partkey") % 700, F.col("p_partkey") % 9 - 4, F.col("p_size") % 7 - 3).alias("cycles"))


@query("""WITH p AS (SELECT p_partkey, (p_partkey * 2654435761) % 4294967296 AS v FROM part) SELECT p_partkey, CAST((SELECT bit_or(1 << ((v >> CAST(s AS BIGINT)) & 3)) FROM range(0, 32, 2) AS r(s)) AS INTEGER) AS used FROM p""")
def colours_used(t):
    return t.part.select("p_partkey", C.colours_used(F.col("p_partkey") * 2654435761 % 4294967296).alias("used"))


@query("""WITH e AS (SELECT event_id // 40 AS row, event_id % 40 AS col, CAST(event_id * 7 % 23 - 11 AS INTEGER) AS x, CAST(event_id * 13 % 17 - 8 AS INTEGER) AS y FROM events),
 n AS (SELECT e.*, coalesce(l.x, 1) AS lx, coalesce(a.x, 1) AS ax, coalesce(r.x, 1) AS rx, coalesce(l.y, -2) AS ly, coalesce(a.y, -2) AS ay, coalesce(r.y, -2) AS ry FROM e LEFT JOIN e l ON l.row = e.row AND l.col = e.col - 1
 LEFT JOIN e a ON a.row = e.row - 1 AND a.col = e.col LEFT JOIN e r ON r.row = e.row - 1 AND r.col = e.col + 1)
 SELECT row, col, list_sort([lx, ax, rx])[2] AS predict_x, list_sort([ly, ay, ry])[2] AS predict_y FROM n""")
def motion_predictor(t):
    grid = t.events.select(F.floor(F.col("event_id") / 40).alias("row"), (F.col("event_id") % 40).alias("col"), (F.col("event_id") * 7 % 23 - 11).cast("int").alias("x"), (F.col("event_id") * 13 % 17 - 8).cast("int").alias("y"))
    return Q.motion_predictor(grid, [], "row", "col", "x", "y", (1, -2)).select("row", "col", "predict_x", "predict_y")


@query("""WITH c AS (SELECT user_id, event_id % 5 AS x, event_id % 3 AS y, value, event_id, row_number() OVER (PARTITION BY user_id, event_id % 5, event_id % 3 ORDER BY value, event_id) AS i FROM events),
 r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS p FROM c WHERE i = 1) SELECT user_id, x, y, value, CAST(p AS INTEGER) AS rank FROM r WHERE p <= 4""")
def best_vectors(t):
    rows = t.events.select("user_id", (F.col("event_id") % 5).alias("x"), (F.col("event_id") % 3).alias("y"), "value", "event_id")
    return Q.best_vectors(rows, ["user_id"], ["x", "y"], "value", "event_id", 4)


@query("SELECT event_id, value FROM events WHERE event_id < 300")
def first_frames(t):
    return Q.first_frames(t.events.select("event_id", "value"), "event_id", 300)


@query("SELECT o_orderkey, o_totalprice * 8 / (64 * 48 * CAST(1 + o_orderkey % 5 AS DOUBLE)) AS bpp FROM orders")
def bits_per_pixel(t):
    return t.orders.select("o_orderkey", S.bits_per_pixel("o_totalprice", F.lit(64), F.lit(48), 1 + F.col("o_orderkey") % 5).alias("bpp"))


@query("""SELECT event_id, CAST(list_transform(range(0, 16), lambda i: (event_id * 131 + i * 17 + 460800 + (i >> 3)) & 255) AS VARCHAR) AS payload FROM events""")
def link_payload(t):
    made = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: S.payload_byte("event_id", i, F.lit(460800)).cast("string"))
    return t.events.select("event_id", F.concat(F.lit("["), F.array_join(made, ", "), F.lit("]")).alias("payload"))


# Telemetry

_US = ("event_id", "event_id % 900", "event_id * 7 % 30000", "CASE WHEN event_id % 13 = 0 THEN 0 ELSE event_id % 500 + 1 END", "event_id * 11 % 50000", "event_id * 41000")
_MORE = ("event_id % 7", "event_id % 11", "event_id % 17", "event_id % 19", "event_id % 23")


def _lines(t):
    short, long = (F.concat(F.lit("F,"), F.concat_ws(",", *[F.expr(e).cast("string") for e in f])) for f in (_US, (*_US, *_MORE)))
    line = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("[core 1] "), long)).when(F.col("event_id") % 17 == 0, F.lit("F,1,2,x")).otherwise(short)
    return t.events.select(line.alias("value"))


_FRAMES = ", ".join([f"CAST({e} AS BIGINT) AS {n}" for e, n in zip(_US, telemetry.FRAME, strict=False)] + [f"CAST(CASE WHEN event_id % 3 = 0 THEN {e} ELSE 0 END AS BIGINT) AS {n}" for e, n in zip(_MORE, telemetry.FRAME[6:], strict=True)])
_FRAMES = f"SELECT {_FRAMES} FROM events WHERE event_id % 3 = 0 OR event_id % 17 <> 0"


@query(_FRAMES)
def telemetry_frames(t):
    return telemetry.frames(_lines(t))


@query(f"""WITH f AS ({_FRAMES}) SELECT count(*) AS frames, (count(*) - 1) * 1e6 / (max(present_us) - min(present_us)) AS fps, count(*) FILTER (WHERE work_us > 33333) AS late, count(*) FILTER (WHERE render_us = 0) AS skipped FROM f""")
def telemetry_deadline(t):
    return telemetry.deadline_summary(telemetry.frames(_lines(t)), 33333)


@query(f"""WITH f AS ({_FRAMES}) SELECT prev AS previous, frame AS next, frame - prev - 1 AS missing FROM (SELECT frame, lag(frame) OVER (ORDER BY frame) AS prev FROM f) WHERE frame > prev + 1""")
def telemetry_gaps(t):
    return telemetry.missing_frames(telemetry.frames(_lines(t)))


_AUDIO = ("event_id", "event_id % 9", "event_id % 8", "event_id * 640", "event_id % 2", "event_id % 4", "0", "1", "event_id % 6")


@query(f"""SELECT {", ".join(f"CAST({e} AS BIGINT) AS {n}" for e, n in zip((*_AUDIO, *("CASE WHEN event_id % 2 = 0 THEN 5 ELSE 0 END",) * 2, "0"), telemetry.AUDIO, strict=True))} FROM events WHERE event_id % 5 <> 0""")
def telemetry_audio(t):
    fields = F.concat_ws(",", *[F.expr(e).cast("string") for e in _AUDIO])
    line = F.concat(F.when(F.col("event_id") % 5 == 0, F.lit("noise A,")).otherwise(F.lit("A,")), fields, F.when(F.col("event_id") % 2 == 0, F.lit(",5,5")).otherwise(F.lit("")))
    return telemetry.audio(t.events.select(line.alias("value")))


@query("""SELECT CASE event_id % 3 WHEN 0 THEN 'MRP' WHEN 1 THEN 'CRV' END AS kind, event_id AS first, user_id AS second FROM events WHERE event_id % 3 <> 2""")
def telemetry_measurements(t):
    line = F.concat(F.when(F.col("event_id") % 3 == 0, F.lit("MRP,")).when(F.col("event_id") % 3 == 1, F.lit("noise CRV,")).otherwise(F.lit("noise MDP,")), F.col("event_id").cast("string"), F.lit(", "), F.col("user_id").cast("string"))
    out = telemetry.measurements(t.events.select(line.alias("value")))
    return out.select("kind", F.get("fields", F.lit(0)).alias("first"), F.get("fields", F.lit(1)).alias("second"))


# Files

_RESULT = ("s_name", "s_acctbal", "CAST(s_suppkey AS INTEGER)", "'hlv'", "concat('q=', s_nationkey)", "s_suppkey * 1000", "s_suppkey * 1.5", "0.5", "2.0", "0.25", "4.0", "40.5", "41.0", "42.0", "s_nationkey * 1.0")
_FIELDS = [f.split(" ") for f in tabular.RESULT.split(", ")]
_KINDS = {"double": "DOUBLE", "string": "VARCHAR", "int": "INTEGER", "long": "BIGINT"}


@query(f"""SELECT {", ".join(f"CAST({e} AS {_KINDS[k]}) AS {n}" for e, (n, k) in zip(_RESULT, _FIELDS, strict=True))} FROM supplier""")
def result_files(t):
    path = new_path(t.spark, "results")
    sinks.write_results(t.supplier.select(*[F.expr(e).alias(n) for e, (n, _) in zip(_RESULT, _FIELDS, strict=True)]), path)
    return tabular.results(t.spark, f"{path}/json", report=True, lines=True)


def _manifest(t) -> str:
    path = new_path(t.spark, "manifest")
    rows = t.nation.select(F.lit("hlv").alias("codec"), F.lower("n_name").alias("source"), F.concat(F.lit("clip"), F.col("n_nationkey")).alias("filename"), F.lit(600).alias("frames"), F.lit(24.0).alias("fps"), F.when(F.col("n_nationkey") % 3 == 0, " False").otherwise("true").alias("enabled"), F.lit(None).cast("string").alias("skip_reason"))
    sinks.write_csv(rows, path)
    return path


@query("SELECT 'hlv' AS codec, lower(n_name) AS source, concat('clip', n_nationkey) AS filename, 600 AS frames, CAST(24 AS DOUBLE) AS fps, 'true' AS enabled, CAST(NULL AS VARCHAR) AS skip_reason FROM nation WHERE n_nationkey % 3 <> 0")
def manifest_rows(t):
    return tabular.manifest(t.spark, _manifest(t))


@query("""SELECT 'hlv' AS codec, lower(n_name) AS source, concat('clip', n_nationkey) AS filename, w AS "window", n_nationkey * 100 + i AS frame, n_nationkey * 10 + i AS decode_us FROM nation, (VALUES ('start', 0), ('middle', 10), ('end', 20)) AS v(w, d), range(0, 3) AS r(j), LATERAL (SELECT d + j AS i) WHERE n_nationkey % 3 <> 0""")
def timing_windows(t):
    path = new_path(t.spark, "timings")
    for r in t.nation.collect():  # a file for each window of a test: the names carry the key
        for d, w in ((0, "start"), (10, "middle"), (20, "end")):
            body = "".join(f"{r.n_nationkey * 100 + d + j},{r.n_nationkey * 10 + d + j}\n" for j in range(3))
            sinks.write_text(t.spark, f"{path}/clip{r.n_nationkey}.{w}.csv", f"frame,decode_us\n{body}")
    out = tabular.joined_windows(tabular.manifest(t.spark, _manifest(t)), tabular.timings(t.spark, path))
    return out.select("codec", "source", "filename", "window", "frame", "decode_us")


@query("""WITH r AS (SELECT n_name, n_regionkey, n_nationkey * 0.125 AS share FROM nation) SELECT '| n_name | n_regionkey | share |' AS line UNION ALL SELECT '| --- | --- | --- |' UNION ALL SELECT concat('| ', n_name, ' | ', n_regionkey, ' | ', printf('%.3f', share), ' |') FROM r""")
def markdown_lines(t):
    text = sinks.markdown(t.nation.select("n_name", "n_regionkey", (F.col("n_nationkey") * 0.125).alias("share")), {"share": 3})
    return t.spark.createDataFrame([(line,) for line in text.split("\n")], "line string")


@query("""SELECT CAST(event_id AS VARCHAR) AS frame, printf('%.4f', value / 3) AS target_psnr, printf('%.4f', value / 2) AS actual_psnr, printf('%.4f', value) AS motion_mad, '0.5000' AS raw_motion_mad, printf('%.4f', value * 2) AS detail,
 CAST(user_id AS VARCHAR) AS q_y, CAST(user_id + 1 AS VARCHAR) AS q_uv, CAST(event_id * 3 AS VARCHAR) AS packet_bytes, CASE WHEN event_id % 24 = 0 THEN 'K' ELSE 'P' END AS frame_type FROM events""")
def quality_log(t):
    v = F.col("value")
    rows = t.events.select(F.col("event_id").alias("frame"), (v / 3).alias("target_psnr"), (v / 2).alias("actual_psnr"), v.alias("motion_mad"), F.lit(0.5).alias("raw_motion_mad"), (v * 2).alias("detail"),
                           F.col("user_id").alias("q_y"), (F.col("user_id") + 1).alias("q_uv"), (F.col("event_id") * 3).alias("packet_bytes"), F.when(F.col("event_id") % 24 == 0, "K").otherwise("P").alias("frame_type"))
    path = new_path(t.spark, "quality-log")
    sinks.write_log(rows, sinks.QUALITY_LOG, path)
    return t.spark.read.option("header", True).csv(path)


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS "window", CAST(o_orderkey * 24 AS VARCHAR) AS first_frame, '24' AS frames, '5' AS trials, CAST(o_orderkey % 50 AS VARCHAR) AS chosen_q, CAST(o_custkey AS VARCHAR) AS probe_bytes, printf('%.0f', o_totalprice * 1.5) AS target_bytes, CAST(o_custkey * 2 AS VARCHAR) AS actual_bytes,
 printf('%.3f', o_totalprice / 7) AS actual_kbps, printf('%.6f', o_totalprice / 1e3) AS relative_error, printf('%.0f', -o_totalprice) AS debt_bytes FROM orders""")
def window_log(t):
    p = F.col("o_totalprice")
    rows = t.orders.select(F.col("o_orderkey").alias("window"), (F.col("o_orderkey") * 24).alias("first_frame"), F.lit(24).alias("frames"), F.lit(5).alias("trials"), (F.col("o_orderkey") % 50).alias("chosen_q"), F.col("o_custkey").alias("probe_bytes"), (p * 1.5).alias("target_bytes"),
                           (F.col("o_custkey") * 2).alias("actual_bytes"), (p / 7).alias("actual_kbps"), (p / 1e3).alias("relative_error"), (-p).alias("debt_bytes"))
    return sinks.log_rows(rows, sinks.WINDOW_LOG)


@query("""WITH r AS (SELECT l_orderkey * 10 + l_linenumber AS frame, min(l_suppkey) AS gop_start, sum(CAST(l_quantity AS BIGINT)) AS bytes, sum(CAST(floor(l_extendedprice) AS BIGINT)) AS cycles, min(l_linenumber) = 1 AS k FROM lineitem GROUP BY 1),
 p AS (SELECT *, row_number() OVER (ORDER BY cycles DESC, frame) AS i FROM r) SELECT CAST(i AS INTEGER) AS rank, frame, gop_start, CASE WHEN k THEN 'K' ELSE 'P' END AS type, bytes AS video_bytes, cycles AS host_cycles FROM p WHERE i <= 128""")
def peak_log(t):
    rows = t.lineitem.groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("frame")).agg(F.min("l_suppkey").alias("gop_start"), F.sum(F.col("l_quantity").cast("long")).alias("video_bytes"), F.sum(F.floor("l_extendedprice")).alias("host_cycles"), (F.min("l_linenumber") == 1).alias("keyframe"))
    return sinks.peak_frames(rows)


@query("""SELECT s_name AS name, s_suppkey * 17 AS size FROM supplier""")
def listing_rows(t):
    made = containers.listing_bytes([(r.s_name, r.s_suppkey * 17) for r in t.supplier.select("s_name", "s_suppkey").collect()])  # a device's directory
    noisy = b"boot\n" + made[:40] + b"HLVL" + made[:60][40:] + made
    files = t.spark.createDataFrame([("listing", bytearray(noisy))], "file string, content binary")
    return B.rows(files, containers.listing, containers.LISTING).drop("file")


@query("""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, length(concat(event_type, event_id)) AS s FROM events)
 SELECT CAST(user_id AS VARCHAR) AS file, n AS packet, CAST(28 + 20 * n + coalesce(sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
 CASE WHEN n % 12 = 0 THEN 'K' ELSE 'P' END AS kind, CAST(1 + event_id % 200 AS INTEGER) AS q_y, s AS payload_size, CAST(5 AS BIGINT) AS video_bytes, s - 5 AS audio_bytes, concat(event_type, event_id) AS payload FROM e""")
def stream_packets(t):
    ship(t.spark)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("event_id")
        packets = [{"kind": "P" if n % 12 else "K", "q_y": 1 + e % 200, "q_uv": 9, "bit_length": 40, "payload": p.encode()} for n, (e, p) in enumerate(zip(part["event_id"].tolist(), part["payload"], strict=True))]
        head = {"width": 64, "height": 48, "fps_num": 24, "fps_den": 1, "audio_codec": "pcm_u8", "audio_rate": 16000}
        return pd.DataFrame({"file": [str(part["user_id"].iloc[0])], "content": [containers.write_hlv(head, packets)]})

    rows = t.events.select("user_id", "event_id", F.concat("event_type", F.col("event_id").cast("string")).alias("payload"))
    out = B.rows(rows.groupBy("user_id").applyInPandas(build, "file string, content binary"), containers.hlv_packets, containers.HLV_PACKET)
    return out.select("file", "packet", "offset", "kind", "q_y", "payload_size", "video_bytes", "audio_bytes", F.col("payload").cast("string").alias("payload"))


@query("""WITH g AS (SELECT f, x, y, (3 * x + 5 * y + 7 * f + 11 * n_nationkey) & 255 AS v, n_nationkey AS k FROM nation, range(0, 3) AS a(f), range(0, 16) AS b(x), range(0, 8) AS c(y))
 SELECT k AS file, f AS frame, CAST(sum((v - 128) * (v - 128)) AS BIGINT) AS sse_y, count(*) AS n_y, CAST(0 AS BIGINT) AS sse_u FROM g GROUP BY 1, 2""")
def raw_frames(t):
    ship(t.spark)

    @F.pandas_udf("binary")
    def build(keys: pd.Series) -> pd.Series:
        return pd.Series([containers.write_y4m(16, 8, 24, 1, [(sinks.pattern(16, 8, f, 11 * k), bytes(32), bytes(32)) for f in range(3)]) for k in keys])

    files = t.nation.select(F.col("n_nationkey").cast("string").alias("file"), build("n_nationkey").alias("content"))
    frames = B.rows(files, containers.y4m_frames, containers.Y4M_FRAME).withColumn("frame", F.col("frame") + 10 * F.col("file").cast("long"))
    flat = frames.withColumn("y", F.lit(bytearray([128]) * 128))
    return blocks.plane_errors(frames, flat).select(F.floor(F.col("frame") / 10).cast("int").alias("file"), (F.col("frame") % 10).alias("frame"), "sse_y", "n_y", "sse_u")


@query("""SELECT lower(n_name) AS name, concat('it''s # ', n_nationkey) AS input, CAST(16 * (n_nationkey + 1) AS INTEGER) AS width, CAST(24 AS DOUBLE) AS fps, n_nationkey / 4.0 AS "toleranceDb", n_nationkey % 2 = 0 AS audio, CAST(NULL AS INTEGER) AS gop FROM nation""")
def configured_videos(t):
    lines = ["# made from nation", "version: 1", "outputDirectory: out", "videos:"]
    for r in t.nation.orderBy("n_nationkey").collect():  # a configuration is a short file
        lines += [f"  - name: {r.n_name.lower()}  # {r.n_nationkey}", f"    input: 'it''s # {r.n_nationkey}'", f"    width: {16 * (r.n_nationkey + 1)}", "    fps: 24", f"    toleranceDb: {r.n_nationkey / 4}", f"    audio: {r.n_nationkey % 2 == 0}", "    gop: ~"]
    return tabular.config_frame(t.spark, tabular.transcode_config("\n".join(lines))).select("name", "input", "width", "fps", "toleranceDb", "audio", "gop")


def _avi(t):
    """A file for each nation: ten video packets of growing size, one of audio after each second."""
    ship(t.spark)

    @F.pandas_udf("binary")
    def build(keys: pd.Series) -> pd.Series:
        packets = [p for i in range(10) for p in ([("V", bytes(5 + i))] + [("A", bytes(3))] * (i % 2))]
        return pd.Series([containers.write_avi(32 + int(k), 24, 30000, 1001, packets) for k in keys])

    return t.nation.select(F.col("n_nationkey").cast("string").alias("file"), build("n_nationkey").alias("content"))


_PACKETS = """p AS (SELECT CAST(n_nationkey AS VARCHAR) AS file, k, i, CASE k WHEN 'V' THEN 5 + i ELSE 3 END AS size, row_number() OVER (PARTITION BY n_nationkey ORDER BY i, k DESC) - 1 AS n FROM nation, range(0, 10) AS r(i), (VALUES ('V'), ('A')) AS v(k) WHERE k = 'V' OR i % 2 = 1),
 o AS (SELECT *, coalesce(sum(8 + size + size % 2) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)"""


@query(f"""WITH {_PACKETS} SELECT file, n AS packet, k AS kind, size, CAST(before + 8 AS BIGINT) AS inside FROM o""")
def avi_packets(t):
    files = _avi(t)
    movi = B.rows(files, containers.avi_headers, containers.AVI_HEADER).select("file", "movi_start")
    out = B.rows(files, containers.avi_packets, containers.AVI_PACKET).join(movi, "file")
    return out.select("file", "packet", "kind", "size", (F.col("offset") - F.col("movi_start")).alias("inside"))


@query(f"""WITH {_PACKETS} SELECT file, n AS entry, CASE k WHEN 'V' THEN '00dc' ELSE '01wb' END AS chunk, CASE k WHEN 'V' THEN CAST(16 AS BIGINT) ELSE 0 END AS flags, CAST(before + 4 AS BIGINT) AS "offset", size FROM o""")
def avi_entries(t):
    return B.rows(_avi(t), containers.avi_index, containers.AVI_INDEX)


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS file, 32 + n_nationkey AS width, 24 AS height, 'MJPG' AS compression, CAST(10 AS BIGINT) AS length, CAST(30000 AS BIGINT) AS fps_num, CAST(1001 AS BIGINT) AS fps_den, 'pcm_u8' AS audio, 8000 AS sample_rate FROM nation""")
def avi_players(t):
    heads = B.rows(_avi(t), containers.avi_headers, containers.AVI_HEADER)
    return containers.avi_adapter(heads, containers.MJPEG_CODES).where("accepted").select("file", "width", "height", "compression", "length", "fps_num", "fps_den", "audio", F.col("sample_rate").cast("int").alias("sample_rate"))


@query("""WITH e AS (SELECT user_id, event_id, length(event_type) AS s, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT CAST(user_id AS VARCHAR) AS file, CAST(n * 6 + (n - 1) * 12 + coalesce(sum(s) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
 CAST(event_id % 65536 AS INTEGER) AS seq, CAST(s AS INTEGER) AS size, event_id % 9 <> 0 AS valid FROM e""")
def framed_records(t):
    ship(t.spark)

    def build(part: pd.DataFrame) -> pd.DataFrame:
        out = b""
        for e, kind in part.sort_values("event_id")[["event_id", "event_type"]].itertuples(index=False):
            record = bytearray(containers.write_framed([(e % 65536, kind.encode())]))
            if e % 9 == 0:
                record[-1] ^= 1  # damaged on the line
            out += b"noise." + bytes(record)
        return pd.DataFrame({"file": [str(part["user_id"].iloc[0])], "content": [out]})

    files = t.events.select("user_id", "event_id", "event_type").groupBy("user_id").applyInPandas(build, "file string, content binary")
    return B.rows(files, containers.framed, containers.FRAMED).select("file", "offset", "seq", "size", "valid")


# Kernels

_SIXTEEN = "list_transform(range(1, 17), lambda k: (p_partkey * k * 37 + p_size * k) % 256)"


def _sixteen(t):
    return t.part.select("p_partkey", F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: ((F.col("p_partkey") * k * 37 + F.col("p_size") * k) % 256).cast("int")).alias("v"))


_SIGN = "[[1, 1, 1, 1], [1, -1, 1, -1], [1, 1, -1, -1], [1, -1, -1, 1]]"


@query(f"""WITH p AS (SELECT p_partkey, {_SIXTEEN} AS v FROM part), c AS (SELECT p_partkey, i, j, sum(v[a * 4 + b + 1] * {_SIGN}[i + 1][a + 1] * {_SIGN}[j + 1][b + 1]) AS w FROM p, range(0, 4) AS r(i), range(0, 4) AS s(j), range(0, 4) AS t(a), range(0, 4) AS u(b) GROUP BY ALL)
 SELECT p_partkey, string_agg(CAST(CAST(w AS BIGINT) AS VARCHAR), ',' ORDER BY i, j) AS transformed, string_agg(CAST(CAST(sign(w) * floor((abs(w) + 6) / 12) AS BIGINT) AS VARCHAR), ',' ORDER BY i, j) AS quantized, true AS inverse FROM c GROUP BY 1""")
def block_transform(t):
    ship(t.spark)

    @F.pandas_udf("transformed string, quantized string, inverse boolean")
    def run(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_numpy()).reshape(-1, 4, 4)
        w = blocks.wht4(x)
        text = lambda a: [",".join(map(str, r)) for r in a.reshape(len(a), -1).tolist()]
        return pd.DataFrame({"transformed": text(w), "quantized": text(blocks.quantize(w, 12)), "inverse": (blocks.wht4_inverse(w) == x).all((1, 2))})

    return _sixteen(t).withColumn("r", run("v")).select("p_partkey", "r.*")


@query("""WITH v AS (SELECT event_id, event_id % 1000 AS u, event_id % 401 - 200 AS s FROM events), c AS (SELECT event_id, bin(u + 1) AS a, bin(CASE WHEN s > 0 THEN 2 * s ELSE 1 - 2 * s END) AS b FROM v) SELECT event_id, concat(repeat('0', length(a) - 1), a) AS ue, concat(repeat('0', length(b) - 1), b) AS se FROM c""")
def golomb_codes(t):
    ship(t.spark)

    @F.pandas_udf("ue string, se string")
    def run(n: pd.Series) -> pd.DataFrame:
        def code(put, v):
            w = getattr(blocks.BitWriter(), put)(v)
            assert getattr(blocks.BitReader(w.bytes()), put)() == v
            return f"{w.value:0{w.bits}b}"

        return pd.DataFrame({"ue": [code("ue", int(e % 1000)) for e in n], "se": [code("se", int(e % 401 - 200)) for e in n]})

    return t.events.select("event_id", run("event_id").alias("r")).select("event_id", "r.*")


@query(f"""WITH p AS (SELECT p_partkey, {_SIXTEEN} AS v FROM part), d AS (SELECT p_partkey, abs(v[r * 4 + c + 1] - v[r * 4 + c]) + abs(v[r * 4 + c + 1] - v[r * 4 - 4 + c + 1]) AS d FROM p, (VALUES (1), (3)) AS a(r), (VALUES (1), (3)) AS b(c)) SELECT p_partkey, sum(d) / 8.0 AS detail FROM d GROUP BY 1""")
def detail_scores(t):
    ship(t.spark)
    run = F.pandas_udf(lambda v: pd.Series([blocks.detail_score(np.array(x).reshape(4, 4)) for x in v]), "double")
    return _sixteen(t).select("p_partkey", run("v").alias("detail"))


@query(f"""WITH p AS (SELECT p_partkey, {_SIXTEEN} AS v FROM part) SELECT p_partkey, CAST(list_transform(v, lambda x: least((x + 2) // 4, 63) * 4) AS VARCHAR) AS luma, CAST(list_transform(v, lambda x: least((x + 4) // 8, 31) * 8) AS VARCHAR) AS chroma FROM p""")
def packed_samples(t):
    ship(t.spark)

    @F.pandas_udf("luma string, chroma string")
    def run(v: pd.Series) -> pd.DataFrame:
        rows = [np.array(x, np.uint8) for x in v]
        back = lambda bits: [str(samples.unpack(samples.pack(r, bits), bits, len(r)).tolist()) for r in rows]
        return pd.DataFrame({"luma": back(6), "chroma": back(5)})

    return _sixteen(t).withColumn("r", run("v")).select("p_partkey", "r.*")


@query(f"""WITH RECURSIVE c AS (SELECT [{", ".join(map(str, audio.STEPS.tolist()))}] AS steps, [{", ".join(map(str, audio.INDEX_STEP.tolist()))}] AS moves), p AS (SELECT p_partkey, md5(p_name || p_partkey) AS h FROM part),
 f AS (SELECT p_partkey, h, 0 AS n, CAST(p_partkey % 1000 AS BIGINT) AS v, CAST(p_partkey % 60 AS BIGINT) AS i FROM p UNION ALL SELECT p_partkey, h, n + 1, greatest(-32768, least(32767, CASE WHEN code >= 8 THEN v - d ELSE v + d END)), greatest(0, least(88, i + moves[code + 1])) FROM
 (SELECT *, (s >> 3) + CASE WHEN code & 4 > 0 THEN s ELSE 0 END + CASE WHEN code & 2 > 0 THEN s >> 1 ELSE 0 END + CASE WHEN code & 1 > 0 THEN s >> 2 ELSE 0 END AS d FROM
 (SELECT f.*, moves, steps[i + 1] AS s, CAST(position(substring(h, n + 1, 1) IN '0123456789abcdef') - 1 AS INTEGER) AS code FROM f, c WHERE n < 32)))
 SELECT p_partkey, string_agg(CAST(v AS VARCHAR), ',' ORDER BY n) AS samples FROM f GROUP BY 1""")
def adpcm_blocks(t):
    ship(t.spark)
    swapped = F.regexp_replace(F.md5(F.concat("p_name", F.col("p_partkey").cast("string"))), "(.)(.)", "$2$1")  # low nibble first
    head = F.concat(*[F.lpad(F.hex(v), 2, "0") for v in (F.col("p_partkey") % 1000 % 256, F.floor(F.col("p_partkey") % 1000 / 256), F.col("p_partkey") % 60)], F.lit("002100"))
    return t.part.select("p_partkey", F.array_join(audio.adpcm_samples(F.unhex(F.concat(head, swapped))).cast("array<string>"), ",").alias("samples"))


_PIXELS = "list_transform(range(1, 17), lambda k: (p_partkey * k * 7919 + p_size * 104729) % 16777216)"


def _pixels(t):
    return t.part.select("p_partkey", F.transform(F.sequence(F.lit(1), F.lit(16)), lambda k: ((F.col("p_partkey") * k * 7919 + F.col("p_size") * 104729) % 16777216).cast("int")).alias("pixels"))


@query(f"""WITH p AS (SELECT p_partkey, unnest({_PIXELS}) AS c FROM part) SELECT p_partkey, round(avg(c >> 16 & 255), 6) AS r, round(avg(c >> 8 & 255), 6) AS g, round(avg(c & 255), 6) AS b, round(stddev_pop(c >> 16 & 255), 6) AS dr, round(stddev_pop(c >> 8 & 255), 6) AS dg, round(stddev_pop(c & 255), 6) AS db FROM p GROUP BY 1""")
def block_descriptors(t):
    ship(t.spark)
    run = F.pandas_udf(lambda v: pd.Series([P.descriptor(x).tolist() for x in v], dtype=object), "array<double>")
    return _pixels(t).withColumn("d", run("pixels")).select("p_partkey", *[F.round(F.get("d", F.lit(i)), 6).alias(n) for i, n in enumerate(("r", "g", "b", "dr", "dg", "db"))])


@query("""WITH b AS (SELECT p_size AS palette, p_partkey, p_partkey % 5 AS bx, p_partkey % 3 AS "by" FROM part), c AS (SELECT palette, (p_partkey * 3 + k) % 16 AS colour FROM b, range(0, 16) AS r(k) WHERE bx * 4 + k % 4 < 18 AND "by" * 4 + k // 4 < 10) SELECT palette, colour, count(*) AS pixels FROM c GROUP BY 1, 2""")
def palette_usage(t):
    colours = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: (F.col("p_partkey") * 3 + k) % 16)
    rows = t.part.select(F.col("p_size").alias("palette"), (F.col("p_partkey") % 5).alias("bx"), (F.col("p_partkey") % 3).alias("by"), colours.alias("colours"))
    return P.usage(rows, ["palette"], "colours", P.inside("bx", "by", 18, 10))


_BANKS = np.array([[[0, 0, 0], [255, 0, 0], [0, 255, 0]], [[0, 0, 255], [255, 255, 255], [128, 128, 128]], [[64, 64, 64], [200, 100, 50], [10, 200, 190]]])


@query(f"""WITH b(palette, r, g, b) AS (VALUES {", ".join(f"({i}, {r}, {g}, {b})" for i, bank in enumerate(_BANKS.tolist()) for r, g, b in bank)}), p AS (SELECT p_partkey, i, c FROM part, LATERAL (SELECT unnest({_PIXELS}) AS c, unnest(range(0, 16)) AS i)),
 m AS (SELECT p_partkey, i, (c >> 16 & 255) // 16 * 16 + 8 AS r, (c >> 8 & 255) // 16 * 16 + 8 AS g, (c & 255) // 16 * 16 + 8 AS b FROM p), d AS (SELECT p_partkey, i, palette, min((m.r - b.r) * (m.r - b.r) + (m.g - b.g) * (m.g - b.g) + (m.b - b.b) * (m.b - b.b)) AS d FROM m, b GROUP BY 1, 2, 3),
 s AS (SELECT p_partkey, palette, sum(d) AS d FROM d GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY d, palette) AS p FROM s) SELECT p_partkey, palette FROM r WHERE p = 1""")
def nearest_palettes(t):
    return motion.nearest_palettes(_pixels(t), "p_partkey", "pixels", _BANKS)


@query("""WITH b AS (SELECT event_id // 60 AS frame, event_id % 60 % 10 AS x, event_id % 60 // 10 AS y, event_id * event_id % 7 AS c FROM events), s AS (SELECT dy, dx, greatest(abs(dy), abs(dx)) AS ring FROM range(-2, 3) AS a(dy), range(-2, 3) AS b(dx) WHERE dy <> 0 OR dx <> 0),
 m AS (SELECT b.frame, b.x, b.y, dy, dx, row_number() OVER (PARTITION BY b.frame, b.x, b.y ORDER BY ring, dy, dx) AS i FROM b, s JOIN b o ON o.frame = b.frame - 1 AND o.c = b.c AND o.x = b.x + dx AND o.y = b.y + dy) SELECT frame, x, y, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx FROM m WHERE i = 1""")
def exact_motion(t):
    e = F.col("event_id")
    grid = t.events.select(F.floor(e / 60).alias("frame"), (e % 60 % 10).alias("x"), F.floor(e % 60 / 10).alias("y"), (e * e % 7).alias("c"))
    return P.exact_motion(grid, "frame", "x", "y", "c", 2)


# Searches

_RATES = (105.0, 333.3, 900.0, 4000.0)


@query(f"""WITH c AS (SELECT n_nationkey, k AS control, 100 * pow(1.09, k) + n_nationkey + k AS rate FROM nation, range(0, 40) AS r(k)), t(target) AS (VALUES {", ".join(f"(CAST({x} AS DOUBLE))" for x in _RATES)}),
 r AS (SELECT *, row_number() OVER (PARTITION BY n_nationkey, target ORDER BY abs(rate - target), -rate) AS p FROM c, t) SELECT n_nationkey, target, control, round(rate, 6) AS rate FROM r WHERE p = 1""")
def nearest_controls(t):
    curve = t.nation.join(F.broadcast(t.spark.range(40).toDF("control"))).select("n_nationkey", "control", (100 * F.pow(F.lit(1.09), F.col("control")) + F.col("n_nationkey") + F.col("control")).alias("rate"))
    return search.nearest_controls(curve, ["n_nationkey"], "control", "rate", list(_RATES)).select("n_nationkey", "target", "control", F.round("rate", 6).alias("rate"))
