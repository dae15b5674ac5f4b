"""Result, manifest, timing and configuration files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "source string, duration_s double, frames int, codec string, setting string, bytes long, bitrate_kbps double, encode_s double, encode_fps double, decode_s double, decode_fps double, psnr_y double, psnr_u double, psnr_v double, psnr_avg double"
MATCHED = RESULT + ", target_kbps double, bitrate_error_pct double, ssim_y double, ssim_u double, ssim_v double, ssim_all double"
MANIFEST = "codec string, source string, filename string, frames int, fps double, enabled string, skip_reason string"


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def sources(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The files that glob patterns and plain names stand for, each once, in order of the patterns and then of name; what doesn't
    exist is left out, and none at all is an error. Listing is the file system's own, so any store will do."""
    found: dict[str, None] = {}
    for pattern in patterns:
        p = spark._jvm.org.apache.hadoop.fs.Path(pattern)
        for status in sorted(str(s.getPath()) for s in p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or ()):
            found[status] = None
    if not found:
        raise FileNotFoundError(f"no source matches {', '.join(patterns)}")
    return list(found)


def results(spark: SparkSession, path: str, matched: bool = False, report: bool = False, lines: bool = False) -> DataFrame:
    """Benchmark rows from JSON arrays, or from `lines` as the results sink writes them, infinite levels included; no file, no rows. Absent SSIM columns are zero. For a report, no rows
    are an error."""
    schema = MATCHED if matched else RESULT
    if not _exists(spark, path):
        if report:
            raise ValueError(f"no results in {path}")
        return spark.createDataFrame([], schema)
    out = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    if report and not out.limit(1).count():
        raise ValueError(f"no results in {path}")
    return out.fillna(0.0, [c for c in out.columns if c.startswith("ssim_")])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Enabled rows; a byte-order mark, blanks and case around `enabled` don't matter, and without the column all are enabled."""
    raw = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    raw = raw.toDF(*[c.lstrip("﻿").strip() for c in raw.columns])
    want = [f.split(" ") for f in MANIFEST.split(", ")]
    out = raw.select(*[(F.col(f"`{n}`") if n in raw.columns else F.lit(None)).cast(t).alias(n) for n, t in want])
    return out.where(F.lower(F.trim(F.coalesce("enabled", F.lit("true")))) != "false")


def timings(spark: SparkSession, path: str) -> DataFrame:
    """filename, window and integer columns of files named <filename>.<start|middle|end>.csv under `path`."""
    raw = spark.read.option("header", True).csv(path)
    name = F.regexp_extract_all(F.col("_metadata.file_name"), F.lit(r"^(.*)\.(start|middle|end)\.csv$"), F.lit(0))
    out = raw.withColumn("__n", F.get(name, F.lit(0)))
    part = lambda i: F.regexp_extract("__n", r"^(.*)\.(start|middle|end)\.csv$", i)
    return out.where(F.col("__n").isNotNull()).select(part(1).alias("filename"), part(2).alias("window"), *[F.col(f"`{c}`").cast("long").alias(c) for c in raw.columns])


def joined_windows(manifest_rows: DataFrame, timing_rows: DataFrame) -> DataFrame:
    """Each enabled test's three windows with their records; a window without records is an error."""
    spark = manifest_rows.sparkSession
    windows = spark.createDataFrame([("start",), ("middle",), ("end",)], "window string")
    wanted = manifest_rows.select("codec", "source", "filename", "fps", "frames").crossJoin(F.broadcast(windows))
    out = wanted.join(timing_rows, ["filename", "window"], "left")
    absent = F.raise_error(F.concat(F.lit("no timing records: "), F.col("filename"), F.lit(" "), F.col("window")))
    return out.withColumn("frame", F.when(F.col("frame").isNull(), absent.cast("long")).otherwise(F.col("frame")))


_NAMED = {"true": True, "false": False, "null": None, "~": None}


def _number(v: str) -> int | float | None:
    """What Python reads as a number, but for what configurations spell as text: underscores, other digits, inf, nan, integers beyond
    64 bits, and exponents without a point."""
    if not v or not set(v) <= set("+-.0123456789eE"):
        return None
    try:
        whole = int(v)
        return whole if -(1 << 63) <= whole < 1 << 63 else None
    except ValueError:
        pass
    try:
        return float(v) if "." in v else None
    except ValueError:
        return None


def scalar(text: str):
    """A configuration value: quoted text, true, false, null or ~ in any case, an integer, a decimal, or plain text."""
    v = text.strip()
    quote = v[:1]
    if quote in ("'", '"'):
        end = v.rfind(quote)
        if end != len(v) - 1 or end == 0:
            raise ValueError(f"unclosed quote: {text}")
        return v[1:end].replace(quote * 2, quote) if quote == "'" else v[1:end]
    if v.lower() in _NAMED:
        return _NAMED[v.lower()]
    number = _number(v)
    return v if number is None else number


def _uncommented(line: str) -> str:
    """The line up to a # that begins it or follows a blank, outside quotes. A quote opens where a value begins; a doubled one closes and
    opens again."""
    quote, before = None, " "
    for i, c in enumerate(line):
        if quote:
            quote = None if c == quote else quote
        elif c in "'\"" and before in (" ", c):
            quote = c
        elif c == "#" and before == " ":
            return line[:i].rstrip()
        before = c
    return line.rstrip()


# The keys a transcode configuration may have.
ROOT_KEYS = ("version", "outputDirectory", "summaryFile", "videos")
VIDEO_KEYS = ("name", "input", "width", "height", "fps", "format", "codec", "targetPsnrDb", "toleranceDb", "resizeMode", "audio", "threads", "gop", "minGop", "sceneThreshold", "candidatePalettes", "samplesPerFrame", "activePalettes")


def transcode_config(text: str) -> dict:
    """A two-level configuration: settings, then `videos:` with a list of maps. Tabs, other structure and unknown keys are errors."""
    out: dict = {"videos": None}
    for number, raw in enumerate(text.splitlines(), 1):
        if "\t" in raw:
            raise ValueError(f"line {number}: tab")
        line = _uncommented(raw)
        body = line.lstrip(" ")
        if not body:
            continue
        depth, videos = len(line) - len(body), out["videos"]
        item = videos is not None and body.startswith("- ")
        if item:
            videos.append({})
            body = body[2:].lstrip(" ")
        wanted = 0 if videos is None else 2 if item else 4
        name, colon, value = body.partition(":")
        if depth != wanted or not colon or not name.isalnum() or not name[0].isalpha() or videos == []:
            raise ValueError(f"line {number}: structure")
        value = value.strip()
        if videos is None and name == "videos" and not value:
            out["videos"] = []
            continue
        if name not in (ROOT_KEYS if videos is None else VIDEO_KEYS):
            raise ValueError(f"line {number}: unknown key {name}")
        if not value:
            raise ValueError(f"line {number}: no value")
        (out if videos is None else videos[-1])[name] = scalar(value)
    if not out["videos"]:
        raise ValueError("no videos")
    return out


def config_frame(spark: SparkSession, config: dict) -> DataFrame:
    """One row for each video of a configuration, absent settings null."""
    kinds = {"width": "int", "height": "int", "fps": "double", "targetPsnrDb": "double", "toleranceDb": "double", "audio": "boolean", "threads": "int", "gop": "int", "minGop": "int", "sceneThreshold": "double", "candidatePalettes": "int", "samplesPerFrame": "int", "activePalettes": "boolean"}
    rows = [tuple(float(v.get(k)) if kinds.get(k) == "double" and v.get(k) is not None else v.get(k) for k in VIDEO_KEYS) for v in config["videos"]]
    return spark.createDataFrame(rows, ", ".join(f"{k} {kinds.get(k, 'string')}" for k in VIDEO_KEYS))
