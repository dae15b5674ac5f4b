"""Predicates that guard inputs, and the labels that results are known by. All stay in the JVM; a null value fails no range and no name."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import col

# The closed range of each encoder option. A bound in OPEN doesn't belong to its range.
RANGES = {
    "quality": (1, 100),
    "qstep_y": (0, 2040),
    "qstep_uv": (0, 2040),
    "gop": (1, None),
    "search": (0, 64),
    "max_frames": (0, None),
    "min_key_interval": (1, None),
    "keyframe_bias": (1.0, 1.25),
    "bitrate_kbps": (0, 100000),
    "syntax": (14, 15),
    "chroma_scale": (0.25, 4.0),
    "rd_luma_weight": (1, 16),
    "rd_lambda_scale": (0.0, 16.0),
    "decode_cycle_weight": (0.0, 4.0),
    "ac_deadzone": (0.5, 2.0),
    "motion_candidates": (1, 8),
    "threads": (1, 8),
    "target_psnr": (0.0, 70.0),
    "psnr_min": (20.0, 60.0),
    "psnr_max": (20.0, 60.0),
    "cq_trials": (2, 10),
    "two_pass_window_seconds": (0.0, 120.0),
    "two_pass_trials": (2, 10),
    "audio_rate": (1000, 65535),
}
OPEN = {"rd_lambda_scale": 0.0}
#: Rules between options, by the name that a breach is reported under, and the options that each needs.
RULES = {
    "qstep_uv without qstep_y": (("qstep_y", "qstep_uv"), lambda o: (o["qstep_uv"] != 0) & (o["qstep_y"] == 0)),
    "min_key_interval not below gop": (("min_key_interval", "gop"), lambda o: o["min_key_interval"] >= o["gop"]),
    "psnr_min above psnr_max": (("psnr_min", "psnr_max"), lambda o: o["psnr_min"] > o["psnr_max"]),
    "two_pass without bitrate": (("two_pass_window_seconds", "bitrate_kbps"), lambda o: (o["two_pass_window_seconds"] > 0) & (o["bitrate_kbps"] == 0)),
    "bitrate with target_psnr": (("bitrate_kbps", "target_psnr"), lambda o: (o["bitrate_kbps"] != 0) & (o["target_psnr"] > 0)),
}
VIDEO_SUFFIXES = (".hlv", ".avi", ".bpv1", ".mpg", ".mpeg", ".txt")
#: Bytes that a file of a suffix begins with, each at its offset.
MAGIC = {".hlv": ((0, b"HLV1"),), ".bpv1": ((0, b"BPV1"),), ".avi": ((0, b"RIFF"), (8, b"AVI ")), ".mpg": ((0, b"\x00\x00\x01\xba"),), ".mpeg": ((0, b"\x00\x00\x01\xba"),)}
NAME_LENGTH = 48


def option_faults(options: dict[str, Column]) -> Column:
    """An array of the options out of range and of the rules broken, of those options that are given; empty where all is well."""
    found = []
    for name, value in options.items():
        low, high = RANGES[name]
        bad = value <= low if name in OPEN else value < low
        found.append(F.when(bad if high is None else bad | (value > high), F.lit(name)))
    found += [F.when(broken(options), F.lit(name)) for name, (needs, broken) in RULES.items() if all(n in options for n in needs)]
    return F.array_compact(F.array(*found))


def has_suffix(name, suffixes=VIDEO_SUFFIXES) -> Column:
    """Whether a name ends in one of the suffixes, whatever its case."""
    low = F.lower(col(name))
    out = F.lit(False)
    for s in suffixes:
        out = out | low.endswith(s.lower())
    return out


def valid_name(name, suffixes=VIDEO_SUFFIXES, most: int = NAME_LENGTH) -> Column:
    """Whether a remote name is ASCII letters, digits, dots, dashes and underscores after a letter or digit, with a known suffix and
    something before it, no longer than `most`."""
    name = col(name)
    plain = name.rlike(r"\A[0-9A-Za-z][0-9A-Za-z._-]*\z")  # so a suffix, which begins with a dot, has something before it
    return plain & has_suffix(name, suffixes) & (F.length(name) <= most)


def magic_matches(name, content) -> Column:
    """Whether the content begins as files of the name's suffix do; true for a suffix without a rule."""
    name, content = F.lower(col(name)), col(content)
    out = F.lit(True)
    for suffix, rules in MAGIC.items():
        good = F.lit(True)
        for at, want in rules:
            good = good & (F.substring(content, at + 1, len(want)) == F.lit(bytearray(want)))
        out = F.when(name.endswith(suffix), good).otherwise(out)
    return out


def setting_label(codec, value) -> Column:
    """The setting of a result: lambda for the palette codec, q for the MPEG family, crf for all others."""
    codec, value = col(codec), col(value).cast("string")
    kind = F.when(codec == "bpv", "lambda").when(codec.isin("mjpeg", "mpeg1", "mpeg2"), "q").otherwise("crf")
    return F.concat(kind, F.lit("="), value)


def short(v) -> Column:
    """A number between a millionth and a million with up to six significant digits and no trailing zeros."""
    v = col(v).cast("double")
    places = F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.abs(v))))
    digits = (F.round(v * places) / places).cast("decimal(38,12)").cast("string")
    return F.when(v == 0, F.lit("0")).otherwise(F.regexp_replace(F.regexp_replace(digits, r"0+$", ""), r"\.$", ""))


def encoder_label(quantizer: Column, preset, syntax, chroma_scale, luma_weight, lambda_scale, deadzone) -> Column:
    """The long label of the block codec's results, from its quantizer's label and its options."""
    parts = [quantizer, col(preset), F.concat(F.lit("v="), col(syntax).cast("string"))]
    parts += [F.concat(F.lit(f"{k}="), short(v)) for k, v in (("cs", chroma_scale), ("lw", luma_weight), ("ls", lambda_scale), ("dz", deadzone))]
    return F.concat_ws(",", *parts)


def clamped_duration(duration, limit) -> Column:
    """A duration cut at a limit; a limit of zero or less is none."""
    return F.when(col(limit) > 0, F.least(col(duration), col(limit))).otherwise(col(duration))


def peak_gain(target_db, peak_db, most: float = 20 * math.log10(64)) -> Column:
    """Gain in dB that brings a peak to the target, null where it lies outside 0 .. most."""
    gain = col(target_db) - col(peak_db)
    return F.when((gain >= 0) & (gain <= most), gain)


def counts_agree(*pairs: tuple[str, str]) -> Column:
    """Whether two tools counted alike, pair by pair; a count that one lacks doesn't agree."""
    out = F.lit(True)
    for a, b in pairs:
        out = out & col(a).eqNullSafe(col(b))
    return out
