"""Sinks. Spark's commit protocol makes a table appear whole or not at all; reports are small by their nature and go through the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import fixed
from ..operators.sequences import top_cost

#: Rows of a report at most; a larger result belongs in a table.
REPORT_ROWS = 100_000


def write_results(df: DataFrame, path: str) -> None:
    """The same rows as JSON and as CSV, each replaced whole."""
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def append_results(df: DataFrame, path: str, batch: int) -> None:
    """Rows of one batch in a folder of their own: a batch that runs again replaces itself."""
    df.write.mode("overwrite").json(f"{path}/batch={batch}")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def markdown(df: DataFrame, digits: dict[str, int] | None = None) -> str:
    """A Markdown table; numbers with fixed digits where named, infinity as inf, null as an empty cell."""
    digits = digits or {}
    cells = df.select(*[F.coalesce(fixed(c, digits[c]) if c in digits else F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    rows = cells.take(REPORT_ROWS + 1)
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"more than {REPORT_ROWS} rows in a report")
    line = lambda v: "| " + " | ".join(v) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(list(r)) for r in rows)])


# The columns of each log and how a number is written; None for text and integers.
QUALITY_LOG = {"frame": None, "target_psnr": 4, "actual_psnr": 4, "motion_mad": 4, "raw_motion_mad": 4, "detail": 4, "q_y": None, "q_uv": None, "packet_bytes": None, "frame_type": None}
WINDOW_LOG = {"window": None, "first_frame": None, "frames": None, "trials": None, "chosen_q": None, "probe_bytes": None, "target_bytes": 0, "actual_bytes": None, "actual_kbps": 3, "relative_error": 6, "debt_bytes": 0}
PEAK_LOG = {"rank": None, "frame": None, "gop_start": None, "type": None, "video_bytes": None, "host_cycles": None}


def log_rows(df: DataFrame, log: dict[str, int | None]) -> DataFrame:
    """The log's columns in order, as text; a null is an empty field."""
    return df.select(*[F.coalesce(F.col(c).cast("string") if d is None else fixed(c, d), F.lit("")).alias(c) for c, d in log.items()])


def peak_frames(df: DataFrame, n: int = 128) -> DataFrame:
    """The n frames of most host_cycles, ties to the lower frame, with their rank, K or P as type."""
    top = top_cost(df.select("frame", "gop_start", F.when(F.col("keyframe"), "K").otherwise("P").alias("type"), "video_bytes", "host_cycles"), "host_cycles", ["frame"], n)
    return top.select(*PEAK_LOG)


def write_log(df: DataFrame, log: dict[str, int | None], path: str) -> None:
    write_csv(log_rows(df, log), path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file at a name that its reader expects, on any file system that Spark knows; an old one is replaced."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def pattern(width: int, height: int, frame: int, phase: int = 0) -> bytes:
    """Luma of a synthetic test frame: slanted ramps that move with the frame, the same everywhere and always."""
    y, x = np.mgrid[0:height, 0:width]
    return ((3 * x + 5 * y + 7 * frame + phase) & 255).astype("u1").tobytes()
