"""Device telemetry lines to typed rows. The same expressions serve batch and streaming frames with a column `value`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ordered import gaps

# The fields of each record, in order.
FRAME = ("frame", "sd_us", "decode_us", "render_us", "work_us", "present_us", "bpv_input_us", "bpv_block_us", "bpv_reference_us", "bpv_input_calls", "bpv_input_bytes")
AUDIO = ("frame", "queued", "pending", "played", "rebuffers", "underrun_samples", "silence_chunks", "loop_events", "loop_chunks", "decode_frames", "decode_us", "convert_us")
VIDEO = ("width", "height", "fps_num", "fps_den", "audio_rate", "frames")
PROFILE = ("total_cycles", "input_cycles", "input_bytes", "input_refills", "crc_cycles", "prediction_cycles", "residual_cycles", "inverse_wht_cycles", "packing_cycles", "reference_commit_cycles", "row_guard_wait_us")
#: Fields of the forms that a frame record may have; the rest of a short form is zero.
FRAME_FORMS = (len(FRAME), 6)


def _record(letter: str, forms: tuple[int, ...]) -> str:
    """A pattern of a record with as many integers as one of its forms, the longest that fits."""
    return letter + "(?:" + "|".join(f"(?:,[0-9]+){{{n}}}" for n in sorted(forms, reverse=True)) + ")"


def _typed(df: DataFrame, text, names: tuple[str, ...], arities: tuple[int, ...]) -> DataFrame:
    """Columns `names` of the comma-separated `text`; other arities and non-integers are dropped, absent fields are zero."""
    rest = [c for c in df.columns if c != "value"]
    out = df.withColumn("__f", F.split(text, ",")).where(F.size("__f").isin([n + 1 for n in arities]))
    values = F.transform(F.slice("__f", 2, len(names)), lambda f: F.trim(f).try_cast("bigint"))
    out = out.withColumn("__v", values).where(~F.exists("__v", lambda v: v.isNull()))
    return out.select(*rest, *[F.coalesce(F.get("__v", F.lit(i)), F.lit(0)).cast("long").alias(n) for i, n in enumerate(names)])


def frames(lines: DataFrame) -> DataFrame:
    """Frame records found anywhere in a line, since another core may write into it."""
    found = lines.withColumn("__m", F.explode(F.regexp_extract_all("value", F.lit(_record("F", FRAME_FORMS)), F.lit(0))))
    return _typed(found, F.col("__m"), FRAME, FRAME_FORMS).drop("__m")


def audio(lines: DataFrame) -> DataFrame:
    return _typed(lines.where(F.col("value").startswith("A,")), F.col("value"), AUDIO, (9, 11, 12))


def video(lines: DataFrame) -> DataFrame:
    """From a `V,` anywhere in the line; a frame rate must be positive."""
    at = F.instr("value", "V,")
    return _typed(lines.where(at > 0), F.expr("substring(value, instr(value, 'V,'))"), VIDEO, (6,)).where("fps_num > 0 AND fps_den > 0")


def profile(lines: DataFrame) -> DataFrame:
    return _typed(lines.where(F.col("value").startswith("H,")), F.col("value"), PROFILE, (11,))


def errors(lines: DataFrame) -> DataFrame:
    """title and detail of status lines whose title tells of an error."""
    f = F.split(F.col("value"), ",", 3)
    out = lines.where(F.col("value").startswith("S,")).select(F.get(f, F.lit(1)).alias("title"), F.coalesce(F.get(f, F.lit(2)), F.lit("")).alias("detail"))
    return out.where(F.lower("title").contains("error"))


#: Marks of the lines that a player reports its own measurements with, and whether one may stand inside a line.
MEASURED = {"MRP": False, "MDP": False, "CRV": True, "CRG": True, "CRF": True}


def measurements(lines: DataFrame) -> DataFrame:
    """kind and fields (the integers after it, text that is none as null) of measurement lines; a mark inside a line begins one only
    where MEASURED says so, and the first mark counts."""
    at = F.coalesce(*[F.when((F.instr("value", f"{k},") > 0) if inside else F.col("value").startswith(f"{k},"), F.instr("value", f"{k},")) for k, inside in MEASURED.items()])
    rest = [c for c in lines.columns if c != "value"]
    found = lines.withColumn("__at", at).where("__at > 0").withColumn("__f", F.split(F.expr("substring(value, __at)"), ","))
    values = F.transform(F.slice("__f", 2, 1 << 20), lambda f: F.trim(f).try_cast("bigint"))
    return found.select(*rest, F.get("__f", F.lit(0)).alias("kind"), values.alias("fields"))


def missing_frames(records: DataFrame) -> DataFrame:
    return gaps(records, "frame")


def deadline_summary(records: DataFrame, period_us: int) -> DataFrame:
    """Frames, observed rate, frames over the deadline and frames without a render."""
    span = F.max("present_us") - F.min("present_us")
    return records.agg(
        F.count("*").alias("frames"),
        F.when(span > 0, (F.count("*") - 1) * 1e6 / span).alias("fps"),
        F.count_if(F.col("work_us") > period_us).alias("late"),
        F.count_if(F.col("render_us") == 0).alias("skipped"),
    )


def audio_accepted(records: DataFrame) -> DataFrame:
    """Whether the last audio record shows no rebuffer, underrun or silence."""
    last = records.agg(F.max_by(F.struct("rebuffers", "underrun_samples", "silence_chunks"), "frame").alias("r"))
    return last.select("r.*", ((F.col("r.rebuffers") == 0) & (F.col("r.underrun_samples") == 0) & (F.col("r.silence_chunks") == 0)).alias("accepted"))
