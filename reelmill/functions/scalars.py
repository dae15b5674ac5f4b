"""Guarded column expressions: rates, rounding rules, signal levels, colour, bit tricks.

All stay in the JVM. Division by zero, log of zero and the three rounding rules (half to even, half away from zero, half up) are
explicit, since engines differ in each.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clamp(v, low, high) -> Column:
    return F.least(F.greatest(col(v), F.lit(low)), F.lit(high))


def ratio(part, whole, default: float | None = 0.0) -> Column:
    """part / whole as double; `default` where whole is zero or null."""
    whole = col(whole).cast("double")
    return F.when(whole != 0, col(part).cast("double") / whole).otherwise(F.lit(default).cast("double"))


def percent(part, whole) -> Column:
    return F.lit(100.0) * ratio(part, whole)


def bitrate_kbps(size, seconds) -> Column:
    return ratio(col(size) * 8, seconds, None) / 1000


def fps(frames, seconds) -> Column:
    return ratio(frames, seconds, None)


def error_percent(actual, target) -> Column:
    return 100 * ratio(col(actual) - col(target), target, None)


def frames_of(seconds, rate) -> Column:
    """At least one frame; half a frame counts up."""
    return F.greatest(F.lit(1), F.floor(col(seconds) * col(rate) + 0.5)).cast("long")


def window_frames(rate, window, frames) -> Column:
    """Frames of a window, half to even."""
    length = F.least(F.lit(float(window)), ratio(frames, rate))
    return F.greatest(F.lit(1), F.bround(col(rate) * length, 0)).cast("long")


def cycles_to_us(cycles, mhz: float = 240.0) -> Column:
    return F.bround(col(cycles) / F.lit(mhz), 0).cast("long")


def bits_per_pixel(size, width, height, frames) -> Column:
    return ratio(col(size) * 8, col(width) * col(height) * col(frames), None)


def rational_start(i, rate: int, num: int, den: int) -> Column:
    """Samples before frame i at `rate` samples and num/den frames a second, without drift: floor(i * rate * den / num)."""
    return F.floor(col(i).cast("decimal(38,0)") * F.lit(rate * den) / F.lit(num)).cast("long")


def rational_count(i, rate: int, num: int, den: int) -> Column:
    return rational_start(col(i) + 1, rate, num, den) - rational_start(i, rate, num, den)


def floor_div(a, b) -> Column:
    """Rounds towards minus infinity, unlike div."""
    return F.floor(col(a) / col(b)).cast("long")


def round_div(a, b) -> Column:
    """Integer division that rounds halves away from zero, whatever the sign; b is positive."""
    a, b = col(a).cast("long"), col(b).cast("long")
    return (F.sign(a) * F.floor((F.abs(a) + F.floor(b / 2)) / b)).cast("long")


def gcd(a, b) -> Column:
    """Greatest common divisor of two integers, zero if both are: Euclid's steps, at most 92 for 64 bits."""
    pair = F.struct(F.abs(col(a).cast("long")).alias("x"), F.abs(col(b).cast("long")).alias("y"))
    step = lambda p, _: F.when(p["y"] == 0, p).otherwise(F.struct(p["y"].alias("x"), (p["x"] % p["y"]).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), pair, step, lambda p: p["x"])


def smoothstep(low: float, high: float, v) -> Column:
    t = clamp((col(v) - low) / (high - low), 0.0, 1.0)
    return t * t * (3 - 2 * t)


def quality_steps(quality) -> tuple[Column, Column]:
    """Luma and chroma quantizer steps of a quality, clamped to 1 to 100 first; halves round away from zero."""
    raw = F.round(F.pow(F.lit(2.0), (F.lit(100.0) - clamp(quality, 1, 100)) / 12.5), 0)
    return clamp(raw, 1, 255).cast("int"), clamp(F.round(raw * 1.35, 0), 1, 255).cast("int")


def adaptive_target(base: float, span: float, motion, detail, cut=None) -> Column:
    """A quality target that falls from base by up to span with motion and detail; on a scene cut at least 0.6 of the span stays."""
    m, d = smoothstep(0.75, 12.0, motion), smoothstep(4.0, 28.0, detail)
    stress = m * (F.lit(0.7) + 0.3 * d)
    if cut is not None:
        stress = F.when(col(cut), F.least(stress, F.lit(0.4))).otherwise(stress)
    return F.lit(base) - span * stress


def psnr(sse, samples, on_zero: float | None = float("inf"), peak: float = 255.0) -> Column:
    """10 log10(peak^2 n / sse); the value for sse = 0 is a convention: inf, 99, 0 or null."""
    sse = col(sse).cast("double")
    return F.when(sse > 0, 10 * F.log10(F.lit(peak * peak) * col(samples) / sse)).otherwise(F.lit(on_zero).cast("double"))


def sse(a, b) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)


def luma(r, g, b) -> Column:
    return 77 * col(r) + 150 * col(g) + 29 * col(b)


def rgb565(r, g, b) -> Column:
    return F.shiftleft(F.shiftright(col(r), 3), 11).bitwiseOR(F.shiftleft(F.shiftright(col(g), 2), 5)).bitwiseOR(F.shiftright(col(b), 3))


def yuv_to_rgb(y, u, v) -> list[Column]:
    """BT.601 full range, half up, clamped."""
    y, u, v = col(y).cast("double"), col(u) - 128.0, col(v) - 128.0
    full = (y + 1.402 * v, y - 0.344136 * u - 0.714136 * v, y + 1.772 * u)
    return [clamp(F.floor(c + 0.5), 0, 255).cast("int") for c in full]


def bank_bits(n) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.log2(F.greatest(col(n), F.lit(1)).cast("double")))).cast("int")


def size_label(n) -> Column:
    """Bytes, KiB with one digit or MiB with two, halves to even."""
    n = col(n)
    return F.when(n < 1024, F.format_string("%d B", n.cast("long"))).when(n < 1 << 20, F.format_string("%.1f KiB", F.bround(n / 1024.0, 1))).otherwise(F.format_string("%.2f MiB", F.bround(n / 1048576.0, 2)))


def fixed(v, digits: int) -> Column:
    """Fixed digits, halves of the shortest decimal form to even; infinity as inf, null as null."""
    v = col(v).cast("double")
    even = F.bround(v.cast("decimal(38,12)"), digits).cast("string")
    plain = F.format_string(f"%.{digits}f", v)
    return F.when(v == float("inf"), F.lit("inf")).when(F.abs(v) < 1e25, even).when(v.isNotNull(), plain)


def exact_sum(v, scale: int = 2) -> Column:
    """Sum by way of decimals, so that the order of rows can't change it."""
    return F.sum(col(v).cast(f"decimal(18,{scale})")).cast("double")


def payload_byte(seq, i, baud) -> Column:
    """Byte i of a link test's payload."""
    return (col(seq) * 131 + col(i) * 17 + col(baud) + F.shiftright(col(i), 3)).bitwiseAND(255)
