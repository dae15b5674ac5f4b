"""Colour spaces, sample quantizers and the costs of coded blocks, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import clamp, col, round_div

# The rows of each linear transform.
TO_YUV = ((16, 0.256788, 0.504129, 0.097906), (128, -0.148223, -0.290993, 0.439216), (128, 0.439216, -0.367788, -0.071427))
FROM_YUV = ((1.164383, 0.0, 1.596027), (1.164383, -0.391762, -0.812968), (1.164383, 2.017232, 0.0))
FROM_YUV_256 = ((298, 0, 409), (298, -100, -208), (298, 516, 0))
RGB_TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
LMS_TO_LAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
LAB_TO_LMS = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
LMS_TO_RGB = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))
DITHER = (0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5)
# Cycles of a macroblock's prediction a sample, by mode, and bits of its header that carry no residual.
PREDICTION = {"SKIP": 2, "SPLIT_INTER": 14, "SPLIT_JOINT": 14, "RECT_SPLIT": 10, "FILL": 2, "INTRA_DC": 4, "GRADIENT": 4, "PALETTE": 3}
HEADER_BITS = {"FILL": 32, "INTRA_DC": 8, "GRADIENT": 80}
NO_RESIDUAL = ("SKIP", "PALETTE", "LITERAL")
SAMPLES, RESIDUAL, INPUT, LITERAL_BYTES, FIXED = 384, 5, 8, 272, 100


def _linear(rows, values: list[Column]) -> list[Column]:
    out = []
    for row in rows:
        total = None
        for k, v in zip(row, values, strict=True):
            part = F.lit(k) * v
            total = part if total is None else total + part
        out.append(total)
    return out


def byte(v) -> Column:
    """Half up, clamped to a byte."""
    return clamp(F.floor(col(v) + 0.5), 0, 255).cast("int")


def rgb_to_yuv(r, g, b) -> list[Column]:
    """BT.601 studio range."""
    rgb = [col(c).cast("double") for c in (r, g, b)]
    return [byte(F.lit(float(row[0])) + v) for row, v in zip(TO_YUV, _linear([row[1:] for row in TO_YUV], rgb), strict=True)]


def yuv_to_rgb(y, u, v) -> list[Column]:
    """BT.601 studio range, in floating point."""
    return [byte(c) for c in _linear(FROM_YUV, [col(y) - 16.0, col(u) - 128.0, col(v) - 128.0])]


def yuv_to_rgb_256(y, u, v) -> list[Column]:
    """BT.601 studio range, in 256ths; luma under black is black."""
    parts = [F.greatest(F.lit(0), col(y).cast("int") - 16), col(u).cast("int") - 128, col(v).cast("int") - 128]
    return [clamp(F.shiftright(c + 128, 8), 0, 255).cast("int") for c in _linear(FROM_YUV_256, parts)]


def srgb_to_oklab(r, g, b) -> list[Column]:
    """L, a and b of a colour given in bytes."""
    unit = [col(c) / 255.0 for c in (r, g, b)]
    linear = [F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4))) for x in unit]
    return _linear(LMS_TO_LAB, [F.cbrt(F.greatest(F.lit(0.0), c)) for c in _linear(RGB_TO_LMS, linear)])


def oklab_to_srgb(lightness, a, b) -> list[Column]:
    """Bytes of a colour, out-of-gamut channels clamped."""
    lms = [c * c * c for c in _linear(LAB_TO_LMS, [col(lightness), col(a), col(b)])]
    linear = [clamp(c, 0.0, 1.0) for c in _linear(LMS_TO_RGB, lms)]
    return [byte(255 * F.when(x <= 0.0031308, 12.92 * x).otherwise(1.055 * F.pow(x, F.lit(1 / 2.4)) - 0.055)) for x in linear]


def sample_code(value, bits: int) -> Column:
    """The code of an 8-bit sample at fewer bits: half up, the last code taking what would pass it."""
    shift = 8 - bits
    return F.least(F.shiftright(col(value).cast("int") + (1 << (shift - 1)), shift), F.lit((1 << bits) - 1))


def correction_q4(error_sum) -> Column:
    """A tile's mean error in sixteenths of a sample, from the sum over 64 samples: over 4, halves away from zero, a signed byte."""
    return clamp(round_div(error_sum, F.lit(4)), -128, 127).cast("int")


def dithered(q4, x, y) -> Column:
    """What a correction in sixteenths adds at a place: its whole part, and one more where the place's threshold is below the rest."""
    q4 = col(q4).cast("int")
    whole = F.floor(q4 / 16).cast("int")
    phase = F.pmod(col(y).cast("int"), F.lit(4)) * 4 + F.pmod(col(x).cast("int"), F.lit(4))
    threshold = F.element_at(F.array(*[F.lit(t) for t in DITHER]), phase + 1)
    return whole + F.when(threshold < q4 - whole * 16, 1).otherwise(0)


def colours_used(pattern) -> Column:
    """Which of the four colours a pattern of 2-bit fields uses: a mask, bit k for colour k."""
    value = col(pattern).cast("long")
    mask = F.lit(0)
    for s in range(0, 32, 2):
        field = F.shiftright(value, s).bitwiseAND(F.lit(3).cast("long")).cast("int")
        mask = mask.bitwiseOR(F.element_at(F.array(F.lit(1), F.lit(2), F.lit(4), F.lit(8)), field + 1))
    return mask


def payload_bits(colours, direct=None) -> Column:
    """Bits of a raw block by its number of colours; a direct block of five and more has nine bytes."""
    bits = F.when(col(colours) == 1, 16).when(col(colours) == 2, 32).otherwise(56)
    return bits if direct is None else F.when(col(direct), 72).otherwise(bits)


def decode_cycles(mode, bits, mvx, mvy) -> Column:
    """An estimate of a macroblock's decoding cost: fixed, input by byte, prediction by mode and half-pel vector, residual by bit."""
    mode, bits = col(mode), col(bits).cast("long")
    half = F.abs(col(mvx)) % 2 + F.abs(col(mvy)) % 2
    sample = F.when(mode.isin("INTER", "GLOBAL"), F.when(half == 0, 2).when(half == 2, 14).otherwise(8)).otherwise(0)
    header = F.lit(0)
    for name, n in PREDICTION.items():
        sample = F.when(mode == name, n).otherwise(sample)
    for name, n in HEADER_BITS.items():
        header = F.when(mode == name, n).otherwise(header)
    residual = F.when(mode.isin(*NO_RESIDUAL), 0).otherwise(F.greatest(F.lit(0), bits - header) * RESIDUAL)
    read = F.when(mode == "LITERAL", LITERAL_BYTES * 2).otherwise(F.floor((bits + 7) / 8) * INPUT)
    return (F.lit(FIXED) + read + sample * SAMPLES + residual).cast("long")
