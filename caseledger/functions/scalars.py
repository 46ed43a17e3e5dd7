"""Intensity, probability, size, hash and status expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .constants import (
    HU_CENTER, HU_HALF_WIDTH, HU_HIGH, HU_LOW, LABEL_CODES, PROBABILITY_LEVELS, SIZE_BINS_MM,
    SIZE_GROUPS, VOXEL_VOLUME_MM3,
)


def clamp(c: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.least(F.greatest(c, low), high)


def window_intensity(raw: Column, slope: Column | float = 1.0, intercept: Column | float = 0.0) -> Column:
    """Rescaled intensity, clipped to the window, rounded half to even, 16 bit."""
    return F.rint(clamp(raw.cast("double") * slope + intercept, HU_LOW, HU_HIGH)).cast("short")


def normalize_intensity(hu: Column) -> Column:
    return clamp((hu.cast("double") - HU_CENTER) / HU_HALF_WIDTH, -1.0, 1.0)


def quantize_probability(p: Column) -> Column:
    return F.rint(clamp(p, 0.0, 1.0) * PROBABILITY_LEVELS).cast("int")


def dequantize_probability(q: Column) -> Column:
    return q.cast("double") / PROBABILITY_LEVELS


def is_close(a: Column, b: Column, rtol: float = 0.0, atol: float = 0.0) -> Column:
    """``|a-b| <= atol + rtol*|b|``; the relative part scales with ``b`` only."""
    return F.coalesce(F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b), F.lit(False))


def all_close(a: Column, b: Column, rtol: float = 0.0, atol: float = 0.0) -> Column:
    """Element-wise :func:`is_close` over two arrays of equal length."""
    return F.coalesce(
        (F.size(a) == F.size(b))
        & F.forall(F.zip_with(a, b, lambda x, y: is_close(x, y, rtol, atol)), lambda ok: ok),
        F.lit(False))


def is_label_value(v: Column) -> Column:
    """Value within 1e-6 of an allowed integer label."""
    return F.coalesce((F.abs(v - F.rint(v)) <= 1e-6) & F.rint(v).between(LABEL_CODES[0], LABEL_CODES[-1]),
                      F.lit(False))


def equivalent_diameter(voxels: Column, voxel_volume: float = VOXEL_VOLUME_MM3) -> Column:
    """Diameter of the sphere with the same volume, in mm."""
    return F.cbrt(voxels.cast("double") * voxel_volume * 6.0 / F.pi())


def size_group(mm: Column) -> Column:
    """Upper-inclusive size class; null stays null."""
    return (F.when(mm <= SIZE_BINS_MM[0], SIZE_GROUPS[0])
            .when(mm <= SIZE_BINS_MM[1], SIZE_GROUPS[1])
            .when(mm.isNotNull(), SIZE_GROUPS[2]))


def stable_rank(seed, role: str, key: Column) -> Column:
    """Hex order key that never changes between runs: SHA-256 of ``seed|role|key``."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(role), key.cast("string")), 256)


def stable_integer(*parts: Column) -> Column:
    """Little-endian first eight digest bytes mod 2**32, i.e. bytes 4,3,2,1 as one number."""
    digest = F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)
    low = F.concat(*[F.substring(digest, i, 2) for i in (7, 5, 3, 1)])
    return F.conv(low, 16, 10).cast("long")


def hash32(*parts: Column) -> Column:
    """First 32 bits of the MD5 of the joined parts, as a non-negative long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def hash_halves(*parts: Column) -> tuple[Column, Column]:
    """First and second 32 bits of the MD5 of the joined parts, as non-negative longs."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return tuple(F.conv(F.substring(digest, at, 8), 16, 10).cast("long") for at in (1, 9))


def mix32(df: DataFrame, x: Column, out: str) -> DataFrame:
    """Adds ``out``, a 32-bit value spread over all its bits, in 64-bit arithmetic that
    can't overflow. Each step is a column of its own, so none is computed twice."""
    kept = df.columns
    for shift, factor in ((16, 0x7FEB352D), (15, 0x45D9F3B), (16, 1)):
        df = df.withColumn(f"{out}_x", x)
        here = F.col(f"{out}_x")
        x = (here.bitwiseXOR(F.shiftright(here, shift)) * F.lit(factor)).bitwiseAND(F.lit(0xFFFFFFFF))
    return df.select(*kept, x.alias(out))


BILLION = 1_000_000_000


def billionths(x: Column) -> Column:
    """A measure as a whole number of billionths (null for NaN), whose sums are exact in
    whatever order rows are added. A long holds the sum of 9e9 values of one."""
    x = x.cast("double")
    return F.when(~F.isnan(x), F.round(x * F.lit(float(BILLION))).cast("long"))


def steady_mean(x: Column) -> Column:
    """Mean, to a billionth, that doesn't depend on the order of rows; null without values."""
    return F.sum(billionths(x)) / F.count(billionths(x)) / F.lit(BILLION)


def hash_uniform(*parts: Column) -> Column:
    """Deterministic uniform value in [0, 1)."""
    return hash32(*parts).cast("double") / F.lit(4294967296.0)


def hash_between(low: int, high: int, *parts: Column) -> Column:
    """Deterministic integer in [low, high]."""
    return (F.lit(low) + hash32(*parts) % F.lit(high - low + 1)).cast("int")


def record_signature(fields: dict[str, Column]) -> Column:
    """SHA-256 of the key-sorted compact JSON of named values."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)


def crc32_hex(content: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0")


def reliability_weight(is_positive: Column, annotation: Column) -> Column:
    """Automatic positive annotations count half."""
    return F.when(is_positive & (annotation == "automatic"), 0.5).otherwise(1.0)


def geometry_status(exact: Column, within_tolerance: Column, reviewed: Column, automatic: Column) -> Column:
    return (F.when(exact, "EXACT")
            .when(within_tolerance, "WITHIN_TOLERANCE")
            .when(reviewed, "REVIEWED_EXCEPTION")
            .when(automatic, "AUTOMATIC_LABEL_EXCEPTION")
            .otherwise("REVIEW_REQUIRED"))


def finite_in(c: Column, low: float, high: float) -> Column:
    return F.coalesce(~F.isnan(c) & c.between(low, high), F.lit(False))


def voxel_to_mm(index: Sequence[Column], spacing: Sequence[float]) -> list[Column]:
    return [i.cast("double") * s for i, s in zip(index, spacing)]


def all_true(checks: dict[str, Column]) -> Column:
    """Conjunction of named checks; a null check counts as failed."""
    result = F.lit(True)
    for c in checks.values():
        result = result & F.coalesce(c, F.lit(False))
    return result
