"""Text, flag, label, vector and box parsing as built-in column expressions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .constants import TRUE_WORDS


def clean_id(c: Column) -> Column:
    """Identifiers as text: trimmed, without a trailing ``.0``."""
    return F.regexp_replace(F.trim(c.cast("string")), r"\.0$", "")


def parse_flag(c: Column, words: Sequence[str] = TRUE_WORDS) -> Column:
    """True for one of ``words`` in any case; everything else, null too, is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin(*words), F.lit(False))


def normalize_text(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), "_", "-")


def decode_label(c: Column, positive: Iterable[str], negative: Iterable[str],
                 names: tuple[str, str]) -> Column:
    """``struct<label, binary>``; a value in neither list fails the query."""
    text = normalize_text(c.cast("string"))
    return (
        F.when(text.isin(*positive), F.struct(F.lit(names[0]).alias("label"), F.lit(1).alias("binary")))
        .when(text.isin(*negative), F.struct(F.lit(names[1]).alias("label"), F.lit(0).alias("binary")))
        .otherwise(F.raise_error(F.concat(F.lit("unexpected diagnostic label: "),
                                          F.coalesce(c.cast("string"), F.lit("NULL")))))
    )


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def decode_vector(c: Column, size: int = 3) -> Column:
    """JSON text to ``size`` finite doubles, or an error."""
    v = F.from_json(c, "array<double>")
    good = F.coalesce((F.size(v) == size) & F.forall(v, _finite), F.lit(False))
    return F.when(good, v).otherwise(
        F.raise_error(F.concat(F.lit("bad vector: "), F.coalesce(c, F.lit("NULL")))).cast("array<double>"))


def decode_matrix(c: Column, rows: int = 4, cols: int = 4) -> Column:
    """JSON text to a finite ``rows`` x ``cols`` matrix, or an error."""
    m = F.from_json(c, "array<array<double>>")
    good = F.coalesce(
        (F.size(m) == rows) & F.forall(m, lambda r: (F.size(r) == cols) & F.forall(r, _finite)),
        F.lit(False))
    return F.when(good, m).otherwise(
        F.raise_error(F.concat(F.lit("bad matrix: "), F.coalesce(c, F.lit("NULL"))))
        .cast("array<array<double>>"))


def decode_box(c: Column) -> Column:
    """JSON box to ``struct<minimum, maximum>``; each maximum must reach its minimum."""
    box = F.from_json(c, "minimum array<double>, maximum array<double>")
    good = F.coalesce(
        (F.size(box["minimum"]) == 3) & (F.size(box["maximum"]) == 3)
        & F.forall(F.arrays_zip(box["minimum"], box["maximum"]),
                   lambda p: _finite(p["minimum"]) & _finite(p["maximum"]) & (p["maximum"] >= p["minimum"])),
        F.lit(False))
    return F.when(good, box).otherwise(
        F.raise_error(F.concat(F.lit("bad box: "), F.coalesce(c, F.lit("NULL"))))
        .cast("struct<minimum:array<double>,maximum:array<double>>"))


def encode_json(c: Column) -> Column:
    """Vector or matrix to JSON text."""
    return F.to_json(c)


def first_present(df: DataFrame, names: Sequence[str]) -> Column:
    """The first of ``names`` that the frame has (schema drift)."""
    for name in names:
        if name in df.columns:
            return F.col(name)
    raise ValueError(f"none of {list(names)} in {df.columns}")


def rebase_path(c: Column, old: str, new: str) -> Column:
    """Path column with its historical root replaced."""
    return F.replace(c, F.lit(old), F.lit(new))


def interval_text(point: Column, low: Column, high: Column) -> Column:
    """``0.770 (0.701-0.835)``, or ``NA`` when the point is missing."""
    return F.when(point.isNull() | F.isnan(point), F.lit("NA")).otherwise(
        F.format_string("%.3f (%.3f-%.3f)", point, low, high))


def number_text(c: Column, digits: int = 3) -> Column:
    return F.when(c.isNull() | F.isnan(c), F.lit("NA")).otherwise(F.format_string(f"%.{digits}f", c))


def percent_text(c: Column, digits: int = 1) -> Column:
    return F.when(c.isNull() | F.isnan(c), F.lit("NA")).otherwise(
        F.format_string(f"%.{digits}f%%", c * 100.0))
