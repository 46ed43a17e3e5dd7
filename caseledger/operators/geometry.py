"""Grid, affine, crop and coverage geometry as column expressions.

A vector is a list of three columns and a matrix a list of rows of columns, so
every formula stays inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.constants import CANVAS_PADDING, CANVAS_SHAPE, CROP_SHAPE, SPACING_MM
from ..functions.scalars import clamp, is_close

Vec = list[Column]
Mat = list[list[Column]]

# the two letters of each target axis; the first is its direction
TARGET_AXES = ("LR", "PA", "SI")


def vec(c: Column | str, n: int = 3) -> Vec:
    c = F.col(c) if isinstance(c, str) else c
    return [c[i] for i in range(n)]


def mat(c: Column | str, rows: int = 4, cols: int = 4) -> Mat:
    c = F.col(c) if isinstance(c, str) else c
    return [[c[i][j] for j in range(cols)] for i in range(rows)]


def lits(values: Sequence[float]) -> Vec:
    return [F.lit(float(v)) for v in values]


def as_array(v: Sequence[Column]) -> Column:
    return F.array(*v)


def as_matrix(m: Mat) -> Column:
    return F.array(*[F.array(*row) for row in m])


def total(terms: Sequence[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


# ---- orientation --------------------------------------------------------------------------------

def source_axis(code: Column, target: int) -> Column:
    """0-based source axis that runs along the target axis."""
    a, b = TARGET_AXES[target]
    return F.greatest(F.instr(code, a), F.instr(code, b)) - 1


def is_flipped(code: Column, target: int) -> Column:
    return F.instr(code, TARGET_AXES[target][1]) > 0


def permuted(v: Column, code: Column) -> Vec:
    """Array ``v`` in target axis order (shape, spacing)."""
    return [F.get(v, source_axis(code, k)) for k in range(3)]


def canonical_point(point: Column, shape: Column, code: Column) -> Vec:
    """Index coordinates in target order; flipped axes count from the other end."""
    out = []
    for k in range(3):
        c, n = F.get(point, source_axis(code, k)), F.get(shape, source_axis(code, k))
        out.append(F.when(is_flipped(code, k), n - 1 - c).otherwise(c))
    return out


def original_point(point: Sequence[Column], shape: Column, code: Column) -> Vec:
    """Inverse of :func:`canonical_point`."""
    out = []
    for axis in range(3):
        value = F.lit(None).cast("double")
        for k in range(3):
            n = F.get(shape, F.lit(axis))
            back = F.when(is_flipped(code, k), n - 1 - point[k]).otherwise(point[k])
            value = F.when(source_axis(code, k) == axis, back).otherwise(value)
        out.append(value)
    return out


def canonical_affine(affine: Mat, shape: Column, code: Column) -> Mat:
    """The affine of the re-ordered, flipped volume: columns permuted, signs turned,
    and the origin moved to the far end of every flipped axis."""
    def column(row: int, k: int) -> Column:
        return F.get(F.array(*affine[row][:3]), source_axis(code, k))

    rows = []
    for i in range(3):
        cols = [F.when(is_flipped(code, k), -column(i, k)).otherwise(column(i, k)) for k in range(3)]
        moves = [F.when(is_flipped(code, k), column(i, k) * (F.get(shape, source_axis(code, k)) - 1)).otherwise(0.0)
                 for k in range(3)]
        rows.append([*cols, affine[i][3] + total(moves)])
    return [*rows, lits((0, 0, 0, 1))]


# ---- affine algebra -----------------------------------------------------------------------------

def apply_affine(m: Mat, p: Sequence[Column]) -> Vec:
    return [total([m[i][j] * p[j] for j in range(3)]) + m[i][3] for i in range(3)]


def transform_box(m: Mat, low: Sequence[Column], high: Sequence[Column], edge: float = 0.5) -> tuple[Vec, Vec]:
    """Axis-aligned box around a transformed box, voxel edges included.

    Per output axis each input axis contributes its smaller or larger end, which
    equals the minimum and maximum over all eight corners.
    """
    lo, hi = [], []
    for i in range(3):
        ends = [(m[i][j] * (low[j] - edge), m[i][j] * (high[j] + edge)) for j in range(3)]
        lo.append(total([F.least(a, b) for a, b in ends]) + m[i][3])
        hi.append(total([F.greatest(a, b) for a, b in ends]) + m[i][3])
    return lo, hi


def determinant(m: Mat) -> Column:
    return (m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
            - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
            + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0]))


def inverse_affine(m: Mat) -> Mat:
    """Closed-form inverse of the 3x3 part, then the offset."""
    d = determinant(m)

    def cofactor(i: int, j: int) -> Column:
        r, c = [x for x in range(3) if x != i], [x for x in range(3) if x != j]
        minor = m[r[0]][c[0]] * m[r[1]][c[1]] - m[r[0]][c[1]] * m[r[1]][c[0]]
        return minor if (i + j) % 2 == 0 else -minor

    inv = [[cofactor(j, i) / d for j in range(3)] for i in range(3)]
    return [*[[*inv[i], -total([inv[i][j] * m[j][3] for j in range(3)])] for i in range(3)], lits((0, 0, 0, 1))]


def axis_lengths(m: Mat) -> Vec:
    """Length of each direction column: the voxel spacing."""
    return [F.sqrt(total([m[i][j] * m[i][j] for i in range(3)])) for j in range(3)]


def unit_directions(m: Mat, spacing: Sequence[Column], tolerance: float = 1e-5) -> Column:
    ok = F.lit(True)
    for length, s in zip(axis_lengths(m), spacing):
        ok = ok & is_close(length / s, F.lit(1.0), tolerance, tolerance)
    return ok


def compose(a: Mat, b: Mat) -> Mat:
    """``a`` after ``b``."""
    rows = []
    for i in range(3):
        cols = [total([a[i][k] * b[k][j] for k in range(3)]) for j in range(3)]
        rows.append([*cols, total([a[i][k] * b[k][3] for k in range(3)]) + a[i][3]])
    return [*rows, lits((0, 0, 0, 1))]


def orientation_code(m: Mat) -> Column:
    """Letters of the dominant world direction of each voxel axis.

    World axes follow the file convention in which +x is right-to-left reversed:
    positive x reads R, positive y A, positive z S.
    """
    letters = []
    for j in range(3):
        size = [F.abs(m[i][j]) for i in range(3)]
        letter = (F.when((size[0] >= size[1]) & (size[0] >= size[2]), F.when(m[0][j] > 0, "R").otherwise("L"))
                  .when(size[1] >= size[2], F.when(m[1][j] > 0, "A").otherwise("P"))
                  .otherwise(F.when(m[2][j] > 0, "S").otherwise("I")))
        letters.append(letter)
    return F.concat(*letters)


# ---- canvas and crop ----------------------------------------------------------------------------

def fit_to_canvas(shape: Sequence[Column], spacing: Sequence[Column], canvas: Sequence[int] = CANVAS_SHAPE,
                  padding: int = CANVAS_PADDING) -> dict[str, Column]:
    """Isotropic spacing, core shape, leading pad, scale and offset per axis."""
    extent = [n.cast("double") * s for n, s in zip(shape, spacing)]
    iso = F.greatest(*[e / float(c - 2 * padding) for e, c in zip(extent, canvas)])
    out = {"iso_spacing": iso}
    for i, a in enumerate("xyz"):
        core = F.ceil(extent[i] / iso - 1e-6).cast("int")
        scale = iso / spacing[i]
        out[f"core_{a}"] = core
        out[f"pad_{a}"] = F.floor((F.lit(canvas[i]) - core) / 2).cast("int")
        out[f"scale_{a}"] = scale
        out[f"offset_{a}"] = (shape[i].cast("double") - 1) / 2 - scale * ((core.cast("double") - 1) / 2)
    return out


def canvas_to_voxel(center: Sequence[Column], fit: dict[str, Column], canvas: Sequence[int] = CANVAS_SHAPE) -> Vec:
    """Centre in [0,1] canvas coordinates to canonical voxel coordinates."""
    return [fit[f"scale_{a}"] * (center[i] * float(canvas[i] - 1) - fit[f"pad_{a}"]) + fit[f"offset_{a}"]
            for i, a in enumerate("xyz")]


def centered_crop(affine: Mat, center: Sequence[Column], shape: Sequence[int] = CROP_SHAPE,
                  spacing: Sequence[float] = SPACING_MM) -> tuple[Mat, Vec]:
    """Crop affine around a voxel centre, and the centre in world mm."""
    world = apply_affine(affine, center)
    length = axis_lengths(affine)
    rows = []
    for i in range(3):
        cols = [affine[i][j] / length[j] * float(spacing[j]) for j in range(3)]
        rows.append([*cols, world[i] - total([cols[j] * ((shape[j] - 1) / 2) for j in range(3)])])
    return [*rows, lits((0, 0, 0, 1))], world


def crop_coverage(center: Sequence[Column], low: Sequence[Column], high: Sequence[Column],
                  spacing: Sequence[Column], fov_mm: Sequence[Column]) -> dict[str, Column]:
    """Containment, covered volume fraction and margins of a box in a centred crop."""
    fractions, margins = [], []
    for c, lo, hi, s, fov in zip(center, low, high, spacing, fov_mm):
        crop_lo, crop_hi = c * s - fov / 2, c * s + fov / 2
        a, b = lo * s, hi * s
        shared = F.greatest(F.least(b, crop_hi) - F.greatest(a, crop_lo), F.lit(0.0))
        fractions.append(clamp(shared / (b - a), 0.0, 1.0))
        margins.append(F.least(a - crop_lo, crop_hi - b))
    least = F.least(*margins)
    return {"fully_contained": least >= -1e-6, "volume_fraction": fractions[0] * fractions[1] * fractions[2],
            "minimum_margin_mm": least, "margin_x": margins[0], "margin_y": margins[1], "margin_z": margins[2]}


def compare_policies(cases: DataFrame, policies: dict[str, tuple[Sequence[Column], Sequence[Column]]],
                     low: Sequence[Column], high: Sequence[Column], spacing: Sequence[Column],
                     keep: Sequence[str]) -> DataFrame:
    """The same coverage for several (centre, field of view) policies, in long form."""
    items = F.array(*[F.struct(F.lit(n).alias("policy"), as_array(c).alias("c"), as_array(f).alias("f"))
                      for n, (c, f) in policies.items()])
    long = cases.select(*keep, as_array(low).alias("_lo"), as_array(high).alias("_hi"), as_array(spacing).alias("_s"),
                        F.explode(items).alias("_p"))
    cov = crop_coverage(vec(F.col("_p.c")), vec("_lo"), vec("_hi"), vec("_s"), vec(F.col("_p.f")))
    return long.select(*keep, F.col("_p.policy").alias("policy"), *[c.alias(n) for n, c in cov.items()])


def crop_index_bounds(center: Sequence[Column], spacing: Sequence[Column], fov_mm: Sequence[float], shape: Column,
                      code: Column) -> tuple[Vec, Vec]:
    """Index box of a canonical crop in the original axis order, clamped to the volume."""
    low = [c - (f / 2) / s for c, s, f in zip(center, spacing, fov_mm)]
    high = [c + (f / 2) / s for c, s, f in zip(center, spacing, fov_mm)]
    a, b = original_point(low, shape, code), original_point(high, shape, code)
    first = [F.greatest(F.ceil(F.least(x, y) - 1e-6), F.lit(0)).cast("int") for x, y in zip(a, b)]
    last = [F.least(F.floor(F.greatest(x, y) + 1e-6), F.get(shape, F.lit(i)) - 1).cast("int")
            for i, (x, y) in enumerate(zip(a, b))]
    return first, last


def center_error(predicted: Sequence[Column], truth: Sequence[Column], spacing: Sequence[Column] | Column) -> dict[str, Column]:
    """Absolute error per axis and Euclidean error, in mm."""
    s = spacing if isinstance(spacing, (list, tuple)) else [spacing] * 3
    d = [(p - q) * x for p, q, x in zip(predicted, truth, s)]
    return {**{f"error_{a}_mm": F.abs(d[i]) for i, a in enumerate("xyz")},
            "error_mm": F.sqrt(total([x * x for x in d]))}


def geometry_audit(shape_a: Column, shape_b: Column, spacing_a: Sequence[Column], spacing_b: Sequence[Column],
                   affine_a: Mat, affine_b: Mat, rtol: float, atol: float) -> dict[str, Column]:
    """Shape, spacing and affine agreement of two headers, and the largest affine difference."""
    spacing_ok, affine_ok = F.lit(True), F.lit(True)
    for x, y in zip(spacing_a, spacing_b):
        spacing_ok = spacing_ok & is_close(x, y, rtol, atol)
    differences = []
    for i in range(4):
        for j in range(4):
            affine_ok = affine_ok & is_close(affine_a[i][j], affine_b[i][j], rtol, atol)
            differences.append(F.abs(affine_a[i][j] - affine_b[i][j]))
    return {"shape_match": shape_a == shape_b, "spacing_match": spacing_ok, "affine_match": affine_ok,
            "largest_affine_difference": F.greatest(*differences)}


def voxel_in_crop(index: Sequence[Column], source_to_crop: Mat, shape: Sequence[int]) -> Column:
    """Whether a source voxel falls inside the crop grid: -0.5 <= c < n - 0.5 on each axis."""
    inside = F.lit(True)
    for c, n in zip(apply_affine(source_to_crop, index), shape):
        inside = inside & (c >= -0.5) & (c < n - 0.5)
    return inside
