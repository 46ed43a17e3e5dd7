"""Geometry queries (H1-H11, C13) over one row per volume header."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as s
from ..operators import geometry as g
from . import views as v
from .registry import query


def _affine(t):
    """A header affine per study: scaled axes, one sheared, and an origin."""
    sp, c = g.vec("spacing"), g.vec("center")
    z = F.lit(0.0)
    m = [[-sp[0], F.lit(0.125), z, c[0]], [z, -sp[1], F.lit(0.25), c[1]], [F.lit(0.0625), z, sp[2], c[2]],
         g.lits((0, 0, 0, 1))]
    return v.v_box(t).withColumn("affine", g.as_matrix(m))


_A = """, a AS (SELECT *, -sx AS a00, 0.125::DOUBLE AS a01, 0::DOUBLE AS a02, cx AS a03, 0::DOUBLE AS a10, -sy AS a11, 0.25::DOUBLE AS a12, cy AS a13,
 0.0625::DOUBLE AS a20, 0::DOUBLE AS a21, sz AS a22, cz AS a23 FROM v_box)"""
_CORNERS = """, corners AS (SELECT a.*, i, j, k2, CASE i WHEN 0 THEN x0 - 0.5::DOUBLE ELSE x1 + 0.5::DOUBLE END AS px,
 CASE j WHEN 0 THEN y0 - 0.5::DOUBLE ELSE y1 + 0.5::DOUBLE END AS py, CASE k2 WHEN 0 THEN z0 - 0.5::DOUBLE ELSE z1 + 0.5::DOUBLE END AS pz
 FROM a, (SELECT unnest([0,1]) AS i), (SELECT unnest([0,1]) AS j), (SELECT unnest([0,1]) AS k2))"""


@query("h1_canonical_orientation", uses="v_box", doubles="spacing_x spacing_y spacing_z point_x point_y point_z", sql="""
, o AS (SELECT *, CASE orientation WHEN 'LPS' THEN [1,2,3] WHEN 'RAS' THEN [1,2,3] WHEN 'LPI' THEN [1,2,3] WHEN 'PSL' THEN [3,1,2] ELSE [2,3,1] END AS perm,
 CASE orientation WHEN 'LPS' THEN [0,0,0] WHEN 'RAS' THEN [1,1,0] WHEN 'LPI' THEN [0,0,1] WHEN 'PSL' THEN [0,0,0] ELSE [1,1,0] END AS flip,
 [nx, ny, nz] AS n, [sx, sy, sz] AS s, [x0, y0, z0] AS p FROM v_box)
SELECT study_id, CAST(n[perm[1]] AS INT) AS shape_x, CAST(n[perm[2]] AS INT) AS shape_y, CAST(n[perm[3]] AS INT) AS shape_z,
 s[perm[1]] AS spacing_x, s[perm[2]] AS spacing_y, s[perm[3]] AS spacing_z,
 CASE flip[1] WHEN 1 THEN n[perm[1]] - 1 - p[perm[1]] ELSE p[perm[1]] END AS point_x,
 CASE flip[2] WHEN 1 THEN n[perm[2]] - 1 - p[perm[2]] ELSE p[perm[2]] END AS point_y,
 CASE flip[3] WHEN 1 THEN n[perm[3]] - 1 - p[perm[3]] ELSE p[perm[3]] END AS point_z FROM o""")
def _(t):
    code = F.col("orientation")
    shape, spacing = g.permuted(F.col("shape"), code), g.permuted(F.col("spacing"), code)
    point = g.canonical_point(F.col("box_min"), F.col("shape"), code)
    return v.v_box(t).select("study_id", *[c.alias(f"shape_{a}") for a, c in zip("xyz", shape)],
                             *[c.alias(f"spacing_{a}") for a, c in zip("xyz", spacing)],
                             *[c.alias(f"point_{a}") for a, c in zip("xyz", point)])


@query("h1_canonical_affine", uses="v_box", doubles="world_x world_y world_z back_x", sql=_A + """
SELECT study_id, a00 * x0 + a01 * y0 + a02 * z0 + a03 AS world_x, a10 * x0 + a11 * y0 + a12 * z0 + a13 AS world_y,
 a20 * x0 + a21 * y0 + a22 * z0 + a23 AS world_z, x0 AS back_x FROM a""")
def _(t):
    """The re-oriented affine maps the re-oriented point to the same world position."""
    code, shape = F.col("orientation"), F.col("shape")
    point = g.canonical_point(F.col("box_min"), shape, code)
    b = _affine(t)
    world = g.apply_affine(g.canonical_affine(g.mat("affine"), shape, code), point)
    return b.select("study_id", *[c.alias(f"world_{a}") for a, c in zip("xyz", world)],
                    g.original_point(point, shape, code)[0].alias("back_x"))


@query("h2_affine_box", uses="v_box", doubles="low_x low_y low_z high_x high_y high_z", sql=_A + _CORNERS + """
SELECT study_id, min(a00 * px + a01 * py + a02 * pz + a03) AS low_x, min(a10 * px + a11 * py + a12 * pz + a13) AS low_y,
 min(a20 * px + a21 * py + a22 * pz + a23) AS low_z, max(a00 * px + a01 * py + a02 * pz + a03) AS high_x,
 max(a10 * px + a11 * py + a12 * pz + a13) AS high_y, max(a20 * px + a21 * py + a22 * pz + a23) AS high_z
FROM corners GROUP BY 1""")
def _(t):
    lo, hi = g.transform_box(g.mat("affine"), g.vec("box_min"), g.vec("box_max"))
    return _affine(t).select("study_id", *[c.alias(f"low_{a}") for a, c in zip("xyz", lo)],
                             *[c.alias(f"high_{a}") for a, c in zip("xyz", hi)])


@query("h3_affine_inverse", uses="v_box", doubles="det back_x back_y back_z", sql=_A + """
SELECT study_id, a00 * (a11 * a22 - a12 * a21) - a01 * (a10 * a22 - a12 * a20) + a02 * (a10 * a21 - a11 * a20) AS det,
 x0 AS back_x, y0 AS back_y, z0 AS back_z,
 abs(sqrt(a00*a00 + a10*a10 + a20*a20) / sx - 1) <= 2e-5::DOUBLE AND abs(sqrt(a01*a01 + a11*a11 + a21*a21) / sy - 1) <= 2e-5::DOUBLE
  AND abs(sqrt(a02*a02 + a12*a12 + a22*a22) / sz - 1) <= 2e-5::DOUBLE AS unit_directions FROM a""")
def _(t):
    """There and back: the inverse undoes the affine."""
    m = g.mat("affine")
    back = g.apply_affine(g.inverse_affine(m), g.apply_affine(m, g.vec("box_min")))
    return _affine(t).select("study_id", g.determinant(m).alias("det"),
                             *[c.alias(f"back_{a}") for a, c in zip("xyz", back)],
                             g.unit_directions(m, g.vec("spacing")).alias("unit_directions"))


_FIT = """, f0 AS (SELECT *, greatest(nx * sx / 88, ny * sy / 88, nz * sz / 152) AS iso FROM v_box),
f1 AS (SELECT *, CAST(ceil(nx * sx / iso - 1e-6::DOUBLE) AS INT) AS core_x, CAST(ceil(ny * sy / iso - 1e-6::DOUBLE) AS INT) AS core_y,
 CAST(ceil(nz * sz / iso - 1e-6::DOUBLE) AS INT) AS core_z FROM f0),
fit AS (SELECT *, (96 - core_x) // 2 AS pad_x, (96 - core_y) // 2 AS pad_y, (160 - core_z) // 2 AS pad_z,
 (nx - 1) / 2.0::DOUBLE - iso / sx * ((core_x - 1) / 2.0::DOUBLE) AS off_x, (ny - 1) / 2.0::DOUBLE - iso / sy * ((core_y - 1) / 2.0::DOUBLE) AS off_y,
 (nz - 1) / 2.0::DOUBLE - iso / sz * ((core_z - 1) / 2.0::DOUBLE) AS off_z FROM f1)"""


@query("h4_fit_to_canvas", uses="v_box", doubles="iso_spacing scale_x offset_x offset_z", sql=_FIT + """
SELECT study_id, iso AS iso_spacing, core_x, core_y, core_z, pad_x, pad_y, pad_z, iso / sx AS scale_x, off_x AS offset_x,
 off_z AS offset_z FROM fit""")
def _(t):
    fit = g.fit_to_canvas(g.vec("shape"), g.vec("spacing"))
    names = ["iso_spacing", "core_x", "core_y", "core_z", "pad_x", "pad_y", "pad_z", "scale_x", "offset_x", "offset_z"]
    return v.v_box(t).select("study_id", *[fit[n].alias(n) for n in names])


@query("h5_canvas_center_to_voxel", uses="v_box", doubles="voxel_x voxel_y voxel_z", sql=_FIT + """
SELECT study_id, iso / sx * (cx / 64 * 95 - pad_x) + off_x AS voxel_x, iso / sy * (cy / 64 * 95 - pad_y) + off_y AS voxel_y,
 iso / sz * (cz / 64 * 159 - pad_z) + off_z AS voxel_z FROM fit""")
def _(t):
    fit = g.fit_to_canvas(g.vec("shape"), g.vec("spacing"))
    voxel = g.canvas_to_voxel([c / 64.0 for c in g.vec("center")], fit)
    return v.v_box(t).select("study_id", *[c.alias(f"voxel_{a}") for a, c in zip("xyz", voxel)])


_CROP = _A + """, l AS (SELECT *, sqrt(a00*a00 + a10*a10 + a20*a20) AS l0, sqrt(a01*a01 + a11*a11 + a21*a21) AS l1, sqrt(a02*a02 + a12*a12 + a22*a22) AS l2,
 a00 * cx + a01 * cy + a02 * cz + a03 AS wx, a10 * cx + a11 * cy + a12 * cz + a13 AS wy, a20 * cx + a21 * cy + a22 * cz + a23 AS wz FROM a)"""


@query("h6_centered_crop_affine", uses="v_box", doubles="world_x world_y world_z origin_x corner_z", sql=_CROP + """
SELECT study_id, wx AS world_x, wy AS world_y, wz AS world_z,
 wx - (a00 / l0 * 1.25::DOUBLE * 119.5::DOUBLE + a01 / l1 * 1.25::DOUBLE * 95.5::DOUBLE + a02 / l2 * 2 * 63.5::DOUBLE) AS origin_x,
 a22 / l2 * 2 AS corner_z FROM l""")
def _(t):
    crop, world = g.centered_crop(g.mat("affine"), g.vec("center"))
    return _affine(t).select("study_id", *[c.alias(f"world_{a}") for a, c in zip("xyz", world)],
                             crop[0][3].alias("origin_x"), crop[2][2].alias("corner_z"))


_COV = """greatest(least({hi} * {s}, {c} * {s} + {f} / 2) - greatest({lo} * {s}, {c} * {s} - {f} / 2), 0)"""


def _cov_sql(c, f):
    fr, mg = [], []
    for a, w in zip("xyz", f):
        cc = c.format(a=a)
        lo, hi, s_ = f"{a}0", f"{a}1", f"s{a}"
        fr.append(f"least(greatest({_COV.format(hi=hi, lo=lo, s=s_, c=cc, f=w)} / ({hi} * {s_} - {lo} * {s_}), 0), 1)")
        mg.append(f"least({lo} * {s_} - ({cc} * {s_} - {w} / 2), {cc} * {s_} + {w} / 2 - {hi} * {s_})")
    return " * ".join(fr), f"least({', '.join(mg)})"


_F1, _M1 = _cov_sql("c{a}", ("60.0::DOUBLE", "60.0::DOUBLE", "60.0::DOUBLE"))
_F2, _M2 = _cov_sql("c{a}", ("30.0::DOUBLE", "40.0::DOUBLE", "20.0::DOUBLE"))
_F4, _M4 = _cov_sql("c{a}", ("90.0::DOUBLE", "90.0::DOUBLE", "90.0::DOUBLE"))
_F5, _M5 = _cov_sql("(({a}0 + {a}1) / 2)", ("60.0::DOUBLE", "60.0::DOUBLE", "60.0::DOUBLE"))
_F3, _M3 = _cov_sql("(({a}0 + {a}1) / 2)", ("90.0::DOUBLE", "90.0::DOUBLE", "90.0::DOUBLE"))


@query("h7_crop_coverage", uses="v_box", doubles="volume_fraction minimum_margin_mm", sql=f"""
SELECT study_id, {_M1} >= -1e-6::DOUBLE AS fully_contained, {_F1} AS volume_fraction, {_M1} AS minimum_margin_mm FROM v_box""")
def _(t):
    cov = g.crop_coverage(g.vec("center"), g.vec("box_min"), g.vec("box_max"), g.vec("spacing"), g.lits((60, 60, 60)))
    return v.v_box(t).select("study_id", *[cov[n].alias(n) for n in ("fully_contained", "volume_fraction", "minimum_margin_mm")])


@query("h8_policy_comparison", uses="v_box", doubles="containment mean_fraction worst_margin", sql=f"""
, p AS (SELECT 'learned' AS policy, {_M1} AS m, {_F1} AS f FROM v_box UNION ALL SELECT 'small', {_M2}, {_F2} FROM v_box
 UNION ALL SELECT 'oracle', {_M3}, {_F3} FROM v_box UNION ALL SELECT 'large', {_M4}, {_F4} FROM v_box
 UNION ALL SELECT 'oracle_fixed', {_M5}, {_F5} FROM v_box)
SELECT policy, count(*) AS cases, avg((m >= -1e-6::DOUBLE)::INT) AS containment, avg(f) AS mean_fraction, min(m) AS worst_margin FROM p GROUP BY 1""")
def _(t):
    lo, hi = g.vec("box_min"), g.vec("box_max")
    middle = [(a + b) / 2 for a, b in zip(lo, hi)]
    policies = {"learned": (g.vec("center"), g.lits((60, 60, 60))), "small": (g.vec("center"), g.lits((30, 40, 20))),
                "oracle": (middle, g.lits((90, 90, 90))), "large": (g.vec("center"), g.lits((90, 90, 90))),
                "oracle_fixed": (middle, g.lits((60, 60, 60)))}
    long = g.compare_policies(v.v_box(t), policies, lo, hi, g.vec("spacing"), ["study_id"])
    return long.groupBy("policy").agg(
        F.count(F.lit(1)).alias("cases"), F.avg(F.col("fully_contained").cast("double")).alias("containment"),
        F.avg("volume_fraction").alias("mean_fraction"), F.min("minimum_margin_mm").alias("worst_margin"))


@query("h9_crop_index_bounds", uses="v_box", sql="""
, o AS (SELECT study_id, nx, ny, nz, CASE orientation WHEN 'PSL' THEN [3,1,2] WHEN 'SRA' THEN [2,3,1] ELSE [1,2,3] END AS perm,
 CASE orientation WHEN 'RAS' THEN [1,1,0] WHEN 'LPI' THEN [0,0,1] WHEN 'SRA' THEN [1,1,0] ELSE [0,0,0] END AS flip,
 [cx - 10 / sx, cy - 10 / sy, cz - 10 / sz] AS lo, [cx + 10 / sx, cy + 10 / sy, cz + 10 / sz] AS hi, [nx, ny, nz] AS n FROM v_box),
q AS (SELECT study_id, n, unnest([1,2,3]) AS k, perm, flip, lo, hi FROM o),
w AS (SELECT study_id, perm[k] AS axis, n[perm[k]] AS size, CASE flip[k] WHEN 1 THEN n[perm[k]] - 1 - hi[k] ELSE lo[k] END AS a,
 CASE flip[k] WHEN 1 THEN n[perm[k]] - 1 - lo[k] ELSE hi[k] END AS b FROM q)
SELECT study_id, CAST(max(greatest(ceil(a - 1e-6::DOUBLE), 0)) FILTER (WHERE axis = 1) AS INT) AS first_x,
 CAST(max(greatest(ceil(a - 1e-6::DOUBLE), 0)) FILTER (WHERE axis = 3) AS INT) AS first_z,
 CAST(max(least(floor(b + 1e-6::DOUBLE), size - 1)) FILTER (WHERE axis = 1) AS INT) AS last_x,
 CAST(max(least(floor(b + 1e-6::DOUBLE), size - 1)) FILTER (WHERE axis = 2) AS INT) AS last_y FROM w GROUP BY 1""")
def _(t):
    first, last = g.crop_index_bounds(g.vec("center"), g.vec("spacing"), (20.0, 20.0, 20.0), F.col("shape"), F.col("orientation"))
    return v.v_box(t).select("study_id", first[0].alias("first_x"), first[2].alias("first_z"),
                             last[0].alias("last_x"), last[1].alias("last_y"))


@query("h10_center_error", uses="v_box", doubles="error_x_mm error_mm", sql="""
SELECT study_id, abs((cx - x0) * sx) AS error_x_mm, sqrt(((cx - x0) * sx) ** 2 + ((cy - y0) * sy) ** 2 + ((cz - z0) * sz) ** 2) AS error_mm FROM v_box""")
def _(t):
    e = g.center_error(g.vec("center"), g.vec("box_min"), g.vec("spacing"))
    return v.v_box(t).select("study_id", e["error_x_mm"].alias("error_x_mm"), e["error_mm"].alias("error_mm"))


@query("h11_geometry_audit", uses="v_box", doubles="largest_affine_difference", sql="""
, d AS (SELECT *, CASE k % 7 WHEN 1 THEN 1e-5::DOUBLE WHEN 2 THEN 0.5 ELSE 0 END AS e FROM v_box)
SELECT study_id, TRUE AS shape_match, e = 0 OR e <= 1e-4::DOUBLE + 1e-3::DOUBLE * abs(sx) AS spacing_match,
 abs((cx + e) - cx) <= 1e-4::DOUBLE + 1e-3::DOUBLE * abs(cx) AS affine_match, abs((cx + e) - cx) AS largest_affine_difference,
 CASE WHEN e = 0 THEN 'EXACT' WHEN e < 0.1 THEN 'WITHIN_TOLERANCE' WHEN k % 2 = 0 THEN 'REVIEWED_EXCEPTION'
  WHEN annotation_type = 'automatic' THEN 'AUTOMATIC_LABEL_EXCEPTION' ELSE 'REVIEW_REQUIRED' END AS geometry_status FROM d""")
def _(t):
    """A second header with a tiny, a large or no disturbance, audited against the first."""
    n = F.col("study_id").cast("int")
    e = F.when(n % 7 == 1, 1e-5).when(n % 7 == 2, 0.5).otherwise(0.0)
    b = _affine(t).withColumn("e", e)
    m, sp = g.mat("affine"), g.vec("spacing")
    other = [[*row] for row in m]
    other[0][3] = m[0][3] + F.col("e")
    a = g.geometry_audit(F.col("shape"), F.col("shape"), [sp[0] + F.col("e"), sp[1], sp[2]], sp, other, m, 1e-3, 1e-4)
    status = s.geometry_status(F.col("e") == 0, a["spacing_match"] & a["affine_match"] & (F.col("e") < 0.1),
                               n % 2 == 0, F.col("annotation_type") == "automatic")
    return b.select("study_id", *[c.alias(x) for x, c in a.items()], status.alias("geometry_status"))


@query("c13_voxel_in_crop_join", uses="v_volume", sql="""
SELECT study_id, count(*) FILTER (WHERE label = 1) AS lesion_total,
 count(*) FILTER (WHERE label = 1 AND x * 0.8::DOUBLE - 1 >= -0.5 AND x * 0.8::DOUBLE - 1 < 1.5 AND y * 0.8::DOUBLE - 1 >= -0.5 AND y * 0.8::DOUBLE - 1 < 1.5
  AND z * 0.5::DOUBLE >= -0.5 AND z * 0.5::DOUBLE < 1.5 AND CAST(study_id AS INT) % 2 = 0) AS lesion_inside FROM v_volume GROUP BY 1""")
def _(t):
    """Voxels meet the one crop row of their study; the affine travels as columns."""
    z = F.lit(0.0)
    # odd studies get a crop far away, so none of their voxels is inside
    shift = F.when(F.col("study_id").cast("int") % 2 == 0, -1.0).otherwise(-100.0)
    crops = v.v_volume(t).select("study_id").distinct().withColumn("to_crop", g.as_matrix(
        [[F.lit(0.8), z, z, shift], [z, F.lit(0.8), z, shift], [z, z, F.lit(0.5), shift + 1.0], g.lits((0, 0, 0, 1))]))
    inside = g.voxel_in_crop([F.col(a).cast("double") for a in "xyz"], g.mat("to_crop"), (2, 2, 2))
    return v.v_volume(t).join(crops, "study_id").groupBy("study_id").agg(
        F.count_if(F.col("label") == 1).alias("lesion_total"),
        F.count_if((F.col("label") == 1) & inside).alias("lesion_inside"))
