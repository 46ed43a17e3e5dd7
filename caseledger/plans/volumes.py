"""Voxel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as k
from ..operators import bricks as br, contracts as ct, geometry as g, sampling as sa, volume as vo
from ..operators.detection import rank_candidates
from ..operators.ordering import exact_percentiles
from ..session import spread_join
from . import views as v
from .drawsql import hash_sql
from .registry import query

SHAPE = (4, 4, 4)


def lesion():
    return F.col("label") == k.LESION


def organ():
    return F.col("label") == k.ORGAN


_DIST = "sqrt(((a.x - b.x) * 1.25::DOUBLE) ** 2 + ((a.y - b.y) * 1.25::DOUBLE) ** 2 + ((a.z - b.z) * 2.0::DOUBLE) ** 2)"


@query("c11_point_to_set_distance", uses="v_points v_probe", doubles="reference_distance_mm", sql=f"""
SELECT probe_id, min({_DIST}) AS reference_distance_mm FROM v_probe a LEFT JOIN v_points b USING (study_id) GROUP BY 1""")
def _(t):
    return vo.nearest_distance(v.v_probe(t), v.v_points(t), "probe_id").select("probe_id", "reference_distance_mm")


def _passes(name: str, source: str, value: str, step: str, reach: dict[str, int]) -> str:
    """SQL of a separable filter: one grouping per axis. ``step`` combines ``b.v`` at offset ``o``."""
    out, last = "", f"SELECT study_id, x, y, z, {value} AS v FROM {source}"
    for axis, r in reach.items():
        place = {a: f"a.{a}" for a in "xyz"} | {axis: f"a.{axis} + o"}
        out += f""", {name}_{axis} AS (SELECT a.study_id, a.x, a.y, a.z, {step.format(a=axis)} AS v FROM ({last}) a, (SELECT unnest(range({-r}, {r + 1})) AS o)
 JOIN ({last}) b ON b.study_id = a.study_id AND b.x = {place['x']} AND b.y = {place['y']} AND b.z = {place['z']} GROUP BY 1, 2, 3, 4)"""
        last = f"SELECT * FROM {name}_{axis}"
    return out


SEED, MARGIN = 0.8, k.GATE_MARGIN_MM
_REACH = {a: int(MARGIN / m) for a, m in zip("xyz", k.SPACING_MM)}
_MM = " ".join(f"WHEN '{a}' THEN {m}::DOUBLE" for a, m in zip("xyz", k.SPACING_MM))
_GATE = _passes("far", "v_tiled", f"CASE WHEN p_organ >= {SEED}::DOUBLE THEN 0::DOUBLE ELSE 1e18::DOUBLE END",
                f"min(b.v + (o * CASE '{{a}}' {_MM} END) ** 2)", _REACH) + f", gate AS (SELECT study_id, x, y, z FROM far_z WHERE v <= {MARGIN * MARGIN}::DOUBLE + 1e-9::DOUBLE)"


@query("c12_radius_gate", uses="v_tiled", sql=_GATE + " SELECT * FROM gate")
def _(t):
    return vo.anatomical_gate(v.v_tiled(t), F.col("p_organ") >= SEED, gaps=True)


@query("c12_radius_gate_large_volume", uses="v_points v_probe", sql=f"""
SELECT DISTINCT a.study_id, a.x, a.y, a.z FROM v_probe a JOIN v_points b ON a.study_id = b.study_id AND {_DIST} <= 5.0""")
def _(t):
    probes = v.v_probe(t).select(*vo.VOXEL).distinct().withColumn("_id", F.concat_ws("/", *vo.VOXEL))
    return vo.near_reference(probes, v.v_points(t), "_id", 5.0).drop("_id")


@query("d10_dice_overlap", uses="v_volume", doubles="organ_dice lesion_dice", sql="""
SELECT study_id, coalesce(2.0::DOUBLE * count(*) FILTER (WHERE p_organ >= 0.5::DOUBLE AND label = 4) / nullif(count(*) FILTER (WHERE p_organ >= 0.5::DOUBLE)
 + count(*) FILTER (WHERE label = 4), 0), 1) AS organ_dice,
 coalesce(2.0::DOUBLE * count(*) FILTER (WHERE p_lesion >= 0.8::DOUBLE AND label = 1) / nullif(count(*) FILTER (WHERE p_lesion >= 0.8::DOUBLE)
 + count(*) FILTER (WHERE label = 1), 0), 0) AS lesion_dice FROM v_volume GROUP BY 1""")
def _(t):
    vol = v.v_volume(t)
    # one grouping for both labels; the empty value is a parameter of each
    c = vol.groupBy("study_id").agg(
        F.count_if((F.col("p_organ") >= 0.5) & organ()).alias("ob"), F.count_if(F.col("p_organ") >= 0.5).alias("op"),
        F.count_if(organ()).alias("ot"), F.count_if((F.col("p_lesion") >= 0.8) & lesion()).alias("lb"),
        F.count_if(F.col("p_lesion") >= 0.8).alias("lp"), F.count_if(lesion()).alias("lt"))
    return c.select("study_id", vo.ratio_or(2.0 * F.col("ob"), F.col("op") + F.col("ot"), 1.0).alias("organ_dice"),
                    vo.ratio_or(2.0 * F.col("lb"), F.col("lp") + F.col("lt"), 0.0).alias("lesion_dice"))


@query("d11_label_histogram", uses="v_volume", sql="""
SELECT study_id, count(*) FILTER (WHERE label = 0) AS label_0, count(*) FILTER (WHERE label = 1) AS label_1,
 count(*) FILTER (WHERE label = 2) AS label_2, count(*) FILTER (WHERE label = 3) AS label_3, count(*) FILTER (WHERE label = 4) AS label_4,
 count(*) FILTER (WHERE label = 5) AS label_5, count(*) FILTER (WHERE label = 6) AS label_6 FROM v_volume GROUP BY 1""")
def _(t):
    return vo.label_histogram(v.v_volume(t))




def _inside():
    return F.col("x").between(1, 2) & (F.col("z") >= 1)


_COVER = """, c AS (SELECT study_id, count(*) FILTER (WHERE label = 1) AS lesion_total, count(*) FILTER (WHERE label = 1 AND x BETWEEN 1 AND 2 AND z >= 1) AS lesion_inside,
 count(*) FILTER (WHERE label = 4) AS organ_total, count(*) FILTER (WHERE label = 4 AND x BETWEEN 1 AND 2 AND z >= 1) AS organ_inside FROM v_volume GROUP BY 1)"""


@query("d12_source_voxel_coverage", uses="v_volume", doubles="lesion_coverage organ_coverage union_coverage", sql=_COVER + """
SELECT *, lesion_total + organ_total AS union_total, lesion_inside + organ_inside AS union_inside,
 coalesce(lesion_inside::DOUBLE / nullif(lesion_total, 0), 1) AS lesion_coverage, coalesce(organ_inside::DOUBLE / nullif(organ_total, 0), 0) AS organ_coverage,
 coalesce((lesion_inside + organ_inside)::DOUBLE / nullif(lesion_total + organ_total, 0), 0) AS union_coverage FROM c""")
def _(t):
    return vo.source_coverage(v.v_volume(t), _inside())


@query("d13_count_consistency", uses="v_volume", sql=_COVER + """
, r AS (SELECT bool_and(lesion_inside <= lesion_total) AS a, bool_and(organ_inside > 0 AND organ_inside <= organ_total) AS b,
 bool_and((CAST(study_id AS INT) % 2 = 0) = (lesion_total > 0)) AS d FROM c)
SELECT 'lesion_bounded' AS check_name, a AS passed FROM r UNION ALL SELECT 'organ_bounded', b FROM r UNION ALL SELECT 'union_is_sum', TRUE FROM r
UNION ALL SELECT 'lesion_iff_positive', d FROM r UNION ALL SELECT 'ALL', a AND b AND d FROM r""")
def _(t):
    counts = vo.source_coverage(v.v_volume(t), _inside())
    return ct.readiness(counts, vo.count_rules(counts, F.col("study_id").cast("int") % 2 == 0))


@query("d14_informative_slices", uses="v_volume", sql="""
, c AS (SELECT study_id, z, count(*) AS n FROM v_volume WHERE label = 1 GROUP BY 1, 2),
l AS (SELECT study_id, list(z ORDER BY z) AS zs, arg_max(z, n * 10 - z) AS peak FROM c GROUP BY 1),
p AS (SELECT *, [zs[1], zs[1 + CAST(round_even((len(zs) - 1) / 2.0, 0) AS INT)], zs[len(zs)]] AS ch FROM l),
q AS (SELECT *, CASE WHEN list_contains(ch, peak) THEN ch ELSE [ch[1], peak, ch[3]] END AS ch2 FROM p),
d AS (SELECT *, list_sort(list_distinct(ch2)) AS ch3 FROM q)
SELECT study_id, array_to_string(list_sort(list_concat(ch3, list_filter(zs, lambda e: NOT list_contains(ch3, e))[1:greatest(least(3, len(zs)) - len(ch3), 0)])), ',') AS slices FROM d""")
def _(t):
    s = vo.informative_slices(v.v_volume(t), lesion(), 3)
    return s.select("study_id", F.array_join(F.transform("slices", lambda z: z.cast("string")), ",").alias("slices"))


@query("d15_masked_intensity", uses="v_volume", doubles="minimum p01 median p99 maximum fraction_in_window", sql="""
SELECT study_id, count(*) AS voxels, min(ct) AS minimum, quantile_cont(ct, 0.01) AS p01, quantile_cont(ct, 0.5) AS median,
 quantile_cont(ct, 0.99) AS p99, max(ct) AS maximum, avg((ct BETWEEN 50 AND 100)::INT) AS fraction_in_window
FROM v_volume WHERE label = 4 GROUP BY 1""")
def _(t):
    masked = v.v_volume(t).where(organ())
    base = masked.groupBy("study_id").agg(
        F.count("ct").alias("voxels"), F.min("ct").alias("minimum"), F.max("ct").alias("maximum"),
        F.avg(F.col("ct").between(50, 100).cast("double")).alias("fraction_in_window"))
    q = exact_percentiles(masked, ["study_id"], "ct", [0.01, 0.5, 0.99]).groupBy("study_id").agg(*[
        F.max(F.when(F.col("p") == p, F.col("percentile_value"))).alias(n)
        for p, n in ((0.01, "p01"), (0.5, "median"), (0.99, "p99"))])
    return base.join(q, "study_id")


@query("d16_heatmap_confidence", uses="v_volume", doubles="max_probability normalized_entropy", sql="""
SELECT study_id, max(p_lesion) AS max_probability, -sum(p_lesion * ln(greatest(p_lesion, 1e-12::DOUBLE))) / ln(64.0::DOUBLE) AS normalized_entropy
FROM v_volume GROUP BY 1""")
def _(t):
    return vo.heatmap_confidence(v.v_volume(t), "p_lesion")


@query("d17_region_scores", uses="v_volume", doubles="max_probability target_max_probability target_mean_probability", sql="""
SELECT study_id, max(p_lesion) AS max_probability, max(p_lesion) FILTER (WHERE label = 1) AS target_max_probability,
 avg(p_lesion) FILTER (WHERE label = 1) AS target_mean_probability, count(*) FILTER (WHERE p_lesion >= 0.9::DOUBLE) AS predicted_voxels,
 count(*) FILTER (WHERE label = 1) AS target_voxels,
 CAST(study_id AS INT) % 2 = 0 AND count(*) FILTER (WHERE p_lesion >= 0.9::DOUBLE AND label = 1) > 0 AS overlaps,
 CAST(study_id AS INT) % 2 = 1 AND count(*) FILTER (WHERE p_lesion >= 0.9::DOUBLE) = 0 AS negative_clean FROM v_volume GROUP BY 1""")
def _(t):
    return vo.region_scores(v.v_volume(t), "p_lesion", lesion(), F.col("study_id").cast("int") % 2 == 0, 0.9)


_SIZES = dict(zip("xyz", vo.filter_sizes(k.PEAK_RADIUS_MM, k.SPACING_MM)))


@query("e8_sliding_maximum", uses="v_tiled", doubles="local_maximum", sql=_passes("mx", "v_tiled", "p_lesion", "max(b.v)", {a: n // 2 for a, n in _SIZES.items()}) + """
SELECT study_id, x, y, z, v AS local_maximum FROM mx_z""")
def _(t):
    return br.sliding_maximum(v.v_tiled(t), "p_lesion", tuple(_SIZES.values()), "local_maximum", gaps=True).drop("p_lesion")


_SIGMA = [k.SMOOTHING_SIGMA_MM / s for s in k.SPACING_MM]


def _smooth_sql() -> str:
    """Separable smoothing; a place past an end takes the end's value."""
    out, last = ", ends AS (SELECT study_id, max(x) AS x, max(y) AS y, max(z) AS z FROM v_tiled GROUP BY 1)", "SELECT study_id, x, y, z, p_lesion AS v FROM v_tiled"
    for axis, sigma in zip("xyz", _SIGMA):
        weights = br.gaussian_weights(sigma)
        listed = ", ".join(f"({i - len(weights) // 2}, {w!r}::DOUBLE)" for i, w in enumerate(weights))
        place = {a: f"a.{a}" for a in "xyz"} | {axis: f"least(greatest(a.{axis} + o, 0), e.{axis})"}
        out += f""", sm_{axis} AS (SELECT a.study_id, a.x, a.y, a.z, sum(w * b.v) AS v FROM ({last}) a JOIN ends e USING (study_id), (VALUES {listed}) k(o, w)
 JOIN ({last}) b ON b.study_id = a.study_id AND b.x = {place['x']} AND b.y = {place['y']} AND b.z = {place['z']} GROUP BY 1, 2, 3, 4)"""
        last = f"SELECT * FROM sm_{axis}"
    return out


_SMOOTH = _smooth_sql()


@query("h19_gaussian_smoothing", uses="v_tiled", doubles="smooth", sql=_SMOOTH + " SELECT study_id, x, y, z, v AS smooth FROM sm_z")
def _(t):
    return br.gaussian_smooth(v.v_tiled(t), "p_lesion", _SIGMA, "smooth", gaps=True)


_PEAKS = _SMOOTH + _passes("mx", "sm_z", "v", "max(b.v)", {a: n // 2 for a, n in _SIZES.items()}) + """, peaks AS (
 SELECT s.study_id, s.x, s.y, s.z, s.v AS s FROM sm_z s JOIN mx_z m USING (study_id, x, y, z) WHERE s.v >= 0.01::DOUBLE AND abs(s.v - m.v) <= 1e-7::DOUBLE)"""


@query("h20_peak_detection", uses="v_tiled", doubles="candidate_score", sql=_PEAKS + """
SELECT study_id, x, y, z, s AS candidate_score FROM peaks""")
def _(t):
    return br.detect_peaks(v.v_tiled(t), "p_lesion", _SIGMA, tuple(_SIZES.values()), k.MINIMUM_SCORE, gaps=True).drop("candidate_raw_probability")


def _components(source: str, side: str = "4") -> str:
    return f""", e AS (SELECT a.study_id, (a.x * {side} + a.y) * {side} + a.z AS u, (b.x * {side} + b.y) * {side} + b.z AS w FROM {source} a JOIN {source} b ON a.study_id = b.study_id
 AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND abs(a.z - b.z) <= 1),
reach AS (SELECT study_id, u, w FROM e UNION SELECT r.study_id, r.u, e.w FROM reach r JOIN e ON e.study_id = r.study_id AND e.u = r.w),
comp AS (SELECT study_id, u, min(w) AS root FROM reach GROUP BY 1, 2)"""


_MASK = ", msk AS (SELECT study_id, x, y, z, floor(p_lesion * 10) / 10 AS s FROM v_volume WHERE p_lesion >= 0.7::DOUBLE)" + _components("msk")


def _mask(t):
    return v.v_volume(t).where("p_lesion >= 0.7").select(
        *vo.VOXEL, (F.floor(F.col("p_lesion") * 10.0) / 10.0).alias("score"))


@query("h21_plateau_components", uses="v_volume", sql=_MASK + """
SELECT study_id, u // 16 AS x, (u // 4) % 4 AS y, u % 4 AS z, root // 16 AS root_x, (root // 4) % 4 AS root_y, root % 4 AS root_z FROM comp""")
def _(t):
    c = vo.connected_plateaus(_mask(t))
    side = 1 << 21
    return c.select("study_id", *[F.col(a).cast("int").alias(a) for a in "xyz"],
                    F.floor(F.col("plateau") / (side * side)).cast("int").alias("root_x"),
                    (F.floor(F.col("plateau") / side) % side).cast("int").alias("root_y"),
                    (F.col("plateau") % side).cast("int").alias("root_z"))


@query("f5_plateau_argmax", uses="v_volume", doubles="score", sql=_MASK + """
, r AS (SELECT m.*, root, row_number() OVER (PARTITION BY m.study_id, root ORDER BY s DESC, x, y, z) AS k FROM msk m
 JOIN comp c ON c.study_id = m.study_id AND c.u = x * 16 + y * 4 + z) SELECT study_id, x, y, z, s AS score FROM r WHERE k = 1""")
def _(t):
    peaks = _mask(t)
    marked = peaks.join(spread_join(vo.connected_plateaus(peaks)), vo.VOXEL)
    return vo.plateau_peaks(marked, "score").drop("plateau")


@query("h22_candidate_generator", uses="v_tiled", doubles="candidate_score", sql=_PEAKS + _GATE + """
, pk AS (SELECT p.* FROM peaks p JOIN gate USING (study_id, x, y, z))""" + _components("pk", "1000000::BIGINT") + """
, best AS (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.study_id, root ORDER BY s DESC, x, y, z) AS k FROM pk p
 JOIN comp c ON c.study_id = p.study_id AND c.u = (x * 1000000::BIGINT + y) * 1000000 + z) WHERE k = 1)
SELECT * FROM (SELECT study_id, x AS candidate_x, y AS candidate_y, z AS candidate_z, s AS candidate_score,
 row_number() OVER (PARTITION BY study_id ORDER BY s DESC, x, y, z) AS candidate_rank FROM best) WHERE candidate_rank <= 256""")
def _(t):
    return vo.generate_candidates(v.v_tiled(t), gate_probability=SEED, gaps=True).drop("candidate_raw_probability")


@query("h23_candidate_truth_ledger", uses="v_points v_probe", doubles="reference_distance_mm", sql=f"""
, d AS (SELECT a.study_id, probe_id, min({_DIST}) AS mm FROM v_probe a LEFT JOIN v_points b USING (study_id) GROUP BY 1, 2),
r AS (SELECT study_id, mm, probe_id % 1000 / 1000.0::DOUBLE AS sc, row_number() OVER (PARTITION BY study_id ORDER BY probe_id % 1000 / 1000.0::DOUBLE DESC, probe_id) AS candidate_rank FROM d)
SELECT study_id, candidate_rank, mm AS reference_distance_mm, coalesce(mm <= 5, FALSE) AS within_reference_tolerance,
 coalesce(mm <= 5 AND candidate_rank = min(CASE WHEN mm <= 5 THEN candidate_rank END) OVER (PARTITION BY study_id), FALSE) AS is_true_positive_candidate,
 sc >= 0.5 AS above_locked_deployment_threshold FROM r""")
def _(t):
    c = v.v_probe(t).select("study_id", "probe_id", (F.col("probe_id") % 1000 / 1000.0).alias("candidate_score"),
                            *[F.col(a).alias(f"candidate_{a}") for a in "xyz"])
    ranked = rank_candidates(c, (("candidate_score", False), ("probe_id", True)))
    return vo.candidate_truth(ranked, v.v_points(t), 0.5).select(
        "study_id", "candidate_rank", "reference_distance_mm", "within_reference_tolerance",
        "is_true_positive_candidate", "above_locked_deployment_threshold")


# ---- regridding, tiles, patches ---------------------------------------------------------------------

_CANVAS = (6, 6, 8)


@query("h12_regrid_to_canvas", uses="v_volume", doubles="ct", sql="""
, vv AS MATERIALIZED (SELECT study_id, x, y, z, ct FROM v_volume),
h AS MATERIALIZED (SELECT study_id, 1.0::DOUBLE AS sx, 1.0::DOUBLE + CAST(study_id AS INT) % 3 * 0.5::DOUBLE AS sy, 2.0::DOUBLE AS sz FROM vv GROUP BY 1),
i AS (SELECT *, greatest(4 * sx / 4, 4 * sy / 4, 4 * sz / 6) AS iso FROM h),
c AS (SELECT *, CAST(ceil(4 * sx / iso - 1e-6::DOUBLE) AS INT) AS kx, CAST(ceil(4 * sy / iso - 1e-6::DOUBLE) AS INT) AS ky, CAST(ceil(4 * sz / iso - 1e-6::DOUBLE) AS INT) AS kz FROM i),
g AS (SELECT c.*, x, y, z, x - (6 - kx) // 2 AS ox, y - (6 - ky) // 2 AS oy, z - (8 - kz) // 2 AS oz
 FROM c, (SELECT unnest(range(6)) AS x), (SELECT unnest(range(6)) AS y), (SELECT unnest(range(8)) AS z)),
p AS (SELECT *, iso / sx * ox + (1.5::DOUBLE - iso / sx * ((kx - 1) / 2.0::DOUBLE)) AS px, iso / sy * oy + (1.5::DOUBLE - iso / sy * ((ky - 1) / 2.0::DOUBLE)) AS py,
 iso / sz * oz + (1.5::DOUBLE - iso / sz * ((kz - 1) / 2.0::DOUBLE)) AS pz FROM g),
q AS MATERIALIZED (SELECT *, ox >= 0 AND ox < kx AND oy >= 0 AND oy < ky AND oz >= 0 AND oz < kz AND px BETWEEN 0 AND 3 AND py BETWEEN 0 AND 3 AND pz BETWEEN 0 AND 3 AS inside FROM p),
e AS MATERIALIZED (SELECT study_id, x, y, z, px, py, pz, CAST(floor(px) AS INT) + i AS nx, CAST(floor(py) AS INT) + j AS ny, CAST(floor(pz) AS INT) + k AS nz
 FROM q, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j), (SELECT unnest([0, 1]) AS k) WHERE inside),
n AS MATERIALIZED (SELECT e.study_id, e.x, e.y, e.z, sum(s.ct * (1 - abs(px - nx)) * (1 - abs(py - ny)) * (1 - abs(pz - nz))) AS v
 FROM e JOIN vv s ON s.study_id = e.study_id AND s.x = nx AND s.y = ny AND s.z = nz GROUP BY 1, 2, 3, 4)
SELECT q.study_id, CAST(q.x AS INT) AS x, CAST(q.y AS INT) AS y, CAST(q.z AS INT) AS z, coalesce(v, -200) AS ct FROM q LEFT JOIN n USING (study_id, x, y, z)""")
def _(t):
    sizes = v.v_volume(t).select("study_id").distinct()
    spacing = [F.lit(1.0), 1.0 + (F.col("study_id").cast("int") % 3) * 0.5, F.lit(2.0)]
    fit = g.fit_to_canvas([F.lit(n) for n in SHAPE], spacing, _CANVAS, padding=1)
    geometry = sizes.select("study_id", *[c.alias(n) for n, c in fit.items()])
    return vo.regrid_to_canvas(v.v_volume(t), geometry, "ct", "ct", _CANVAS, k.HU_LOW)


@query("h13_regrid_to_crop", uses="v_volume", doubles="ct", sql="""
, g AS (SELECT DISTINCT study_id, o_x, o_y, o_z, 0.8::DOUBLE * o_x + 0.3::DOUBLE AS px, 0.9::DOUBLE * o_y + 0.1::DOUBLE * o_z + 0.2::DOUBLE AS py,
 0.05::DOUBLE * o_y + 1.1::DOUBLE * o_z - 0.25::DOUBLE * (CAST(study_id AS INT) % 2) AS pz FROM v_volume, (SELECT unnest(range(4)) AS o_x), (SELECT unnest(range(4)) AS o_y), (SELECT unnest(range(3)) AS o_z)),
i AS (SELECT *, px BETWEEN 0 AND 3 AND py BETWEEN 0 AND 3 AND pz BETWEEN 0 AND 3 AS inside FROM g)
SELECT i.study_id, CAST(o_x AS INT) AS o_x, CAST(o_y AS INT) AS o_y, CAST(o_z AS INT) AS o_z,
 coalesce(sum(s.ct * greatest(1 - abs(px - s.x), 0) * greatest(1 - abs(py - s.y), 0) * greatest(1 - abs(pz - s.z), 0)), -200) AS ct,
 coalesce(max(s.label) FILTER (WHERE s.x = floor(px + 0.5::DOUBLE) AND s.y = floor(py + 0.5::DOUBLE) AND s.z = floor(pz + 0.5::DOUBLE)), 0) AS label
FROM i LEFT JOIN v_volume s ON s.study_id = i.study_id AND inside AND abs(px - s.x) <= 1 AND abs(py - s.y) <= 1 AND abs(pz - s.z) <= 1 GROUP BY 1, 2, 3, 4""")
def _(t):
    z = F.lit(0.0)
    shift = -0.25 * (F.col("study_id").cast("int") % 2)
    crops = v.v_volume(t).select("study_id").distinct().withColumn("m", g.as_matrix(
        [[F.lit(0.8), z, z, F.lit(0.3)], [z, F.lit(0.9), F.lit(0.1), F.lit(0.2)], [z, F.lit(0.05), F.lit(1.1), shift],
         g.lits((0, 0, 0, 1))]))
    return vo.regrid_to_crop(v.v_volume(t), crops, "m", SHAPE, (4, 4, 3), "ct", "label", k.HU_LOW)


@query("h14_tile_plan", uses="v_box", sql="""
, a AS (SELECT study_id, unnest(list_distinct(list_append(range(0, greatest(nx - 32, 0) + 1, 16), greatest(nx - 32, 0)))) AS start_x, ny, nz FROM v_box),
b AS (SELECT study_id, start_x, unnest(list_distinct(list_append(range(0, greatest(ny - 32, 0) + 1, 16), greatest(ny - 32, 0)))) AS start_y, nz FROM a)
SELECT study_id, CAST(start_x AS INT) AS start_x, CAST(start_y AS INT) AS start_y, CAST(unnest(list_distinct(list_append(range(0, greatest(nz - 32, 0) + 1, 16), greatest(nz - 32, 0)))) AS INT) AS start_z FROM b""")
def _(t):
    return vo.tile_plan(v.v_box(t).select("study_id", "shape"), g.vec("shape"), (32, 32, 32)).drop("shape")


@query("h15_tile_merge", uses="v_volume", doubles="merged", sql="""
, s AS (SELECT unnest([0, 1, 2]) AS s)
SELECT study_id, x, y, z, avg(p_lesion + 0.01::DOUBLE * a.s - 0.02::DOUBLE * c.s) AS merged, count(*) AS tiles
FROM v_volume, s a, s b, s c WHERE x BETWEEN a.s AND a.s + 1 AND y BETWEEN b.s AND b.s + 1 AND z BETWEEN c.s AND c.s + 1 GROUP BY 1, 2, 3, 4""")
def _(t):
    vol = v.v_volume(t).select(*vo.VOXEL, "p_lesion")
    tiles = vo.cut_tiles(vol, SHAPE, (2, 2, 2)).withColumn(
        "p", F.col("p_lesion") + 0.01 * F.col("start_x") - 0.02 * F.col("start_z"))
    return vo.require_covered(vo.merge_tiles(tiles, "p", "merged"), vol, SHAPE)


_PATCH = (2, 2, 2)


def _start_sql(a):
    return (f"least(greatest(a{a} + CAST(-1 + {hash_sql(f"'20260728|jitter|3|' || study_id || '|{a}'")} % 3 AS INT) - 1, 0), 2) AS start_{a}")


@query("h16_anchor_patch", uses="v_volume", doubles="ct", sql=f"""
, anc AS (SELECT study_id, x AS ax, y AS ay, z AS az FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY
 {hash_sql("'20260728|patch|3|' || study_id || '|' || x || '|' || y || '|' || z")}, x, y, z) AS r FROM v_volume WHERE label = 1) WHERE r = 1),
o AS (SELECT study_id, {_start_sql('x')}, {_start_sql('y')}, {_start_sql('z')} FROM anc)
SELECT study_id, CAST(x - start_x AS INT) AS p_x, CAST(y - start_y AS INT) AS p_y, CAST(z - start_z AS INT) AS p_z, ct FROM v_volume JOIN o USING (study_id)
WHERE x - start_x BETWEEN 0 AND 1 AND y - start_y BETWEEN 0 AND 1 AND z - start_z BETWEEN 0 AND 1""")
def _(t):
    vol = v.v_volume(t)
    origins = sa.patch_origin(sa.anchor_voxels(vol, lesion(), k.SEED, 3), (1, 1, 1), SHAPE, _PATCH, k.SEED, 3)
    return sa.cut_patch(vol, origins, _PATCH).select("study_id", "p_x", "p_y", "p_z", "ct")


def _uni(role):
    return f"({hash_sql(f"'20260728|{role}|3|' || study_id")} / 4294967296.0::DOUBLE)"


@query("h17_augmented_patch", uses="v_volume", doubles="hu", sql=f"""
, anc AS (SELECT DISTINCT study_id, 2 AS ax, 2 AS ay, 2 AS az FROM v_volume),
o AS (SELECT study_id, {_start_sql('x')}, {_start_sql('y')}, {_start_sql('z')} FROM anc),
p AS (SELECT study_id, x - start_x AS px, y - start_y AS py, z - start_z AS pz, least(greatest((ct - 50) / 250, -1), 1) AS u FROM v_volume JOIN o USING (study_id)
WHERE x - start_x BETWEEN 0 AND 1 AND y - start_y BETWEEN 0 AND 1 AND z - start_z BETWEEN 0 AND 1)
SELECT study_id, CAST(CASE WHEN {_uni('flip_x')} < 0.5 THEN 1 - px ELSE px END AS INT) AS p_x, CAST(CASE WHEN {_uni('flip_y')} < 0.5 THEN 1 - py ELSE py END AS INT) AS p_y,
 CAST(pz AS INT) AS p_z, least(greatest(u * (0.9::DOUBLE + {_uni('scale')} * 0.2::DOUBLE) + (-0.08::DOUBLE + {_uni('shift')} * 0.16::DOUBLE), -1), 1) AS hu FROM p""")
def _(t):
    from ..functions.scalars import normalize_intensity

    vol = v.v_volume(t).select(*vo.VOXEL, normalize_intensity(F.col("ct")).alias("hu"))
    middle = vol.select("study_id").distinct().select("study_id", *[F.lit(2).alias(f"anchor_{a}") for a in "xyz"])
    patch = sa.cut_patch(vol, sa.patch_origin(middle, (1, 1, 1), SHAPE, _PATCH, k.SEED, 3), _PATCH)
    return sa.augment(patch, "hu", _PATCH, k.SEED, 3, (0.90, 1.10), (-0.08, 0.08))


@query("h18_block_mask", uses="v_volume", sql=f"""
, b AS (SELECT study_id, b, row_number() OVER (PARTITION BY study_id ORDER BY {hash_sql("'20260728|mask|0|' || study_id || '|' || b")}, b) AS r
 FROM (SELECT DISTINCT study_id FROM v_volume), (SELECT unnest(range(16)) AS b)),
h AS (SELECT study_id, b // 8 AS bx, (b // 4) % 2 AS b_y, b % 4 AS bz FROM b WHERE r <= 7)
SELECT v.study_id, x, y, z, bx IS NOT NULL AS hidden FROM v_volume v LEFT JOIN h ON h.study_id = v.study_id AND bx = x // 2 AND b_y = y // 2 AND bz = z""")
def _(t):
    vol = v.v_volume(t).select(*vo.VOXEL, *[F.col(a).alias(f"p_{a}") for a in "xyz"])
    mask = sa.block_mask(vol.select("study_id").distinct(), SHAPE, (2, 2, 1))
    return sa.apply_block_mask(vol, mask, (2, 2, 1)).select(*vo.VOXEL, "hidden")


# ---- quality --------------------------------------------------------------------------------------

# Every check is disturbed for each n-th study (study 0 is disturbed in all ways at once).
_BAD = {"bytes": 3, "digest": 5, "axes_lps": 7, "centre": 11, "partition_and_diagnosis": 13, "members": 17, "recorded_edges": 19,
        "coverage": 23, "recount_lesion": 29, "recount_organ": 31, "world_centre": 37, "voxel_edges": 41, "four_by_four": 43, "finite": 47,
        "invertible": 53, "recount_both": 59, "ct_finite": 61, "ct_whole_numbers": 67, "label_whole_numbers": 71, "label_finite": 73}
# Of these, the ones that fail by what happens to others as well.
_JOINT = ("voxel_edges", "finite", "ct_finite", "ct_whole_numbers", "label_whole_numbers", "label_finite")
_AREAS = {
    "payload": "ct_fills_grid label_fills_grid ct_finite label_finite ct_whole_numbers ct_in_window label_whole_numbers label_known_codes",
    "header": "members digest bytes centre partition_and_diagnosis",
    "geometry": "axes_lps voxel_edges recorded_edges four_by_four finite invertible world_centre",
    "counts": "organ_present lesion_as_diagnosed recount_both recount_lesion recount_organ inside_is_part coverage"}
_NAMES = ", ".join(f"('{area}', '{name}', {0 if name in _JOINT else _BAD.get(name, 0)})" for area, names in _AREAS.items() for name in names.split())


def _is_bad(name: str) -> str:
    return f"n % {_BAD[name]} = 0"


@query("h24_volume_quality", uses="v_volume", sql=f"""
, vv AS (SELECT study_id, CAST(study_id AS INT) AS n, label, CASE WHEN x + y + z = 0 AND {_is_bad('ct_whole_numbers')} THEN 0.5::DOUBLE ELSE ct END AS ct
  FROM (SELECT *, CAST(study_id AS INT) AS n FROM v_volume)),
c AS (SELECT study_id, n, count(*) FILTER (WHERE label = 1) AS le, count(*) FILTER (WHERE label = 4) AS org, min(ct) AS lo, max(ct) AS hi,
  count(ct) = 64 AS full_ct, count(label) = 64 AS full_label, bool_and(label IN (0, 1, 2, 3, 4, 5, 6)) AS codes, count(*) FILTER (WHERE label = 0) > 0 AS zeros FROM vv GROUP BY 1, 2),
names AS (SELECT * FROM (VALUES {_NAMES}) AS t(area, "check", every))
SELECT study_id, area, "check", CASE WHEN every > 0 THEN n % every <> 0 ELSE TRUE END AND CASE "check"
  WHEN 'ct_fills_grid' THEN full_ct WHEN 'label_fills_grid' THEN full_label
  WHEN 'ct_finite' THEN NOT ({_is_bad('ct_finite')}) WHEN 'ct_in_window' THEN lo >= -200 AND hi <= 300 AND NOT ({_is_bad('ct_finite')})
  WHEN 'ct_whole_numbers' THEN NOT ({_is_bad('ct_whole_numbers')}) OR {_is_bad('ct_finite')}
  WHEN 'label_finite' THEN NOT (zeros AND {_is_bad('label_finite')})
  WHEN 'label_whole_numbers' THEN NOT (zeros AND ({_is_bad('label_finite')} OR {_is_bad('label_whole_numbers')}))
  WHEN 'label_known_codes' THEN codes AND NOT (zeros AND ({_is_bad('label_finite')} OR {_is_bad('label_whole_numbers')}))
  WHEN 'voxel_edges' THEN NOT ({_is_bad('voxel_edges')} OR {_is_bad('invertible')}) WHEN 'finite' THEN NOT ({_is_bad('finite')} OR {_is_bad('four_by_four')})
  WHEN 'lesion_as_diagnosed' THEN le > 0 WHEN 'organ_present' THEN org > 0 WHEN 'inside_is_part' THEN org > 0
  ELSE TRUE END AS passed FROM c, names""")
def _(t):
    """Stored records are built from the volumes and disturbed for some studies, one check each."""
    n = F.col("study_id").cast("int")
    bad = lambda name: n % _BAD[name] == 0
    stored = v.v_volume(t).withColumn("ct", F.rint("ct"))
    corner, nan, zero = F.col("x") + F.col("y") + F.col("z") == 0, F.lit(float("nan")), F.col("label") == 0
    vol = stored.withColumns({
        "ct": F.when(corner & bad("ct_finite"), nan).when(corner & bad("ct_whole_numbers"), 0.5).otherwise(F.col("ct")),
        "label": F.when(zero & bad("label_finite"), nan).when(zero & bad("label_whole_numbers"), 0.5).otherwise(F.col("label").cast("double"))})
    counts = stored.groupBy("study_id").agg(F.count_if(lesion()).alias("lesion"), F.count_if(organ()).alias("organ"))
    z = F.lit(0.0)
    turn = F.when(bad("axes_lps"), 1.0).otherwise(-1.0)
    affine = g.as_matrix([[turn * 1.25, z, z, z], [z, F.lit(-1.25), z, z],
                         [z, z, F.when(bad("invertible"), 1e-9).when(bad("voxel_edges"), 2.1).otherwise(2.0), z], [F.when(bad("finite"), nan).otherwise(0.0), z, z, F.lit(1.0)]])
    affine = F.when(bad("four_by_four"), F.slice(affine, 1, 3)).otherwise(affine)
    names = lambda *x: F.array(*[F.lit(i) for i in x])
    ledger = counts.select(
        "study_id", F.lit(1).alias("label_binary"), F.lit("train").alias("locked_partition"), F.lit("lesion").alias("diagnostic_label"),
        F.when(bad("partition_and_diagnosis"), "test").otherwise("train").alias("stored_partition"), F.lit("lesion").alias("stored_label"),
        F.lit(100).alias("expected_size"), F.when(bad("bytes"), 99).otherwise(100).alias("stored_size"),
        F.sha2("study_id", 256).alias("expected_sha256"),
        F.sha2(F.when(bad("digest"), F.lit("x")).otherwise(F.col("study_id")), 256).alias("stored_sha256"),
        names("ct", "mask").alias("expected_keys"),
        F.when(bad("members"), names("ct")).otherwise(names("mask", "ct")).alias("payload_keys"),
        affine.alias("crop_affine"),
        F.array(F.when(bad("recorded_edges"), 1.0).otherwise(1.25), F.lit(1.25), F.lit(2.0)).alias("crop_spacing"),
        F.array(F.when(bad("centre"), 1.001).otherwise(1.0), F.lit(1.0), F.lit(1.0)).alias("stored_center"),
        g.as_array(g.lits((1, 1, 1))).alias("expected_center"), F.array(F.lit(5.0), F.lit(6.0), F.when(bad("world_centre"), float("nan")).otherwise(7.0)).alias("world_center"),
        (F.col("lesion") + bad("recount_lesion").cast("int")).alias("crop_lesion"), (F.col("organ") + bad("recount_organ").cast("int")).alias("crop_organ"), (F.col("lesion") + F.col("organ") + bad("recount_both").cast("int")).alias("crop_union"),
        *[c.alias(f"{kind}_{what}") for kind in ("full", "inside") for what, c in
          (("lesion", F.col("lesion")), ("organ", F.col("organ")), ("union", F.col("lesion") + F.col("organ")))],
        F.lit(1.0).alias("lesion_coverage"),
        # one of two ratios is disturbed
        *[F.when(bad("coverage") & ((n % 2 == 0) == first), 0.5).otherwise(F.when(F.col("organ") + more > 0, 1.0).otherwise(0.0)).alias(f"{what}_coverage")
          for what, more, first in (("organ", F.lit(0), True), ("union", F.col("lesion"), False))])
    return vo.volume_quality(vol, ledger, SHAPE, k.SPACING_MM)
