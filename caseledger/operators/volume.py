"""Voxel-table operators: distances, gates, filters, peaks, tiles, regridding, quality.

A volume is many rows ``(study_id, x, y, z, value...)``. Work that runs along
one axis gathers *lines* (one row per line, an array as long as the axis), so
the largest group is one axis, whatever the number or size of studies; no
operator gathers a volume or a study.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import constants as k
from ..functions.scalars import clamp
from ..session import cut_lineage, ship_package, spread, spread_join
from .bricks import detect_peaks, within_gate
from .detection import match_candidates, top_candidates

AXES = ("x", "y", "z")
VOXEL = ["study_id", *AXES]


# ---- lines --------------------------------------------------------------------------------------

def along_axis(voxels: DataFrame, axis: str, carry: Sequence[str],
               outputs: dict[str, Callable[[dict[str, Column]], Column]],
               keys: Sequence[str] = ("study_id",)) -> DataFrame:
    """Applies array functions to every line of ``axis``.

    ``outputs`` map a name to a function of the carried value arrays (ordered by
    the axis coordinate) giving an array. Coordinates must run 0..n-1, each once:
    a line with a gap fails the query, as its values would move.
    Per-study constants may ride along in ``keys``.
    """
    others = [a for a in AXES if a != axis]
    lines = voxels.groupBy(*keys, *others).agg(
        F.array_sort(F.collect_list(F.struct(axis, *carry))).alias("_line"))

    def member(name: str) -> Column:
        return F.transform("_line", lambda s: s[name])

    at = member(axis)
    whole = (F.element_at(at, 1) == 0) & (F.element_at(at, -1) == F.size("_line") - 1)
    message = F.concat(F.lit(f"a line along {axis} has a gap in study "), F.coalesce(F.col("study_id").cast("string"), F.lit("null")))
    lines = lines.withColumn("_line", F.when(whole & (F.size(F.array_distinct(at)) == F.size("_line")), F.col("_line")).otherwise(F.raise_error(message)))
    step = lines.select(*keys, *others, *[member(c).alias(f"_in_{c}") for c in carry])
    seen = {c: F.col(f"_in_{c}") for c in carry}
    for name, fn in outputs.items():  # later outputs may use earlier ones
        step = step.withColumn(f"_out_{name}", fn(seen))
        seen[name] = F.col(f"_out_{name}")
    zipped = F.arrays_zip(*[F.col(f"_out_{n}").alias(n) for n in outputs])
    rows = step.select(*keys, *others, F.posexplode(zipped).alias(axis, "_v"))
    return rows.select(*keys, *AXES, *[F.col("_v")[n].alias(n) for n in outputs])


def filter_sizes(radius_mm: float, spacing: Sequence[float]) -> tuple[int, ...]:
    """Odd box sizes covering a radius in mm on each axis."""
    return tuple(2 * math.ceil(radius_mm / s) + 1 for s in spacing)


# ---- distances ----------------------------------------------------------------------------------

def near_reference(probes: DataFrame, references: DataFrame, identity: str, radius: float,
                   spacing: Sequence[float] = k.SPACING_MM) -> DataFrame:
    """Probes within ``radius`` mm of a reference voxel of their study. For few probes
    in large volumes; :func:`anatomical_gate` serves when all voxels are asked for."""
    return nearest_distance(probes, references, identity, spacing, radius).where(
        F.col("reference_distance_mm").isNotNull()).drop("reference_distance_mm")


def anatomical_gate(voxels: DataFrame, seed: Column, radius: float = k.GATE_MARGIN_MM,
                    spacing: Sequence[float] = k.SPACING_MM, gaps: bool = False) -> DataFrame:
    """Voxels (study_id, x, y, z) of dense volumes within the radius of a seed voxel; a study
    without seeds passes whole. By distance transform on bricks: a pass writes a row per voxel.
    With ``gaps``, voxels may be absent; a distance then does not lead through them."""
    marked = voxels.select(*VOXEL, F.coalesce(seed, F.lit(False)).cast("double").alias("_seed"))
    near = within_gate(marked, "_seed", radius, spacing, gaps=gaps).select(*VOXEL)
    seeded = marked.where("_seed <> 0").select("study_id").distinct()
    return near.unionByName(voxels.select(*VOXEL).join(seeded, "study_id", "left_anti"))


def nearest_distance(probes: DataFrame, references: DataFrame, identity: str,
                     spacing: Sequence[float] = k.SPACING_MM, limit: float | None = None, levels: int = 4,
                     factor: int = 4) -> DataFrame:
    """Exact distance in mm from each probe to the nearest reference voxel of its study.

    A pyramid of occupied cells (edges 4, 16, 64, 256 voxels) is searched from the top, not
    by probes but by the cells of edge 4 that hold any: cells whose nearest possible point
    is farther than another cell's farthest possible point are dropped, and only the rest
    are opened. Each step is an equi-join on (study, cell), so a crowded study spreads over
    cells. A task then measures the distinct places of a block of 4 x 4 x 4 such cells
    against the voxels of the reference cells that are left. So the search grows with the
    occupied cells, and a probe is shuffled for its distinct place and for its answer only.
    Studies without references give null, and so do distances above ``limit`` if one is
    given: such cells leave the search as soon as their bounds show it.
    """
    ship_package(probes.sparkSession)
    refs = references.select(*VOXEL).where("study_id IS NOT NULL")
    spot, block = [f"p_{a}" for a in AXES], [f"b_{a}" for a in AXES]
    own = [f"q_{a}" for a in AXES]

    def cell(c: Column, level: int) -> Column:
        return F.floor(c / factor ** level).cast("int")

    # level 1: cells with their voxels; level i: occupied cells with the tight box of their content.
    leaves = cut_lineage(refs.groupBy("study_id", *[cell(F.col(a), 1).alias(f"c_{a}") for a in AXES]).agg(
        *[F.min(a).alias(f"lo_{a}") for a in AXES], *[F.max(a).alias(f"hi_{a}") for a in AXES],
        F.collect_set(F.array(*[F.col(a).cast("int") for a in AXES])).alias("_voxels")))
    pyramid = [leaves.drop("_voxels")]
    for _ in range(1, levels):
        below = pyramid[-1]
        pyramid.append(below.groupBy("study_id", *[cell(F.col(f"c_{a}"), 1).alias(f"c_{a}") for a in AXES]).agg(
            *[F.min(f"lo_{a}").alias(f"lo_{a}") for a in AXES], *[F.max(f"hi_{a}").alias(f"hi_{a}") for a in AXES]))

    located = probes.select("*", *[F.col(a).cast("double").alias(p) for a, p in zip(AXES, spot)])
    whole = F.lit(True)
    for c in ("study_id", *spot):
        whole = whole & F.col(c).isNotNull()
    places = cut_lineage(located.where(whole).select("study_id", *spot).distinct().select(
        "*", *[cell(F.col(p), 1).alias(q) for p, q in zip(spot, own)]))
    asked = places.groupBy("study_id", *own).agg(*[f(p).alias(f"{n}_{p}") for p in spot for n, f in (("from", F.min), ("to", F.max))])

    def bounded(df: DataFrame) -> DataFrame:
        nearest, farthest = F.lit(0.0), F.lit(0.0)
        for a, s in zip(AXES, spacing):
            low, high, lo, hi = (F.col(f"{c}_{a}") for c in ("from_p", "to_p", "lo", "hi"))
            gap = F.greatest(lo - high, low - hi, F.lit(0.0)) * s
            span = F.greatest(high - lo, hi - low) * s
            nearest, farthest = nearest + gap * gap, farthest + span * span
        out = df.withColumn("_near", nearest).withColumn("_far", farthest)
        return out if limit is None else out.where(F.col("_near") <= limit * limit + 1e-9)

    carried = ["study_id", *own, *[f"{n}_{p}" for p in spot for n in ("from", "to")]]

    def closest(frontier: DataFrame) -> DataFrame:
        reach = F.min("_far").over(Window.partitionBy("study_id", *own))
        return frontier.withColumn("_reach", reach).where(F.col("_near") <= F.col("_reach") + 1e-9)

    frontier = bounded(asked.join(pyramid[-1], "study_id"))
    for below in pyramid[-2::-1]:
        opened = closest(frontier).select(*carried, *[F.col(f"c_{a}").alias(f"up_{a}") for a in AXES])
        children = below.select("*", *[cell(F.col(f"c_{a}"), 1).alias(f"up_{a}") for a in AXES])
        frontier = bounded(opened.join(children, ["study_id", *[f"up_{a}" for a in AXES]]))
    pairs = closest(frontier).select("study_id", *own, *[f"c_{a}" for a in AXES])

    def blocked(df: DataFrame) -> DataFrame:
        return df.select("*", *[cell(F.col(q), 1).alias(c) for q, c in zip(own, block)])

    near = blocked(pairs.join(leaves.select("study_id", *[f"c_{a}" for a in AXES], "_voxels"), ["study_id", *[f"c_{a}" for a in AXES]])
                   .select(*[F.col(c).alias(c) for c in ("study_id", *own, "_voxels")]))  # columns of their own for the cogroup
    kind = places.schema["study_id"].dataType.simpleString()
    best = blocked(places).groupBy("study_id", *block).cogroup(near.groupBy("study_id", *block)).applyInArrow(
        _measuring(tuple(spacing), None if limit is None else limit * limit + 1e-9),
        f"study_id {kind}, " + ", ".join(f"{p} double" for p in spot) + ", reference_distance_mm double")
    return located.join(best, ["study_id", *spot], "left").select(*[F.col(c) for c in probes.columns], "reference_distance_mm")


def _measuring(spacing: tuple[float, ...], most: float | None):
    """Places of a block against the voxels that their cells are left with."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        place, at, cells = (np.stack([np.asarray(t.column(f"{c}_{a}")) for a in AXES], 1)
                            for t, c in ((left, "p"), (left, "q"), (right, "q")))
        voxels = right.column("_voxels").combine_chunks()
        ends = np.cumsum([0, *(len(x) for x in voxels)])
        flat = np.asarray(voxels.flatten().flatten()).reshape(-1, 3).astype(float)
        of: dict[tuple, list[int]] = {}
        for i, c in enumerate(map(tuple, cells.tolist())):
            of.setdefault(c, []).append(i)
        rows: dict[tuple, list[int]] = {}
        for i, c in enumerate(map(tuple, at.tolist())):
            rows.setdefault(c, []).append(i)
        best = np.full(len(place), np.inf)
        for c, mine in rows.items():
            for part in np.array_split(np.array(mine), -(-len(mine) // 64)):
                for i in of.get(c, ()):
                    own = flat[ends[i]:ends[i + 1]]
                    d = 0.0
                    for axis, s in enumerate(spacing):
                        d = d + ((place[part, axis][:, None] - own[:, axis][None, :]) * s) ** 2
                    best[part] = np.minimum(best[part], d.min(1))
        found = np.isfinite(best) if most is None else best <= most
        return pa.table({"study_id": left.column("study_id"), **{f"p_{a}": left.column(f"p_{a}") for a in AXES},
                         "reference_distance_mm": pa.array(np.sqrt(best), mask=~found)})

    return run


# ---- overlap, counts, intensities ---------------------------------------------------------------

def dice(voxels: DataFrame, predicted: Column, target: Column, empty: float, out: str = "dice") -> DataFrame:
    """2|P and T| / (|P|+|T|) per study; ``empty`` when both are empty."""
    c = voxels.groupBy("study_id").agg(F.count_if(predicted & target).alias("_both"),
                                       F.count_if(predicted).alias("_p"), F.count_if(target).alias("_t"))
    size = F.col("_p") + F.col("_t")
    return c.select("study_id", F.when(size > 0, 2.0 * F.col("_both") / size).otherwise(F.lit(empty)).alias(out),
                    F.col("_p").alias("predicted_voxels"), F.col("_t").alias("target_voxels"))


def label_histogram(voxels: DataFrame, codes: Sequence[int] = k.LABEL_CODES) -> DataFrame:
    return voxels.groupBy("study_id").agg(*[F.count_if(F.col("label") == c).alias(f"label_{c}") for c in codes])


def ratio_or(numerator: Column, denominator: Column, empty: float) -> Column:
    return F.when(denominator > 0, numerator / denominator).otherwise(F.lit(float(empty)))


def source_coverage(voxels: DataFrame, inside: Column) -> DataFrame:
    """Voxels inside the crop over all voxels, per label and for their union."""
    lesion, organ = F.col("label") == k.LESION, F.col("label") == k.ORGAN
    c = voxels.groupBy("study_id").agg(
        F.count_if(lesion).alias("lesion_total"), F.count_if(lesion & inside).alias("lesion_inside"),
        F.count_if(organ).alias("organ_total"), F.count_if(organ & inside).alias("organ_inside"))
    union_total, union_inside = (F.col("lesion_total") + F.col("organ_total"),
                                 F.col("lesion_inside") + F.col("organ_inside"))
    return c.select("*", union_total.alias("union_total"), union_inside.alias("union_inside"),
                    ratio_or(F.col("lesion_inside"), F.col("lesion_total"), 1.0).alias("lesion_coverage"),
                    ratio_or(F.col("organ_inside"), F.col("organ_total"), 0.0).alias("organ_coverage"),
                    ratio_or(union_inside, union_total, 0.0).alias("union_coverage"))


def count_rules(c: DataFrame, positive: Column) -> dict[str, Column]:
    """Consistency of coverage counts, as named row conditions."""
    col = F.col
    return {
        "lesion_bounded": (col("lesion_inside") >= 0) & (col("lesion_inside") <= col("lesion_total")),
        "organ_bounded": (col("organ_inside") > 0) & (col("organ_inside") <= col("organ_total")),
        "union_is_sum": (col("union_total") == col("lesion_total") + col("organ_total"))
        & (col("union_inside") == col("lesion_inside") + col("organ_inside")),
        "lesion_iff_positive": positive == (col("lesion_total") > 0)}


def informative_slices(voxels: DataFrame, label: Column, number: int = 6) -> DataFrame:
    """Up to ``number`` slices per study: evenly spaced non-empty ones, and the fullest.

    Reduced to one count per slice first; the array per study is as long as the
    axis at most.
    """
    per = voxels.groupBy("study_id", "z").agg(F.count_if(label).alias("n")).where("n > 0")
    arr = per.groupBy("study_id").agg(F.array_sort(F.collect_list(F.struct("z", "n"))).alias("_a"))
    zs = F.transform("_a", lambda s: s["z"])
    size = F.size("_a")
    most = F.array_max(F.transform("_a", lambda s: s["n"]))
    step = arr.select(
        "study_id", zs.alias("_zs"),
        F.transform(F.sequence(F.lit(0), F.lit(number - 1)),
                    lambda i: F.get(zs, F.rint(i * (size - 1) / F.lit(float(max(number - 1, 1)))).cast("int"))).alias("_c"),
        F.array_min(F.transform(F.filter("_a", lambda s: s["n"] == most), lambda s: s["z"])).alias("_peak"))
    # the interior pick nearest to the fullest slice gives way to it
    inner = F.sequence(F.lit(1), F.lit(number - 2)) if number > 2 else F.array().cast("array<int>")
    nearest = F.array_min(F.transform(inner, lambda i: F.struct(
        F.abs(F.get(F.col("_c"), i) - F.col("_peak")).alias("d"), i.alias("i"))))["i"]
    swap = F.transform("_c", lambda z, i: F.when(
        ~F.array_contains("_c", F.col("_peak")) & (i == nearest), F.col("_peak")).otherwise(z))
    chosen = step.select("study_id", "_zs", F.array_sort(F.array_distinct(swap)).alias("_c"))
    rest = F.filter("_zs", lambda z: ~F.array_contains("_c", z))
    room = F.greatest(F.least(F.lit(number), F.size("_zs")) - F.size("_c"), F.lit(0))
    return chosen.select("study_id", F.array_sort(F.concat("_c", F.slice(rest, 1, room))).alias("slices"))


def heatmap_confidence(voxels: DataFrame, p: str) -> DataFrame:
    """Largest probability and entropy over log(cells), floored at 1e-12 inside the log."""
    return voxels.groupBy("study_id").agg(
        F.max(p).alias("max_probability"),
        (-F.sum(F.col(p) * F.log(F.greatest(F.col(p), F.lit(1e-12)))) / F.log(F.count(F.lit(1)).cast("double")))
        .alias("normalized_entropy"))


def region_scores(voxels: DataFrame, p: str, target: Column, positive: Column, cut: float = 0.5) -> DataFrame:
    """Scores inside the target, predicted and target sizes, overlap and clean flags."""
    predicted = F.col(p) >= cut
    c = voxels.groupBy("study_id").agg(
        F.max(p).alias("max_probability"), F.max(F.when(target, F.col(p))).alias("target_max_probability"),
        F.avg(F.when(target, F.col(p))).alias("target_mean_probability"),
        F.count_if(predicted).alias("predicted_voxels"), F.count_if(target).alias("target_voxels"),
        F.count_if(predicted & target).alias("_both"), F.bool_or(positive).alias("_pos"))
    return c.select("study_id", "max_probability", "target_max_probability", "target_mean_probability",
                    "predicted_voxels", "target_voxels", (F.col("_pos") & (F.col("_both") > 0)).alias("overlaps"),
                    (~F.col("_pos") & (F.col("predicted_voxels") == 0)).alias("negative_clean"))


# ---- peaks and candidates -----------------------------------------------------------------------

_SHIFT = 1 << 21  # coordinates below 2**21 pack into one ordered code


def voxel_code() -> Column:
    return (F.col("x").cast("long") * _SHIFT + F.col("y")) * _SHIFT + F.col("z")


def connected_plateaus(peaks: DataFrame) -> DataFrame:
    """26-connected components of peak voxels: adds ``plateau``, the smallest voxel code.

    Alternates large-star and small-star joins until the edges are stars, which
    takes a logarithmic number of rounds even for a component as long as a
    volume. Each round is checkpointed to reliable storage, so lineage stays
    short and a lost executor costs one round.
    """
    nodes = peaks.select(*VOXEL).distinct().withColumn("_u", voxel_code())
    offsets = [(i, j, m) for i in (-1, 0, 1) for j in (-1, 0, 1) for m in (-1, 0, 1) if (i, j, m) > (0, 0, 0)]
    spread = nodes.withColumn("_o", F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(m).alias("m")) for i, j, m in offsets])))
    ahead = spread.select("study_id", (F.col("x") + F.col("_o.i")).alias("x"), (F.col("y") + F.col("_o.j")).alias("y"),
                          (F.col("z") + F.col("_o.m")).alias("z"), F.col("_u").alias("_w"))
    # edges point from the larger code to the smaller
    edges = cut_lineage(nodes.join(spread_join(ahead), VOXEL).select("study_id", F.col("_u").alias("u"), F.col("_w").alias("v")))
    while not _settled(edges):
        edges = cut_lineage(_small_star(_large_star(edges)))
    roots = edges.select("study_id", F.col("u").alias("_u"), F.col("v").alias("plateau"))
    return (nodes.join(spread_join(roots), ["study_id", "_u"], "left")
            .withColumn("plateau", F.coalesce("plateau", "_u")).drop("_u"))


def _settled(edges: DataFrame) -> bool:
    """Whether the edges are stars: each voxel has one parent, and no parent has one."""
    twice = edges.groupBy("study_id", "u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("study_id", "u")
    parents = edges.select("study_id", F.col("v").alias("u")).distinct()
    return twice.union(edges.select("study_id", "u").join(parents, ["study_id", "u"], "left_semi")).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of a node are linked to the smallest node around it."""
    both = edges.unionByName(edges.select("study_id", F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("study_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, ["study_id", "u"]).select(
        "study_id", F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    low = edges.groupBy("study_id", "u").agg(F.min("v").alias("m"))
    moved = edges.join(low, ["study_id", "u"])
    return (moved.where("v <> m").select("study_id", F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("study_id", "u", F.col("m").alias("v"))).distinct())


def plateau_peaks(peaks: DataFrame, score: str) -> DataFrame:
    """The best voxel of each plateau, first in index order on ties: a map-side ``max``."""
    best = F.max(F.struct(F.col(score).alias("s"), *[(-F.col(a)).alias(a) for a in AXES]))
    keep = [c for c in peaks.columns if c not in (*VOXEL, "plateau", score)]
    if keep:
        best = F.max(F.struct(F.col(score).alias("s"), *[(-F.col(a)).alias(a) for a in AXES], *keep))
    return peaks.groupBy("study_id", "plateau").agg(best.alias("_b")).select(
        "study_id", "plateau", F.col("_b.s").alias(score), *[(-F.col(f"_b.{a}")).alias(a) for a in AXES],
        *[F.col(f"_b.{c}").alias(c) for c in keep])


def generate_candidates(voxels: DataFrame, lesion: str = "p_lesion", organ: str = "p_organ",
                        spacing: Sequence[float] = k.SPACING_MM, gate_probability: float = k.GATE_PROBABILITY,
                        gate_margin: float = k.GATE_MARGIN_MM, sigma_mm: float = k.SMOOTHING_SIGMA_MM,
                        radius_mm: float = k.PEAK_RADIUS_MM, minimum: float = k.MINIMUM_SCORE,
                        most: int = k.MAXIMUM_CANDIDATES, gaps: bool = False) -> DataFrame:
    """Probability volumes to ranked candidates: peaks, gate, plateaus, best voxel, top-k.

    The gate is a distance transform in the bricks that find the peaks; a study without
    seeds passes whole. With ``gaps``, voxels may be absent.
    """
    seed = F.coalesce(F.col(organ) >= gate_probability, F.lit(False))
    marked = voxels.select(*VOXEL, lesion, seed.cast("double").alias("_seed"))
    peaks = cut_lineage(detect_peaks(marked, lesion, [sigma_mm / s for s in spacing], filter_sizes(radius_mm, spacing), minimum,
                                     gaps=gaps, seed="_seed", radius=gate_margin, spacing=spacing))
    free = peaks.join(marked.where("_seed <> 0").select("study_id").distinct(), "study_id", "left_anti")
    gated = cut_lineage(peaks.where("near_seed <> 0").unionByName(free).drop("near_seed"))
    marked = gated.join(spread_join(connected_plateaus(gated)), VOXEL)
    best = plateau_peaks(marked, "candidate_score").select(
        "study_id", *[F.col(a).alias(f"candidate_{a}") for a in AXES], "candidate_score", "candidate_raw_probability")
    return top_candidates(best, most)


def candidate_truth(candidates: DataFrame, reference_voxels: DataFrame, threshold: float,
                    spacing: Sequence[float] = k.SPACING_MM, tolerance: float = k.TOLERANCE_MM) -> DataFrame:
    """Distance, tolerance, TP, FP and deployment flag of each ranked candidate."""
    keyed = candidates.withColumn("_id", F.concat_ws("/", "study_id", F.col("candidate_rank").cast("string")))
    probes = keyed.select("_id", "study_id", *[F.col(f"candidate_{a}").alias(a) for a in AXES])
    far = nearest_distance(probes, reference_voxels, "_id", spacing).select("_id", "reference_distance_mm")
    return match_candidates(keyed.join(far, "_id").drop("_id"), tolerance).withColumn(
        "above_locked_deployment_threshold", F.col("candidate_score") >= threshold)


# ---- tiles and regridding -----------------------------------------------------------------------

def tile_starts(size: int | Column, patch: int, overlap: float = 0.5) -> Column:
    """Starts along one axis; the last tile ends flush with the volume."""
    size = size if isinstance(size, Column) else F.lit(size)
    step = max(1, int(round(patch * (1.0 - overlap))))
    last = F.greatest(size - patch, F.lit(0))
    return F.array_sort(F.array_union(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))


def tile_plan(volumes: DataFrame, shape: Sequence[Column], patch: Sequence[int], overlap: float = 0.5) -> DataFrame:
    """All tiles of each volume."""
    df = volumes
    for a, n, p in zip(AXES, shape, patch):
        df = df.withColumn(f"start_{a}", F.explode(tile_starts(n, p, overlap)))
    return df


def cut_tiles(voxels: DataFrame, size: Sequence[int], patch: Sequence[int], overlap: float = 0.5) -> DataFrame:
    """Voxels once per tile that covers them. The covering starts are computed from
    the voxel itself, so no join is needed."""

    def covering(axis: str, n: int, p: int) -> Column:
        return F.filter(tile_starts(n, p, overlap), lambda s: (F.col(axis) >= s) & (F.col(axis) < s + p))

    df = voxels
    for a, n, p in zip(AXES, size, patch):
        df = df.withColumn(f"start_{a}", F.explode(covering(a, n, p)))
    return df


def merge_tiles(tiles: DataFrame, value: str, out: str) -> DataFrame:
    """Mean over overlapping tiles per voxel, with the number of tiles."""
    return tiles.groupBy(*VOXEL).agg(F.avg(value).alias(out), F.count(F.lit(1)).alias("tiles"))


def require_covered(merged: DataFrame, volumes: DataFrame, shape: Sequence[int]) -> DataFrame:
    """Fails if any voxel of a volume is missing from the merged result."""
    want = shape[0] * shape[1] * shape[2]
    have = merged.groupBy("study_id").agg(F.count(F.lit(1)).alias("_have"))
    bad = F.coalesce(F.col("_have"), F.lit(0)) != want
    checked = volumes.select("study_id").distinct().join(spread_join(have), "study_id", "left").where(
        F.when(bad, F.raise_error(F.concat(F.lit("uncovered voxels in "), F.col("study_id")))).otherwise(F.lit(True)))
    return merged.join(spread_join(checked.select("study_id")), "study_id")


def regrid_to_canvas(voxels: DataFrame, geometry: DataFrame, value: str, out: str, canvas: Sequence[int],
                     outside: float) -> DataFrame:
    """Linear resampling of whole volumes onto a padded canvas, one axis at a time.

    ``geometry`` has ``scale_a, offset_a, core_a, pad_a`` per study and axis. A
    position outside [0, n-1] on any axis, and all padding, gets ``outside``.
    """
    fit = [f"{n}_{a}" for a in AXES for n in ("scale", "offset", "core", "pad")]
    df = voxels.select(*VOXEL, F.col(value).cast("double").alias(out)).join(spread_join(geometry.select("study_id", *fit)), "study_id")
    keys = ["study_id", *fit]
    for axis, n in zip(AXES, canvas):
        def line(arrays: dict[str, Column], a: str = axis, n: int = n) -> Column:
            values = arrays[out]
            last = F.size(values) - 1

            def at(i: Column) -> Column:
                o = i - F.col(f"pad_{a}")
                c = F.col(f"scale_{a}") * o.cast("double") + F.col(f"offset_{a}")
                lo = F.floor(c).cast("int")
                part = c - lo
                inside = (o >= 0) & (o < F.col(f"core_{a}")) & (c >= 0) & (c <= last)
                return F.when(inside, F.get(values, lo) * (1.0 - part)
                              + F.coalesce(F.get(values, lo + 1), F.lit(0.0)) * part).otherwise(F.lit(float(outside)))

            return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)

        df = along_axis(df, axis, [out], {out: line}, keys)
    return df.select(*VOXEL, out)


def crop_grid(crops: DataFrame, shape: Sequence[int], carry: Sequence[str]) -> DataFrame:
    """All voxels ``o_x, o_y, o_z`` of each study's crop grid, spread by slab first."""
    df = crops.select("study_id", *carry, F.explode(F.sequence(F.lit(0), F.lit(shape[0] - 1))).alias("o_x"))
    df = spread(df, "study_id", "o_x")
    for a, n in zip("yz", shape[1:]):
        df = df.withColumn(f"o_{a}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return df


def regrid_to_crop(voxels: DataFrame, crops: DataFrame, matrix: str, source_shape: Sequence[int],
                   shape: Sequence[int], linear: str, nearest: str, outside: float) -> DataFrame:
    """Crop through an affine: ``linear`` by eight neighbours, ``nearest`` by the closest.

    ``matrix`` (4x4 array column of ``crops``) maps crop to source voxels. Each
    crop voxel asks for its neighbours by an equi-join on the voxel key.
    """
    grid = crop_grid(crops, shape, [matrix])
    m = F.col(matrix)
    pos = [m[i][0] * F.col("o_x") + m[i][1] * F.col("o_y") + m[i][2] * F.col("o_z") + m[i][3] for i in range(3)]
    inside = F.lit(True)
    for c, n in zip(pos, source_shape):
        inside = inside & (c >= 0) & (c <= n - 1)
    placed = grid.select("study_id", "o_x", "o_y", "o_z", *[c.alias(f"_c{a}") for a, c in zip(AXES, pos)],
                         inside.alias("_in"))
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(m).alias("m"))
                                  for i in (0, 1) for j in (0, 1) for m in (0, 1)]))
    asked = placed.where("_in").withColumn("_k", corners)
    weight, near = F.lit(1.0), F.lit(True)
    for a, s in zip(AXES, "ijm"):
        part = F.col(f"_c{a}") - F.floor(f"_c{a}")
        weight = weight * F.when(F.col(f"_k.{s}") == 1, part).otherwise(1.0 - part)
        near = near & (F.floor(f"_c{a}") + F.col(f"_k.{s}") == F.floor(F.col(f"_c{a}") + 0.5))
    wanted = asked.select("study_id", "o_x", "o_y", "o_z", weight.alias("_w"), near.alias("_near"),
                          *[(F.floor(f"_c{a}") + F.col(f"_k.{s}")).cast("int").alias(a) for a, s in zip(AXES, "ijm")])
    got = wanted.where((F.col("_w") > 0) | F.col("_near")).join(spread_join(voxels.select(*VOXEL, linear, nearest)), VOXEL)
    sums = got.groupBy("study_id", "o_x", "o_y", "o_z").agg(
        F.sum(F.col("_w") * F.col(linear)).alias(linear), F.max(F.when(F.col("_near"), F.col(nearest))).alias(nearest),
        F.count(F.lit(1)).alias("_found"))
    # every asked voxel comes back; a neighbour that the source lacks fails the query
    complete = (F.col("_found") == F.col("_asked"))
    asked_for = wanted.where((F.col("_w") > 0) | F.col("_near")).groupBy("study_id", "o_x", "o_y", "o_z").agg(F.count(F.lit(1)).alias("_asked"))
    lacking = F.raise_error(F.concat(F.lit("the source lacks a voxel that a crop needs in study "), F.col("study_id").cast("string")))
    sums = (asked_for.join(spread_join(sums), ["study_id", "o_x", "o_y", "o_z"], "left")
            .withColumn(linear, F.when(complete, F.col(linear)).otherwise(lacking.cast("double")))
            .select("study_id", "o_x", "o_y", "o_z", linear, nearest))
    # voxels outside the source never enter the join
    empty = placed.where(~F.col("_in")).select("study_id", "o_x", "o_y", "o_z", F.lit(float(outside)).alias(linear),
                                               F.lit(0).alias(nearest))
    return sums.unionByName(empty)


# ---- quality ------------------------------------------------------------------------------------

def _numbers(values: Column, n: int) -> Column:
    """``n`` finite numbers."""
    return (F.size(values) == n) & F.forall(values, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))


def _within(a: Column, b, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance + tolerance * F.abs(F.lit(b) if not isinstance(b, Column) else b)


def voxel_facts(voxels: DataFrame, hu: tuple[float, float]) -> DataFrame:
    """What one pass over the voxels says of a study's two arrays."""
    ct, label = F.col("ct").cast("double"), F.col("label").cast("double")
    return voxels.groupBy("study_id").agg(
        *[F.count(c).alias(f"n_{c}") for c in ("ct", "label")],
        *[f(a).alias(f"{n}_{a}") for a in AXES for n, f in (("from", F.min), ("to", F.max))],
        *[F.bool_and(c == F.rint(c)).alias(f"whole_{n}") for n, c in (("ct", ct), ("label", label))],
        *[F.bool_and(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))).alias(f"finite_{n}") for n, c in (("ct", ct), ("label", label))],
        F.bool_and(ct.between(*hu)).alias("in_window"), F.bool_and(F.col("label").isin(*k.LABEL_CODES)).alias("known_codes"),
        F.bool_and(label.between(0, 255)).alias("byte_codes"),
        F.count_if(F.col("label") == k.LESION).alias("lesion_now"), F.count_if(F.col("label") == k.ORGAN).alias("organ_now"))


def volume_quality(voxels: DataFrame, ledger: DataFrame, shape: Sequence[int], spacing: Sequence[float],
                   hu: tuple[float, float] = (k.HU_LOW, k.HU_HIGH)) -> DataFrame:
    """27 checks per case in long form: study_id, area, check, passed.

    Areas: ``payload`` (the arrays themselves), ``header`` (what the record says of
    its file), ``geometry`` (its affine) and ``counts`` (what it says of the
    labels). ``ledger`` carries stored and expected values. A check on a
    missing value does not pass; a case without voxels fails its array checks.
    """
    from .geometry import axis_lengths, determinant, mat, orientation_code

    c, m, flat = F.col, mat("crop_affine"), F.flatten("crop_affine")
    filled = F.lit(True)
    for a, n in zip(AXES, shape):
        filled = filled & (c(f"from_{a}") == 0) & (c(f"to_{a}") == n - 1)
    cells = math.prod(shape)
    edges, recorded = F.lit(True), F.size("crop_spacing") == 3
    for i, want in enumerate(spacing):
        edges = edges & _within(axis_lengths(m)[i], float(want), 1e-6)
        recorded = recorded & _within(F.get("crop_spacing", F.lit(i)), float(want), 1e-6)
    apart = F.array_max(F.zip_with("stored_center", "expected_center", lambda a, b: F.abs(a - b)))
    sick = c("label_binary") == 1
    adds_up = [c(f"{kind}_lesion") + c(f"{kind}_organ") == c(f"{kind}_union") for kind in ("full", "inside")]
    areas = {
        "payload": [
            *((f"{n}_fills_grid", filled & (c(f"n_{n}") == cells)) for n in ("ct", "label")),
            *((f"{n}_finite", c(f"finite_{n}")) for n in ("ct", "label")),
            ("ct_whole_numbers", c("whole_ct")), ("ct_in_window", c("in_window")),
            ("label_whole_numbers", c("whole_label") & c("byte_codes")), ("label_known_codes", c("known_codes"))],
        "header": [
            ("members", F.array_sort("expected_keys") == F.array_sort("payload_keys")), ("digest", c("expected_sha256") == c("stored_sha256")),
            ("bytes", c("expected_size") == c("stored_size")), ("centre", _numbers(c("stored_center"), 3) & (apart <= 1e-5)),
            ("partition_and_diagnosis", (c("locked_partition") == c("stored_partition")) & (c("diagnostic_label") == c("stored_label")))],
        "geometry": [
            ("axes_lps", orientation_code(m) == "LPS"), ("voxel_edges", edges), ("recorded_edges", recorded),
            ("four_by_four", (F.size(flat) == 16) & (F.size("crop_affine") == 4)), ("finite", _numbers(flat, 16)),
            ("invertible", F.abs(determinant(m)) > 1e-8), ("world_centre", _numbers(c("world_center"), 3))],
        "counts": [
            ("organ_present", (c("organ_now") > 0) & (c("full_organ") > 0)),
            ("lesion_as_diagnosed", F.when(sick, (c("lesion_now") > 0) & (c("full_lesion") > 0)).otherwise(c("lesion_now") + c("full_lesion") == 0)),
            ("recount_both", c("lesion_now") + c("organ_now") == c("crop_union")),
            ("recount_lesion", c("lesion_now") == c("crop_lesion")), ("recount_organ", c("organ_now") == c("crop_organ")),
            ("inside_is_part", (c("inside_organ") > 0) & (c("inside_organ") <= c("full_organ")) & (c("inside_lesion") <= c("full_lesion")) & adds_up[0] & adds_up[1]),
            ("coverage", (F.abs(ratio_or(c("inside_organ"), c("full_organ"), 0.0) - c("organ_coverage")) <= 1e-12)
             & (F.abs(ratio_or(c("inside_lesion"), c("full_lesion"), 1.0) - c("lesion_coverage")) <= 1e-12)
             & (F.abs(ratio_or(c("inside_union"), c("full_union"), 0.0) - c("union_coverage")) <= 1e-12))]}
    rows = [F.struct(F.lit(area).alias("area"), F.lit(name).alias("check"), F.coalesce(test, F.lit(False)).alias("passed"))
            for area, tests in areas.items() for name, test in tests]
    both = ledger.join(voxel_facts(voxels, hu), "study_id", "left")
    return both.select("study_id", F.explode(F.array(*rows)).alias("r")).select("study_id", "r.*")
