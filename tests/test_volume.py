"""Volume operators against brute force on small fixtures."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from caseledger.operators import bricks as br, geometry as g, volume as vo


def voxels(spark, fn, shape=(6, 5, 4), studies=("a", "b")):
    rows = [(s, x, y, z, float(fn(s, x, y, z))) for s in studies
            for x in range(shape[0]) for y in range(shape[1]) for z in range(shape[2])]
    return {r[:4]: r[4] for r in rows}, spark.createDataFrame(rows, "study_id string, x int, y int, z int, v double")


@pytest.mark.parametrize("edge", [64, 2, 3])
def test_gaussian_and_maximum(spark, edge):
    """One brick, and bricks that are smaller than the margin they need."""
    rng = random.Random(5)
    shape = (6, 5, 4)
    data, df = voxels(spark, lambda *_: rng.random(), shape)
    sigma = (0.8, 0.6, 0.5)
    w = [br.gaussian_weights(s) for s in sigma]
    got = {(r.study_id, r.x, r.y, r.z): r.g for r in br.gaussian_smooth(df, "v", sigma, "g", edge).collect()}
    clip = lambda i, n: min(max(i, 0), n - 1)
    for key in rng.sample(sorted(data), 25):
        s, x, y, z = key
        want = 0.0
        for (i, a), (j, b), (k, c) in itertools.product(*[enumerate(q) for q in w]):
            want += a * b * c * data[(s, clip(x + i - len(w[0]) // 2, shape[0]), clip(y + j - len(w[1]) // 2, shape[1]),
                                      clip(z + k - len(w[2]) // 2, shape[2]))]
        assert got[key] == pytest.approx(want)
    top = {(r.study_id, r.x, r.y, r.z): r.m for r in br.sliding_maximum(df, "v", (5, 3, 3), "m", edge).collect()}
    for (s, x, y, z), m in top.items():
        assert m == max(data[(s, i, j, k)] for i in range(max(0, x - 2), min(6, x + 3))
                        for j in range(max(0, y - 1), min(5, y + 2)) for k in range(max(0, z - 1), min(4, z + 2)))


@pytest.mark.parametrize("edge", [3, 64])
def test_peaks_do_not_depend_on_bricks(spark, edge):
    """Peaks of several studies of different size, against both filters on the whole array."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows, want = [], set()
    for study, shape in (("a", (11, 7, 8)), ("b", (3, 4, 9)), (None, (1, 1, 1))):
        cube = rng.random(shape)
        rows += [(study, x, y, z, float(cube[x, y, z])) for x, y, z in np.ndindex(shape)]
        s = br.smooth(cube[None], (0.6, 0.5, 0.4))
        top = br.box_maximum(s, (5, 3, 3))
        want |= {(study, *(int(i) for i in p[1:])) for p in zip(*np.nonzero((s >= 0.1) & (abs(s - top) <= 1e-7)))}
    df = spark.createDataFrame(rows, "study_id string, x int, y int, z int, v double").repartition(3)
    got = br.detect_peaks(df, "v", (0.6, 0.5, 0.4), (5, 3, 3), 0.1, edge).collect()
    assert {(r.study_id, r.x, r.y, r.z) for r in got} == want and len(got) == len(want) > 4
    assert all(r.candidate_raw_probability == {x[:4]: x[4] for x in rows}[(r.study_id, r.x, r.y, r.z)] for r in got)
    assert br.detect_peaks(df.limit(0), "v", (0.6, 0.5, 0.4), (5, 3, 3), 0.1, edge).count() == 0


@pytest.mark.parametrize("edge", [2, 64])
def test_bricks_refuse_gaps(spark, edge):
    cube = [("s", x, y, z, 1.0) for x in range(4) for y in range(4) for z in range(4)]
    frame = lambda rows: spark.createDataFrame(rows, "study_id string, x int, y int, z int, v double")
    for rows in ([r for r in cube if r[1:4] != (1, 2, 1)], cube + cube[:1], [(*cube[0][:4], None), *cube[1:]], [r for r in cube if r[1] != 1]):
        with pytest.raises(Exception, match="in study s"):
            br.sliding_maximum(frame(rows), "v", (3, 3, 3), "m", edge).collect()


def test_filter_sizes():
    assert vo.filter_sizes(10.0, (1.25, 1.25, 2.0)) == (17, 17, 11)


@pytest.mark.parametrize("crowded", [1.0, 0.3])
def test_nearest_distance_and_radius(spark, crowded):
    rng = random.Random(9)
    refs = {("hot" if rng.random() < crowded else "b", rng.randrange(300), rng.randrange(40), rng.randrange(90)) for _ in range(400)}
    probes = [(i, rng.choice(["hot", "b", "none"]), rng.randrange(-20, 320), rng.randrange(45), rng.randrange(100)) for i in range(300)]
    rdf = spark.createDataFrame(sorted(refs), "study_id string, x int, y int, z int")
    pdf = spark.createDataFrame(probes, "i long, study_id string, x int, y int, z int")
    sp = (1.25, 1.25, 2.0)

    def brute(p):
        ds = [math.dist([a * s for a, s in zip(p[2:], sp)], [a * s for a, s in zip(r[1:], sp)]) for r in refs if r[0] == p[1]]
        return min(ds) if ds else None

    want = {p[0]: brute(p) for p in probes}
    got = {r.i: r.reference_distance_mm for r in vo.nearest_distance(pdf, rdf, "i", sp).collect()}
    assert set(got) == set(want)
    assert all((got[i] is None) == (want[i] is None) and (want[i] is None or got[i] == pytest.approx(want[i])) for i in want)
    near = {r.i for r in vo.near_reference(pdf, rdf, "i", 12.0, sp).collect()}
    assert near == {i for i, d in want.items() if d is not None and d <= 12.0}


@pytest.mark.parametrize("edge", [4, 64])
def test_gate_equals_distance(spark, edge):
    shape, seeds, sp = (17, 11, 9), ((5, 5, 5), (9, 5, 6), (16, 0, 0)), (1.25, 1.25, 2.0)
    rows = [(s, x, y, z, float(s == "a" and (x, y, z) in seeds)) for s in "ab" for x in range(shape[0]) for y in range(shape[1]) for z in range(shape[2])]
    df = spark.createDataFrame(rows, "study_id string, x int, y int, z int, v double")
    far = {r[1:4]: min(math.dist([a * m for a, m in zip(r[1:4], sp)], [a * m for a, m in zip(q, sp)]) for q in seeds) for r in rows if r[0] == "a"}
    got = {(r.study_id, r.x, r.y, r.z): r.distance_mm for r in br.within_gate(df, "v", 5.0, sp, edge).collect()}
    assert set(got) == {("a", *p) for p, d in far.items() if d <= 5.0} and all(d == pytest.approx(far[p[1:]]) for p, d in got.items())
    passed = {tuple(r) for r in vo.anatomical_gate(df, F.col("v") == 1, 5.0, sp).collect()}
    assert passed == set(got) | {r[:4] for r in rows if r[0] == "b"}  # a study without seeds passes whole


def test_components_of_a_long_snake_and_singletons(spark):
    # a winding chain far longer than any fixed number of neighbour rounds
    snake = [("a", x, y, 0) for y in range(0, 40, 2) for x in (range(60) if y % 4 == 0 else range(59, -1, -1))]
    snake += [("a", 59 if y % 4 == 0 else 0, y + 1, 0) for y in range(0, 38, 2)]
    lone = [("a", 5, 5, 50), ("b", 0, 0, 0), ("b", 2, 0, 0), ("b", 3, 1, 1)]
    df = spark.createDataFrame(snake + lone, "study_id string, x int, y int, z int").repartition(5)
    got = vo.connected_plateaus(df).groupBy("study_id", "plateau").count().collect()
    assert sorted((r.study_id, r["count"]) for r in got) == [("a", 1), ("a", len(set(snake))), ("b", 1), ("b", 2)]


def test_tiles(spark):
    one = spark.range(1).select(*[vo.tile_starts(n, p).alias(str(i)) for i, (n, p) in enumerate(((240, 128), (192, 128), (128, 64)))]).first()
    assert [list(c) for c in one] == [[0, 64, 112], [0, 64], [0, 32, 64]]
    data, df = voxels(spark, lambda s, x, y, z: x + 10 * y + 100 * z)
    merged = vo.merge_tiles(vo.cut_tiles(df, (6, 5, 4), (4, 2, 4)), "v", "m")
    assert {(r.study_id, r.x, r.y, r.z): r.m for r in merged.collect()} == data
    assert vo.require_covered(merged, df, (6, 5, 4)).count() == len(data)
    with pytest.raises(Exception, match="uncovered"):
        vo.require_covered(merged.where("x < 5"), df, (6, 5, 4)).collect()


def test_dice_hand_case(spark):
    rows = [("a", i, i < 3, i in (1, 2, 3, 4, 5)) for i in range(8)] + [("e", 0, False, False)]
    df = spark.createDataFrame(rows, "study_id string, i int, p boolean, t boolean")
    got = {r.study_id: r.dice for r in vo.dice(df, F.col("p"), F.col("t"), 1.0).collect()}
    assert got == {"a": 0.5, "e": 1.0}
    assert vo.dice(df, F.col("p"), F.col("t"), 0.0).where("study_id = 'e'").first().dice == 0.0


def test_coverage_hand_case_and_positive_control(spark):
    df = spark.range(1)
    ten, fifteen, twenty, one = (g.lits((v, v, v)) for v in (10, 15, 20, 1))
    cov = g.crop_coverage(fifteen, ten, twenty, one, g.lits((8, 8, 8)))
    row = df.select(*[c.alias(n) for n, c in cov.items()]).first()
    assert row.volume_fraction == pytest.approx(0.512)
    assert row.minimum_margin_mm == pytest.approx(-1.0) and not row.fully_contained
    exact = g.crop_coverage(fifteen, ten, twenty, one, g.lits((10, 10, 10)))
    assert df.select(exact["fully_contained"].alias("c")).first().c


def test_informative_slices_follow_the_rule(spark):
    def rule(counts, number):
        pos = [z for z, n in sorted(counts.items()) if n]
        chosen = [pos[round(i * (len(pos) - 1) / (number - 1))] for i in range(number)]
        peak = min(z for z in counts if counts[z] == max(counts.values()))
        if peak not in chosen:
            inner = min(range(1, number - 1), key=lambda i: abs(chosen[i] - peak))
            chosen[inner] = peak
        out = sorted(set(chosen))
        out += [z for z in pos if z not in out][:max(min(number, len(pos)) - len(out), 0)]
        return sorted(out)

    rng = random.Random(2)
    rows, want = [], {}
    for s in range(30):
        counts = {z: rng.randrange(0, 6) for z in range(rng.randrange(1, 25))}
        counts[0] = counts.get(0, 0) + 1
        rows += [(str(s), i, 0, z) for z, n in counts.items() for i in range(n)]
        want[str(s)] = rule({z: n for z, n in counts.items() if n}, 6)
    df = spark.createDataFrame(rows, "study_id string, x int, y int, z int")
    got = {r.study_id: list(r.slices) for r in vo.informative_slices(df, F.lit(True), 6).collect()}
    assert got == want


def test_candidate_chain_end_to_end(spark):
    """Two blobs, one outside the gate; the flat top of the other gives one candidate."""
    def p(s, x, y, z):
        if abs(x - 3) <= 1 and abs(y - 3) <= 1 and z in (2, 3):
            return 0.9
        return 0.8 if x == 14 and y == 3 and z == 2 else 0.02

    data, df = voxels(spark, p, (16, 8, 6), ("a",))
    vol = df.withColumnRenamed("v", "p_lesion").withColumn("p_organ", F.when(F.col("x") <= 4, 0.5).otherwise(0.0))
    got = vo.generate_candidates(vol, sigma_mm=0.5, radius_mm=5.0, gate_margin=5.0).collect()
    assert [(r.candidate_x, r.candidate_y, r.candidate_z, r.candidate_rank) for r in got if r.candidate_score > 0.5] == [(3, 3, 2, 1)]
    truth = vo.candidate_truth(vo.generate_candidates(vol, sigma_mm=0.5, radius_mm=5.0, gate_margin=5.0),
                               vol.where("p_lesion >= 0.9"), 0.5).orderBy("candidate_rank").collect()
    assert truth[0].is_true_positive_candidate and truth[0].reference_distance_mm == 0.0
    assert sum(r.is_true_positive_candidate for r in truth) == 1
