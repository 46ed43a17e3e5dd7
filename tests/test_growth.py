"""Tables of odd sizes and of larger ones: what grows, what is absent, what is never broadcast."""

import os

import pytest
from pyspark.sql import functions as F

from caseledger.operators import bricks as br, volume as vo
from caseledger.plans.catalog import ORACLES, QUERIES
from oracle import TABLES, compare, duck


def tables(tmp_path, sf, **replaced):
    """The driver tables, some replaced by a query on them."""
    import duckdb

    for t in TABLES:
        if t not in replaced:
            os.symlink(f"{sf}/{t}.parquet", tmp_path / f"{t}.parquet")
    for t, sql in replaced.items():
        duckdb.sql(f"COPY ({sql.format(sf=sf)}) TO '{tmp_path}/{t}.parquet'")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["c12_radius_gate", "e8_sliding_maximum", "h19_gaussian_smoothing", "h20_peak_detection", "h22_candidate_generator"])
def test_a_volume_whose_last_layer_is_not_full(spark, sf, tmp_path, name):
    """181 tiles and some that are absent: no multiple of a layer of 25."""
    d = tables(tmp_path, sf, embeddings="SELECT * FROM '{sf}/embeddings.parquet' WHERE vec_id < 181 AND vec_id <> 60 AND vec_id NOT BETWEEN 100 AND 149")
    assert compare(spark, duck(d), name, d, QUERIES, ORACLES) == ""


@pytest.mark.parametrize("edge", [3, 64])
def test_absent_voxels_do_not_depend_on_bricks(spark, edge):
    import numpy as np

    rng = np.random.default_rng(4)
    shape, reach, spacing = (9, 7, 8), [2, 2, 1], (1.25, 1.25, 2.0)
    cube, there, seeds = rng.random(shape), rng.random(shape) < 0.7, rng.random(shape) < 0.05
    there[-1, -1, -1] = True  # each axis ends where some voxel is
    rows = [(None, x, y, z, float(cube[x, y, z]), float(seeds[x, y, z])) for x, y, z in np.ndindex(shape) if there[x, y, z]]
    df = spark.createDataFrame(rows, "study_id string, x int, y int, z int, v double, s double").repartition(3)
    of = lambda frame, c: {(r.x, r.y, r.z): r[c] for r in frame.collect()}
    smooth, top = br.smooth(cube[None], (0.6, 0.5, 0.4), there)[0], br.box_maximum(cube[None], (5, 3, 3), there)[0]
    gate = br.squared_distance((seeds & there), reach, spacing, there)
    at = [tuple(int(i) for i in p) for p in zip(*np.nonzero(there))]
    assert of(br.gaussian_smooth(df, "v", (0.6, 0.5, 0.4), "g", edge, True), "g") == pytest.approx({p: smooth[p] for p in at})
    assert of(br.sliding_maximum(df, "v", (5, 3, 3), "m", edge, True), "m") == {p: top[p] for p in at}
    near = of(br.within_gate(df, "s", 2.5, spacing, edge, True), "distance_mm")
    assert near == pytest.approx({p: gate[p] ** 0.5 for p in at if gate[p] <= 6.25 + 1e-9})


def written(spark):
    """Rows that shuffles have written so far."""
    store, total, i = spark.sparkContext._jsc.sc().statusStore(), 0, 0
    while True:
        try:
            total += store.lastStageAttempt(i).shuffleWriteRecords()
        except Exception:  # noqa: BLE001 - no such stage
            return total
        i += 1


def test_draws_do_not_travel_one_by_one(spark):
    """375,000 draws are dealt out here, and 6,000,000 made beside the units."""
    from caseledger.operators import resample as rs

    rows = spark.range(20000).select(F.lit("all").alias("g"), F.col("id").alias("i"), (F.col("id") % 7).cast("double").alias("v"))
    before = written(spark)
    assert rs.mean_interval(rows, ["g"], "i", "v", 300).first().lower < 3.0
    assert written(spark) - before < 200000
    sums = rs.drawn_sums(rs.placed_draws(rows.withColumn("one", F.lit(1)), ["g"], "i", 300, rs.SEED), ["g"], ["one"], 300).collect()
    assert len(sums) == 300 and all(r.one == 20000 for r in sums)  # two blocks of places


def test_replicates_with_too_many_draws_are_dealt_anew(spark, monkeypatch):
    from caseledger.operators import resample as rs

    monkeypatch.setattr(rs, "SLACK", 0)  # all strata at the highest rate: half of the replicates exceed n
    units = spark.range(200).select((F.col("id") % 2).alias("g"), F.col("id").alias("i"), F.lit(1).alias("one"), (F.col("id") * 10 ** 12).alias("big"))
    got = rs.draw_weights(units, ["g"], "i", 40).groupBy("replicate", "g").agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("big")).alias("s")).collect()
    assert len(got) == 80 and all(r.n == 100 for r in got)
    sums = rs.drawn_sums(rs.placed_draws(units, ["g"], "i", 40, rs.SEED), ["g"], ["one", "big"], 40).collect()
    assert {(r.replicate, r.g, r.one, r.big) for r in sums} == {(r.replicate, r.g, r.n, r.s) for r in got}


@pytest.mark.parametrize("name", ["h12_regrid_to_canvas", "h13_regrid_to_crop", "h15_tile_merge", "h16_anchor_patch", "h17_augmented_patch", "h18_block_mask"])
def test_voxels_are_not_broadcast(spark, sf, name):
    """By the size of a small file of arrays, their voxels look small enough for a broadcast."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_the_search_grows_with_cells_not_with_probes(spark):
    """Forty probes a place: the search for the nearest voxel sees a place once."""
    refs = spark.range(300).select(F.lit("s").alias("study_id"), *[(F.col("id") * p % m).cast("int").alias(a) for a, p, m in zip("xyz", (7, 11, 5), (60, 48, 31))])
    places = spark.range(1000).select(*[(F.col("id") * p % m).cast("int").alias(a) for a, p, m in zip("xyz", (13, 17, 19), (60, 48, 31))])
    counts = []
    for copies in (1, 40):
        probes = places.crossJoin(spark.range(copies)).withColumn("i", F.monotonically_increasing_id()).withColumn("study_id", F.lit("s"))
        before = written(spark)
        assert vo.nearest_distance(probes, refs, "i").where("reference_distance_mm IS NULL").count() == 0
        counts.append(written(spark) - before)
    assert counts[1] - counts[0] < 2 * 40000


def test_poisson_numbers_are_made_once(spark, monkeypatch):
    """Means and the counts of the draws come from one pass; sums are those of the draws themselves."""
    from caseledger.operators import resample as rs

    units = spark.range(1500).select(
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id").alias("i"), (F.col("id") % 50).cast("double").alias("s"),
        F.lit(1).alias("one"), (F.col("id") * 10 ** 12).alias("big"), F.when(F.col("id") % 5 > 0, F.col("id") / 7).alias("part"))
    values, passes, real = ["one", "big", "part"], [], rs._summing
    monkeypatch.setattr(rs, "_summing", lambda *a: passes.append(not a[-1]) or real(*a))
    for slack in (rs.SLACK, 0):  # 0: half of the replicates exceed their stratum and are dealt anew
        monkeypatch.setattr(rs, "SLACK", slack)
        drawn = rs.draw_weights(units, ["g"], "i", 30)
        for keys, sort in (["g"], False), ([], False), (["s"], True):
            passes.clear()
            got = rs.unit_sums(units, ["g"], "i", keys, values, 30, spread_keys=sort)
            assert sum(passes) == 1
            want = drawn.groupBy(*keys, "replicate").agg(*[F.sum(F.col("weight") * F.coalesce(F.col(c), F.lit(0))).alias(c) for c in values])
            a, b = ({(*(r[k] for k in keys), r.replicate): (r.one, r.big, round(r.part, 6)) for r in df.collect()} for df in (got, want))
            assert a == b and len(a) >= 30
    passes.clear()
    rs.mean_interval(units, ["g"], "i", "part", 30).collect()
    assert sum(passes) == 1


def test_large_files_are_hashed_piece_by_piece(spark, tmp_path):
    """Files that are larger than a row may be: no byte of them is held as a row."""
    import hashlib
    import random
    import zlib

    from caseledger.sources import files as fl

    rng = random.Random(3)
    want = {}
    for name, size in (("small", 1000), ("a b%20c#ä.gz", 1001), ("large.parquet", 9_000_000)):
        content = rng.randbytes(size)
        (tmp_path / name).write_bytes(content)
        want[name] = (size, hashlib.sha256(content).hexdigest(), f"{zlib.crc32(content):08x}")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", 1000)  # as 2 GB and a larger file
    try:
        got = {r.path.rsplit("/", 1)[1]: (r.size_bytes, r.sha256, r.crc32_hex) for r in fl.hashed_files(spark, str(tmp_path), whole=1000).collect()}
        assert got == want
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")


def test_the_passes_over_replicates_are_dealt_evenly(spark, monkeypatch):
    """Units are few bytes and much work: their passes keep all shuffle partitions, with even shares."""
    from caseledger.operators import resample as rs

    units = spark.range(4000).select(F.when(F.col("id") > 40, "large").otherwise("small").alias("g"), F.col("id").alias("i"), F.lit(1).alias("one"))
    shares, real = [], rs._sums
    monkeypatch.setattr(rs, "_sums", lambda rows, *a, **k: shares.append(
        [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]) or real(rows, *a, **k))
    want = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for run in (lambda: rs.unit_sums(units, ["g"], "i", ["g"], ["one"], 20), lambda: rs.placed_draws(units, ["g"], "i", 20, rs.SEED)):
        shares.clear()
        run()
        assert len(shares[0]) == want and max(shares[0]) < 1.3 * sum(shares[0]) / want
    assert {r.one for r in rs.unit_sums(units, ["g"], "i", ["g"], ["one"], 20).collect()} == {41, 3959}


def test_only_needed_columns_meet_their_dealt_draws(spark, monkeypatch):
    from caseledger.operators import resample as rs

    seen, real = [], rs._with_dealt
    monkeypatch.setattr(rs, "_with_dealt", lambda numbered, *a: seen.append(numbered.columns) or real(numbered, *a))
    units = spark.range(3000).select((F.col("id") % 2).alias("g"), F.col("id").alias("i"), F.lit(1).alias("one"), F.lit("text").alias("name"))
    sums = rs.unit_sums(units, ["g"], "i", ["g"], ["one"], 20).collect()
    assert not {"i", "name", "__b", "__n", "__level"} & set(seen[0]) and {r.one for r in sums} == {1500}
