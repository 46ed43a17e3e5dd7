"""Bootstrap properties; stream equals batch; resume equals one run."""

import random

import pytest
from pyspark.sql import functions as F

from caseledger.operators import joins as j, resample as rs, sampling as sa
from caseledger.session import fresh_path
from caseledger.streaming import ledgers as st


@pytest.fixture(scope="module")
def cases(spark):
    rng = random.Random(1)
    rows = [(str(i), str(i // 3), int(i % 3 == 0), rng.random()) for i in range(240)]
    return spark.createDataFrame(rows, "study_id string, patient_id string, label_binary int, score double")


def test_draws_keep_stratum_sizes(cases):
    w = rs.draw_weights(cases, ["label_binary"], "study_id", 12)
    got = w.groupBy("replicate", "label_binary").agg(F.sum("weight").alias("n")).collect()
    assert {(r.label_binary, r.n) for r in got} == {(1, 80), (0, 160)} and len(got) == 24
    again = rs.draw_weights(cases.repartition(7), ["label_binary"], "study_id", 12)
    assert w.exceptAll(again).count() == 0


def test_draws_are_multinomial(spark):
    """Counts of a unit have the mean 1 and the variance 1 - 1/n, two units the covariance -1/n;
    small strata are dealt out draw by draw, larger ones mostly beside the units."""
    import numpy as np

    n, small, reps = 200, 3, 1500
    rows = [(f"u{i}", "big") for i in range(n)] + [(f"s{i}", None) for i in range(small)]
    units = spark.createDataFrame(rows, "study_id string, g string").repartition(3)
    w = rs.draw_weights(units, ["g"], "study_id", reps).groupBy("replicate", "study_id").agg(F.sum("weight").alias("w")).collect()
    at = {u: i for i, (u, _) in enumerate(rows)}
    table = np.zeros((reps, n + small))
    for r in w:
        table[r.replicate - 1, at[r.study_id]] = r.w
    for part in (table[:, :n], table[:, n:]):
        size = part.shape[1]
        assert (part.sum(1) == size).all()
        cov = np.cov(part.T)
        assert abs(part.mean(0) - 1).max() < 0.15
        assert np.diag(cov).mean() == pytest.approx(1 - 1 / size, abs=0.03)
        assert (cov.sum() - np.trace(cov)) / (size * (size - 1)) == pytest.approx(-1 / size, abs=0.01)
        # probabilities of 0, 1, 2 draws
        for k, p in enumerate((1 - 1 / size) ** size * np.array([1, size / (size - 1)])):
            assert (part == k).mean() == pytest.approx(p, abs=0.01)


@pytest.mark.parametrize("level", [1, 3, 10])
def test_limits_are_poisson(level):
    import math

    rate, limits = 1 - 0.5 ** level, [0, *rs.poisson_limits(level)]
    for j, (a, b) in enumerate(zip(limits, limits[1:])):
        assert (b - a) / 2 ** 32 == pytest.approx(math.exp(-rate) * rate ** j / math.factorial(j), abs=1e-9)
    # so far below n that n is passed once in a billion replicates at most
    n = rs.least_units(level)
    assert (n - rate * n) / math.sqrt(rate * n) >= rs.SLACK


def test_interval_covers_the_point(cases):
    row = rs.mean_interval(cases.withColumn("g", F.lit("all")), ["g"], "study_id", "score", 200).first()
    assert row.lower < row.mean < row.upper and row.upper - row.lower < 0.15


def test_means_and_metrics_per_replicate(cases):
    drawn = rs.draw_weights(cases, ["label_binary"], "study_id", 5).toPandas()
    got = rs.replicate_metrics(cases, ["label_binary"], "study_id", {"m": F.col("score")}, "label_binary", "score", 5).collect()
    assert len(got) == 5
    for r in got:
        part = drawn[drawn.replicate == r.replicate]
        assert r.m == pytest.approx((part.score * part.weight).sum() / part.weight.sum())
        pos, neg = part[part.label_binary == 1], part[part.label_binary == 0]
        wins = sum(a.weight * b.weight * (1.0 if a.score > b.score else 0.5 if a.score == b.score else 0.0)
                   for a in pos.itertuples() for b in neg.itertuples())
        assert r.auc == pytest.approx(wins / (pos.weight.sum() * neg.weight.sum()))


def test_undefined_replicates_lenient_and_strict(spark):
    df = spark.createDataFrame([(1, 0.1), (2, None), (3, 0.3), (4, float("nan"))], "replicate int, m double")
    row = rs.percentile_intervals(df, ["m"]).first()
    assert row.used == 2 and row.lower == pytest.approx(0.105)
    with pytest.raises(Exception, match="non-finite"):
        rs.percentile_intervals(df, ["m"], strict=True).collect()


def test_balanced_epoch(cases):
    got = sa.balanced_epoch(cases, 4, 50).collect()
    assert sum(r.label_binary for r in got) == 50 and len(got) == 100
    negatives = [r.study_id for r in got if r.label_binary == 0]
    assert len(set(negatives)) == 50
    assert sorted(r.slot_order for r in got) == list(range(1, 101))
    assert {tuple(r) for r in got} != {tuple(r) for r in sa.balanced_epoch(cases, 5, 50).collect()}


def test_block_mask_is_exact(spark):
    ids = spark.createDataFrame([(str(i),) for i in range(5)], "study_id string")
    got = sa.block_mask(ids).groupBy("study_id").agg(F.count("*").alias("n"), F.count_distinct("block_x", "block_y", "block_z").alias("d")).collect()
    assert all(r.n == r.d == round(0.45 * 8 * 8 * 8) for r in got) and len(got) == 5


def test_stream_resume_equals_batch(spark):
    rng = random.Random(4)
    rows = [(f"s{rng.randrange(30)}", i, rng.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "study_id string, t long, v double")
    landing, out = fresh_path(spark, "landing"), fresh_path(spark, "ledger")
    schema = df.schema
    df.where("t < 150").repartition(3).write.mode("append").parquet(landing)
    st.run_ledger(st.arriving_cases(spark, landing, schema, files_per_batch=1), out, ["t"])
    first = st.current_ledger(spark, out, ["t"]).count()
    df.where("t >= 150").repartition(3).write.mode("append").parquet(landing)
    st.run_ledger(st.arriving_cases(spark, landing, schema, files_per_batch=2), out, ["t"])
    st.run_ledger(st.arriving_cases(spark, landing, schema), out, ["t"])  # nothing new
    want = {tuple(r) for r in j.keep_last(df, ["study_id"], ["t"]).select("study_id", "t", "v").collect()}
    got = {tuple(r) for r in st.current_ledger(spark, out, ["t"]).select("study_id", "t", "v").collect()}
    assert first <= 30 and got == want
    compact = st.compact_ledger(spark, out, ["t"], fresh_path(spark, "compact"))
    assert {tuple(r) for r in spark.read.parquet(compact).select("study_id", "t", "v").collect()} == want


def test_stream_quarantine_goes_on(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("b", 1, -1.0), ("c", 1, 2.0)], "study_id string, t long, v double")
    landing, out = fresh_path(spark, "landing"), fresh_path(spark, "ledger")
    df.write.parquet(landing)
    st.run_ledger(st.arriving_cases(spark, landing, df.schema), out, ["t"], problem=F.when(F.col("v") < 0, "negative"))
    assert {r.study_id for r in st.current_ledger(spark, out, ["t"]).collect()} == {"a", "c"}
    assert [(r.study_id, r.error) for r in st.error_ledger(spark, out).collect()] == [("b", "negative")]
