"""Hand cases and properties of matching, curves and ranking metrics."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from caseledger.operators import detection as det


@pytest.fixture(scope="module")
def hand(spark):
    rows = [("A", 1, 0.9, 12.0), ("A", 2, 0.8, 4.0), ("A", 3, 0.7, 1.0), ("B", 1, 0.8, 5.0), ("C", 1, 0.6, None)]
    candidates = spark.createDataFrame(rows, "study_id string, candidate_rank long, candidate_score double, reference_distance_mm double")
    cases = spark.createDataFrame([("A", 1), ("B", 1), ("C", 0)], "study_id string, label_binary int")
    return candidates, cases


def test_greedy_match_second_candidate_in_tolerance_is_false(hand):
    got = {(r.study_id, r.candidate_rank): r.is_true_positive_candidate
           for r in det.match_candidates(hand[0]).collect()}
    assert got == {("A", 1): False, ("A", 2): True, ("A", 3): False, ("B", 1): True, ("C", 1): False}


@pytest.mark.parametrize("direct", [True, False])
def test_froc_curve_and_points(hand, direct):
    candidates, cases = hand
    sizes = det.cohort_sizes(cases)
    curve = (det.froc_from_distances(candidates, sizes) if direct
             else det.froc_curve(det.match_candidates(candidates), sizes))
    got = sorted(((round(r.threshold, 6), r.tp, r.fp) for r in curve.collect()), reverse=True)
    assert got == [(0.900001, 0, 0), (0.9, 0, 1), (0.8, 2, 1), (0.7, 2, 2), (0.6, 2, 3)]
    points = {r.target: (r.sensitivity, round(r.threshold, 6)) for r in det.operating_points(curve).collect()}
    assert points[0.25] == (0.0, 0.900001)
    assert points[0.5] == (1.0, 0.8)
    # equal sensitivity: the point with more false positives wins
    assert points[1.0] == (1.0, 0.6)
    threshold = det.deployment_threshold(det.operating_points(curve)).first().locked_threshold
    assert threshold == pytest.approx(0.6)


def test_froc_without_candidates_is_the_origin_alone(spark, hand):
    candidates, cases = hand
    none = candidates.where("study_id = 'nobody'")
    row = det.froc_from_distances(none, det.cohort_sizes(cases)).collect()
    assert [(r.threshold, r.tp, r.fp, r.sensitivity) for r in row] == [(1.0, 0, 0, 0.0)]


def test_locked_metrics_use_cohort_denominators(hand):
    candidates, cases = hand
    extra = cases.unionByName(cases.sparkSession.createDataFrame([("D", 1), ("E", 0)], cases.schema))
    scored = det.case_scores(extra, candidates, 0.75)
    row = det.locked_metrics(det.match_candidates(candidates), scored, 0.75).first()
    assert (row.n_cases, row.n_refs, row.tp, row.fp) == (5, 3, 2, 1)
    assert row.lesion_sensitivity == pytest.approx(2 / 3)
    assert row.fp_per_case == pytest.approx(1 / 5)
    assert row.negative_specificity == pytest.approx(1.0)


def _auc(labels, scores):
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0)
             for (x, a), (y, b) in itertools.product(zip(labels, scores), repeat=2) if x == 1 and y == 0]
    return sum(pairs) / len(pairs)


def _ap(labels, scores):
    total, out = sum(labels), 0.0
    for s in sorted(set(scores), reverse=True):
        tp = sum(1 for y, x in zip(labels, scores) if x >= s and y)
        n = sum(1 for x in scores if x >= s)
        here = sum(1 for y, x in zip(labels, scores) if x == s and y)
        out += here / total * tp / n
    return out


def test_auc_and_ap_ties_by_hand(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label_binary int, score double")
    row = det.ranking_metrics(df).first()
    assert row.auc == pytest.approx(0.875)
    assert row.average_precision == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_auc_ap_against_definitions_and_monotone_transform(spark):
    rng = random.Random(7)
    data = [(g, int(rng.random() < 0.4), round(rng.random(), 1)) for g in "ab" for _ in range(60)]
    df = spark.createDataFrame(data, "g string, label_binary int, score double")
    got = {r.g: r for r in det.ranking_metrics(df, ["g"]).collect()}
    moved = {r.g: r for r in det.ranking_metrics(df.withColumn("score", F.exp("score") * 3), ["g"]).collect()}
    for g in "ab":
        y = [b for a, b, _ in data if a == g]
        s = [c for a, _, c in data if a == g]
        assert got[g].auc == pytest.approx(_auc(y, s))
        assert got[g].average_precision == pytest.approx(_ap(y, s))
        assert moved[g].auc == pytest.approx(got[g].auc)


def test_metrics_undefined_for_one_class(spark):
    df = spark.createDataFrame([("n", 0, 0.1), ("n", 0, 0.4), ("p", 1, 0.3)], "g string, label_binary int, score double")
    got = {r.g: (r.auc, r.average_precision) for r in det.ranking_metrics(df, ["g"]).collect()}
    assert got["n"] == (None, None)
    assert got["p"] == (None, pytest.approx(1.0))


def test_froc_is_monotone(spark):
    rng = random.Random(3)
    rows = [(str(i // 4), i % 4 + 1, rng.random(), rng.choice([None, 3.0, 9.0])) for i in range(400)]
    c = spark.createDataFrame(rows, "study_id string, candidate_rank long, candidate_score double, reference_distance_mm double")
    cases = spark.createDataFrame([(str(i), 1) for i in range(120)], "study_id string, label_binary int")
    curve = sorted((-r.threshold, r.tp, r.fp) for r in det.froc_from_distances(c, det.cohort_sizes(cases)).collect())
    assert all(a[1] <= b[1] and a[2] <= b[2] for a, b in zip(curve, curve[1:]))


def test_roc_drops_collinear_points(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (1, 0.7), (0, 0.3), (0, 0.2)], "label_binary int, score double")
    got = sorted((r.fpr, r.tpr) for r in det.roc_curve(df).collect())
    assert got == [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)]


def test_rank_order_check_finds_violations(spark):
    ok = [("a", 1, 0.9), ("a", 2, 0.8)]
    bad = [("b", 1, 0.5), ("b", 2, 0.6)]
    df = spark.createDataFrame(ok + bad, "study_id string, candidate_rank long, candidate_score double")
    assert [(r.study_id, r.violations) for r in det.score_order_violations(df).collect()] == [("b", 1)]


def test_top_candidates_limit_reaches_the_map_side(spark):
    df = spark.range(1000).select((F.col("id") % 3).cast("string").alias("study_id"),
                                  *[F.col("id").alias(f"candidate_{a}") for a in "xyz"],
                                  F.rand(1).alias("candidate_score"))
    top = det.top_candidates(df, 5)
    assert top.count() == 15
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
