"""Candidate matching, ranking curves and operating points.

Every function takes an optional list of ``keys`` (source, arm, bootstrap
replicate); curves are computed per key in one job. Rows are grouped by score
before anything is ordered, so ties cost nothing and the ordered part holds one
row per distinct score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.constants import (
    DEPLOYMENT_FP_TARGET, FP_TARGETS, MAXIMUM_CANDIDATES, STANDARD_FP_TARGETS, TOLERANCE_MM,
)
from .ordering import Order, exact_percentiles, rank_within, running_totals, sort_columns

CANDIDATE_ORDER: Order = (("candidate_score", False), ("candidate_x", True), ("candidate_y", True),
                          ("candidate_z", True))


def rank_candidates(candidates: DataFrame, order: Order = CANDIDATE_ORDER,
                    out: str = "candidate_rank") -> DataFrame:
    """1-based rank inside each study, best score first."""
    return rank_within(candidates, ["study_id"], order, out)


def top_candidates(candidates: DataFrame, k: int = MAXIMUM_CANDIDATES, order: Order = CANDIDATE_ORDER,
                   keys: Sequence[str] = ("study_id",), out: str = "candidate_rank") -> DataFrame:
    """The ``k`` best per key. ``row_number() <= k`` lets Spark cut every map
    partition to ``k`` rows per key before the shuffle, so a hot key sends at
    most ``k`` rows per map task."""
    w = Window.partitionBy(*keys).orderBy(*sort_columns(order))
    # the bare row number is filtered, the form the limit is inferred from
    return (candidates.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= k)
            .withColumn(out, F.col("_rn").cast("long")).drop("_rn"))


def match_candidates(candidates: DataFrame, tolerance: float = TOLERANCE_MM) -> DataFrame:
    """Greedy truth: per study only the best-ranked candidate within tolerance is
    a true positive; later ones inside the tolerance are false positives.

    The winner per study is a map-side aggregate, not a window.
    """
    within = F.coalesce(F.col("reference_distance_mm") <= tolerance, F.lit(False))
    marked = candidates.withColumn("within_reference_tolerance", within)
    first = (marked.where("within_reference_tolerance").groupBy("study_id")
             .agg(F.min("candidate_rank").alias("_first")))
    hit = F.coalesce(F.col("candidate_rank") == F.col("_first"), F.lit(False))
    return (marked.join(first, "study_id", "left")
            .withColumn("is_true_positive_candidate", hit)
            .withColumn("is_false_positive_candidate", ~hit)
            .drop("_first"))


def case_scores(cases: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """Best candidate score per case (0 without candidates) and its decision."""
    best = candidates.groupBy("study_id").agg(F.max("candidate_score").alias("maximum_candidate_score"))
    return (cases.join(best, "study_id", "left")
            .withColumn("maximum_candidate_score", F.coalesce("maximum_candidate_score", F.lit(0.0)))
            .withColumn("case_positive", F.col("maximum_candidate_score") >= threshold))


def _score_groups(rows: DataFrame, keys: Sequence[str], label: str, score: str,
                  weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """One row per distinct score with weighted positive and negative counts, and
    the ungrouped rows they come from."""
    w = F.col(weight) if weight else F.lit(1)
    raw = rows.where(F.col(score).isNotNull()).select(
        *keys, F.col(score).alias("_s"), F.when(F.col(label) == 1, w).otherwise(0).cast("long").alias("_p"),
        F.when(F.col(label) == 0, w).otherwise(0).cast("long").alias("_q"))
    return raw.groupBy(*keys, "_s").agg(F.sum("_p").alias("_pos"), F.sum("_q").alias("_neg")), raw


def ranking_metrics(rows: DataFrame, keys: Sequence[str] = (), label: str = "label_binary",
                    score: str = "score", weight: str | None = None,
                    undrawn: DataFrame | None = None) -> DataFrame:
    """ROC AUC with tie correction and step-wise average precision, per key.

    ``auc`` is null with one class only, ``average_precision`` without
    positives. ``weight`` is an integer multiplicity (bootstrap draws), and
    ``undrawn`` then the table behind the draws, whose row count bounds the
    score groups of one key.
    """
    keys = list(keys)
    groups, raw = _score_groups(rows, keys, label, score, weight)
    if undrawn is None:
        out = ranked_sums(groups, raw, keys)
    else:
        out = ranked_sums(groups, undrawn.select(F.col(score).alias("_s")), keys, rows_per_key=undrawn.count())
    return out.select(*keys, "positives", "negatives", "auc", "average_precision")


def ranked_sums(groups: DataFrame, raw: DataFrame | None, keys: Sequence[str],
                extra: Sequence[str] = (), rows_per_key: int | None = None) -> DataFrame:
    """AUC and average precision of score groups (``_s, _pos, _neg``), with the
    sums of any ``extra`` columns in the same grouping."""
    keys = list(keys)
    run = running_totals(groups, keys, [("_s", False)], {"_tp": "_pos", "_fp": "_neg"}, source=raw,
                         rows_per_key=rows_per_key)
    sums = run.groupBy(*keys).agg(
        F.sum("_pos").alias("positives"), F.sum("_neg").alias("negatives"),
        # negatives of a score lose against all positives above it and half of its own
        F.sum(F.col("_neg") * (F.col("_tp") - F.col("_pos") / 2.0)).alias("_area"),
        F.sum(F.when(F.col("_tp") + F.col("_fp") > 0,
                     F.col("_pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp")))).alias("_steps"),
        *[F.sum(c).alias(c) for c in extra])
    p, n = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return sums.select(*keys, "positives", "negatives", *extra,
                       F.when((p > 0) & (n > 0), F.col("_area") / (p * n)).alias("auc"),
                       F.when(p > 0, F.col("_steps") / p).alias("average_precision"))


def roc_curve(rows: DataFrame, label: str = "label_binary", score: str = "score") -> DataFrame:
    """ROC points; starts at (0,0) with threshold +inf; collinear points dropped.

    Neighbouring points come from an equi-join on the position, so no window
    spans the whole curve.
    """
    groups, raw = _score_groups(rows, [], label, score)
    run = running_totals(groups.withColumn("_one", F.lit(1).cast("long")), [], [("_s", False)],
                         {"_tp": "_pos", "_fp": "_neg", "_i": "_one"}, source=raw)
    following = run.select((F.col("_i") - 1).alias("_i"), F.col("_pos").alias("_dp"), F.col("_neg").alias("_dn"))
    step = run.withColumn("threshold", F.col("_s").cast("double")).join(following, "_i", "left")
    # a point stays when the step into it and the step out of it differ, or at the end
    kept = step.where(F.col("_dp").isNull() | (F.col("_dp") != F.col("_pos")) | (F.col("_dn") != F.col("_neg")))
    ends = run.agg(F.max("_tp").alias("_P"), F.max("_fp").alias("_N"))
    start = ends.select(F.lit(0).cast("long").alias("_tp"), F.lit(0).cast("long").alias("_fp"),
                        F.lit(float("inf")).alias("threshold"))
    return (kept.select("_tp", "_fp", "threshold").unionByName(start).join(F.broadcast(ends))
            .select((F.col("_fp") / F.col("_N").cast("double")).alias("fpr"),
                    (F.col("_tp") / F.col("_P").cast("double")).alias("tpr"), "threshold"))


def cohort_sizes(cases: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Cases and positive cases per key: the denominators of every detection rate."""
    return cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cases"),
        F.sum(F.when(F.col("label_binary") == 1, 1).otherwise(0)).alias("n_refs"))


def _join_sizes(df: DataFrame, sizes: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    return df.join(sizes, list(keys), how) if keys else df.join(F.broadcast(sizes))


def froc_curve(truth: DataFrame, sizes: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Free-response curve: one row per distinct score, plus the origin.

    ``sizes`` holds ``n_cases`` and ``n_refs`` per key, from the cohort and not
    from the candidates. The origin sits 1e-6 above the best score, or at 1.0
    for a key without candidates.
    """
    keys = list(keys)
    raw = truth.select(*keys, F.col("candidate_score").alias("threshold"),
                       F.col("is_true_positive_candidate").cast("long").alias("_p"),
                       F.col("is_false_positive_candidate").cast("long").alias("_q"))
    grouped = raw.groupBy(*keys, "threshold").agg(F.sum("_p").alias("_tp"), F.sum("_q").alias("_fp"))
    return _froc(grouped, raw, sizes, keys)


def _froc(grouped: DataFrame, raw: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    run = running_totals(grouped, keys, [("threshold", False)], {"tp": "_tp", "fp": "_fp"}, source=raw)
    best = raw.groupBy(*keys).agg(F.max("threshold").alias("_best"))
    top = sizes.join(best, keys, "left") if keys else sizes.join(F.broadcast(best))
    origin = top.select(*keys, F.coalesce(F.col("_best") + 1e-6, F.lit(1.0)).alias("threshold"),
                        F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("fp"))
    both = run.select(*keys, "threshold", "tp", "fp").unionByName(origin)
    refs = F.col("n_refs").cast("double")
    return _join_sizes(both, sizes, keys).select(
        *keys, "threshold", "tp", "fp", "n_refs", "n_cases",
        F.when(refs > 0, F.col("tp") / refs).alias("sensitivity"),
        (F.col("fp") / F.col("n_cases").cast("double")).alias("fp_per_case"))


def matched_totals(candidates: DataFrame, tolerance: float = TOLERANCE_MM,
                   keys: Sequence[str] = ()) -> DataFrame:
    """True and false positives per distinct score, straight from distances.

    A study contributes one true positive, at the best score it reaches inside
    the tolerance; every other candidate is false. So neither a rank nor a join
    back to the candidates is needed: two map-side aggregates and a union.
    """
    keys = list(keys)
    inside = F.coalesce(F.col("reference_distance_mm") <= tolerance, F.lit(False))
    won = (candidates.where(inside).groupBy(*keys, "study_id").agg(F.max("candidate_score").alias("threshold"))
           .groupBy(*keys, "threshold").agg(F.count(F.lit(1)).alias("_won"))
           .select(*keys, "threshold", "_won", F.lit(0).cast("long").alias("_all")))
    every = (candidates.groupBy(*keys, F.col("candidate_score").alias("threshold"))
             .agg(F.count(F.lit(1)).alias("_all"))
             .select(*keys, "threshold", F.lit(0).cast("long").alias("_won"), "_all"))
    return (every.unionByName(won).groupBy(*keys, "threshold")
            .agg(F.sum("_won").alias("_tp"), (F.sum("_all") - F.sum("_won")).alias("_fp")))


def froc_from_distances(candidates: DataFrame, sizes: DataFrame, tolerance: float = TOLERANCE_MM,
                        keys: Sequence[str] = ()) -> DataFrame:
    """:func:`froc_curve` of unmatched candidates, without ranking them first."""
    keys = list(keys)
    raw = candidates.select(*keys, F.col("candidate_score").alias("threshold"))
    return _froc(matched_totals(candidates, tolerance, keys), raw, sizes, keys)


def operating_points(curve: DataFrame, targets: Sequence[float] = FP_TARGETS,
                     keys: Sequence[str] = ()) -> DataFrame:
    """Best curve point at or below each false-positive target.

    Ties: higher sensitivity, then *higher* FP rate, then higher threshold.
    Each curve row emits the targets it is eligible for (a fixed handful), and
    ``max`` of a struct is combined map-side.
    """
    eligible = curve.select(
        *keys, F.explode(F.filter(F.array(*[F.lit(float(t)) for t in targets]),
                                  lambda t: F.col("fp_per_case") <= t + 1e-12)).alias("target"),
        F.struct("sensitivity", "fp_per_case", "threshold", "tp", "fp").alias("_row"))
    best = eligible.groupBy(*keys, "target").agg(F.max("_row").alias("_row"))
    return best.select(*keys, "target", F.col("_row.fp_per_case").alias("achieved_fp_per_case"),
                       F.col("_row.sensitivity").alias("sensitivity"),
                       F.col("_row.threshold").alias("threshold"),
                       F.col("_row.tp").alias("tp"), F.col("_row.fp").alias("fp"))


def mean_froc_sensitivity(points: DataFrame, keys: Sequence[str] = (),
                          targets: Sequence[float] = STANDARD_FP_TARGETS) -> DataFrame:
    return (points.where(F.col("target").isin(*[float(t) for t in targets])).groupBy(*keys)
            .agg(F.avg("sensitivity").alias("mean_froc_sensitivity")))


def deployment_threshold(points: DataFrame, target: float = DEPLOYMENT_FP_TARGET,
                         keys: Sequence[str] = ()) -> DataFrame:
    return (points.where(F.abs(F.col("target") - target) <= 1e-12)
            .select(*keys, F.col("threshold").alias("locked_threshold"), "sensitivity",
                    F.col("achieved_fp_per_case")))


def _rate(hits: Column, total: Column) -> Column:
    return F.when(total > 0, hits / total.cast("double"))


def locked_metrics(truth: DataFrame, scored_cases: DataFrame, threshold: float | Column,
                   keys: Sequence[str] = ()) -> DataFrame:
    """Detection rates at a fixed threshold; denominators are cohort counts.

    Reduced to one row per study first, so candidates and cases meet in one
    join of study-sized rows.
    """
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    above = truth.where(F.col("candidate_score") >= t)
    hits = above.groupBy("study_id").agg(
        F.sum(F.col("is_true_positive_candidate").cast("long")).alias("_tp"),
        F.sum(F.col("is_false_positive_candidate").cast("long")).alias("_fp"))
    return _locked(scored_cases.join(hits, "study_id", "left"), t, keys)


def _locked(per_case: DataFrame, t: Column, keys: Sequence[str]) -> DataFrame:
    per_case = per_case.withColumn("_tp", F.coalesce("_tp", F.lit(0))).withColumn("_fp", F.coalesce("_fp", F.lit(0)))
    pos, neg = F.col("label_binary") == 1, F.col("label_binary") == 0
    out = per_case.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_cases"), F.sum(pos.cast("long")).alias("n_refs"),
        F.sum(neg.cast("long")).alias("n_negatives"),
        F.sum("_tp").alias("tp"), F.sum("_fp").alias("fp"),
        F.sum((neg & (F.col("maximum_candidate_score") < t)).cast("long")).alias("_clean"),
        F.sum((pos & (F.col("_tp") > 0)).cast("long")).alias("_localized"))
    return out.select(
        *keys, "n_cases", "n_refs", "n_negatives", "tp", "fp",
        _rate(F.col("tp"), F.col("n_refs")).alias("lesion_sensitivity"),
        _rate(F.col("fp"), F.col("n_cases")).alias("fp_per_case"),
        _rate(F.col("_clean"), F.col("n_negatives")).alias("negative_specificity"),
        _rate(F.col("_localized"), F.col("n_refs")).alias("localization_sensitivity"))


def locked_from_distances(candidates: DataFrame, scored_cases: DataFrame, threshold: float,
                          keys: Sequence[str] = (), tolerance: float = TOLERANCE_MM) -> DataFrame:
    """:func:`locked_metrics` of unmatched candidates: a study has its one true
    positive above the threshold if its best score within tolerance is; the rest
    above the threshold is false. One map-side aggregate per study."""
    inside = F.coalesce(F.col("reference_distance_mm") <= tolerance, F.lit(False))
    hits = candidates.groupBy("study_id").agg(
        F.max(F.when(inside, F.col("candidate_score"))).alias("_best"),
        F.count_if(F.col("candidate_score") >= threshold).alias("_above"))
    won = F.coalesce((F.col("_best") >= threshold).cast("long"), F.lit(0).cast("long"))
    counted = hits.select("study_id", won.alias("_tp"), (F.col("_above") - won).alias("_fp"))
    return _locked(scored_cases.join(counted, "study_id", "left"), F.lit(float(threshold)), keys)


def score_order_violations(ranked: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Studies whose scores rise with the rank. Neighbours meet by an equi-join on
    ``(study, rank)``: evenly spread even for a study with very many candidates."""
    after = ranked.select("study_id", (F.col("candidate_rank") - 1).alias("candidate_rank"),
                          F.col("candidate_score").alias("_next"))
    return (ranked.join(after, ["study_id", "candidate_rank"])
            .where(F.col("_next") > F.col("candidate_score") + tolerance)
            .groupBy("study_id").agg(F.count(F.lit(1)).alias("violations")))


def median_of(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    return exact_percentiles(df, keys, value, [0.5], out).drop("p")
