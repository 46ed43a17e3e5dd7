"""Detection queries: ranks, matching, curves, operating points, locked metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.constants import STANDARD_FP_TARGETS
from ..operators import detection as det
from ..operators.ordering import hash_index, rank_within, running_totals
from . import views as v
from .registry import Tables, query

THRESHOLD = 0.9


def truth(t: Tables) -> DataFrame:
    """Ranked and matched candidates of the adapter views."""
    ranked = det.rank_candidates(v.v_candidate(t), v.V_CANDIDATE_ORDER)
    return det.match_candidates(ranked)


def curve(t: Tables) -> DataFrame:
    return det.froc_from_distances(v.v_candidate(t), det.cohort_sizes(v.v_cohort(t)))


# SQL building blocks of the oracle side, on plain windows
TRUTH_SQL = """, ranked AS (
 SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY candidate_score DESC, candidate_x, candidate_y,
   candidate_z, shipped, reference_distance_mm NULLS LAST) AS candidate_rank FROM v_candidate),
truth AS (
 SELECT *, coalesce(reference_distance_mm <= 5, FALSE) AS within_reference_tolerance,
  coalesce(reference_distance_mm <= 5 AND candidate_rank =
   min(CASE WHEN reference_distance_mm <= 5 THEN candidate_rank END) OVER (PARTITION BY study_id), FALSE) AS tp
 FROM ranked)"""
CURVE_SQL = TRUTH_SQL + """, sizes AS (SELECT count(*) AS n_cases, CAST(sum(label_binary) AS BIGINT) AS n_refs FROM v_cohort),
steps AS (
 SELECT DISTINCT candidate_score AS threshold,
  CAST(sum(CASE WHEN tp THEN 1 ELSE 0 END) OVER (ORDER BY candidate_score DESC) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN tp THEN 0 ELSE 1 END) OVER (ORDER BY candidate_score DESC) AS BIGINT) AS fp FROM truth),
curve AS (
 SELECT s.threshold, s.tp, s.fp, n_refs, n_cases, CAST(s.tp AS DOUBLE) / n_refs AS sensitivity,
  CAST(s.fp AS DOUBLE) / n_cases AS fp_per_case
 FROM (SELECT * FROM steps UNION ALL
       SELECT max(threshold) + 1e-6::DOUBLE, 0, 0 FROM steps) s, sizes),
points AS (
 SELECT target, achieved_fp_per_case, sensitivity, threshold, tp, fp FROM (
  SELECT target, fp_per_case AS achieved_fp_per_case, sensitivity, threshold, tp, fp,
   row_number() OVER (PARTITION BY target ORDER BY sensitivity DESC, fp_per_case DESC, threshold DESC) AS r
  FROM curve, (SELECT unnest([0.25, 0.5, 1, 2, 4, 8]::DOUBLE[]) AS target)
  WHERE fp_per_case <= target + 1e-12::DOUBLE) WHERE r = 1)"""
CV = "v_cohort v_candidate"


@query("e1_rank_within_case", uses=CV, sql=TRUTH_SQL + """
 SELECT study_id, candidate_rank, candidate_score, candidate_x, candidate_y, candidate_z FROM ranked""",
       doubles="candidate_score")
def _(t):
    return det.rank_candidates(v.v_candidate(t), v.V_CANDIDATE_ORDER).select(
        "study_id", "candidate_rank", "candidate_score", "candidate_x", "candidate_y", "candidate_z")


@query("e2_running_totals_global", uses=CV, doubles="candidate_score", sql=TRUTH_SQL + """, g AS (
 SELECT candidate_score, sum(CASE WHEN tp THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN tp THEN 0 ELSE 1 END) AS fp
 FROM truth GROUP BY 1)
SELECT candidate_score, CAST(sum(tp) OVER (ORDER BY candidate_score DESC) AS BIGINT) AS cumulative_tp,
 CAST(sum(fp) OVER (ORDER BY candidate_score DESC) AS BIGINT) AS cumulative_fp FROM g""")
def _(t):
    per_score = truth(t).groupBy("candidate_score").agg(
        F.sum(F.col("is_true_positive_candidate").cast("long")).alias("tp"),
        F.sum(F.col("is_false_positive_candidate").cast("long")).alias("fp"))
    return running_totals(per_score, [], [("candidate_score", False)],
                          {"cumulative_tp": "tp", "cumulative_fp": "fp"}).drop("tp", "fp")


@query("e3_last_row_per_score", uses=CV, doubles="candidate_score", sql=TRUTH_SQL + """
SELECT candidate_score, study_id, candidate_rank FROM (
 SELECT *, row_number() OVER (PARTITION BY candidate_score ORDER BY study_id DESC, candidate_rank DESC) AS r
 FROM truth) WHERE r = 1""")
def _(t):
    # the last row of each score in (study, rank) order, as a map-side aggregate
    return (truth(t).groupBy("candidate_score")
            .agg(F.max(F.struct("study_id", "candidate_rank")).alias("_last"))
            .select("candidate_score", "_last.study_id", "_last.candidate_rank"))


@query("e4_greedy_first_match", uses=CV, sql=TRUTH_SQL + """
 SELECT study_id, candidate_rank, within_reference_tolerance, tp AS is_true_positive_candidate,
  NOT tp AS is_false_positive_candidate FROM truth""")
def _(t):
    return truth(t).select("study_id", "candidate_rank", "within_reference_tolerance",
                           "is_true_positive_candidate", "is_false_positive_candidate")


@query("e6_score_monotonicity", uses=CV, sql=TRUTH_SQL + """, chk AS (
 SELECT study_id, candidate_score - lag(candidate_score) OVER (PARTITION BY study_id ORDER BY candidate_rank) AS d,
  candidate_z - lag(candidate_z) OVER (PARTITION BY study_id ORDER BY candidate_rank) AS dz FROM ranked)
SELECT count(*) FILTER (WHERE d > 1e-7::DOUBLE) AS score_violations,
 count(*) FILTER (WHERE dz > 0) AS line_violations FROM chk""")
def _(t):
    ranked = det.rank_candidates(v.v_candidate(t), v.V_CANDIDATE_ORDER)
    by_score = det.score_order_violations(ranked).agg(
        F.coalesce(F.sum("violations"), F.lit(0)).alias("score_violations"))
    # the same check on a column that is not sorted does find violations
    by_line = det.score_order_violations(
        ranked.select("study_id", "candidate_rank", F.col("candidate_z").cast("double").alias("candidate_score"))
    ).agg(F.coalesce(F.sum("violations"), F.lit(0)).alias("line_violations"))
    return by_score.join(F.broadcast(by_line))


@query("d18_roc_auc", uses="v_case", doubles="auc", sql="""
, p AS (SELECT source_group, maximum_candidate_score AS s, count(*) AS n FROM v_case WHERE label_binary = 1 GROUP BY 1, 2),
q AS (SELECT source_group, maximum_candidate_score AS s, count(*) AS n FROM v_case WHERE label_binary = 0 GROUP BY 1, 2)
SELECT p.source_group, sum(p.n * q.n * CASE WHEN p.s > q.s THEN 1.0::DOUBLE WHEN p.s = q.s THEN 0.5::DOUBLE ELSE 0 END)
 / sum(p.n * q.n) AS auc FROM p JOIN q USING (source_group) GROUP BY 1""")
def _(t):
    return det.ranking_metrics(v.v_case(t), ["source_group"], score="maximum_candidate_score").select(
        "source_group", "auc")


@query("d18_roc_auc_document_quality", doubles="auc", sql="""
WITH d AS (SELECT quality, CAST(n_chars AS DOUBLE) AS s FROM documents JOIN labels USING (doc_id))
SELECT avg(CASE WHEN a.s > b.s THEN 1.0::DOUBLE WHEN a.s = b.s THEN 0.5::DOUBLE ELSE 0 END) AS auc
FROM d a, d b WHERE a.quality = 1 AND b.quality = 0""")
def _(t):
    rows = t("documents").select("doc_id", F.col("n_chars").cast("double").alias("score")).join(
        t("labels").select("doc_id", F.col("quality").alias("label_binary")), "doc_id")
    return det.ranking_metrics(rows).select("auc")


@query("d19_average_precision", uses="v_case", doubles="average_precision", sql="""
, g AS (SELECT source_group, maximum_candidate_score AS s, sum(label_binary) AS p, count(*) AS n FROM v_case GROUP BY 1, 2),
c AS (SELECT source_group, p, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM g
      WINDOW w AS (PARTITION BY source_group ORDER BY s DESC))
SELECT source_group, sum(CAST(p AS DOUBLE) * CAST(tp AS DOUBLE) / CAST(seen AS DOUBLE)) / sum(CAST(p AS DOUBLE)) AS average_precision
FROM c GROUP BY 1""")
def _(t):
    return det.ranking_metrics(v.v_case(t), ["source_group"], score="maximum_candidate_score").select(
        "source_group", "average_precision")


@query("d20_roc_curve", uses="v_case", doubles="fpr tpr threshold", sql="""
, g AS (SELECT maximum_candidate_score AS s, sum(label_binary) AS p, sum(1 - label_binary) AS n FROM v_case GROUP BY 1),
c AS (SELECT s, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS fp FROM g
      UNION ALL SELECT 'inf'::DOUBLE, 0, 0),
d AS (SELECT *, lag(tp) OVER w AS tp0, lead(tp) OVER w AS tp1, lag(fp) OVER w AS fp0, lead(fp) OVER w AS fp1 FROM c
      WINDOW w AS (ORDER BY s DESC))
SELECT CAST(fp AS DOUBLE) / (SELECT max(fp) FROM c) AS fpr, CAST(tp AS DOUBLE) / (SELECT max(tp) FROM c) AS tpr,
 s AS threshold FROM d
WHERE tp0 IS NULL OR tp1 IS NULL OR tp1 - 2 * tp + tp0 <> 0 OR fp1 - 2 * fp + fp0 <> 0""")
def _(t):
    return det.roc_curve(v.v_case(t), score="maximum_candidate_score")


@query("d21_froc_curve", uses=CV, doubles="threshold sensitivity fp_per_case",
       sql=CURVE_SQL + " SELECT * FROM curve")
def _(t):
    return curve(t)


@query("d21_froc_curve_from_ledger", uses=CV, doubles="threshold sensitivity fp_per_case",
       sql=CURVE_SQL + " SELECT * FROM curve")
def _(t):
    """The same curve from a stored truth ledger with per-candidate flags."""
    return det.froc_curve(truth(t), det.cohort_sizes(v.v_cohort(t)))


@query("d22_operating_points", uses=CV, doubles="achieved_fp_per_case sensitivity threshold",
       sql=CURVE_SQL + " SELECT * FROM points")
def _(t):
    return det.operating_points(curve(t))


@query("d23_mean_froc_sensitivity", uses=CV, doubles="mean_froc_sensitivity",
       sql=CURVE_SQL + " SELECT avg(sensitivity) AS mean_froc_sensitivity FROM points WHERE target < 8")
def _(t):
    return det.mean_froc_sensitivity(det.operating_points(curve(t)))


@query("d24_threshold_selection", uses=CV, doubles="locked_threshold sensitivity achieved_fp_per_case",
       sql=CURVE_SQL + """ SELECT threshold AS locked_threshold, sensitivity, achieved_fp_per_case
 FROM points WHERE target = 1""")
def _(t):
    return det.deployment_threshold(det.operating_points(curve(t)))


LOCKED_DOUBLES = "lesion_sensitivity fp_per_case negative_specificity localization_sensitivity"


LOCKED_SQL = TRUTH_SQL + """, per AS (
 SELECT c.study_id, c.source_group, c.label_binary, coalesce(max(candidate_score), 0) AS best,
  count(*) FILTER (WHERE tp AND candidate_score >= 0.9::DOUBLE) AS tp,
  count(*) FILTER (WHERE NOT tp AND candidate_score >= 0.9::DOUBLE) AS fp
 FROM v_cohort c LEFT JOIN truth r USING (study_id) GROUP BY 1, 2, 3)
SELECT source_group, count(*) AS n_cases, CAST(sum(label_binary) AS BIGINT) AS n_refs,
 CAST(sum(1 - label_binary) AS BIGINT) AS n_negatives, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp,
 CAST(sum(tp) AS DOUBLE) / sum(label_binary) AS lesion_sensitivity,
 CAST(sum(fp) AS DOUBLE) / count(*) AS fp_per_case,
 avg(CASE WHEN label_binary = 0 THEN CASE WHEN best < 0.9::DOUBLE THEN 1.0::DOUBLE ELSE 0 END END) AS negative_specificity,
 avg(CASE WHEN label_binary = 1 THEN CASE WHEN tp > 0 THEN 1.0::DOUBLE ELSE 0 END END) AS localization_sensitivity
FROM per GROUP BY 1"""


@query("d25_locked_threshold_metrics", uses=CV, doubles=LOCKED_DOUBLES, sql=LOCKED_SQL)
def _(t):
    scored = det.case_scores(v.v_cohort(t), v.v_candidate(t), THRESHOLD)
    return det.locked_from_distances(v.v_candidate(t), scored, THRESHOLD, ["source_group"])


@query("d25_locked_metrics_from_ledger", uses=CV, doubles=LOCKED_DOUBLES, sql=LOCKED_SQL)
def _(t):
    """The same metrics from a stored truth ledger."""
    scored = det.case_scores(v.v_cohort(t), v.v_candidate(t), THRESHOLD)
    return det.locked_metrics(truth(t), scored, THRESHOLD, ["source_group"])


@query("d26_case_score", uses=CV, doubles="maximum_candidate_score", sql="""
SELECT c.study_id, coalesce(max(candidate_score), 0.0::DOUBLE) AS maximum_candidate_score,
 coalesce(max(candidate_score), 0.0::DOUBLE) >= 0.9::DOUBLE AS case_positive
FROM v_cohort c LEFT JOIN v_candidate USING (study_id) GROUP BY 1""")
def _(t):
    return det.case_scores(v.v_cohort(t), v.v_candidate(t), THRESHOLD).select(
        "study_id", "maximum_candidate_score", "case_positive")


@query("c9_theta_targets_by_curve", uses=CV, sql=CURVE_SQL + """
SELECT target, count(*) AS eligible_points, max(fp) AS largest_fp
FROM curve JOIN (SELECT unnest([0.25, 0.5, 1, 2, 4, 8]::DOUBLE[]) AS target) ON fp_per_case <= target + 1e-12::DOUBLE
GROUP BY 1""")
def _(t):
    from ..functions.constants import FP_TARGETS

    eligible = curve(t).select("fp", F.explode(F.filter(
        F.array(*[F.lit(x) for x in FP_TARGETS]), lambda x: F.col("fp_per_case") <= x + 1e-12)).alias("target"))
    return eligible.groupBy("target").agg(F.count(F.lit(1)).alias("eligible_points"),
                                          F.max("fp").alias("largest_fp"))


@query("f3_top_candidates_per_case", uses=CV, doubles="candidate_score", sql=TRUTH_SQL + """
SELECT study_id, candidate_rank, candidate_score FROM ranked WHERE candidate_rank <= 3""")
def _(t):
    return det.top_candidates(v.v_candidate(t), 3, v.V_CANDIDATE_ORDER).select(
        "study_id", "candidate_rank", "candidate_score")


@query("minimum_slice_locked_metrics", uses=CV, doubles="threshold lesion_sensitivity fp_per_case", sql=CURVE_SQL + """
SELECT threshold, CAST((SELECT count(*) FROM truth WHERE tp AND candidate_score >= threshold) AS BIGINT) AS tp,
 CAST((SELECT count(*) FROM truth WHERE NOT tp AND candidate_score >= threshold) AS BIGINT) AS fp,
 CAST((SELECT count(*) FROM truth WHERE tp AND candidate_score >= threshold) AS DOUBLE) / n_refs AS lesion_sensitivity,
 CAST((SELECT count(*) FROM truth WHERE NOT tp AND candidate_score >= threshold) AS DOUBLE) / n_cases AS fp_per_case
FROM points, sizes WHERE target = 1""")
def minimum_slice(t):
    """Rank, match, curve, operating point at one FP per case, metrics at that threshold."""
    point = det.deployment_threshold(det.operating_points(curve(t)))
    matched = truth(t).join(F.broadcast(point.select("locked_threshold")))
    above = F.col("candidate_score") >= F.col("locked_threshold")
    hits = matched.groupBy(F.col("locked_threshold").alias("threshold")).agg(
        F.sum((above & F.col("is_true_positive_candidate")).cast("long")).alias("tp"),
        F.sum((above & F.col("is_false_positive_candidate")).cast("long")).alias("fp"))
    sizes = det.cohort_sizes(v.v_cohort(t))
    return hits.join(F.broadcast(sizes)).select(
        "threshold", "tp", "fp", (F.col("tp") / F.col("n_refs")).alias("lesion_sensitivity"),
        (F.col("fp") / F.col("n_cases")).alias("fp_per_case"))
