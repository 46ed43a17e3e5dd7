"""Aggregation queries over case tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as k, scalars as s
from ..operators import contracts as ct, detection as det, resample as rs, summary as sm
from ..operators.ordering import exact_percentiles
from ..session import cut_lineage
from . import views as v
from .detect import CURVE_SQL, THRESHOLD
from .drawsql import REPLICATES, draws_sql, drawn_mean, exact, mean_sql
from .registry import query


@query("d1_group_count", uses="v_cohort", sql="""
SELECT locked_partition, source_group, count(*) AS cases FROM v_cohort GROUP BY 1, 2""")
def _(t):
    return v.v_cohort(t).groupBy("locked_partition", "source_group").agg(F.count(F.lit(1)).alias("cases"))


@query("d2_multi_measure_group", uses="v_case", sql="""
SELECT locked_partition, CASE WHEN label_binary = 1 THEN annotation_type END AS annotation, count(*) AS cases,
 count(DISTINCT patient_id) AS patients, count(*) FILTER (WHERE target_present) AS files,
 count(*) FILTER (WHERE case_positive) AS passed FROM v_case GROUP BY 1, 2""")
def _(t):
    # the distinct count is taken over (key, patient) groups, so a big group is spread over tasks
    keys = ["locked_partition", F.when(F.col("label_binary") == 1, F.col("annotation_type")).alias("annotation")]
    per = v.v_case(t).groupBy(*keys, "patient_id").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("target_present").alias("files"),
        F.count_if("case_positive").alias("passed"))
    return per.groupBy("locked_partition", "annotation").agg(
        F.sum("cases").alias("cases"), F.count(F.lit(1)).alias("patients"), F.sum("files").alias("files"),
        F.sum("passed").alias("passed"))


@query("d3_contingency_table", uses="v_cohort", sql="""
SELECT locked_partition, count(*) FILTER (WHERE source_group = 'F') AS F, count(*) FILTER (WHERE source_group = 'O') AS O,
 count(*) FILTER (WHERE source_group = 'P') AS P FROM v_cohort GROUP BY 1""")
def _(t):
    return sm.contingency(v.v_cohort(t), "locked_partition", "source_group", ["F", "O", "P"])


@query("d4_stacked_scopes", uses="v_case", doubles="mean_organ_dice", sql="""
SELECT 'ALL' AS scope_kind, 'ALL' AS scope_value, count(*) AS cases, avg(organ_dice) AS mean_organ_dice FROM v_case
UNION ALL SELECT 'diagnostic_label', diagnostic_label, count(*), avg(organ_dice) FROM v_case GROUP BY 2
UNION ALL SELECT 'annotation_type', annotation_type, count(*), avg(organ_dice) FROM v_case GROUP BY 2""")
def _(t):
    return sm.stacked_scopes(v.v_case(t), ["diagnostic_label", "annotation_type"],
                             {"cases": "count(1)", "mean_organ_dice": "avg(organ_dice)"})


@query("d5_overlapping_scopes", uses="v_case", doubles="mean_organ_dice minimum_organ_dice", sql="""
, s AS (SELECT 'ALL' AS scope, * FROM v_case UNION ALL SELECT 'TRAIN', * FROM v_case WHERE locked_partition = 'train'
 UNION ALL SELECT 'VALIDATION', * FROM v_case WHERE locked_partition = 'validation'
 UNION ALL SELECT 'POSITIVE', * FROM v_case WHERE label_binary = 1
 UNION ALL SELECT 'NEGATIVE', * FROM v_case WHERE label_binary = 0)
SELECT scope, count(*) AS cases, avg(organ_dice) AS mean_organ_dice, min(organ_dice) AS minimum_organ_dice,
 count(*) FILTER (WHERE organ_dice >= 0.2::DOUBLE) AS covered FROM s GROUP BY 1""")
def _(t):
    scopes = {"ALL": F.lit(True), "TRAIN": F.col("locked_partition") == "train",
              "VALIDATION": F.col("locked_partition") == "validation",
              "POSITIVE": F.col("label_binary") == 1, "NEGATIVE": F.col("label_binary") == 0}
    return sm.scoped(v.v_case(t), scopes).groupBy("scope").agg(
        F.count(F.lit(1)).alias("cases"), F.avg("organ_dice").alias("mean_organ_dice"),
        F.min("organ_dice").alias("minimum_organ_dice"), F.count_if(F.col("organ_dice") >= 0.2).alias("covered"))


@query("d6_distribution_lock", uses="v_cohort", sql="""
, e AS (SELECT * FROM (VALUES ('train', 100::BIGINT), ('test', 1000000::BIGINT), ('held', 5::BIGINT)) x(locked_partition, expected_rows)),
c AS (SELECT locked_partition, count(*) AS n FROM v_cohort GROUP BY 1)
SELECT locked_partition, coalesce(n, 0) AS rows, coalesce(expected_rows, 0) AS expected_rows,
 coalesce(n, 0) = coalesce(expected_rows, 0) AS matches FROM c FULL JOIN e USING (locked_partition)""")
def _(t):
    expected = ct.expected_rows(t.spark, "locked_partition", {"train": 100, "test": 1000000, "held": 5})
    return ct.distribution_difference(v.v_cohort(t), "locked_partition", expected)


@query("d7_cardinality_lock", sql="""
SELECT count(*) AS rows, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_ids, FALSE AS locked FROM lineitem""")
def _(t):
    return ct.cardinality_lock(t("lineitem"), ["l_orderkey", "l_linenumber"], 1671)


@query("d8_exact_percentiles", doubles="percentile_value", sql="""
, q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.01, 0.05, 0.5, 0.9, 0.95, 0.99]) AS v FROM lineitem GROUP BY 1)
SELECT l_returnflag, unnest([0.01, 0.05, 0.5, 0.9, 0.95, 0.99]::DOUBLE[]) AS p, unnest(v) AS percentile_value FROM q""")
def _(t):
    return exact_percentiles(t("lineitem"), ["l_returnflag"], "l_extendedprice", [0.01, 0.05, 0.5, 0.9, 0.95, 0.99])


@query("d9_threshold_fractions", doubles="within_10 within_20 within_30 within_50", sql="""
SELECT l_linestatus, avg((l_quantity <= 10)::INT) AS within_10, avg((l_quantity <= 20)::INT) AS within_20,
 avg((l_quantity <= 30)::INT) AS within_30, avg((l_quantity <= 50)::INT) AS within_50 FROM lineitem GROUP BY 1""")
def _(t):
    return sm.within_rates(t("lineitem"), "l_quantity", [10, 20, 30, 50], ["l_linestatus"])


SUMMARY_METRICS = ["auc", "average_precision", "mean_organ_dice", "median_organ_dice", "organ_presence",
                   "mean_lesion_dice", "median_lesion_dice", "lesion_presence", "locked_threshold",
                   "lesion_sensitivity", "localization_sensitivity", "fp_per_case", "negative_specificity",
                   "mean_froc_sensitivity"]


@query("d27_metric_summary", uses="v_case v_candidate", doubles="value", sql=CURVE_SQL.replace(
    "v_cohort)", "v_case)") + """, pairs AS (SELECT sum(CASE WHEN a.s > b.s THEN a.n * b.n WHEN a.s = b.s THEN a.n * b.n * 0.5::DOUBLE ELSE 0 END)
  / sum(a.n * b.n) AS auc FROM (SELECT maximum_candidate_score AS s, count(*) AS n FROM v_case WHERE label_binary = 1 GROUP BY 1) a,
  (SELECT maximum_candidate_score AS s, count(*) AS n FROM v_case WHERE label_binary = 0 GROUP BY 1) b),
 g AS (SELECT maximum_candidate_score AS s, sum(label_binary) AS p, count(*) AS n FROM v_case GROUP BY 1),
 apx AS (SELECT sum(p::DOUBLE * tp::DOUBLE / seen::DOUBLE) / sum(p) AS ap FROM (SELECT p, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS seen FROM g))
SELECT 'auc' AS metric, auc AS value FROM pairs UNION ALL SELECT 'average_precision', ap FROM apx
UNION ALL SELECT 'mean_organ_dice', """ + mean_sql('organ_dice') + """ FROM v_case
UNION ALL SELECT 'median_organ_dice', median(organ_dice) FROM v_case
UNION ALL SELECT 'organ_presence', avg(target_present::INT) FROM v_case
UNION ALL SELECT 'mean_lesion_dice', """ + mean_sql('lesion_dice') + """ FROM v_case WHERE label_binary = 1
UNION ALL SELECT 'median_lesion_dice', median(lesion_dice) FROM v_case WHERE label_binary = 1
UNION ALL SELECT 'lesion_presence', avg(target_present::INT) FROM v_case WHERE label_binary = 1
UNION ALL SELECT 'locked_threshold', 0.9::DOUBLE
UNION ALL SELECT 'lesion_sensitivity', (SELECT count(*) FROM truth WHERE tp AND candidate_score >= 0.9::DOUBLE)::DOUBLE / n_refs FROM sizes
UNION ALL SELECT 'localization_sensitivity', avg(lesion_localized::INT) FROM v_case WHERE label_binary = 1
UNION ALL SELECT 'fp_per_case', (SELECT count(*) FROM truth WHERE NOT tp AND candidate_score >= 0.9::DOUBLE)::DOUBLE / n_cases FROM sizes
UNION ALL SELECT 'negative_specificity', avg(1 - case_positive::INT) FROM v_case WHERE label_binary = 0
UNION ALL SELECT 'mean_froc_sensitivity', avg(sensitivity) FROM points WHERE target < 8""")
def _(t):
    # both are read many times; kept, they are built once
    cases = cut_lineage(v.v_case(t).select(*sm.CASE_COLUMNS))
    candidates = cut_lineage(v.v_candidate(t).select("study_id", "candidate_score", "reference_distance_mm"))
    one = sm.case_means(cases).drop("cases", "positive_cases", "negative_cases")
    ranks = det.ranking_metrics(cases, score="maximum_candidate_score").drop("positives", "negatives")
    curve = det.froc_from_distances(candidates, det.cohort_sizes(cases))
    froc = det.mean_froc_sensitivity(det.operating_points(curve))
    # the curve already holds the counts at every score: the last row above the lock is the lock
    locked = curve.where(F.col("threshold") >= THRESHOLD).agg(
        F.max("sensitivity").alias("lesion_sensitivity"), F.max("fp_per_case").alias("fp_per_case"))
    medians = [det.median_of(cases, [], "organ_dice", "median_organ_dice"),
               det.median_of(cases.where("label_binary = 1"), [], "lesion_dice", "median_lesion_dice")]
    for extra in (ranks, froc, locked, *medians):  # one row each
        one = one.join(F.broadcast(extra))
    return sm.metric_rows(one.withColumn("locked_threshold", F.lit(THRESHOLD)), SUMMARY_METRICS)


@query("d28_subgroup_table", uses="v_case", doubles="mean_organ_dice mean_lesion_dice localization_sensitivity negative_specificity", sql=f"""
SELECT 'annotation_type=' || annotation_type AS subgroup, count(*) AS cases, count(*) FILTER (WHERE label_binary = 1) AS positive_cases,
 count(*) FILTER (WHERE label_binary = 0) AS negative_cases, {mean_sql('organ_dice')} AS mean_organ_dice,
 {mean_sql('lesion_dice', 'label_binary = 1')} AS mean_lesion_dice,
 avg(lesion_localized::INT) FILTER (WHERE label_binary = 1) AS localization_sensitivity,
 avg(1 - case_positive::INT) FILTER (WHERE label_binary = 0) AS negative_specificity FROM v_case GROUP BY 1""")
def _(t):
    return sm.subgroup_table(v.v_case(t), "annotation_type")


_SRC_DOUBLES = ("auc average_precision mean_organ_dice mean_lesion_dice lesion_presence lesion_sensitivity fp_per_case "
                "negative_specificity mean_froc_sensitivity")


@query("d29_source_separated_table", uses="v_case v_candidate", doubles=_SRC_DOUBLES, sql="""
, cs AS (SELECT * REPLACE (CASE WHEN source_group = 'P' THEN 0 ELSE label_binary END AS label_binary) FROM v_case),
cd AS (SELECT c.study_id, source_group, candidate_score, candidate_x, candidate_y, candidate_z, shipped,
  CASE WHEN cs.label_binary = 1 THEN reference_distance_mm END AS d FROM v_candidate c JOIN cs USING (study_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY candidate_score DESC, candidate_x, candidate_y, candidate_z, shipped, d) AS k FROM cd),
tr AS (SELECT *, coalesce(d <= 5 AND k = min(CASE WHEN d <= 5 THEN k END) OVER (PARTITION BY study_id), FALSE) AS tp FROM r),
sz AS (SELECT source_group, count(*) AS n, sum(label_binary) AS p FROM cs GROUP BY 1),
cu AS (SELECT DISTINCT source_group, candidate_score AS s, sum(tp::INT) OVER w AS tp, sum(1 - tp::INT) OVER w AS fp FROM tr
  WINDOW w AS (PARTITION BY source_group ORDER BY candidate_score DESC)),
cv AS (SELECT source_group, tp::DOUBLE / p AS se, fp::DOUBLE / n AS f FROM (SELECT source_group, tp, fp FROM cu
  UNION ALL SELECT source_group, 0, 0 FROM sz) JOIN sz USING (source_group)),
fr AS (SELECT source_group, avg(m) AS froc FROM (SELECT source_group, x, max(se) AS m FROM cv, (SELECT unnest([0.25,0.5,1,2,4]::DOUBLE[]) AS x)
  WHERE f <= x + 1e-12::DOUBLE GROUP BY 1, 2) GROUP BY 1),
g AS (SELECT source_group, maximum_candidate_score AS s, sum(label_binary) AS p, sum(1 - label_binary) AS q FROM cs GROUP BY 1, 2),
w2 AS (SELECT *, sum(p) OVER o AS tp, sum(q) OVER o AS fp, sum(p) OVER (PARTITION BY source_group) AS pp,
  sum(q) OVER (PARTITION BY source_group) AS qq FROM g WINDOW o AS (PARTITION BY source_group ORDER BY s DESC)),
rk AS (SELECT source_group, CASE WHEN max(pp) > 0 AND max(qq) > 0 THEN sum(q * (tp - p / 2.0::DOUBLE)) / (max(pp)::DOUBLE * max(qq)::DOUBLE) END AS auc,
  CASE WHEN max(pp) > 0 THEN sum(p::DOUBLE * tp::DOUBLE / (tp + fp)::DOUBLE) / max(pp) END AS ap FROM w2 GROUP BY 1)
SELECT cs.source_group, count(*) AS cases, count(*) FILTER (WHERE label_binary = 1) AS positive_cases,
 count(*) FILTER (WHERE label_binary = 0) AS negative_cases, any_value(auc) AS auc, any_value(ap) AS average_precision,
 """ + mean_sql('organ_dice') + """ AS mean_organ_dice, """ + mean_sql('lesion_dice', 'label_binary = 1') + """ AS mean_lesion_dice,
 avg(target_present::INT) FILTER (WHERE label_binary = 1) AS lesion_presence,
 (SELECT count(*) FROM tr WHERE tp AND candidate_score >= 0.9::DOUBLE AND tr.source_group = cs.source_group)::DOUBLE
  / nullif(sum(label_binary), 0) AS lesion_sensitivity,
 (SELECT count(*) FROM tr WHERE NOT tp AND candidate_score >= 0.9::DOUBLE AND tr.source_group = cs.source_group)::DOUBLE / count(*) AS fp_per_case,
 avg(1 - case_positive::INT) FILTER (WHERE label_binary = 0) AS negative_specificity,
 CASE WHEN sum(label_binary) > 0 THEN any_value(froc) END AS mean_froc_sensitivity
FROM cs JOIN rk USING (source_group) LEFT JOIN fr USING (source_group) GROUP BY 1""")
def _(t):
    # one source is made negative-only, so its positive metrics must come out null
    neg_only = F.col("source_group") == "P"
    cases = v.v_case(t).withColumn("label_binary", F.when(neg_only, 0).otherwise(F.col("label_binary")))
    cases = cut_lineage(cases.select("source_group", *sm.CASE_COLUMNS))
    kept = cases.select("study_id", F.col("label_binary").alias("_y"))
    candidates = cut_lineage(v.v_candidate(t).select("study_id", "candidate_score", "reference_distance_mm").join(kept, "study_id").select(
        "study_id", "candidate_score", F.when(F.col("_y") == 1, F.col("reference_distance_mm")).alias("reference_distance_mm")))
    return sm.source_table(cases, candidates, THRESHOLD)


def _sized(t):
    mm = s.equivalent_diameter(F.col("lesion_voxels"))
    pos = v.v_case(t).where("label_binary = 1").withColumn("diameter_mm", mm).withColumn("size_group", s.size_group(mm))
    return sm.pooled(pos, "source_group", ["F", "O", "P"], "F_O_P")


_SIZED_SQL = """
, d AS (SELECT *, cbrt(lesion_voxels * 3.125::DOUBLE * 6 / pi()) AS mm FROM v_case WHERE label_binary = 1),
sized AS (SELECT *, CASE WHEN mm <= 20 THEN 'small_<=20mm' WHEN mm <= 40 THEN 'medium_>20-40mm' ELSE 'large_>40mm' END AS size_group,
 unnest([source_group, 'F_O_P']) AS cohort FROM d)"""


_SIZED_DRAWS = _SIZED_SQL + f"""
, z AS (SELECT cohort || '|' || size_group AS stratum, study_id, {exact('lesion_dice')} AS ld, {exact('lesion_localized::INT')} AS lo FROM sized)""" + draws_sql(
    "z", "study_id", "stratum", "stratum", "stratum, ld, lo") + f"""
, per AS (SELECT stratum, r, {drawn_mean('ld')} AS d, {drawn_mean('lo')} AS l FROM w GROUP BY 1, 2),
lim AS (SELECT stratum, quantile_cont(d, 0.025) AS d0, quantile_cont(d, 0.975) AS d1, quantile_cont(l, 0.025) AS l0, quantile_cont(l, 0.975) AS l1 FROM per GROUP BY 1)"""


@query("d30_lesion_size_strata", uses="v_case",
       doubles="minimum_mm median_mm maximum_mm mean_lesion_dice mean_lesion_dice_lower mean_lesion_dice_upper localization_sensitivity "
               "localization_sensitivity_lower localization_sensitivity_upper", sql=_SIZED_DRAWS + f"""
SELECT cohort, size_group, count(mm) AS cases, count(*) FILTER (WHERE annotation_type = 'manual') AS manual_cases,
 count(*) FILTER (WHERE annotation_type = 'automatic') AS automatic_cases, min(mm) AS minimum_mm, median(mm) AS median_mm,
 max(mm) AS maximum_mm, {mean_sql('lesion_dice')} AS mean_lesion_dice, any_value(d0) AS mean_lesion_dice_lower, any_value(d1) AS mean_lesion_dice_upper,
 {mean_sql('lesion_localized::INT')} AS localization_sensitivity, any_value(l0) AS localization_sensitivity_lower, any_value(l1) AS localization_sensitivity_upper
FROM (SELECT * FROM (SELECT unnest(['F','O','P','F_O_P']) AS cohort) , (SELECT unnest(['small_<=20mm','medium_>20-40mm','large_>40mm']) AS size_group))
LEFT JOIN sized USING (cohort, size_group) LEFT JOIN lim ON stratum = cohort || '|' || size_group GROUP BY 1, 2""")
def _(t):
    return sm.size_strata(_sized(t), ["F", "O", "P", "F_O_P"])


_MANUAL = ("mean_organ_dice", "od", "organ_dice"), ("mean_lesion_dice", "ld", "lesion_dice"), ("localization_sensitivity", "lo", "lesion_localized::INT")


@query("d31_manual_only_table", uses="v_case", doubles=" ".join(f"{n} {n}_lower {n}_upper" for n, _, _ in _MANUAL), sql="""
, manual AS (SELECT *, unnest([source_group, 'F_O_P']) AS cohort FROM v_case WHERE annotation_type = 'manual' AND label_binary = 1),
z AS (SELECT cohort, study_id, """ + ", ".join(f"{exact(x)} AS {a}" for _, a, x in _MANUAL) + " FROM manual)" + draws_sql(
    "z", "study_id", "cohort", "cohort", "cohort, od, ld, lo") + """
, per AS (SELECT cohort, r, """ + ", ".join(f"{drawn_mean(a)} AS {a}" for _, a, _ in _MANUAL) + """ FROM w GROUP BY 1, 2),
lim AS (SELECT cohort, """ + ", ".join(f"quantile_cont({a}, 0.025) AS {n}_lower, quantile_cont({a}, 0.975) AS {n}_upper" for n, a, _ in _MANUAL) + """ FROM per GROUP BY 1)
SELECT * FROM (SELECT cohort, count(*) AS cases, """ + ", ".join(f"{mean_sql(x)} AS {n}" for n, _, x in _MANUAL) + " FROM manual GROUP BY 1) JOIN lim USING (cohort)")
def _(t):
    manual = v.v_case(t).where("annotation_type = 'manual' AND label_binary = 1")
    return sm.manual_table(sm.pooled(manual, "source_group", ["F", "O", "P"], "F_O_P"))


_ARM_SQL = """
, m AS (SELECT arm, count(*) AS cases, CAST(sum(label_binary) AS BIGINT) AS positive_cases, min(best_epoch) AS best_epoch,
 """ + mean_sql('organ_dice') + """ AS mean_organ_dice, """ + mean_sql('lesion_dice', 'label_binary = 1') + """ AS mean_lesion_dice,
 median(lesion_dice) FILTER (WHERE label_binary = 1) AS median_lesion_dice FROM v_arm_case GROUP BY 1),
h AS (SELECT arm, label_binary AS y, case_score AS s, count(*)::DOUBLE AS n FROM v_arm_case GROUP BY 1, 2, 3),
a AS (SELECT p.arm, sum(p.n * q.n * CASE WHEN p.s > q.s THEN 1 WHEN p.s = q.s THEN 0.5::DOUBLE ELSE 0 END) / sum(p.n * q.n) AS auc
 FROM h p JOIN h q ON p.arm = q.arm AND p.y = 1 AND q.y = 0 GROUP BY 1),
b AS (SELECT arm, sum(pp * tp / seen) / sum(pp) AS average_precision FROM (
 SELECT arm, pp, sum(pp) OVER w AS tp, sum(n) OVER w AS seen FROM (
  SELECT arm, s, sum(n) AS n, sum(n * y) AS pp FROM h GROUP BY 1, 2) WINDOW w AS (PARTITION BY arm ORDER BY s DESC)) GROUP BY 1),
arms AS (SELECT m.*, auc, average_precision, 0.7::DOUBLE * mean_lesion_dice + 0.3::DOUBLE * mean_organ_dice AS selection_score
 FROM m JOIN a USING (arm) JOIN b USING (arm))"""


@query("d32_arm_summary", uses="v_arm_case", doubles="""mean_organ_dice mean_lesion_dice median_lesion_dice auc
 average_precision selection_score""", sql=_ARM_SQL + " SELECT * FROM arms")
def _(t):
    return sm.arm_summary(v.v_arm_case(t))


@query("f8_best_single_row", uses="v_arm_case", doubles="selection_score", sql=_ARM_SQL + """
 SELECT arm, selection_score FROM arms ORDER BY selection_score DESC LIMIT 1""")
def _(t):
    return sm.best_by(sm.arm_summary(v.v_arm_case(t)), "arm", "selection_score")


@query("d33_localiser_error_metrics", doubles="weighted_loss mean_error max_error median_error p90_error p95_error", sql="""
SELECT l_returnflag, sum(l_discount * l_quantity) / sum(l_quantity) AS weighted_loss, avg(l_extendedprice) AS mean_error,
 max(l_extendedprice) AS max_error, quantile_cont(l_extendedprice, 0.5) AS median_error,
 quantile_cont(l_extendedprice, 0.9) AS p90_error, quantile_cont(l_extendedprice, 0.95) AS p95_error FROM lineitem GROUP BY 1""")
def _(t):
    return sm.error_metrics(t("lineitem"), ["l_returnflag"], "l_extendedprice", "l_discount", "l_quantity")


@query("d39_run_totals", doubles="gib", sql="""
SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, sum(strlen(text)) / 1073741824.0::DOUBLE AS gib,
 count(quality) AS completed, count(*) - count(quality) AS remaining, count(*) FILTER (WHERE toxic = 1) AS errors
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def _(t):
    d = t("documents").select("doc_id", "source", F.octet_length("text").cast("long").alias("size"))
    return d.join(t("labels"), "doc_id", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"),
        (F.sum("size") / float(2 ** 30)).alias("gib"), F.count("quality").alias("completed"),
        F.count_if(F.col("quality").isNull()).alias("remaining"), F.count_if(F.col("toxic") == 1).alias("errors"))


@query("d40_largest_differences", uses="v_arm_case", doubles="organ_difference lesion_difference", sql="""
SELECT max(abs(a.organ_dice - b.organ_dice)) AS organ_difference, max(abs(a.lesion_dice - b.lesion_dice)) AS lesion_difference
FROM v_arm_case a JOIN v_arm_case b USING (study_id) WHERE a.arm = 'pretrained' AND b.arm = 'scratch'""")
def _(t):
    from ..operators.joins import paired_arms

    pairs = paired_arms(v.v_arm_case(t), ["study_id"], ["organ_dice", "lesion_dice"], "pretrained", "scratch")
    return sm.largest_differences(pairs, {
        "organ_difference": ("organ_dice_pretrained", "organ_dice_scratch"),
        "lesion_difference": ("lesion_dice_pretrained", "lesion_dice_scratch")})


# ---- bootstrap ---------------------------------------------------------------------------------

_BOOT_CASES = f""", bc AS (SELECT study_id, label_binary, maximum_candidate_score AS s, {exact('organ_dice')} AS od, {exact('lesion_dice')} AS ld,
 lesion_localized::INT AS lo, case_positive::INT AS cp, target_present::INT AS tpr FROM v_case)"""
_BOOT_MEANS = f""", per AS (SELECT r, {drawn_mean('od')} AS mean_organ_dice, {drawn_mean('ld')} AS mean_lesion_dice,
 sum(w * lo) FILTER (WHERE label_binary = 1) / sum(w) FILTER (WHERE label_binary = 1) AS localization_sensitivity,
 sum(w * (1 - cp)) FILTER (WHERE label_binary = 0) / sum(w) FILTER (WHERE label_binary = 0) AS negative_specificity,
 sum(w * tpr) FILTER (WHERE label_binary = 1) / sum(w) FILTER (WHERE label_binary = 1) AS lesion_presence FROM w GROUP BY 1)"""
_BOOT_RANKS = """, g AS (SELECT r, s, sum(w * label_binary)::DOUBLE AS p, sum(w * (1 - label_binary))::DOUBLE AS q FROM w GROUP BY 1, 2),
ranks AS (SELECT r, sum(q * (tp - p / 2)) / (sum(p) * sum(q)) AS auc, sum(p * tp / (tp + fp)) / sum(p) AS average_precision
 FROM (SELECT *, sum(p) OVER o AS tp, sum(q) OVER o AS fp FROM g WINDOW o AS (PARTITION BY r ORDER BY s DESC)) GROUP BY 1)"""
BOOT_METRICS = ["auc", "average_precision", "mean_organ_dice", "mean_lesion_dice", "localization_sensitivity",
                "negative_specificity", "lesion_presence"]


def _means():
    pos, neg = F.col("label_binary") == 1, F.col("label_binary") == 0
    num = lambda c: F.col(c).cast("long")
    return {"mean_organ_dice": s.billionths(F.col("organ_dice")), "mean_lesion_dice": F.when(pos, s.billionths(F.col("lesion_dice"))),
            "localization_sensitivity": F.when(pos, num("lesion_localized")),
            "negative_specificity": F.when(neg, 1 - num("case_positive")),
            "lesion_presence": F.when(pos, num("target_present"))}


def _replicates(t):
    out = rs.replicate_metrics(v.v_case(t), ["label_binary"], "study_id", _means(), "label_binary", "maximum_candidate_score", REPLICATES)
    return out.withColumns({c: F.col(c) / s.BILLION for c in ("mean_organ_dice", "mean_lesion_dice")})


_BOOT_SQL = _BOOT_CASES + draws_sql("bc", "study_id", "label_binary", "label_binary", "label_binary, s, od, ld, lo, cp, tpr") + _BOOT_MEANS + _BOOT_RANKS


@query("d34_stratified_bootstrap", uses="v_case", doubles=" ".join(BOOT_METRICS), sql=_BOOT_SQL + """
SELECT r AS replicate, mean_organ_dice, mean_lesion_dice, localization_sensitivity, negative_specificity, lesion_presence,
 auc, average_precision FROM per JOIN ranks USING (r)""")
def _(t):
    return _replicates(t)


@query("d38_percentile_interval", uses="v_case", doubles="lower upper", sql=_BOOT_SQL + """
, long AS (UNPIVOT (SELECT r, mean_organ_dice, mean_lesion_dice, localization_sensitivity, negative_specificity, lesion_presence,
 auc, average_precision FROM per JOIN ranks USING (r)) ON COLUMNS(* EXCLUDE r) INTO NAME metric VALUE x)
SELECT metric, quantile_cont(x, 0.025) AS lower, quantile_cont(x, 0.975) AS upper, count(*) AS used FROM long GROUP BY 1""")
def _(t):
    return rs.percentile_intervals(_replicates(t), BOOT_METRICS, strict=True)


_FORMS = (("simple", "w1", "source_group", "source_group"), ("stratified", "w2", "stratum", "stratum"))


@query("d35_source_bootstrap", uses="v_case v_candidate", doubles=" ".join(f"{n} {n}_lower {n}_upper" for n in ("fp_per_case", "mean_organ_dice")), sql=f"""
, f AS (SELECT study_id, count(*) AS fp FROM v_candidate WHERE candidate_score >= 0.9::DOUBLE
        AND coalesce(reference_distance_mm > 5, TRUE) GROUP BY 1),
z AS (SELECT study_id, source_group, source_group || '|' || label_binary AS stratum, {exact('coalesce(fp, 0)')} AS fp, {exact('organ_dice')} AS od
      FROM v_case LEFT JOIN f USING (study_id))""" + "".join(draws_sql("z", "study_id", own, label, "source_group, fp, od", name) for _, name, own, label in _FORMS) + """
, point AS (SELECT source_group, sum(fp)::DOUBLE / count(*) / 1000000000 AS fp_per_case, sum(od)::DOUBLE / count(*) / 1000000000 AS mean_organ_dice FROM z GROUP BY 1),
per AS (""" + " UNION ALL ".join(f"SELECT '{form}' AS form, source_group, r, {drawn_mean('fp')} AS f, {drawn_mean('od')} AS o FROM {name} GROUP BY 2, 3" for form, name, _, _ in _FORMS) + """),
lim AS (SELECT form, source_group, quantile_cont(f, 0.025) AS fp_per_case_lower, quantile_cont(f, 0.975) AS fp_per_case_upper,
 quantile_cont(o, 0.025) AS mean_organ_dice_lower, quantile_cont(o, 0.975) AS mean_organ_dice_upper FROM per GROUP BY 1, 2)
SELECT * FROM lim JOIN point USING (source_group)""")
def _(t):
    """False positives per case and an overlap mean of each source with their intervals: cases
    drawn from the source as a whole, and from its positives and negatives apart."""
    return _source_intervals(t)


def _source_intervals(t):
    from ..operators.joins import count_per_case
    from ..operators.lineage import stacked

    far = F.coalesce(F.col("reference_distance_mm") > 5.0, F.lit(True))
    fp = v.v_candidate(t).where((F.col("candidate_score") >= 0.9) & far)
    cases = cut_lineage(count_per_case(v.v_case(t), fp, "fp").select("study_id", "source_group", "label_binary", "organ_dice", "fp"))
    values = {"fp_per_case": F.col("fp"), "mean_organ_dice": F.col("organ_dice")}
    return stacked({form: rs.mean_intervals(cases, ["source_group"], "study_id", values, REPLICATES, within=within).withColumnsRenamed({f"{n}_mean": n for n in values})
                    for form, within in (("simple", []), ("stratified", ["label_binary"]))}, "form")


@query("d38_percentile_interval_lenient", uses="v_case", doubles="lower upper", sql=f"""
, z AS (SELECT study_id, source_group, {exact('organ_dice')} AS od, CASE WHEN source_group <> 'P' AND label_binary = 1 THEN {exact('lesion_dice')} END AS ld FROM v_case)""" + draws_sql(
    "z", "study_id", "source_group", "source_group", "source_group, od, ld") + f"""
, per AS (SELECT source_group, r, {drawn_mean('od')} AS o, {drawn_mean('ld')} AS l FROM w GROUP BY 1, 2)
SELECT source_group, 'mean_organ_dice' AS metric, quantile_cont(o, 0.025) AS lower, quantile_cont(o, 0.975) AS upper, count(o) AS used FROM per GROUP BY 1
UNION ALL SELECT source_group, 'mean_lesion_dice', quantile_cont(l, 0.025), quantile_cont(l, 0.975), count(l) FROM per GROUP BY 1""")
def _(t):
    """A source read as negative-only has no lesion metric in any replicate: null bounds, none used."""
    cases = v.v_case(t).select("study_id", "source_group", s.billionths(F.col("organ_dice")).alias("od"), F.when(
        (F.col("label_binary") == 1) & (F.col("source_group") != "P"), s.billionths(F.col("lesion_dice"))).alias("ld"))
    per = rs.drawn_means(cases, ["source_group"], "study_id", {"mean_organ_dice": F.col("od"), "mean_lesion_dice": F.col("ld")}, REPLICATES)
    per = per.withColumns({c: F.col(c) / s.BILLION for c in ("mean_organ_dice", "mean_lesion_dice")})
    return rs.percentile_intervals(per, ["mean_organ_dice", "mean_lesion_dice"], ["source_group"])


@query("d36_cluster_bootstrap_difference", uses="v_arm_case", doubles="selection_difference auc_difference", sql=f"""
, pt AS (SELECT DISTINCT patient_id FROM v_arm_case)""" + draws_sql("pt", "patient_id", "", "'all'", "patient_id") + f"""
, ac AS (SELECT patient_id, arm, label_binary, case_score, {exact('organ_dice')} AS od, {exact('lesion_dice')} AS ld FROM v_arm_case),
z AS (SELECT r, arm, ((sum(w * ld) FILTER (WHERE label_binary = 1))::DOUBLE / sum(w) FILTER (WHERE label_binary = 1) / 1000000000) * 0.7::DOUBLE
  + (sum(w * od)::DOUBLE / sum(w) / 1000000000) * 0.3::DOUBLE AS sel FROM w JOIN ac USING (patient_id) GROUP BY 1, 2),
g AS (SELECT r, arm, case_score AS s, sum(w * label_binary)::DOUBLE AS p, sum(w * (1 - label_binary))::DOUBLE AS q
 FROM w JOIN ac USING (patient_id) GROUP BY 1, 2, 3),
u AS (SELECT r, arm, sum(q * (tp - p / 2)) / (sum(p) * sum(q)) AS auc
 FROM (SELECT *, sum(p) OVER (PARTITION BY r, arm ORDER BY s DESC) AS tp FROM g) GROUP BY 1, 2)
SELECT r AS replicate, max(sel) FILTER (WHERE arm = 'pretrained') - max(sel) FILTER (WHERE arm = 'scratch') AS selection_difference,
 max(auc) FILTER (WHERE arm = 'pretrained') - max(auc) FILTER (WHERE arm = 'scratch') AS auc_difference
FROM z JOIN u USING (r, arm) GROUP BY 1""")
def _(t):
    from ..operators.joins import paired_arms
    from .joins import PAIR_KEYS

    pairs = paired_arms(v.v_arm_case(t), PAIR_KEYS, ["organ_dice", "lesion_dice", "case_score"], "pretrained", "scratch")
    return rs.cluster_differences(pairs, "patient_id", "pretrained", "scratch", "lesion_dice", "organ_dice",
                                  "case_score", replicates=REPLICATES)


@query("d37_mean_bootstrap", uses="v_case", doubles="mean lower upper", sql=_SIZED_SQL + f"""
, k0 AS (SELECT study_id, cohort || '/' || size_group AS stratum, {exact('lesion_dice')} AS ld FROM sized)""" + draws_sql(
    "k0", "study_id", "stratum", "stratum", "stratum, ld") + f"""
, per AS (SELECT stratum, r, {drawn_mean('ld')} AS m FROM w GROUP BY 1, 2)
SELECT stratum, mean, lower, upper FROM (SELECT stratum, sum(ld)::DOUBLE / count(ld) / 1000000000 AS mean FROM k0 GROUP BY 1) JOIN
 (SELECT stratum, quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper FROM per GROUP BY 1) USING (stratum)""")
def _(t):
    rows = _sized(t).select(F.concat_ws("/", "cohort", "size_group").alias("stratum"), "study_id", "lesion_dice")
    return rs.mean_interval(rows, ["stratum"], "study_id", "lesion_dice", REPLICATES)
