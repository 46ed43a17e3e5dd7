"""Summary tables: scopes, strata, subgroups, arms, sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.constants import BOOTSTRAP_REPLICATES, LESION_WEIGHT, ORGAN_WEIGHT, SEED, SIZE_GROUPS
from ..functions.scalars import steady_mean
from ..session import cut_lineage
from . import detection as det
from .ordering import exact_percentiles
from .resample import mean_intervals


def conditional_mean(value: Column, when: Column) -> Column:
    """Mean over the rows where ``when`` holds; null when there are none."""
    return steady_mean(F.when(when, value.cast("double")))


def scoped(df: DataFrame, scopes: dict[str, Column]) -> DataFrame:
    """Each row once per scope it belongs to (scopes may overlap): adds ``scope``.

    The number of scopes is fixed by the caller, so this multiplies rows by a
    small constant; grouping by scope then combines map-side.
    """
    hits = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in scopes.items()]))
    return df.withColumn("scope", F.explode(hits))


def stacked_scopes(df: DataFrame, columns: Sequence[str], measures: dict[str, str]) -> DataFrame:
    """ALL plus one block per grouping column, by GROUPING SETS.

    ``measures`` are SQL aggregate expressions.
    """
    view = df
    aggs = [F.expr(e).alias(n) for n, e in measures.items()]
    sets = view.groupingSets([[], *[[c] for c in columns]], *columns)
    out = sets.agg(*[F.grouping(c).alias(f"_g_{c}") for c in columns], *aggs)
    kind, value = F.lit("ALL"), F.lit("ALL")
    for c in columns:
        kind = F.when(F.col(f"_g_{c}") == 0, F.lit(c)).otherwise(kind)
        value = F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(value)
    return out.select(kind.alias("scope_kind"), value.alias("scope_value"), *measures)


def contingency(df: DataFrame, row: str, column: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``column`` values per ``row``; the value list is given, so no extra pass."""
    return df.groupBy(row).pivot(column, list(values)).count().na.fill(0)


def metric_rows(one_row: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Wide to long: ``(keys, metric, value)``."""
    return one_row.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")).select(
        *keys, "_m.metric", "_m.value")


#: What the summaries of cases read.
CASE_COLUMNS = ("study_id", "label_binary", "organ_dice", "lesion_dice", "target_present", "lesion_localized", "case_positive", "maximum_candidate_score")


def case_means(cases: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Means over all, positive and negative cases; null for an empty class."""
    pos, neg = F.col("label_binary") == 1, F.col("label_binary") == 0
    return cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"), F.sum(pos.cast("long")).alias("positive_cases"),
        F.sum(neg.cast("long")).alias("negative_cases"),
        steady_mean(F.col("organ_dice")).alias("mean_organ_dice"),
        conditional_mean(F.col("lesion_dice"), pos).alias("mean_lesion_dice"),
        steady_mean(F.col("target_present").cast("double")).alias("organ_presence"),
        conditional_mean(F.col("target_present"), pos).alias("lesion_presence"),
        conditional_mean(F.col("lesion_localized"), pos).alias("localization_sensitivity"),
        conditional_mean(~F.col("case_positive"), neg).alias("negative_specificity"))


def subgroup_table(cases: DataFrame, column: str) -> DataFrame:
    """Case means per value of one column."""
    return (case_means(cases, [column]).withColumn("subgroup", F.concat(F.lit(f"{column}="), F.col(column)))
            .drop(column, "organ_presence", "lesion_presence"))


def source_table(cases: DataFrame, candidates: DataFrame, threshold: float) -> DataFrame:
    """All metrics per source; those needing positives are null in a source without any."""
    key = ["source_group"]
    tagged = candidates.join(cases.select("study_id", "source_group"), "study_id")
    ranks = det.ranking_metrics(cases, key, score="maximum_candidate_score").select(
        "source_group", "auc", "average_precision")
    sizes = det.cohort_sizes(cases, key)
    froc = det.mean_froc_sensitivity(
        det.operating_points(det.froc_from_distances(tagged, sizes, keys=key), keys=key), key)
    locked = det.locked_from_distances(candidates, cases, threshold, key).select(
        "source_group", "lesion_sensitivity", "fp_per_case")
    out = case_means(cases, key).join(ranks, key, "left").join(froc, key, "left").join(locked, key, "left")
    return out.select(
        "source_group", "cases", "positive_cases", "negative_cases", "auc", "average_precision", "mean_organ_dice",
        "mean_lesion_dice", "lesion_presence", "lesion_sensitivity", "fp_per_case", "negative_specificity",
        F.when(F.col("positive_cases") > 0, F.col("mean_froc_sensitivity")).alias("mean_froc_sensitivity"))


def pooled(cases: DataFrame, column: str, members: Sequence[str], name: str, out: str = "cohort") -> DataFrame:
    """Each row under its own cohort and, for ``members``, under the pooled cohort too."""
    return cases.where(F.col(column).isin(*members)).withColumn(
        out, F.explode(F.array(F.col(column), F.lit(name))))


def _with_limits(names: dict[str, Column]) -> list[Column]:
    return [F.col(f"{n}_{part}").alias(n if part == "mean" else f"{n}_{part}") for n in names for part in ("mean", "lower", "upper")]


def size_strata(cases: DataFrame, cohorts: Sequence[str], diameter: str = "diameter_mm", group: str = "size_group",
                identity: str = "study_id", replicates: int = BOOTSTRAP_REPLICATES, seed: int = SEED) -> DataFrame:
    """Every cohort x size class, also empty ones: counts, diameters, overlap and sensitivity
    with the limits of their bootstrap intervals (null for a class without cases)."""
    spark = cases.sparkSession
    frame = spark.createDataFrame([(c, g) for c in cohorts for g in SIZE_GROUPS], f"cohort string, {group} string")
    keys = ["cohort", group]
    cases = cut_lineage(cases.select(*keys, identity, "annotation_type", diameter, "lesion_dice", "lesion_localized"))
    stats = cases.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("annotation_type") == "manual").alias("manual_cases"),
        F.count_if(F.col("annotation_type") == "automatic").alias("automatic_cases"),
        F.min(diameter).alias("minimum_mm"), F.max(diameter).alias("maximum_mm"))
    medians = det.median_of(cases, keys, diameter, "median_mm")
    values = {"mean_lesion_dice": F.col("lesion_dice"), "localization_sensitivity": F.col("lesion_localized").cast("double")}
    limits = mean_intervals(cases, keys, identity, values, replicates, seed).select(*keys, *_with_limits(values))
    out = frame.join(stats, keys, "left").join(medians, keys, "left").join(limits, keys, "left")
    counts = ["cases", "manual_cases", "automatic_cases"]
    return out.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in counts else F.col(c) for c in out.columns])


def manual_table(cases: DataFrame, identity: str = "study_id", replicates: int = BOOTSTRAP_REPLICATES, seed: int = SEED) -> DataFrame:
    """Per cohort of manually annotated positive cases: overlaps and sensitivity with the
    limits of their bootstrap intervals."""
    values = {"mean_organ_dice": F.col("organ_dice"), "mean_lesion_dice": F.col("lesion_dice"),
              "localization_sensitivity": F.col("lesion_localized").cast("double")}
    cases = cut_lineage(cases.select("cohort", identity, "organ_dice", "lesion_dice", "lesion_localized"))
    counts = cases.groupBy("cohort").agg(F.count(F.lit(1)).alias("cases"))
    return counts.join(mean_intervals(cases, ["cohort"], identity, values, replicates, seed).select("cohort", *_with_limits(values)), "cohort", "left")


def arm_summary(arms: DataFrame) -> DataFrame:
    """Per arm: overlap, median lesion overlap, ranking metrics and selection score."""
    pos = F.col("label_binary") == 1
    means = arms.groupBy("arm").agg(
        F.count(F.lit(1)).alias("cases"), F.sum(pos.cast("long")).alias("positive_cases"),
        F.min("best_epoch").alias("best_epoch"), steady_mean(F.col("organ_dice")).alias("mean_organ_dice"),
        conditional_mean(F.col("lesion_dice"), pos).alias("mean_lesion_dice"))
    medians = det.median_of(arms.where(pos), ["arm"], "lesion_dice", "median_lesion_dice")
    ranks = det.ranking_metrics(arms, ["arm"], score="case_score").select("arm", "auc", "average_precision")
    return means.join(medians, "arm", "left").join(ranks, "arm", "left").withColumn(
        "selection_score", LESION_WEIGHT * F.col("mean_lesion_dice") + ORGAN_WEIGHT * F.col("mean_organ_dice"))


def best_by(df: DataFrame, name: str, score: str) -> DataFrame:
    """The name with the highest score."""
    return df.agg(F.max_by(name, score).alias(name), F.max(score).alias(score))


def error_metrics(df: DataFrame, keys: Sequence[str], error: str, loss: str, weight: str) -> DataFrame:
    """Weighted mean loss; mean, median, p90, p95 and largest error."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(
        (F.sum(F.col(loss) * F.col(weight)) / F.sum(weight)).alias("weighted_loss"),
        F.avg(error).alias("mean_error"), F.max(error).alias("max_error"))
    tail = exact_percentiles(df, keys, error, [0.5, 0.9, 0.95]).groupBy(*keys).agg(*[
        F.max(F.when(F.col("p") == p, F.col("percentile_value"))).alias(n)
        for p, n in ((0.5, "median_error"), (0.9, "p90_error"), (0.95, "p95_error"))])
    return base.join(tail, keys) if keys else base.join(F.broadcast(tail))


def within_rates(df: DataFrame, value: str, limits: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Fraction of rows at or below each limit."""
    return df.groupBy(*keys).agg(*[
        F.avg((F.col(value) <= x).cast("double")).alias(f"within_{x:g}") for x in limits])


def largest_differences(df: DataFrame, pairs: dict[str, tuple[str, str]]) -> DataFrame:
    return df.agg(*[F.max(F.abs(F.col(a) - F.col(b))).alias(n) for n, (a, b) in pairs.items()])
