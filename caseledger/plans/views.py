"""Adapter views: the driver tables read as cohort, candidate, ledger and voxel tables.

Each view has a SQL twin of the same name in ``viewsql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .registry import Tables

POSITIVE_PRICE = 350000.0


def v_cohort(t: Tables) -> DataFrame:
    o = t("orders")
    positive = F.col("o_totalprice") > POSITIVE_PRICE
    return o.select(
        F.col("o_orderkey").cast("string").alias("study_id"),
        F.col("o_custkey").cast("string").alias("patient_id"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "train")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "validation").otherwise("test").alias("locked_partition"),
        F.col("o_orderstatus").alias("source_group"),
        F.when(positive, "lesion").otherwise("non-lesion").alias("diagnostic_label"),
        F.when(positive, 1).otherwise(0).alias("label_binary"),
        F.when(F.col("o_orderkey") % 2 == 0, "manual").otherwise("automatic").alias("annotation_type"))


def v_candidate(t: Tables) -> DataFrame:
    """Scored candidates with distances; scores have two digits, so ties abound."""
    label = v_cohort(t).select("study_id", "label_binary")
    c = t("lineitem").select(
        F.col("l_orderkey").cast("string").alias("study_id"),
        (F.floor(F.col("l_extendedprice") / 1000.0) / 100.0).alias("candidate_score"),
        F.col("l_partkey").alias("candidate_x"), F.col("l_suppkey").alias("candidate_y"),
        F.col("l_linenumber").cast("long").alias("candidate_z"), "l_quantity",
        F.datediff("l_shipdate", F.lit("1970-01-01")).alias("shipped"))
    return c.join(label, "study_id").select(
        "study_id", "candidate_score", "candidate_x", "candidate_y", "candidate_z", "shipped", "label_binary",
        F.when(F.col("label_binary") == 1, F.col("l_quantity")).alias("reference_distance_mm"))


# a full key: rows equal in all of it are equal in every column used here
V_CANDIDATE_ORDER = (("candidate_score", False), ("candidate_x", True), ("candidate_y", True),
                     ("candidate_z", True), ("shipped", True), ("reference_distance_mm", True))


def v_case(t: Tables) -> DataFrame:
    """Case metrics: two overlap scores, voxel counts and a presence flag per study."""
    per = t("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("study_id")).agg(
        (F.floor(F.sum("l_discount") * 1000.0 + 0.5) / 1000.0).alias("_d"),
        (F.floor(F.sum("l_tax") * 1000.0 + 0.5) / 1000.0).alias("_t"),
        F.sum("l_quantity").cast("long").alias("_q"),
        F.max(F.floor(F.col("l_extendedprice") / 1000.0) / 100.0).alias("maximum_candidate_score"),
        F.min("l_quantity").alias("_closest"))
    pos = F.col("label_binary") == 1
    c = v_cohort(t).join(per, "study_id", "left")
    return c.select(
        "study_id", "patient_id", "locked_partition", "source_group", "diagnostic_label", "label_binary",
        "annotation_type",
        F.coalesce(F.least(F.col("_d"), F.lit(1.0)), F.lit(0.0)).alias("organ_dice"),
        F.when(pos, F.coalesce(F.least(F.col("_t"), F.lit(1.0)), F.lit(0.0))).alias("lesion_dice"),
        F.when(pos, F.coalesce(F.col("_q"), F.lit(0)) * 30).otherwise(F.lit(0)).cast("long").alias("lesion_voxels"),
        F.coalesce("maximum_candidate_score", F.lit(0.0)).alias("maximum_candidate_score"),
        (pos & F.coalesce(F.col("_closest") <= 5.0, F.lit(False))).alias("lesion_localized"),
        F.coalesce(F.col("maximum_candidate_score") >= 0.9, F.lit(False)).alias("case_positive"),
        F.coalesce(F.col("_q") > 20, F.lit(False)).alias("target_present"))


def v_arm_case(t: Tables) -> DataFrame:
    """The same cases scored by two arms, in long form."""
    base = v_case(t).select("study_id", "patient_id", "diagnostic_label", "label_binary", "annotation_type",
                            "organ_dice", "lesion_dice", "maximum_candidate_score")
    arm = F.explode(F.array(
        F.struct(F.lit("pretrained").alias("arm"), F.lit(12).alias("best_epoch"),
                 F.col("organ_dice").alias("organ"), F.col("lesion_dice").alias("lesion"),
                 F.col("maximum_candidate_score").alias("score")),
        F.struct(F.lit("scratch").alias("arm"), F.lit(17).alias("best_epoch"),
                 (F.col("organ_dice") * 0.5).alias("organ"), (F.lit(1.0) - F.col("lesion_dice")).alias("lesion"),
                 F.col("organ_dice").alias("score"))))
    return base.select("study_id", "patient_id", "diagnostic_label", "label_binary", "annotation_type",
                       arm.alias("_a")).select(
        "study_id", "patient_id", "diagnostic_label", "label_binary", "annotation_type", "_a.arm",
        "_a.best_epoch", F.col("_a.organ").alias("organ_dice"), F.col("_a.lesion").alias("lesion_dice"),
        F.col("_a.score").alias("case_score"))


def v_ledger(t: Tables) -> DataFrame:
    """Ledger rows keyed by (user, type); version is time then event id."""
    return t("events").select(
        F.concat_ws("/", F.col("user_id").cast("string"), F.col("event_type")).alias("study_id"),
        F.col("event_type").alias("status"), F.col("value").alias("score"),
        F.col("ts").alias("completed_at"), F.col("event_id").alias("seq"))


def v_history(t: Tables) -> DataFrame:
    """One score per arm and epoch."""
    return t("events").select(F.col("event_type").alias("arm"), F.col("event_id").alias("epoch"),
                              F.col("value").alias("score"), (F.col("event_id") % 3 == 0).alias("validated"))


def v_volume(t: Tables) -> DataFrame:
    """Each 64-vector as a 4x4x4 volume in row-major order, with derived label and probabilities."""
    v = t("embeddings").select(F.col("vec_id").cast("string").alias("study_id"),
                               F.posexplode("embedding").alias("i", "f"))
    x = F.col("f").cast("double")
    return v.select(
        "study_id", F.floor(F.col("i") / 16).cast("int").alias("x"),
        F.floor(F.col("i") / 4).cast("int").bitwiseAND(3).alias("y"), F.col("i").bitwiseAND(3).alias("z"),
        (x * 1000.0).alias("ct"),
        F.when(x > 0.15, 1).when(x > 0.02, 4).otherwise(0).alias("label"),
        F.least(F.greatest(F.lit(0.5) + x * 2.0, F.lit(0.0)), F.lit(1.0)).alias("p_lesion"),
        F.least(F.greatest(F.lit(0.4) - x, F.lit(0.0)), F.lit(1.0)).alias("p_organ"))


def v_tiled(t: Tables) -> DataFrame:
    """All 64-vectors as 4x4x4 tiles of one volume, five by five side by side, layer on layer;
    the last layer need not be full."""
    v = t("embeddings").select("vec_id", F.posexplode("embedding").alias("i", "f"))
    x, n = F.col("f").cast("double"), F.col("vec_id")
    return v.select(
        F.lit("tiled").alias("study_id"), ((n % 5) * 4 + F.floor(F.col("i") / 16)).cast("int").alias("x"),
        ((F.floor(n / 5) % 5) * 4 + F.floor(F.col("i") / 4) % 4).cast("int").alias("y"),
        (F.floor(n / 25) * 4 + F.col("i") % 4).cast("int").alias("z"),
        F.least(F.greatest(F.lit(0.5) + x * 2.0, F.lit(0.0)), F.lit(1.0)).alias("p_lesion"),
        F.least(F.greatest(F.lit(0.4) - x, F.lit(0.0)), F.lit(1.0)).alias("p_organ"))


def v_points(t: Tables) -> DataFrame:
    """Sparse reference voxels in larger volumes."""
    return t("lineitem").select(
        F.col("l_suppkey").cast("string").alias("study_id"), (F.col("l_partkey") % 60).cast("int").alias("x"),
        (F.col("l_orderkey") % 48).cast("int").alias("y"),
        (F.col("l_linenumber") * 4 + F.col("l_orderkey") % 4).cast("int").alias("z")).distinct()


def v_probe(t: Tables) -> DataFrame:
    """Points whose distance to the reference voxels is asked for."""
    return t("orders").select(
        F.col("o_orderkey").alias("probe_id"),
        (F.col("o_orderkey") % 100).cast("string").alias("study_id"),
        (F.col("o_custkey") % 60).cast("int").alias("x"), (F.col("o_orderkey") % 47).cast("int").alias("y"),
        (F.col("o_custkey") % 31).cast("int").alias("z"))


def v_box(t: Tables) -> DataFrame:
    """A centre, a box and a spacing per part, with simple exact numbers."""
    p = F.col("p_partkey")
    return t("part").select(
        p.cast("string").alias("study_id"),
        F.array(*[(p % m).cast("double") * 0.5 + 20.0 for m in (41, 37, 29)]).alias("center"),
        F.array(*[(p % m).cast("double") * 0.25 + 12.0 for m in (23, 31, 19)]).alias("box_min"),
        F.array(*[(p % m).cast("double") * 0.25 + 14.0 + F.col("p_size") for m in (23, 31, 19)]).alias("box_max"),
        F.array(*[(p % m).cast("double") * 0.25 + 0.5 for m in (3, 5, 4)]).alias("spacing"),
        F.array(*[(p % m + 20).cast("int") for m in (50, 60, 70)]).alias("shape"),
        F.element_at(F.array(*[F.lit(c) for c in ("LPS", "RAS", "LPI", "PSL", "SRA")]),
                     (p % 5 + 1).cast("int")).alias("orientation"),
        F.when(p % 3 == 0, "manual").otherwise("automatic").alias("annotation_type"),
        F.when(p % 4 == 0, 1).otherwise(0).alias("label_binary"))


def v_payload(t: Tables) -> DataFrame:
    """Documents as stored files with recorded size and hash; every 97th record is stale."""
    return t("documents").select(
        F.concat(F.lit("/old/root/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"),
                 F.lit(".txt")).alias("path"),
        F.col("doc_id").cast("string").alias("study_id"), F.col("text").cast("binary").alias("content"))
