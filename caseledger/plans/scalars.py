"""Projection and scalar-function queries (B, K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import constants as k, parsing as p, scalars as s
from ..operators import contracts
from . import views as v
from .registry import query


@query("b1_clean_id", sql="""
SELECT o_orderkey, regexp_replace(trim(CASE WHEN o_orderkey % 2 = 0 THEN '  00' || o_orderkey || '.0 '
  ELSE o_orderkey || ' ' END), '\\.0$', '') AS study_id FROM orders""")
def _(t):
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("  00"), "o_orderkey", F.lit(".0 "))).otherwise(
        F.concat("o_orderkey", F.lit(" ")))
    return t("orders").select("o_orderkey", p.clean_id(raw).alias("study_id"))


WORDS = ["TRUE", " yes ", "1", "Pass", "complete", "COMPLETED", "no", "0", "2"]
_WORD_SQL = "list_extract(['TRUE',' yes ','1','Pass','complete','COMPLETED','no','0','2'], CAST(event_id % 10 AS BIGINT) + 1)"


@query("b2_parse_flag", sql=f"""
SELECT event_id, coalesce(lower(trim({_WORD_SQL})) IN ('true','1','yes'), FALSE) AS flag,
 coalesce(lower(trim({_WORD_SQL})) IN ('true','1','yes','pass','complete','completed'), FALSE) AS status_flag FROM events""")
def _(t):
    # every tenth word is missing
    word = F.get(F.array(*[F.lit(w) for w in WORDS]), (F.col("event_id") % 10).cast("int"))
    return t("events").select("event_id", p.parse_flag(word).alias("flag"),
                              p.parse_flag(word, k.TRUE_STATUS_WORDS).alias("status_flag"))


@query("b3_normalize_text", sql="""
SELECT p_partkey, replace(lower(trim('  ' || replace(p_type || ' ' || p_name, ' ', '_') || ' ')), '_', '-') AS text
FROM part""")
def _(t):
    raw = F.concat(F.lit("  "), F.translate(F.concat_ws(" ", "p_type", "p_name"), " ", "_"), F.lit(" "))
    return t("part").select("p_partkey", p.normalize_text(raw).alias("text"))


@query("b4_decode_label", uses="v_cohort", sql="""
SELECT study_id, diagnostic_label AS label, label_binary FROM v_cohort""")
def _(t):
    raw = F.when(F.col("label_binary") == 1, F.element_at(F.array(*[F.lit(x) for x in (" LESION", "1.0", "true")]),
                                                          (F.col("study_id").cast("int") % 3 + 1)))
    raw = F.coalesce(raw, F.element_at(F.array(*[F.lit(x) for x in ("Non_Lesion", "0", "false ")]),
                                       (F.col("study_id").cast("int") % 3 + 1)))
    d = p.decode_label(raw, ("lesion", "1", "1.0", "true"), ("non-lesion", "0", "0.0", "false"),
                       ("lesion", "non-lesion"))
    return v.v_cohort(t).select("study_id", d.alias("_d")).select(
        "study_id", F.col("_d.label").alias("label"), F.col("_d.binary").alias("label_binary"))


@query("b5_decode_vector", uses="v_box", doubles="cx cy cz", sql="SELECT study_id, cx, cy, cz FROM v_box")
def _(t):
    return v.v_box(t).select("study_id", p.decode_vector(p.encode_json(F.col("center"))).alias("c")).select(
        "study_id", *[F.col("c")[i].alias(n) for i, n in enumerate(("cx", "cy", "cz"))])


@query("b6_decode_matrix", uses="v_box", doubles="trace corner", sql="""
SELECT study_id, sx + sy + sz + 1 AS trace, cx AS corner FROM v_box""")
def _(t):
    sp, c = F.col("spacing"), F.col("center")
    zero = F.lit(0.0)
    m = F.array(F.array(sp[0], zero, zero, c[0]), F.array(zero, sp[1], zero, c[1]),
                F.array(zero, zero, sp[2], c[2]), F.array(zero, zero, zero, F.lit(1.0)))
    d = v.v_box(t).select("study_id", p.decode_matrix(p.encode_json(m)).alias("m"))
    return d.select("study_id", (F.col("m")[0][0] + F.col("m")[1][1] + F.col("m")[2][2] + F.col("m")[3][3])
                    .alias("trace"), F.col("m")[0][3].alias("corner"))


@query("b7_decode_box", uses="v_box", doubles="width depth", sql="""
SELECT study_id, x1 - x0 AS width, z1 - z0 AS depth FROM v_box""")
def _(t):
    text = F.to_json(F.struct(F.col("box_min").alias("minimum"), F.col("box_max").alias("maximum")))
    return v.v_box(t).select("study_id", p.decode_box(text).alias("b")).select(
        "study_id", (F.col("b.maximum")[0] - F.col("b.minimum")[0]).alias("width"),
        (F.col("b.maximum")[2] - F.col("b.minimum")[2]).alias("depth"))


@query("b8_encode_vector", uses="v_box", sql="""
SELECT study_id, '[' || nx || ',' || ny || ',' || nz || ']' AS shape_json,
 '[[' || nx || ',' || ny || '],[' || nz || ',1]]' AS matrix_json FROM v_box""")
def _(t):
    n = F.col("shape")
    return v.v_box(t).select("study_id", p.encode_json(n).alias("shape_json"), p.encode_json(
        F.array(F.array(n[0], n[1]), F.array(n[2], F.lit(1)))).alias("matrix_json"))


@query("b9_first_present_column", sql="""
SELECT c_custkey, c_mktsegment AS annotation_type FROM customer""")
def _(t):
    c = t("customer")
    return c.select("c_custkey", p.first_present(c, ["annotation_type", "c_mktsegment", "c_name"]).alias("annotation_type"))


@query("b10_required_columns", sql="""
SELECT 'c_acctbal' AS checked_column, count(c_acctbal) AS present_rows, TRUE AS present FROM customer
UNION ALL SELECT 'c_label', 0, FALSE""")
def _(t):
    c = contracts.require_columns(t("customer"), ["c_custkey", "c_acctbal"])
    absent = contracts.missing_columns(c, ["c_acctbal", "c_label"])
    rows = [c.agg(F.lit(n).alias("checked_column"),
                  (F.count(n) if n not in absent else F.count(F.lit(1)) * 0).cast("long").alias("present_rows"))
            .withColumn("present", F.lit(n not in absent)) for n in ("c_acctbal", "c_label")]
    return rows[0].unionByName(rows[1])


@query("b11_partition_predicates", uses="v_cohort", sql="""
SELECT study_id, source_group, label_binary FROM v_cohort
WHERE locked_partition = 'test' AND source_group IN ('F','O')""")
def _(t):
    return v.v_cohort(t).where((F.col("locked_partition") == "test") & F.col("source_group").isin("F", "O")).select(
        "study_id", "source_group", "label_binary")


@query("b12_window_intensity", uses="v_volume", sql="""
SELECT study_id, x, y, z, CAST(round_even(least(greatest(ct * 1.5::DOUBLE + 10, -200), 300), 0) AS INT) AS hu FROM v_volume""")
def _(t):
    return v.v_volume(t).select("study_id", "x", "y", "z",
                                s.window_intensity(F.col("ct"), 1.5, 10.0).cast("int").alias("hu"))


@query("b13_normalize_intensity", uses="v_volume", doubles="unit", sql="""
SELECT study_id, x, y, z, least(greatest((ct - 50) / 250, -1), 1) AS unit FROM v_volume""")
def _(t):
    return v.v_volume(t).select("study_id", "x", "y", "z", s.normalize_intensity(F.col("ct")).alias("unit"))


@query("b14_quantize_probability", uses="v_volume", doubles="largest_error", sql="""
SELECT study_id, CAST(sum(round_even(p_lesion * 65535, 0)) AS BIGINT) AS level_sum,
 max(abs(p_lesion - round_even(p_lesion * 65535, 0)::DOUBLE / 65535)) AS largest_error,
 TRUE AS within_bound FROM v_volume GROUP BY 1""")
def _(t):
    q = s.quantize_probability(F.col("p_lesion"))
    d = v.v_volume(t).select("study_id", "p_lesion", q.alias("q"))
    err = F.abs(F.col("p_lesion") - s.dequantize_probability(F.col("q")))
    return d.groupBy("study_id").agg(F.sum("q").alias("level_sum"), F.max(err).alias("largest_error")).withColumn(
        "within_bound", F.col("largest_error") <= 1.0 / k.PROBABILITY_LEVELS + 1e-7)


@query("b15_tolerance_comparison", uses="v_box", sql="""
SELECT study_id, abs(cx - cx * 1.0001::DOUBLE) <= 1e-4::DOUBLE + 1e-3::DOUBLE * abs(cx * 1.0001::DOUBLE) AS close_one,
 abs(cx - x0) <= 1 + 0.5::DOUBLE * abs(x0) AND abs(cy - y0) <= 1 + 0.5::DOUBLE * abs(y0)
  AND abs(cz - z0) <= 1 + 0.5::DOUBLE * abs(z0) AS close_all FROM v_box""")
def _(t):
    c = F.col("center")
    return v.v_box(t).select("study_id", s.is_close(c[0], c[0] * 1.0001, 1e-3, 1e-4).alias("close_one"),
                             s.all_close(c, F.col("box_min"), 0.5, 1.0).alias("close_all"))


@query("b16_label_value_check", uses="v_volume", sql="""
SELECT study_id, TRUE AS labels_ok, bool_and(abs(ct / 50 - round_even(ct / 50, 0)::DOUBLE) <= 1e-6::DOUBLE
  AND round_even(ct / 50, 0) BETWEEN 0 AND 6) AS intensities_ok FROM v_volume GROUP BY 1""")
def _(t):
    return v.v_volume(t).groupBy("study_id").agg(
        F.bool_and(s.is_label_value(F.col("label").cast("double") + 5e-7)).alias("labels_ok"),
        F.bool_and(s.is_label_value(F.col("ct") / 50.0)).alias("intensities_ok"))


@query("b17_equivalent_diameter", uses="v_case", doubles="diameter_mm", sql="""
SELECT study_id, cbrt(lesion_voxels * 3.125::DOUBLE * 6 / pi()) AS diameter_mm FROM v_case WHERE label_binary = 1""")
def _(t):
    return v.v_case(t).where("label_binary = 1").select(
        "study_id", s.equivalent_diameter(F.col("lesion_voxels")).alias("diameter_mm"))


@query("b18_size_group", sql="""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <= 20 THEN 'small_<=20mm'
 WHEN l_quantity <= 40 THEN 'medium_>20-40mm' ELSE 'large_>40mm' END AS size_group FROM lineitem""")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey",
                                s.size_group(F.col("l_quantity")).alias("size_group"))


@query("b19_stable_rank_key", sql="""
SELECT o_orderkey, sha256('20260728|validation|' || o_orderkey) AS rank_key FROM orders""")
def _(t):
    return t("orders").select("o_orderkey", s.stable_rank(k.SEED, "validation", F.col("o_orderkey")).alias("rank_key"))


@query("b20_stable_integer", sql="""
, d AS (SELECT c_custkey, sha256('20260728|patch|7|' || c_custkey) AS h FROM customer)
SELECT c_custkey, CAST(('0x' || h[7:8] || h[5:6] || h[3:4] || h[1:2]) AS BIGINT) AS seed FROM d""")
def _(t):
    return t("customer").select("c_custkey", s.stable_integer(
        F.lit(k.SEED), F.lit("patch"), F.lit(7), F.col("c_custkey")).alias("seed"))


@query("b21_record_signature", sql="""
SELECT p_partkey, sha256('{"brand":"' || p_brand || '","margin_mm":20.0,"size":' || p_size || '}') AS signature FROM part""")
def _(t):
    return t("part").select("p_partkey", s.record_signature(
        {"size": F.col("p_size"), "margin_mm": F.lit(20.0), "brand": F.col("p_brand")}).alias("signature"))


@query("b22_geometry_status", uses="v_box", sql="""
SELECT study_id, CASE WHEN sx = sy AND sy = sz THEN 'EXACT' WHEN abs(sx - sy) <= 0.25 THEN 'WITHIN_TOLERANCE'
 WHEN k % 10 = 3 THEN 'REVIEWED_EXCEPTION' WHEN annotation_type = 'automatic' THEN 'AUTOMATIC_LABEL_EXCEPTION'
 ELSE 'REVIEW_REQUIRED' END AS geometry_status FROM v_box""")
def _(t):
    b = v.v_box(t)
    reviewed = b.select("study_id").where(F.col("study_id").cast("int") % 10 == 3).withColumn("reviewed", F.lit(True))
    sp = F.col("spacing")
    return b.join(reviewed, "study_id", "left").select("study_id", s.geometry_status(
        (sp[0] == sp[1]) & (sp[1] == sp[2]), F.abs(sp[0] - sp[1]) <= 0.25,
        F.coalesce("reviewed", F.lit(False)), F.col("annotation_type") == "automatic").alias("geometry_status"))


@query("b23_reliability_weight", uses="v_cohort", doubles="weight", sql="""
SELECT study_id, CASE WHEN label_binary = 1 AND annotation_type = 'automatic' THEN 0.5 ELSE 1.0 END AS weight FROM v_cohort""")
def _(t):
    return v.v_cohort(t).select("study_id", s.reliability_weight(
        F.col("label_binary") == 1, F.col("annotation_type")).alias("weight"))


@query("b24_range_checks", uses="v_case", sql="""
SELECT source_group, bool_and(organ_dice BETWEEN 0 AND 1) AS organ_ok,
 bool_and(coalesce(lesion_dice BETWEEN 0.1::DOUBLE AND 1, FALSE)) AS lesion_ok FROM v_case GROUP BY 1""")
def _(t):
    return v.v_case(t).groupBy("source_group").agg(
        F.bool_and(s.finite_in(F.col("organ_dice"), 0.0, 1.0)).alias("organ_ok"),
        F.bool_and(s.finite_in(F.col("lesion_dice"), 0.1, 1.0)).alias("lesion_ok"))


@query("b25_display_format", uses="v_case", sql="""
SELECT study_id, coalesce(printf('%.3f (%.3f-%.3f)', lesion_dice, lesion_dice / 2, lesion_dice), 'NA') AS interval_text,
 coalesce(printf('%.3f', lesion_dice), 'NA') AS number_text, coalesce(printf('%.1f%%', lesion_dice * 100), 'NA') AS percent_text
FROM (SELECT study_id, CASE WHEN lesion_dice < 0.9::DOUBLE THEN lesion_dice + 0.0001::DOUBLE END AS lesion_dice FROM v_case)""")
def _(t):
    # kept off the halfway points, where Java and C printing differ
    d = F.when(F.col("lesion_dice") < 0.9, F.col("lesion_dice") + 0.0001)
    return v.v_case(t).select("study_id", d.alias("d")).select(
        "study_id", p.interval_text(F.col("d"), F.col("d") / 2.0, F.col("d")).alias("interval_text"),
        p.number_text(F.col("d")).alias("number_text"), p.percent_text(F.col("d")).alias("percent_text"))


@query("b26_default_before_gate", uses="v_case", doubles="gate_value", sql="""
SELECT study_id, coalesce(lesion_dice, -1) AS gate_value, coalesce(lesion_dice >= 0.3::DOUBLE, FALSE) AS gate_pass FROM v_case""")
def _(t):
    return v.v_case(t).select("study_id", F.coalesce("lesion_dice", F.lit(-1.0)).alias("gate_value"),
                              F.coalesce(F.col("lesion_dice") >= 0.3, F.lit(False)).alias("gate_pass"))


@query("b27_voxel_to_mm", uses=("v_cohort v_candidate"), doubles="x_mm y_mm z_mm", sql="""
SELECT study_id, candidate_x * 1.25 AS x_mm, candidate_y * 1.25 AS y_mm, candidate_z * 2.0 AS z_mm FROM v_candidate""")
def _(t):
    mm = s.voxel_to_mm([F.col(f"candidate_{a}") for a in "xyz"], k.SPACING_MM)
    return v.v_candidate(t).select("study_id", *[c.alias(f"{a}_mm") for a, c in zip("xyz", mm)])


@query("k1_map_column_function", uses="v_case", sql="""
SELECT source_group, CASE WHEN cbrt(lesion_voxels * 3.125::DOUBLE * 6 / pi()) <= 20 THEN 'small_<=20mm'
 WHEN cbrt(lesion_voxels * 3.125::DOUBLE * 6 / pi()) <= 40 THEN 'medium_>20-40mm' ELSE 'large_>40mm' END AS size_group,
 count(*) AS cases FROM v_case GROUP BY 1, 2""")
def _(t):
    """A column function applied to a whole column, then counted: no Python per row."""
    group = s.size_group(s.equivalent_diameter(F.col("lesion_voxels")))
    return v.v_case(t).groupBy("source_group", group.alias("size_group")).agg(F.count(F.lit(1)).alias("cases"))


@query("k2_row_check_function", uses="v_case", sql="""
SELECT study_id, organ_dice BETWEEN 0 AND 1 AND (label_binary = 1) = (lesion_dice IS NOT NULL)
 AND (label_binary = 1 OR lesion_voxels = 0) AS row_ok,
 CASE WHEN label_binary = 1 AND lesion_voxels = 0 THEN 'positive_without_lesion'
      WHEN NOT target_present THEN 'target_absent' ELSE 'pass' END AS row_note FROM v_case""")
def _(t):
    """Several checks per ledger row as one projection."""
    pos = F.col("label_binary") == 1
    checks = {"organ": s.finite_in(F.col("organ_dice"), 0.0, 1.0),
              "lesion": pos == F.col("lesion_dice").isNotNull(), "voxels": pos | (F.col("lesion_voxels") == 0)}
    note = (F.when(pos & (F.col("lesion_voxels") == 0), "positive_without_lesion")
            .when(~F.col("target_present"), "target_absent").otherwise("pass"))
    return v.v_case(t).select("study_id", s.all_true(checks).alias("row_ok"), note.alias("row_note"))
