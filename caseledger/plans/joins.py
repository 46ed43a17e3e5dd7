"""Join and set queries (C, G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts as ct, joins as j
from . import views as v
from .registry import query


@query("c1_one_to_one_join", uses="v_case", sql="""
SELECT study_id, patient_id, organ_dice, target_present FROM v_case""", doubles="organ_dice")
def _(t):
    metrics = v.v_case(t).select("study_id", "organ_dice", "target_present")
    return j.one_to_one(v.v_cohort(t).select("study_id", "patient_id"), metrics, ["study_id"])


@query("c1_cardinality_report", sql="""
, a AS (SELECT o_custkey AS id FROM orders), b AS (SELECT c_custkey AS id FROM customer)
SELECT (SELECT count(*) FROM a) AS left_rows, (SELECT count(DISTINCT id) FROM a) AS left_keys,
 (SELECT count(*) FROM b) AS right_rows, (SELECT count(DISTINCT id) FROM b) AS right_keys,
 (SELECT count(DISTINCT id) FROM a WHERE id IN (SELECT id FROM b)) AS shared_keys, FALSE AS one_to_one""")
def _(t):
    return j.cardinality_report(t("orders").select(F.col("o_custkey").alias("id")),
                                t("customer").select(F.col("c_custkey").alias("id")), ["id"])


@query("c2_many_to_one_lookup", sql="""
SELECT p_partkey, n_name AS archive_name, n_regionkey AS record_id FROM part
LEFT JOIN nation ON n_nationkey = p_partkey % 27""")
def _(t):
    member = t("part").select("p_partkey", (F.col("p_partkey") % 27).cast("int").alias("batch"))
    source = t("nation").select(F.col("n_nationkey").alias("batch"), F.col("n_name").alias("archive_name"),
                                F.col("n_regionkey").alias("record_id"))
    return j.lookup(member, source, ["batch"]).drop("batch")


@query("c3_left_enrichment", uses="v_ledger", doubles="score", sql="""
, last AS (SELECT study_id, score FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY completed_at DESC, seq DESC) AS r
  FROM v_ledger) WHERE r = 1)
SELECT m.study_id, score FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) || '/purchase' AS study_id FROM events) m
LEFT JOIN last USING (study_id)""")
def _(t):
    manifest = t("events").select(F.concat(F.col("user_id").cast("string"), F.lit("/purchase")).alias("study_id")).distinct()
    return j.enrich_missing(manifest, v.v_ledger(t), ["study_id"], "score", ["completed_at", "seq"])


@query("c4_full_outer_comparison", uses="v_case", doubles="organ_dice_internal organ_dice_external", sql="""
, a AS (SELECT patient_id, avg(organ_dice) AS d FROM v_case WHERE source_group = 'F' GROUP BY 1),
b AS (SELECT patient_id, avg(organ_dice) AS d FROM v_case WHERE source_group = 'P' GROUP BY 1)
SELECT patient_id, a.d AS organ_dice_internal, b.d AS organ_dice_external FROM a FULL JOIN b USING (patient_id)""")
def _(t):
    def mean(source):
        return v.v_case(t).where(F.col("source_group") == source).groupBy("patient_id").agg(
            F.avg("organ_dice").alias("organ_dice"))
    return j.compare_outer(mean("F"), mean("P"), ["patient_id"], ("_internal", "_external"))


@query("c5_semi_join_ids", uses="v_cohort v_candidate", doubles="candidate_score", sql="""
SELECT study_id, candidate_score, candidate_x FROM v_candidate
WHERE study_id IN (SELECT study_id FROM v_cohort WHERE locked_partition = 'validation')""")
def _(t):
    ids = v.v_cohort(t).where("locked_partition = 'validation'")
    return j.only_ids(v.v_candidate(t), ids).select("study_id", "candidate_score", "candidate_x")


@query("c6_anti_join_pending", uses="v_cohort", sql="""
SELECT study_id, source_group FROM v_cohort WHERE study_id NOT IN
 (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R')""")
def _(t):
    done = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").cast("string").alias("study_id"))
    return j.pending(v.v_cohort(t).select("study_id", "source_group"), done)


PAIR_KEYS = ["study_id", "patient_id", "diagnostic_label", "label_binary", "annotation_type"]


@query("c7_paired_arms", uses="v_arm_case", doubles="""organ_dice_pretrained organ_dice_scratch organ_dice_difference
 lesion_dice_difference""", sql="""
SELECT a.study_id, a.organ_dice AS organ_dice_pretrained, b.organ_dice AS organ_dice_scratch,
 a.organ_dice - b.organ_dice AS organ_dice_difference, a.lesion_dice - b.lesion_dice AS lesion_dice_difference
FROM v_arm_case a JOIN v_arm_case b USING (study_id, patient_id, diagnostic_label, label_binary, annotation_type)
WHERE a.arm = 'pretrained' AND b.arm = 'scratch'""")
def _(t):
    pairs = j.paired_arms(v.v_arm_case(t), PAIR_KEYS, ["organ_dice", "lesion_dice"], "pretrained", "scratch")
    return pairs.select("study_id", "organ_dice_pretrained", "organ_dice_scratch", "organ_dice_difference",
                        "lesion_dice_difference")


@query("c8_count_with_zero_fill", sql="""
SELECT CAST(c_custkey AS VARCHAR) AS study_id, count(o_orderkey) AS events FROM customer
LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1""")
def _(t):
    cases = t("customer").select(F.col("c_custkey").cast("string").alias("study_id"))
    events = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("study_id"))
    return j.count_per_case(cases, events, "events")


@query("c10_exactly_one_lookup", sql="""
SELECT CAST(p_partkey AS VARCHAR) AS study_id, p_name, p_retailprice FROM part
WHERE p_partkey IN (SELECT l_partkey FROM lineitem)""", doubles="p_retailprice")
def _(t):
    frame = t("part").select(F.col("p_partkey").cast("string").alias("study_id"), "p_name", "p_retailprice")
    ids = t("lineitem").select(F.col("l_partkey").cast("string").alias("study_id"))
    return j.exactly_one(frame, ids)


@query("c14_role_mapping", uses="v_cohort", sql="""
SELECT study_id, CASE source_group WHEN 'F' THEN 'internal_test' WHEN 'O' THEN 'external_mixed' ELSE 'unassigned' END AS role
FROM v_cohort""")
def _(t):
    return v.v_cohort(t).select("study_id", j.map_codes(
        F.col("source_group"), {"F": "internal_test", "O": "external_mixed"}, "unassigned").alias("role"))


@query("c15_identity_check", uses="v_case", sql="""
SELECT source_group, count(*) AS cases, TRUE AS patients_agree, bool_and(patient_id = CAST(CAST(study_id AS BIGINT) % 100 AS VARCHAR))
 AS shuffled_agree FROM v_case GROUP BY 1""")
def _(t):
    a = v.v_cohort(t).select("study_id", "patient_id", "source_group")
    b = v.v_case(t).select("study_id", F.col("patient_id").alias("ledger_patient"))
    wrong = (F.col("study_id").cast("long") % 100).cast("string")
    return a.join(b, "study_id").groupBy("source_group").agg(
        F.count(F.lit(1)).alias("cases"),
        F.bool_and(F.col("patient_id").eqNullSafe(F.col("ledger_patient"))).alias("patients_agree"),
        F.bool_and(F.col("patient_id").eqNullSafe(wrong)).alias("shuffled_agree"))


def _customers_with(t, status):
    return t("orders").where(F.col("o_orderstatus") == status).select(F.col("o_custkey").cast("string").alias("study_id"))


_SETS = """
, a AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_orderstatus = 'P'),
n AS (SELECT (SELECT count(*) FROM a WHERE id IN (SELECT id FROM b)) AS shared,
 (SELECT count(*) FROM a WHERE id NOT IN (SELECT id FROM b)) AS only_left,
 (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM a)) AS only_right)"""


@query("g1_set_equality", sql=_SETS + " SELECT *, only_left + only_right = 0 AS equal_sets FROM n")
def _(t):
    return ct.set_comparison(_customers_with(t, "F"), _customers_with(t, "P")).drop("left_is_subset")


@query("g2_subset_check", sql="""
, a AS (SELECT DISTINCT o_custkey AS id FROM orders), b AS (SELECT c_custkey AS id FROM customer)
SELECT (SELECT count(*) FROM a WHERE id NOT IN (SELECT id FROM b)) AS only_left,
 NOT EXISTS (SELECT 1 FROM a WHERE id NOT IN (SELECT id FROM b)) AS left_is_subset""")
def _(t):
    a = t("orders").select(F.col("o_custkey").alias("study_id"))
    b = t("customer").select(F.col("c_custkey").alias("study_id"))
    return ct.set_comparison(a, b).select("only_left", "left_is_subset")


@query("g3_difference_listing", sql=_SETS + """
 SELECT id AS study_id, 'missing' AS side FROM a WHERE id NOT IN (SELECT id FROM b)
 UNION ALL SELECT id, 'unexpected' FROM b WHERE id NOT IN (SELECT id FROM a)""")
def _(t):
    return ct.difference_listing(_customers_with(t, "F"), _customers_with(t, "P"))


@query("g4_symmetric_key_difference", sql="""
, kv AS (SELECT l_orderkey, list(DISTINCT l_returnflag) AS have FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_sort(list_concat(list_filter(have, lambda e: NOT list_contains(['A','R','X'], e)),
 list_filter(['A','R','X'], lambda e: NOT list_contains(have, e)))), ',') AS difference FROM kv""")
def _(t):
    keys = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("have"))
    return keys.select("l_orderkey", F.array_join(ct.symmetric_keys(
        F.col("have"), F.array(*[F.lit(x) for x in "ARX"])), ",").alias("difference"))


@query("g5_union_by_name", doubles="price", sql="""
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS price, NULL::VARCHAR AS brand FROM orders
UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_retailprice, p_brand FROM part""")
def _(t):
    a = t("orders").select(F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("price"))
    b = t("part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("brand"),
                         F.col("p_retailprice").alias("price"))
    return a.unionByName(b, allowMissingColumns=True)


@query("g6_constant_set_check", sql="""
SELECT min(l_linestatus) AS lowest, max(l_linestatus) AS highest, count(*) FILTER (WHERE l_linestatus IS NULL) AS nulls,
 count(DISTINCT l_linestatus) = 1 AS constant FROM lineitem""")
def _(t):
    return ct.constant_check(t("lineitem"), "l_linestatus")
