"""Source, ledger, ordering, streaming and audit queries (A, E5-E9, F, I, J)."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from ..functions import constants as k, parsing as p, scalars as s
from ..functions.scalars import hash32
from ..operators import contracts as ct, detection as det, joins as j, ledger as lg, lineage as ln, resample as rs, sampling as sa
from ..operators import summary as sm
from ..session import cut_lineage, fresh_path
from ..sources import files as fl, tables as tb
from ..streaming import ledgers as st
from . import views as v
from .detect import CURVE_SQL, curve
from .drawsql import REPLICATES, drawn_mean, draws_sql, exact, hash_sql, mean_sql
from .registry import query

VERSION = ["completed_at", "seq"]
_LAST = """, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY completed_at DESC, seq DESC) AS r
 FROM v_ledger) WHERE r = 1)"""


# ---- A: sources and sinks ------------------------------------------------------------------------

@query("a1_typed_csv_scan", sql="""
SELECT CASE WHEN c_custkey % 3 = 0 THEN '000' || c_custkey ELSE c_custkey || '.0' END AS study_id, c_acctbal AS score,
 c_mktsegment AS status FROM customer""", doubles="score")
def _(t):
    """Written as CSV and read back with a declared schema: leading zeros and ``.0`` survive."""
    out = fresh_path(t.spark, "csv")
    raw_id = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("000"), "c_custkey")).otherwise(
        F.concat("c_custkey", F.lit(".0")))
    t("customer").select(raw_id.alias("study_id"), F.col("c_acctbal").alias("score"),
                         F.col("c_mktsegment").alias("status")).write.option("header", True).csv(out)
    schema = T.StructType([T.StructField("study_id", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("status", T.StringType())])
    return tb.typed_csv(t.spark, out, schema)


@query("a2_blind_scan", sql="SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    blind = tb.blind_scan(t("orders"), ["o_orderkey", "o_orderpriority", "o_orderstatus"], ["o_totalprice", "o_custkey"])
    kept = blind.where("o_orderstatus = 'F'").drop("o_orderstatus")
    tb.assert_not_read(kept, ["o_totalprice", "o_custkey"])
    return kept


@query("a3_protocol_gate", uses="v_cohort", sql="SELECT source_group, count(*) AS cases FROM v_cohort GROUP BY 1")
def _(t):
    """The lock record is derived from the cohort, stored as JSON, read back and checked."""
    out = fresh_path(t.spark, "protocol")
    v.v_cohort(t).agg(F.count(F.lit(1)).alias("cases"), F.lit(True).alias("frozen"),
                      F.struct(F.lit(5.0).alias("tolerance_mm")).alias("matching")).coalesce(1).write.json(out)
    lock = tb.read_protocol(t.spark, out, "cases long, frozen boolean, matching struct<tolerance_mm: double>")
    counts = v.v_cohort(t).groupBy("source_group").agg(F.count(F.lit(1)).alias("cases"))
    return tb.gated(counts, lock, F.col("frozen") & (F.col("cases") > 0) & (F.col("matching.tolerance_mm") == 5.0), "freeze")


@query("a4_empty_ledger_scan", uses="v_cohort", sql="SELECT study_id, 'pending' AS state FROM v_cohort")
def _(t):
    """No ledger yet: the typed empty table joins like any other."""
    schema = T.StructType([T.StructField("study_id", T.StringType()), T.StructField("status", T.StringType())])
    ledger = tb.read_or_empty(t.spark, fresh_path(t.spark, "absent"), schema)
    return v.v_cohort(t).select("study_id").join(ledger, "study_id", "left").select(
        "study_id", F.when(F.col("status").isNull(), "pending").otherwise("done").alias("state"))


@query("a5_payload_member_pruning", uses="v_volume", doubles="mean_ct", sql="""
SELECT study_id, count(*) AS voxels, avg(ct) AS mean_ct FROM v_volume GROUP BY 1""")
def _(t):
    """Only the intensity member of the stored volume table is read."""
    out = tb.write_version(v.v_volume(t), fresh_path(t.spark, "volumes"))
    scan = t.spark.read.parquet(out).groupBy("study_id").agg(F.count("ct").alias("voxels"), F.avg("ct").alias("mean_ct"))
    tb.assert_not_read(scan, ["label", "p_lesion", "p_organ"])
    return scan


@query("a6_payload_write_bucketed", uses="v_volume", doubles="ct_sum", sql="""
SELECT study_id, CAST(sum(label) AS BIGINT) AS label_sum, sum(ct) AS ct_sum FROM v_volume GROUP BY 1""")
def _(t):
    """Volumes by hash bucket of the study, metadata beside the voxels, then read back."""
    rows = v.v_volume(t).withColumn("spacing_json", F.lit("[1.25,1.25,2.0]"))
    out = tb.write_volumes(rows, fresh_path(t.spark, "volumes"))
    return t.spark.read.parquet(out).groupBy("study_id").agg(
        F.sum("label").cast("long").alias("label_sum"), F.sum("ct").alias("ct_sum"))


@query("a7_versioned_table_write", sql="""
SELECT source, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1""")
def _(t):
    """A second version replaces the first only when complete; readers see the newest one."""
    base = fresh_path(t.spark, "table")
    full = t("documents").select("doc_id", "source", "n_chars")
    tb.write_version(full.where("n_chars < 0"), base)
    tb.write_version(full, base)
    return t.spark.read.parquet(tb.latest_version(t.spark, base)).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("n_chars").cast("long").alias("chars"))


@query("a8_record_json_write", uses="v_case", sql="""
SELECT '{"study_id":"' || study_id || '","voxels":' || lesion_voxels || ',"ratio":null,"flags":{"present":' ||
 target_present || '}}' AS value FROM v_case""")
def _(t):
    """One JSON record per case; the non-finite ratio is written as null."""
    out = fresh_path(t.spark, "records")
    text = tb.record_json({"study_id": F.col("study_id"), "voxels": F.col("lesion_voxels"),
                           "ratio": F.lit(float("nan")), "flags": F.struct(F.col("target_present").alias("present"))},
                          numbers=["ratio"])
    v.v_case(t).select(text.alias("value")).write.text(out)
    return t.spark.read.text(out)


@query("a9_file_inventory")
def _(t):
    """Files of the table directory against a ledger that expects one absent file."""
    files = fl.list_files(t.spark, t.directory, "*.parquet")
    expected = files.select("file_name").where("file_name <> 'region.parquet'").unionByName(
        files.agg(F.lit("volumes.parquet").alias("file_name")))
    return fl.inventory_against_ledger(files, expected)


@query("a9_payload_inventory", sql="""
SELECT CAST(doc_id AS VARCHAR) AS file_name, 'unexpected' AS state FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'missing' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def _(t):
    name = F.col("doc_id").cast("string").alias("file_name")
    return fl.inventory_against_ledger(t("documents").select(name), t("labels").select(name))


_STALE = "CAST(study_id AS BIGINT) % 97 = 5"


def _manifest(t):
    inv = fl.hashed_payloads(v.v_payload(t))
    stale = F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\."), 1).cast("long") % 97 == 5
    return inv, inv.select("path", F.when(stale, F.col("size_bytes") + 1).otherwise(F.col("size_bytes")).alias("size_bytes"),
                           F.when(stale, F.lit("0")).otherwise(F.col("sha256")).alias("sha256"), "crc32_hex")


@query("a10_content_integrity", uses="v_payload", sql=f"""
SELECT path, TRUE AS exists, NOT ({_STALE}) AS size_matches, NOT ({_STALE}) AS hash_matches FROM v_payload""")
def _(t):
    inv, manifest = _manifest(t)
    return ln.integrity(manifest, inv)


@query("a10_file_hashes")
def _(t):
    """SHA-256 and size of every table file, checked against themselves."""
    inv = cut_lineage(fl.hashed_files(t.spark, t.directory, "*.parquet"))  # both sides read it; files are hashed once
    return ln.integrity(inv.select("path", "size_bytes", "sha256"), inv)


@query("a11_crc_check", sql="""
, b AS (SELECT p_partkey, p_name, list_transform(range(1, strlen(p_name) + 1), lambda i: ascii(p_name[i])::BIGINT) AS bytes FROM part),
c AS (SELECT p_partkey, p_name, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda acc, x:
  list_reduce(list_prepend(xor(acc, x), range(8)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS r FROM b)
SELECT p_partkey, lower(printf('%08x', xor(r, 4294967295::BIGINT))) AS crc32_hex, TRUE AS crc_matches, TRUE AS size_matches FROM c""")
def _(t):
    payload = t("part").select(F.col("p_partkey").alias("path"), F.col("p_name").cast("binary").alias("content"))
    expected = fl.hashed_payloads(payload)
    # the archive lists the checksum in upper case
    listed = expected.select("path", F.upper("crc32_hex").alias("crc32_hex"), "size_bytes")
    return fl.crc_check(payload, listed).join(expected.select("path", "crc32_hex"), "path").withColumnRenamed(
        "path", "p_partkey")


@query("a12_acquisition_plan", sql="""
SELECT p_partkey, n_name AS archive_name, CASE WHEN n_regionkey = 0 THEN 'range://' || n_name
 ELSE 'range://' || n_name || ' whole://' || n_name || '/' || p_partkey END AS endpoints,
 CAST(p_retailprice * 100 AS BIGINT) AS transfer_bytes
FROM part JOIN nation ON n_nationkey = p_partkey % 25""")
def _(t):
    members = t("part").select(
        "p_partkey", (F.col("p_partkey") % 25).cast("int").alias("batch"),
        F.round(F.col("p_retailprice") * 100.0).cast("long").alias("transfer_bytes"))
    sources = t("nation").select(F.col("n_nationkey").alias("batch"), F.col("n_name").alias("archive_name"), "n_regionkey")
    ranged = F.format_string("range://%s", F.col("archive_name"))
    whole = F.when(F.col("n_regionkey") > 0, F.format_string("whole://%s/%s", F.col("archive_name"), F.col("p_partkey")))
    plan = fl.acquisition_plan(members, sources, "batch", [ranged, ranged, whole])
    return plan.select("p_partkey", "archive_name", F.array_join("endpoints", " ").alias("endpoints"), "transfer_bytes")


@query("a13_evidence_manifest", uses="v_payload", sql="""
SELECT row_number() OVER (ORDER BY path) AS evidence_order, path, CASE WHEN split_part(path, '/', 4) = 'web' THEN 'primary' ELSE 'supporting' END AS role,
 CAST(strlen(content) AS BIGINT) AS size_bytes, sha256(content) AS sha256 FROM v_payload""")
def _(t):
    role = F.when(F.element_at(F.split("path", "/"), 4) == "web", "primary").otherwise("supporting")
    return ln.evidence_manifest(fl.hashed_payloads(v.v_payload(t)), role)


@query("e9_evidence_order", sql="""
SELECT row_number() OVER (ORDER BY url, page_id) AS evidence_order, page_id FROM pages""")
def _(t):
    from ..operators.ordering import rank_within

    return rank_within(t("pages").select("url", "page_id"), [], [("url", True), ("page_id", True)],
                       "evidence_order").drop("url")


@query("a14_path_rebase", uses="v_payload", sql="""
SELECT study_id, '/new/place' || path[10:] AS path FROM v_payload""")
def _(t):
    return v.v_payload(t).select("study_id", p.rebase_path(F.col("path"), "/old/root", "/new/place").alias("path"))


@query("a15_cache_population", uses="v_payload", sql=f"""
SELECT count(*) FILTER (WHERE CAST(study_id AS BIGINT) % 3 = 0 AND NOT ({_STALE})) AS reused,
 count(*) FILTER (WHERE NOT (CAST(study_id AS BIGINT) % 3 = 0 AND NOT ({_STALE}))) AS copied,
 CAST(sum(CASE WHEN CAST(study_id AS BIGINT) % 3 = 0 AND NOT ({_STALE}) THEN 0
  WHEN {_STALE} THEN strlen(content) + 1 ELSE strlen(content) END) AS BIGINT) AS missing_bytes FROM v_payload""")
def _(t):
    inv, manifest = _manifest(t)
    number = F.element_at(F.split(F.element_at(F.split("path", "/"), -1), r"\."), 1).cast("long")
    return fl.cache_totals(fl.cache_population(manifest, inv.where(number % 3 == 0)))


# ---- E, F: windows, orders, samples ------------------------------------------------------------

@query("e5_keep_last", uses="v_ledger", doubles="score", sql=_LAST + " SELECT study_id, score, seq FROM last")
def _(t):
    return j.keep_last(v.v_ledger(t), ["study_id"], VERSION).select("study_id", "score", "seq")


@query("e7_best_so_far", uses="v_history", doubles="best_score", sql="""
, h AS (SELECT arm, epoch, score FROM v_history WHERE validated),
f AS (SELECT arm, arg_min(score, epoch) AS score, min(epoch) AS epoch FROM h GROUP BY 1),
chain AS (SELECT arm, epoch, score FROM f UNION ALL
 SELECT arm, epoch, score FROM (SELECT h.arm, h.epoch, h.score, row_number() OVER (PARTITION BY h.arm ORDER BY h.epoch) AS r
  FROM chain c JOIN h ON h.arm = c.arm AND h.epoch > c.epoch AND h.score > c.score + 0.000001::DOUBLE) WHERE r = 1),
b AS (SELECT arm, max(epoch) AS best_epoch, arg_max(score, epoch) AS best_score, count(*) AS improvements FROM chain GROUP BY 1)
SELECT arm, best_epoch, best_score, improvements, count(*) AS checks, count(*) FILTER (WHERE epoch > best_epoch) AS checks_without_improvement
FROM h JOIN b USING (arm) GROUP BY 1, 2, 3, 4""")
def _(t):
    return lg.best_with_stall(v.v_history(t), "validated")


@query("f1_mixed_direction_sort", uses="v_cohort v_candidate", doubles="candidate_score", sql="""
SELECT candidate_score, study_id, candidate_x, candidate_y FROM v_candidate
ORDER BY candidate_score DESC, study_id, candidate_x, candidate_y""")
def _(t):
    return v.v_candidate(t).select("candidate_score", "study_id", "candidate_x", "candidate_y").orderBy(
        F.desc("candidate_score"), "study_id", "candidate_x", "candidate_y")


@query("f2_work_queue", uses="v_payload", sql="""
SELECT study_id, size FROM (SELECT study_id, strlen(content) AS size, CAST(study_id AS BIGINT) % 2 AS automatic FROM v_payload
 WHERE CAST(study_id AS BIGINT) NOT IN (SELECT doc_id FROM labels)) ORDER BY automatic, size, study_id LIMIT 40""")
def _(t):
    done = t("labels").select(F.col("doc_id").cast("string").alias("study_id"))
    todo = j.pending(v.v_payload(t).select("study_id", F.octet_length("content").cast("long").alias("size")), done)
    return sa.work_queue(todo, 40, [F.col("study_id").cast("long") % 2, F.col("size"), F.col("study_id")])


@query("f4_stratified_top_n_by_hash", uses="v_cohort", sql="""
SELECT study_id, label_binary FROM (SELECT study_id, label_binary, row_number() OVER (PARTITION BY label_binary
 ORDER BY sha256('20260728|validation|' || study_id), study_id) AS r FROM v_cohort) WHERE r <= 48""")
def _(t):
    return sa.stratified_by_hash(v.v_cohort(t), "label_binary", 48).select("study_id", "label_binary")


@query("f6_worst_first_failures", uses="v_case", doubles="lesion_dice", sql="""
SELECT study_id, lesion_dice, lesion_voxels FROM v_case WHERE label_binary = 1 AND NOT lesion_localized
ORDER BY lesion_dice, lesion_voxels DESC, study_id""")
def _(t):
    return v.v_case(t).where("label_binary = 1 AND NOT lesion_localized").select(
        "study_id", "lesion_dice", "lesion_voxels").orderBy("lesion_dice", F.desc("lesion_voxels"), "study_id")


@query("f7_class_balanced_epoch", uses="v_cohort", sql=f"""
, pos AS (SELECT study_id, row_number() OVER (ORDER BY {hash_sql("'|' || study_id")}, study_id) - 1 AS i, count(*) OVER () AS n
 FROM v_cohort WHERE label_binary = 1),
slots AS (SELECT s, {hash_sql("'20260728|samples|3|' || s")} AS h FROM (SELECT unnest(range(688)) AS s)),
pick AS (SELECT 'p' || s AS slot, study_id, 1 AS label_binary FROM slots JOIN pos ON i = h % n),
neg AS (SELECT 'n' || study_id AS slot, study_id, 0 AS label_binary FROM v_cohort WHERE label_binary = 0
 ORDER BY {hash_sql("'20260728|samples|3|' || study_id")}, study_id LIMIT 688),
both_ AS (SELECT * FROM pick UNION ALL SELECT * FROM neg)
SELECT slot, study_id, label_binary, row_number() OVER (ORDER BY {hash_sql("'20260728|order|3|' || slot")}, slot) AS slot_order FROM both_""")
def _(t):
    return sa.balanced_epoch(v.v_cohort(t), 3, 688)


# ---- I: incremental -----------------------------------------------------------------------------

@query("i1_validated_resume", uses="v_ledger", sql=_LAST + """
SELECT study_id FROM last WHERE seq % 5 <> 0 AND seq % 7 <> 0 AND seq % 11 <> 0 AND seq % 13 <> 0""")
def _(t):
    last = j.keep_last(v.v_ledger(t), ["study_id"], VERSION)
    inventory = last.select("study_id", F.sha2(F.col("seq").cast("string"), 256).alias("sha256"),
                            F.lit(10).alias("payload_rows"))
    n = F.col("seq")
    ledger = last.select(
        "study_id", F.when(n % 5 == 0, F.lit("changed")).otherwise(F.sha2(n.cast("string"), 256)).alias("sha256"),
        F.when(n % 7 == 0, 9).otherwise(10).alias("payload_rows"),
        F.when(n % 11 == 0, "old").otherwise("sig").alias("signature"),
        F.when(n % 13 == 0, 0.5).otherwise(0.46).alias("threshold"))
    locks = last.agg(F.lit("sig").alias("signature"), F.lit(0.46).alias("threshold"))
    return lg.validated_done(ledger, locks, inventory)


@query("i2_upsert", uses="v_ledger", doubles="score", sql="""
, cut AS (SELECT *, seq % 4 = 0 AS fresh FROM v_ledger)
SELECT study_id, score, seq FROM cut WHERE fresh
UNION ALL SELECT study_id, score, seq FROM cut WHERE NOT fresh AND study_id NOT IN (SELECT study_id FROM cut WHERE fresh)""")
def _(t):
    rows = v.v_ledger(t).select("study_id", "score", "seq")
    return lg.upsert(rows.where("seq % 4 <> 0"), rows.where("seq % 4 = 0"))


def _stream(t, limit=None):
    """The event table as a stream of arriving ledger rows."""
    schema = t("events").schema
    raw = st.arriving_cases(t.spark, t.directory, schema, "events.parquet", limit)
    return raw.select(F.concat_ws("/", F.col("user_id").cast("string"), F.col("event_type")).alias("study_id"),
                      F.col("value").alias("score"), F.col("ts").alias("completed_at"), F.col("event_id").alias("seq"))


@query("i3_streaming_ledger", uses="v_ledger", doubles="score", sql=_LAST + " SELECT study_id, score, seq FROM last")
def _(t):
    out = fresh_path(t.spark, "stream")
    st.run_ledger(_stream(t), out, VERSION)
    return st.current_ledger(t.spark, out, VERSION).select("study_id", "score", "seq")


@query("i4_bounded_batches", uses="v_ledger", sql=_LAST + " SELECT count(*) AS keys, CAST(sum(seq) AS BIGINT) AS seq_sum FROM last")
def _(t):
    """The event rows arrive as eight files, two per batch; a second run finds nothing new."""
    landing, out = fresh_path(t.spark, "landing"), fresh_path(t.spark, "stream")
    v.v_ledger(t).select("study_id", "score", "completed_at", "seq").repartition(8, "seq").write.parquet(landing)
    for _ in range(2):
        stream = st.arriving_cases(t.spark, landing, t.spark.read.parquet(landing).schema, "*.parquet", 2)
        st.run_ledger(stream, out, VERSION)
    return st.current_ledger(t.spark, out, VERSION).agg(F.count(F.lit(1)).alias("keys"), F.sum("seq").alias("seq_sum"))


@query("i5_error_quarantine", uses="v_ledger", sql="""
SELECT error, count(*) AS rows FROM (SELECT CASE WHEN status = 'error' THEN 'failed status' WHEN score > 50 THEN 'score out of range' END AS error
 FROM v_ledger) WHERE error IS NOT NULL GROUP BY 1""")
def _(t):
    out = fresh_path(t.spark, "stream")
    problem = (F.when(F.endswith("study_id", F.lit("/error")), "failed status")
               .when(F.col("score") > 50, "score out of range"))
    st.run_ledger(_stream(t), out, VERSION, problem=problem)
    return st.error_ledger(t.spark, out).groupBy("error").agg(F.count(F.lit(1)).alias("rows"))


@query("i6_error_resolution", uses="v_ledger", sql="""
SELECT DISTINCT study_id, CASE WHEN study_id IN (SELECT study_id FROM v_ledger WHERE score < 2) THEN 'RESOLVED' ELSE 'UNRESOLVED' END AS resolution
FROM v_ledger WHERE score > 20""")
def _(t):
    rows = v.v_ledger(t)
    return lg.resolve_errors(rows.where("score > 20").select("study_id").distinct(), rows.where("score < 2"))


@query("i7_run_state", uses="v_case", sql="""
SELECT source_group, count(*) AS target, count(*) FILTER (WHERE target_present) AS completed,
 count(*) FILTER (WHERE source_group = 'P' AND case_positive AND NOT target_present) AS errors,
 CASE WHEN count(*) FILTER (WHERE source_group = 'P' AND case_positive AND NOT target_present) > 0 THEN 'STOPPED_WITH_ERROR'
  WHEN count(*) = count(*) FILTER (WHERE target_present) THEN 'COMPLETE' ELSE 'INCOMPLETE' END AS run_state FROM v_case GROUP BY 1""")
def _(t):
    bad = (F.col("source_group") == "P") & F.col("case_positive") & ~F.col("target_present")
    return v.v_case(t).groupBy("source_group").agg(
        F.count(F.lit(1)).alias("target"), F.count_if("target_present").alias("completed"),
        F.count_if(bad).alias("errors")).withColumn(
        "run_state", lg.run_state(F.col("target"), F.col("completed"), F.col("errors")))


# ---- J: audit and report ------------------------------------------------------------------------

@query("j1_readiness_checks", uses="v_case", sql="""
, c AS (SELECT bool_and(organ_dice BETWEEN 0 AND 1) AS organ_in_range, bool_and((label_binary = 1) = (lesion_dice IS NOT NULL)) AS lesion_only_positive,
 bool_and(target_present) AS all_present FROM v_case)
SELECT 'organ_in_range' AS check_name, organ_in_range AS passed FROM c UNION ALL SELECT 'lesion_only_positive', lesion_only_positive FROM c
UNION ALL SELECT 'all_present', all_present FROM c UNION ALL SELECT 'ALL', organ_in_range AND lesion_only_positive AND all_present FROM c""")
def _(t):
    return ct.readiness(v.v_case(t), {
        "organ_in_range": s.finite_in(F.col("organ_dice"), 0.0, 1.0),
        "lesion_only_positive": (F.col("label_binary") == 1) == F.col("lesion_dice").isNotNull(),
        "all_present": F.col("target_present")})


@query("j2_acceptance_gates", uses="v_case", doubles="value gate_limit", sql="""
, s AS (SELECT avg(target_present::INT) AS presence, avg(organ_dice) AS dice, max(lesion_voxels)::DOUBLE AS largest FROM v_case),
g AS (SELECT 'presence at least half' AS gate, presence AS value, 0.5::DOUBLE AS gate_limit, presence >= 0.5 AS passed FROM s
 UNION ALL SELECT 'mean overlap', dice, 0.9::DOUBLE, dice >= 0.9 FROM s UNION ALL SELECT 'largest lesion', largest, 1e9::DOUBLE, largest <= 1e9 FROM s)
SELECT *, CASE WHEN (SELECT bool_and(passed) FROM g) THEN 'ACCEPTED' ELSE 'REJECTED' END AS decision FROM g""")
def _(t):
    one = v.v_case(t).agg(F.avg(F.col("target_present").cast("double")).alias("presence"), F.avg("organ_dice").alias("dice"),
                          F.max("lesion_voxels").cast("double").alias("largest"))
    return ct.acceptance_gates(one, [("presence at least half", "presence", ">=", 0.5), ("mean overlap", "dice", ">=", 0.9),
                                     ("largest lesion", "largest", "<=", 1e9)])


def _tree_sql(name, row):
    """Three levels of hashes over ``row``: the last table of ``name`` holds one root."""
    return f"""{name}0 AS (SELECT sha256({row}) AS h FROM v_payload),
{name}1 AS (SELECT substr(h, 1, 6) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM {name}0 GROUP BY 1),
{name}2 AS (SELECT substr(b, 1, 3) AS b, sha256(string_agg(h, '' ORDER BY h)) AS h FROM {name}1 GROUP BY 1),
{name} AS (SELECT sha256(string_agg(h, '' ORDER BY h)) AS h FROM {name}2)"""


@query("j3_hash_chain", uses="v_payload", sql=f"""
, {_tree_sql("listed", f"path || '|' || (strlen(content) + CASE WHEN {_STALE} THEN 1 ELSE 0 END) || '|' || CASE WHEN {_STALE} THEN '0' ELSE sha256(content) END")},
{_tree_sql("frozen", "path || '|' || strlen(content) || '|' || sha256(content)")},
n AS (SELECT count(*) AS items, count(*) FILTER (WHERE {_STALE}) AS bad_items FROM v_payload)
SELECT items, bad_items, listed.h AS manifest_sha256, listed.h = frozen.h AS manifest_matches, listed.h = frozen.h AND bad_items = 0 AS chain_ok
FROM n, listed, frozen""")
def _(t):
    """The hash was frozen before some records of the manifest went stale."""
    inv, manifest = _manifest(t)
    columns = ["path", "size_bytes", "sha256"]
    frozen = ln.manifest_hash(inv, columns).select(F.col("manifest_sha256").alias("frozen_sha256"))
    return ln.chain_check(manifest, inv, frozen, columns)


@query("j4_constant_agreement", sql="""
SELECT event_type AS name, count(*) AS records, max(value) - min(value) AS spread, max(value) - min(value) <= 100 AS agrees
FROM events GROUP BY 1""", doubles="spread")
def _(t):
    return ct.constants_agree(t("events").select(F.col("event_type").alias("name"), "value"), "name", "value", 100.0)


@query("j5_reproduction_check", uses="v_case", doubles="largest_difference", sql="""
, n AS (SELECT *, organ_dice + (CAST(study_id AS BIGINT) % 7) * 0.00001::DOUBLE AS o2,
 maximum_candidate_score - (CAST(study_id AS BIGINT) % 5) * 0.0625::DOUBLE AS m2 FROM v_case)
SELECT 'organ_dice' AS value_column, max(abs(o2 - organ_dice)) AS largest_difference, bool_and(abs(o2 - organ_dice) <= 1e-4) AS reproduced FROM n
UNION ALL SELECT 'maximum_candidate_score', max(abs(m2 - maximum_candidate_score)), bool_and(abs(m2 - maximum_candidate_score) <= 0.05) FROM n""")
def _(t):
    old = v.v_case(t).select("study_id", "organ_dice", "maximum_candidate_score")
    number = F.col("study_id").cast("long")
    new = old.withColumn("organ_dice", F.col("organ_dice") + number % 7 * 0.00001).withColumn(
        "maximum_candidate_score", F.col("maximum_candidate_score") - number % 5 * 0.0625)
    return ln.reproduction_check(new, old, ["study_id"], {"organ_dice": 1e-4, "maximum_candidate_score": 0.05})


@query("j6_recompute_check", uses="v_case", sql="""
SELECT source_group, TRUE AS ratios_ok, bool_and(organ_dice = coalesce(lesion_voxels / nullif(lesion_voxels + 30, 0), 0)) AS wrong_ratio_ok
FROM v_case GROUP BY 1""")
def _(t):
    total = F.col("lesion_voxels") + F.when(F.col("target_present"), 30).otherwise(0)
    c = v.v_case(t).withColumn("total_voxels", total).withColumn(
        "stored", F.when(F.col("total_voxels") > 0, F.col("lesion_voxels") / F.col("total_voxels")).otherwise(1.0))
    return c.groupBy("source_group").agg(
        F.bool_and(ln.recompute_check(c, "stored", "lesion_voxels", "total_voxels", 1.0)).alias("ratios_ok"),
        F.bool_and(ln.recompute_check(c, "organ_dice", "lesion_voxels", "total_voxels", 1.0)).alias("wrong_ratio_ok"))


@query("j7_metadata_repair", sql="""
SELECT event_id, sha256('{"cases":' || '"' || user_id || '","old_name":"' || event_type || '"}') AS before_sha256,
 sha256('{"cases":' || '"' || user_id || '","new_name":"' || event_type || '"}') AS after_sha256, 1 AS renamed, TRUE AS values_unchanged FROM events""")
def _(t):
    record = F.create_map(F.lit("old_name"), F.col("event_type"), F.lit("cases"), F.col("user_id").cast("string"))
    r = t("events").select("event_id", ln.repair_record(record, {"old_name": "new_name"}).alias("r"))
    return r.select("event_id", "r.before_sha256", "r.after_sha256", "r.renamed", "r.values_unchanged")


@query("j8_access_audit", uses="v_case", sql="""
SELECT count(*) AS rows, FALSE AS touched_labels, TRUE AS touched_masks, FALSE AS access_clean FROM v_case""")
def _(t):
    ledger = v.v_case(t).select(F.lit(False).alias("touched_labels"), (F.col("lesion_voxels") > 100).alias("touched_masks"))
    return ln.access_audit(ledger, ["touched_labels", "touched_masks"])


_LONG_SQL = f""", m AS (SELECT source_group AS cohort, count(*) AS cases, {mean_sql('organ_dice')} AS mean_organ_dice,
 {mean_sql('lesion_dice')} AS mean_lesion_dice, avg(lesion_localized::INT) FILTER (WHERE label_binary = 1) AS localization_sensitivity,
 count(*) FILTER (WHERE label_binary = 1) AS positive_cases FROM v_case GROUP BY 1),
long AS (SELECT cohort, cases, metric, value FROM m UNPIVOT (value FOR metric IN (mean_organ_dice, mean_lesion_dice, localization_sensitivity)))"""


def _publication(t):
    means = sm.case_means(v.v_case(t), ["source_group"]).withColumnRenamed("source_group", "cohort")
    return sm.metric_rows(means, ["mean_organ_dice", "mean_lesion_dice", "localization_sensitivity"], ["cohort", "cases"])


@query("j9_publication_table", uses="v_case", doubles="value", sql=_LONG_SQL + " SELECT * FROM long")
def _(t):
    return _publication(t)


@query("j10_cohort_performance_wide", uses="v_case", doubles="mean_organ_dice mean_lesion_dice localization_sensitivity prevalence_percent", sql=_LONG_SQL + """
SELECT cohort, mean_organ_dice, mean_lesion_dice, localization_sensitivity, 100.0::DOUBLE * positive_cases / cases AS prevalence_percent FROM m""")
def _(t):
    names = ["mean_organ_dice", "mean_lesion_dice", "localization_sensitivity"]
    wide = _publication(t).groupBy("cohort").pivot("metric", names).agg(F.max("value"))
    share = det.cohort_sizes(v.v_case(t), ["source_group"]).select(
        F.col("source_group").alias("cohort"), (100.0 * F.col("n_refs") / F.col("n_cases")).alias("prevalence_percent"))
    return wide.join(share, "cohort")


_COHORTS = {"F": ["F"], "EXTERNAL_COMBINED": ["O", "P"]}


def _cohort_intervals_sql() -> str:
    parts = []
    for i, (cohort, sources) in enumerate(_COHORTS.items()):
        listed = ", ".join(f"'{x}'" for x in sources)
        text = f""", bc{i} AS (SELECT study_id, label_binary, {exact('organ_dice')} AS od, {exact('lesion_dice')} AS ld FROM v_case WHERE source_group IN ({listed}))"""
        text += draws_sql(f"bc{i}", "study_id", "label_binary", "label_binary", "label_binary, od, ld", f"w{i}")
        parts.append((cohort, i, text))
    own = f""", zs AS (SELECT study_id, source_group, {exact('organ_dice')} AS od FROM v_case WHERE source_group IN ('O', 'P'))""" + draws_sql(
        "zs", "study_id", "source_group", "source_group", "source_group, od", "ws")
    per = [f"SELECT '{c}' AS cohort, metric, x FROM (SELECT r, {drawn_mean('od')} AS mean_organ_dice, {drawn_mean('ld')} AS mean_lesion_dice FROM w{i} GROUP BY 1) UNPIVOT (x FOR metric IN (mean_organ_dice, mean_lesion_dice))" for c, i, _ in parts]
    per.append(f"SELECT source_group, 'mean_organ_dice', {drawn_mean('od')} FROM ws GROUP BY source_group, r")
    return "".join(t for _, _, t in parts) + own + ", long AS (" + " UNION ALL ".join(per) + """)
SELECT cohort, metric, quantile_cont(x, 0.025) AS lower, quantile_cont(x, 0.975) AS upper, count(*) AS used FROM long GROUP BY 1, 2"""


@query("j11_interval_union", uses="v_case", doubles="lower upper", sql=_cohort_intervals_sql())
def _(t):
    """The interval tables of the internal cohort, of all external sources together (both
    stratified by diagnosis) and of each external source, one below the other."""
    cases, bn = cut_lineage(v.v_case(t).select("study_id", "source_group", "label_binary", "organ_dice", "lesion_dice")), s.billionths
    metrics = {"mean_organ_dice": bn(F.col("organ_dice")), "mean_lesion_dice": bn(F.col("lesion_dice"))}
    tables = {}
    for cohort, sources in _COHORTS.items():
        own = rs.replicate_metrics(cases.where(F.col("source_group").isin(sources)), ["label_binary"], "study_id", metrics, replicates=REPLICATES)
        tables[cohort] = rs.percentile_intervals(own.withColumns({m: F.col(m) / s.BILLION for m in metrics}), list(metrics))
    each = cases.where("source_group IN ('O', 'P')").select("study_id", "source_group", bn(F.col("organ_dice")).alias("od"))
    per = rs.drawn_means(each, ["source_group"], "study_id", {"mean_organ_dice": F.col("od")}, REPLICATES)
    per = per.withColumn("mean_organ_dice", F.col("mean_organ_dice") / s.BILLION)
    own = rs.percentile_intervals(per, ["mean_organ_dice"], ["source_group"]).withColumnRenamed("source_group", "cohort")
    return ln.stacked(tables).unionByName(own)


@query("j12_froc_long_by_cohort", uses="v_cohort v_candidate", doubles="achieved_fp_per_case sensitivity threshold", sql="""
, cd AS (SELECT source_group AS cohort, c.* FROM v_candidate c JOIN v_cohort USING (study_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY candidate_score DESC, candidate_x, candidate_y, candidate_z, shipped, reference_distance_mm) AS k FROM cd),
tr AS (SELECT *, coalesce(reference_distance_mm <= 5 AND k = min(CASE WHEN reference_distance_mm <= 5 THEN k END) OVER (PARTITION BY study_id), FALSE) AS hit FROM rk),
sz AS (SELECT source_group AS cohort, count(*) AS n, sum(label_binary) AS p FROM v_cohort GROUP BY 1),
st AS (SELECT DISTINCT cohort, candidate_score AS threshold, CAST(sum(hit::INT) OVER o AS BIGINT) AS tp, CAST(sum(1 - hit::INT) OVER o AS BIGINT) AS fp
  FROM tr WINDOW o AS (PARTITION BY cohort ORDER BY candidate_score DESC)),
cv AS (SELECT cohort, threshold, tp, fp, tp::DOUBLE / p AS sensitivity, fp::DOUBLE / n AS f FROM (SELECT * FROM st UNION ALL
  SELECT cohort, max(threshold) + 1e-6::DOUBLE, 0, 0 FROM st GROUP BY 1) JOIN sz USING (cohort))
SELECT cohort, target, f AS achieved_fp_per_case, sensitivity, threshold, tp, fp FROM (
 SELECT *, row_number() OVER (PARTITION BY cohort, target ORDER BY sensitivity DESC, f DESC, threshold DESC) AS r
 FROM cv, (SELECT unnest([0.25, 0.5, 1, 2, 4, 8]::DOUBLE[]) AS target) WHERE f <= target + 1e-12::DOUBLE) WHERE r = 1""")
def _(t):
    """A curve per cohort, read at the standard targets, in long form."""
    key = ["cohort"]
    cohort = v.v_cohort(t).withColumnRenamed("source_group", "cohort")
    tagged = v.v_candidate(t).select("study_id", "candidate_score", "reference_distance_mm").join(cohort.select("study_id", "cohort"), "study_id")
    tagged = cut_lineage(tagged)  # read many times, built once
    return det.operating_points(det.froc_from_distances(tagged, det.cohort_sizes(cohort, key), keys=key), keys=key)


@query("j13_frozen_manifest", uses="v_case", sql="""
SELECT study_id, lesion_voxels, target_present, sha256(study_id || '|' || lesion_voxels || '|' || target_present) AS row_sha256 FROM v_case""")
def _(t):
    ledger = v.v_case(t).select("study_id", "lesion_voxels")
    qc = v.v_case(t).select("study_id", "target_present")
    return ln.frozen_manifest(ledger, qc, ["study_id"], ["study_id", "lesion_voxels", "target_present"])


@query("j14_report_lines", uses="v_case", sql=_LONG_SQL + """
SELECT cohort || ': ' || positive_cases || ' of ' || cases || ' cases are positive' AS line FROM m""")
def _(t):
    rows = sm.case_means(v.v_case(t), ["source_group"])
    return ln.report_lines(rows, "%s: %s of %s cases are positive", F.col("source_group"), F.col("positive_cases"), F.col("cases"))


@query("j15_cohort_delta", uses="v_case", doubles="delta", sql=_LONG_SQL + """
SELECT metric, max(value) FILTER (WHERE cohort = 'O') - max(value) FILTER (WHERE cohort = 'F') AS delta FROM long GROUP BY 1""")
def _(t):
    return ln.cohort_delta(_publication(t), "F", "O")


@query("j16_audit_status", sql="""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN value > 5 WHEN 1 THEN value > 10 WHEN 2 THEN event_type = 'click' ELSE FALSE END AS passed FROM events""")
def _(t):
    n = F.col("event_id") % 4
    result = F.when(n == 2, F.when(F.col("event_type") == "click", "pass_with_notes").otherwise("failed"))
    return t("events").select("event_id", ln.audit_status(
        F.when(n == 0, F.col("value") > 5), F.when(n == 1, F.col("value") > 10), result).alias("passed"))
