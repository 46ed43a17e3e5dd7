"""Contracts must fail when one input is broken."""

import pytest
from pyspark.sql import functions as F, types as T

from caseledger.functions import parsing as p, scalars as s
from caseledger.operators import contracts as ct, joins as j, ledger as lg, lineage as ln
from caseledger.session import fresh_path
from caseledger.sources import files as fl, tables as tb


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def fails(df, text):
    with pytest.raises(Exception) as e:
        df.collect()
    assert text in str(e.value)


def test_one_to_one_rejects_repeats_and_gaps(spark):
    a = frame(spark, [("1", 1), ("2", 2)], "study_id string, a int")
    b = frame(spark, [("1", 5), ("2", 6)], "study_id string, b int")
    assert j.one_to_one(a, b, ["study_id"]).count() == 2
    fails(j.one_to_one(a, b.unionByName(b.limit(1)), ["study_id"]), "repeated key")
    fails(j.one_to_one(a, b.where("study_id = '1'"), ["study_id"]), "unmatched key")
    # also when the joined columns are not selected
    with pytest.raises(Exception):
        j.one_to_one(a, b.where("study_id = '1'"), ["study_id"]).select("study_id").collect()


def test_exactly_one(spark):
    a = frame(spark, [("1", 1), ("2", 2), ("2", 3)], "study_id string, a int")
    ids = lambda *x: frame(spark, [(i,) for i in x], "study_id string")
    assert [r.a for r in j.exactly_one(a, ids("1")).collect()] == [1]
    fails(j.exactly_one(a, ids("2")), "repeated key")
    fails(j.exactly_one(a, ids("9")), "no row for")


def test_keep_last_and_upsert(spark):
    df = frame(spark, [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "k int, t int, v string")
    assert {(r.k, r.v) for r in j.keep_last(df, ["k"], ["t"]).collect()} == {(1, "b"), (2, "c")}
    new = frame(spark, [(1, 9, "x")], "k int, t int, v string")
    assert sorted((r.k, r.v) for r in lg.upsert(df, new, ["k"]).collect()) == [(1, "x"), (2, "c")]


@pytest.mark.parametrize("text", ["[1,2]", "[1,2,\"NaN\"]", "nonsense", None])
def test_bad_vectors_fail(spark, text):
    fails(frame(spark, [(text,)], "c string").select(p.decode_vector(F.col("c"))), "bad vector")


def test_bad_label_matrix_and_box_fail(spark):
    fails(frame(spark, [("maybe",)], "c string").select(
        p.decode_label(F.col("c"), ["lesion"], ["non-lesion"], ("lesion", "non-lesion"))), "unexpected diagnostic label")
    fails(frame(spark, [("[[1,2],[3,4]]",)], "c string").select(p.decode_matrix(F.col("c"))), "bad matrix")
    fails(frame(spark, [('{"minimum":[1,1,5],"maximum":[2,2,4]}',)], "c string").select(p.decode_box(F.col("c"))), "bad box")


def test_gate_and_blind_scan(spark):
    data = frame(spark, [("1", 1)], "study_id string, label int")
    closed = frame(spark, [(False,)], "frozen boolean")
    fails(tb.gated(data, closed, F.col("frozen"), "freeze"), "gate closed")
    fails(tb.gated(data, closed.where("1 = 0"), F.col("frozen"), "freeze"), "gate closed")
    out = fresh_path(spark, "blind")
    data.write.parquet(out)
    stored = spark.read.parquet(out)
    assert tb.blind_scan(stored, ["study_id"], ["label"]).columns == ["study_id"]
    with pytest.raises(ValueError):
        tb.blind_scan(stored.where("label = 1"), ["study_id"], ["label"])
    with pytest.raises(ValueError):
        tb.blind_scan(stored, ["absent"], ["label"])


def test_missing_ledger_is_empty_and_typed(spark):
    schema = T.StructType([T.StructField("study_id", T.StringType())])
    df = tb.read_or_empty(spark, fresh_path(spark, "nothing"), schema)
    assert df.count() == 0 and df.schema == schema


def test_half_written_version_is_never_read(spark):
    base = fresh_path(spark, "versions")
    assert tb.latest_version(spark, base) is None
    first = tb.write_version(spark.range(3), base)
    assert tb.latest_version(spark, base).endswith(first.rsplit("/", 1)[1])
    import os

    later = [tb.write_version(spark.range(n), base) for n in (4, 5)]
    os.utime(f"{first.removeprefix('file:')}/_SUCCESS")  # times of files don't matter
    assert tb.latest_version(spark, base).endswith(later[1].rsplit("/", 1)[1])
    os.remove(f"{later[1].removeprefix('file:')}/_SUCCESS")
    assert tb.latest_version(spark, base).endswith(later[0].rsplit("/", 1)[1])
    assert tb.write_version(spark.range(1), base).rsplit("/v-", 1)[1].startswith("000000000004-")


def test_one_changed_byte_breaks_integrity_and_chain(spark):
    payload = frame(spark, [("a", bytearray(b"one")), ("b", bytearray(b"two"))], "path string, content binary")
    manifest = fl.hashed_payloads(payload)
    changed = fl.hashed_payloads(payload.withColumn("content", F.when(F.col("path") == "a", F.lit(b"onf")).otherwise(F.col("content"))))
    cols = ["path", "size_bytes", "sha256"]
    frozen = ln.manifest_hash(manifest, cols).first().manifest_sha256
    assert ln.chain_check(manifest, manifest, frozen, cols).first().chain_ok
    row = ln.chain_check(manifest, changed, frozen, cols).first()
    assert (row.bad_items, row.manifest_matches, row.chain_ok) == (1, True, False)
    assert not ln.chain_check(changed, changed, frozen, cols).first().manifest_matches


def test_readiness_fails_on_null_and_on_no_rows(spark):
    df = frame(spark, [(1.0,), (None,)], "v double")
    got = {r.check_name: r.passed for r in ct.readiness(df, {"positive": F.col("v") > 0}).collect()}
    assert got == {"positive": False, "ALL": False}
    none = {r.check_name: r.passed for r in ct.readiness(df.where("v > 5"), {"positive": F.col("v") > 0}).collect()}
    assert none["ALL"] is False


def test_protocol_signature_golden_value(spark):
    # The eight protocol parameters and their published signature.
    fields = {"pancreas_gate_probability": F.lit(0.10), "pancreas_gate_margin_mm": F.lit(20.0),
              "lesion_smoothing_sigma_mm": F.lit(2.5), "nms_radius_mm": F.lit(10.0),
              "minimum_candidate_score": F.lit(0.01), "maximum_candidates_per_case": F.lit(256),
              "reference_localization_tolerance_mm": F.lit(5.0),
              "spacing_mm": F.array(F.lit(1.25), F.lit(1.25), F.lit(2.0))}
    got = spark.range(1).select(s.record_signature(fields).alias("s")).first().s
    assert got == "a10ae14a708e66580232454f6473b840bb70bd92d28d5a9f569208b889307379"


def test_stable_integer_matches_its_definition(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"20260728|patch|1|x").digest()[:8], "little") % 2 ** 32
    got = spark.range(1).select(s.stable_integer(F.lit(20260728), F.lit("patch"), F.lit(1), F.lit("x")).alias("s")).first().s
    assert got == want


@pytest.mark.parametrize("fold_rows", [1_000_000, 3])
def test_best_so_far_margin_depends_on_the_path(spark, fold_rows):
    # each step is below the margin, so none but the first and a clear jump counts
    rows = [("a", e, 0.5 + e * 4e-7) for e in range(5)] + [("a", 9, 0.6), ("a", 10, 0.6000005), ("b", 1, 0.3), ("b", 2, 0.2)]
    got = {(r.arm, r.epoch) for r in lg.best_so_far(frame(spark, rows, "arm string, epoch long, score double"),
                                                     fold_rows=fold_rows).collect()}
    assert got == {("a", 0), ("a", 3), ("a", 9), ("b", 1)}


def test_display_formats(spark):
    df = frame(spark, [(0.77, 0.701, 0.835), (None, None, None)], "p double, l double, h double")
    got = [r.t for r in df.select(p.interval_text(F.col("p"), F.col("l"), F.col("h")).alias("t")).collect()]
    assert got == ["0.770 (0.701-0.835)", "NA"]


def test_size_groups_are_upper_inclusive(spark):
    df = frame(spark, [(20.0,), (20.1,), (40.0,), (40.1,), (None,)], "mm double")
    got = [r.g for r in df.select(s.size_group(F.col("mm")).alias("g")).collect()]
    assert got == ["small_<=20mm", "medium_>20-40mm", "medium_>20-40mm", "large_>40mm", None]
    d = spark.range(1).select(s.equivalent_diameter(F.lit(1000)).alias("d")).first().d
    assert round(d, 2) == 18.14
