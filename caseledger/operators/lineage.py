"""Hash-based lineage: manifests, integrity, chains, repairs, access audits, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .joins import one_to_one
from .ordering import rank_within


def integrity(manifest: DataFrame, inventory: DataFrame, key: str = "path") -> DataFrame:
    """Per manifest row: exists, size equal, hash equal."""
    have = inventory.select(key, F.col("size_bytes").alias("_size"), F.col("sha256").alias("_sha"))
    out = manifest.join(have, key, "left")
    return out.select(
        key, F.col("_sha").isNotNull().alias("exists"),
        F.coalesce(F.col("size_bytes") == F.col("_size"), F.lit(False)).alias("size_matches"),
        F.coalesce(F.col("sha256") == F.col("_sha"), F.lit(False)).alias("hash_matches"))


def evidence_manifest(inventory: DataFrame, role: Column, key: str = "path") -> DataFrame:
    """One numbered row per file: order, role, size, hash."""
    numbered = rank_within(inventory.withColumn("role", role), [], [(key, True)], "evidence_order")
    return numbered.select("evidence_order", key, "role", "size_bytes", "sha256")


def manifest_hash(manifest: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One hash of a whole manifest, built as a three-level hash tree.

    Row hashes fall into 16**6 leaves by their first six digits, leaves into
    4096 branches by their first three, branches into the root. Each node
    hashes its sorted children, so the result does not depend on partitioning;
    a branch or root has at most 4096 children, a leaf its 16-millionth of the
    rows.
    """
    def fold(name: str) -> Column:
        return F.sha2(F.concat_ws("", F.array_sort(F.collect_list(name))), 256)

    row = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)
    leaves = manifest.select(row.alias("_h")).groupBy(F.substring("_h", 1, 6).alias("_p")).agg(
        fold("_h").alias("_h"), F.count(F.lit(1)).alias("_n"))
    branches = leaves.groupBy(F.substring("_p", 1, 3).alias("_p")).agg(fold("_h").alias("_h"), F.sum("_n").alias("_n"))
    return branches.agg(fold("_h").alias("manifest_sha256"), F.sum("_n").alias("rows"))


def chain_check(manifest: DataFrame, inventory: DataFrame, frozen: str | DataFrame, columns: Sequence[str],
                key: str = "path") -> DataFrame:
    """The manifest hash equals the frozen one, and every listed file still agrees.

    ``frozen`` is a hash, or a table with one row and the column ``frozen_sha256``."""
    items = integrity(manifest, inventory, key).agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(~(F.col("exists") & F.col("size_matches") & F.col("hash_matches"))).alias("bad_items"))
    whole = manifest_hash(manifest, columns)
    if isinstance(frozen, DataFrame):
        whole = whole.join(F.broadcast(frozen.select("frozen_sha256")))  # one row
    else:
        whole = whole.withColumn("frozen_sha256", F.lit(frozen))
    same = F.col("manifest_sha256") == F.col("frozen_sha256")
    return whole.join(F.broadcast(items)).select(
        "items", "bad_items", "manifest_sha256", same.alias("manifest_matches"), (same & (F.col("bad_items") == 0)).alias("chain_ok"))


def frozen_manifest(ledger: DataFrame, qc: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Ledger joined 1:1 with its quality rows, narrowed to the published columns, with a row hash."""
    joined = one_to_one(ledger, qc, key).select(*columns)
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return joined.withColumn("row_sha256", F.sha2(text, 256))


def reproduction_check(new: DataFrame, old: DataFrame, key: Sequence[str], values: dict[str, float]) -> DataFrame:
    """Largest difference per value column against its tolerance."""
    b = old.select(*key, *[F.col(c).alias(f"_old_{c}") for c in values])
    joined = one_to_one(new.select(*key, *values), b, key)
    row = joined.agg(*[F.max(F.abs(F.col(c) - F.col(f"_old_{c}"))).alias(c) for c in values])
    items = [F.struct(F.lit(c).alias("value_column"), F.col(c).alias("largest_difference"),
                      F.coalesce(F.col(c) <= tol, F.lit(False)).alias("reproduced")) for c, tol in values.items()]
    return row.select(F.explode(F.array(*items)).alias("_c")).select("_c.*")


def recompute_check(ledger: DataFrame, ratio: str, numerator: str, denominator: str, empty: float,
                    atol: float = 1e-12) -> Column:
    """Whether the stored ratio equals the ratio of the stored counts."""
    want = F.when(F.col(denominator) > 0, F.col(numerator) / F.col(denominator)).otherwise(F.lit(empty))
    return F.coalesce(F.abs(F.col(ratio) - want) <= atol, F.lit(False))


def repair_record(record: Column, renames: dict[str, str]) -> Column:
    """Map record with keys renamed; hashes before and after; values unchanged.

    ``struct<record, before_sha256, after_sha256, renamed, values_unchanged>``
    """
    names = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
    fixed = F.transform_keys(record, lambda k, _: F.coalesce(F.element_at(names, k), k))
    order = lambda m: F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))))
    return F.struct(
        fixed.alias("record"), F.sha2(order(record), 256).alias("before_sha256"),
        F.sha2(order(fixed), 256).alias("after_sha256"),
        F.size(F.map_filter(record, lambda k, _: F.element_at(names, k).isNotNull())).alias("renamed"),
        (F.array_sort(F.map_values(record)) == F.array_sort(F.map_values(fixed))).alias("values_unchanged"))


def access_audit(ledger: DataFrame, flags: Sequence[str]) -> DataFrame:
    """No row touched what it must not: one verdict per flag and an overall one."""
    row = ledger.agg(F.count(F.lit(1)).alias("rows"),
                     *[F.coalesce(F.bool_or(F.col(f)), F.lit(False)).alias(f) for f in flags])
    clean = F.lit(True)
    for f in flags:
        clean = clean & ~F.col(f)
    return row.withColumn("access_clean", clean)


def audit_status(flag: Column | None, complete: Column | None, result: Column | None) -> Column:
    """First of several record shapes that says whether an audit passed."""
    options = [c for c in (flag, complete) if c is not None]
    if result is not None:
        options.append(F.startswith(F.upper(result), F.lit("PASS")))
    return F.coalesce(*options, F.lit(False))


def report_lines(rows: DataFrame, template: str, *columns: Column) -> DataFrame:
    """One text line per result row."""
    return rows.select(F.format_string(template, *columns).alias("line"))


def stacked(tables: dict[str, DataFrame], column: str = "cohort") -> DataFrame:
    """Union by name of several tables, each tagged with its name."""
    out = None
    for name, df in tables.items():
        part = df.withColumn(column, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def cohort_delta(long: DataFrame, first: str, second: str, column: str = "cohort") -> DataFrame:
    """``second - first`` per metric of a long metric table."""
    pick = lambda n: F.max(F.when(F.col(column) == n, F.col("value")))
    return long.groupBy("metric").agg((pick(second) - pick(first)).alias("delta"))
