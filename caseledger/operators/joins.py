"""Joins under a contract: uniqueness, completeness, zero fill, pairing.

Contracts are part of the plan: a violation raises while the rows flow, with no
extra pass and nothing collected. Whether a side is broadcast is left to Spark,
which knows its size at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def unique_by(df: DataFrame, keys: Sequence[str], what: str = "table") -> DataFrame:
    """The frame itself if every key occurs once; otherwise the query fails.

    Counted with map-side combine, so even a very frequent bad key is one row
    per map task. The grouping also places the rows for the join that follows.
    """
    rest = [c for c in df.columns if c not in keys]
    grouped = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    checked = F.when(F.col("_n") == 1, F.col("_r")).otherwise(
        F.raise_error(F.concat(F.lit(f"{what}: repeated key "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))))
    return grouped.select(*keys, checked.alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def one_to_one(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join that fails unless both sides hold the same keys, once each."""
    keys = list(keys)
    a = unique_by(left, keys, "left").withColumn("_l", F.lit(True))
    b = unique_by(right, keys, "right").withColumn("_r", F.lit(True))
    joined = a.join(b, keys, "full_outer")
    ok = F.when(F.col("_l") & F.col("_r"), F.lit(True)).otherwise(F.raise_error(
        F.concat(F.lit("unmatched key "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))))
    # as a filter, so that the check runs even when no checked column is selected
    return joined.where(ok).drop("_l", "_r")


def cardinality_report(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows and distinct keys per side, shared keys, and whether 1:1 holds."""
    tagged = left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
    per = tagged.groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    out = per.agg(total(F.col("_l")).alias("left_rows"), total(F.col("_l") > 0).alias("left_keys"),
                  total(F.col("_r")).alias("right_rows"), total(F.col("_r") > 0).alias("right_keys"),
                  total((F.col("_l") > 0) & (F.col("_r") > 0)).alias("shared_keys"))
    same = [F.col(c) == F.col("left_rows") for c in ("left_keys", "right_rows", "right_keys", "shared_keys")]
    return out.withColumn("one_to_one", same[0] & same[1] & same[2] & same[3])


def lookup(fact: DataFrame, dim: DataFrame, key: Sequence[str]) -> DataFrame:
    """Many-to-one left join; the dimension key must be unique."""
    return fact.join(unique_by(dim, key, "dimension"), list(key), "left")


def keep_last(ledger: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Newest row per key by the version columns.

    ``max`` of (version, row) is combined before the shuffle, so one key with
    very many versions sends one row per map task.
    """
    rest = [c for c in ledger.columns if c not in keys and c not in version]
    newest = F.max(F.struct(*version, *rest)).alias("_r")
    return ledger.groupBy(*keys).agg(newest).select(
        *keys, *[F.col("_r")[c].alias(c) for c in ledger.columns if c not in keys])


def enrich_missing(manifest: DataFrame, ledger: DataFrame, key: Sequence[str], column: str,
                   version: Sequence[str]) -> DataFrame:
    """Takes ``column`` from the newest ledger row, only if the manifest lacks it."""
    if column in manifest.columns:
        return manifest
    newest = keep_last(ledger.select(*key, *version, column), key, version).drop(*version)
    return manifest.join(newest, list(key), "left")


def compare_outer(left: DataFrame, right: DataFrame, keys: Sequence[str], suffixes: tuple[str, str]) -> DataFrame:
    """Full outer join; value columns of both sides carry a suffix."""
    def named(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(*keys, *[F.col(c).alias(c + suffix) for c in df.columns if c not in keys])

    return named(left, suffixes[0]).join(named(right, suffixes[1]), list(keys), "full_outer")


def only_ids(df: DataFrame, ids: DataFrame, key: Sequence[str] = ("study_id",)) -> DataFrame:
    return df.join(ids.select(*key), list(key), "left_semi")


def pending(target: DataFrame, done: DataFrame, key: Sequence[str] = ("study_id",)) -> DataFrame:
    return target.join(done.select(*key), list(key), "left_anti")


def paired_arms(arms: DataFrame, keys: Sequence[str], values: Sequence[str], first: str, second: str,
                arm: str = "arm") -> DataFrame:
    """Both arms of a case side by side with ``first - second`` differences.

    One grouping instead of a self-join; cases without both arms are left out.
    """
    def of(name: str, column: str) -> Column:
        return F.max(F.when(F.col(arm) == name, F.col(column)))

    per = (arms.where(F.col(arm).isin(first, second)).groupBy(*keys).agg(
        F.count_if(F.col(arm) == first).alias("_a"), F.count_if(F.col(arm) == second).alias("_b"),
        *[of(first, c).alias(f"{c}_{first}") for c in values],
        *[of(second, c).alias(f"{c}_{second}") for c in values]))
    both = per.where((F.col("_a") == 1) & (F.col("_b") == 1)).drop("_a", "_b")
    return both.select("*", *[(F.col(f"{c}_{first}") - F.col(f"{c}_{second}")).alias(f"{c}_difference")
                              for c in values])


def count_per_case(cases: DataFrame, events: DataFrame, out: str, key: Sequence[str] = ("study_id",)) -> DataFrame:
    """Event count for every case, zero where there is none."""
    counts = events.groupBy(*key).agg(F.count(F.lit(1)).alias(out))
    return cases.join(counts, list(key), "left").withColumn(out, F.coalesce(out, F.lit(0).cast("long")))


def exactly_one(frame: DataFrame, ids: DataFrame, key: Sequence[str] = ("study_id",)) -> DataFrame:
    """The row of each asked id; fails if an id has none or several."""
    key = list(key)
    found = unique_by(only_ids(frame, ids, key), key, "look-up").withColumn("_hit", F.lit(True))
    asked = ids.select(*key).distinct().join(found, key, "left")
    ok = F.when(F.col("_hit"), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("no row for "), F.concat_ws(",", *[F.col(k).cast("string") for k in key]))))
    return asked.where(ok).drop("_hit")


def map_codes(code: Column, names: dict[str, str], default: str | None = None) -> Column:
    """Code to text through a small fixed dictionary."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), code)
    return F.coalesce(found, F.lit(default)) if default is not None else found
