"""Checks over tables: sets, counts, distributions, constants, readiness.

Each returns a small DataFrame; nothing is collected here.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    return df


def distribution_difference(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """Values whose count differs from ``expected(column, expected_rows)``."""
    seen = df.groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return (seen.join(expected, column, "full_outer")
            .select(column, F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
                    F.coalesce("expected_rows", F.lit(0)).cast("long").alias("expected_rows"))
            .withColumn("matches", F.col("rows") == F.col("expected_rows")))


def cardinality_lock(df: DataFrame, key: Sequence[str], expected: int | Column) -> DataFrame:
    """Rows, distinct keys, and whether both equal the expected number.

    Grouping by the key first keeps the distinct count spread over tasks.
    """
    per = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    out = per.agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("distinct_ids"))
    want = expected if isinstance(expected, Column) else F.lit(expected)
    return out.withColumn("locked", (F.col("rows") == want) & (F.col("distinct_ids") == want))


def set_comparison(a: DataFrame, b: DataFrame, key: Sequence[str] = ("study_id",)) -> DataFrame:
    """One row: shared, only left, only right keys; equality and subset verdicts."""
    tagged = a.select(*key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per = tagged.groupBy(*key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    n = lambda cond: F.count_if(cond)
    return per.agg(n((F.col("_a") == 1) & (F.col("_b") == 1)).alias("shared"),
                   n(F.col("_b") == 0).alias("only_left"), n(F.col("_a") == 0).alias("only_right")).select(
        "*", ((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("equal_sets"),
        (F.col("only_left") == 0).alias("left_is_subset"))


def difference_listing(a: DataFrame, b: DataFrame, key: str = "study_id") -> DataFrame:
    """Keys on one side only: ``missing`` (expected, absent) and ``unexpected``."""
    tagged = a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    per = tagged.groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    return per.where("_a <> _b").select(key, F.when(F.col("_a") == 1, "missing").otherwise("unexpected").alias("side"))


def constant_check(df: DataFrame, column: str, expected: Column | None = None) -> DataFrame:
    """Whether all rows carry one (expected) value, from min and max alone."""
    out = df.agg(F.min(column).alias("lowest"), F.max(column).alias("highest"),
                 F.count_if(F.col(column).isNull()).alias("nulls"))
    same = (F.col("lowest") == F.col("highest")) & (F.col("nulls") == 0)
    if expected is not None:
        same = same & (F.col("lowest") == expected)
    return out.withColumn("constant", F.coalesce(same, F.lit(False)))


def symmetric_keys(have: Column, want: Column) -> Column:
    """Names in one array only, sorted."""
    return F.array_sort(F.array_union(F.array_except(have, want), F.array_except(want, have)))


def readiness(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Named boolean checks over all rows: ``(check, passed)`` plus ``ALL``.

    ``checks`` are row conditions; each must hold in every row.
    """
    row = df.agg(*[F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False)).alias(n)
                   for n, c in checks.items()])
    return long_checks(row, list(checks))


def long_checks(row: DataFrame, names: Sequence[str]) -> DataFrame:
    """One-row check columns to long form with a final ``ALL`` row."""
    every = F.lit(True)
    for n in names:
        every = every & F.col(n)
    items = [F.struct(F.lit(n).alias("check_name"), F.col(n).alias("passed")) for n in names]
    items.append(F.struct(F.lit("ALL").alias("check_name"), every.alias("passed")))
    return row.select(F.explode(F.array(*items)).alias("_c")).select("_c.check_name", "_c.passed")


def acceptance_gates(summary: DataFrame, gates: Sequence[tuple[str, str, str, float]]) -> DataFrame:
    """Numeric gates ``(name, column, '>=' or '<=', limit)`` on a one-row summary."""
    def holds(column: str, op: str, limit: float) -> Column:
        c = F.col(column)
        return F.coalesce(c >= limit if op == ">=" else c <= limit, F.lit(False))

    every = F.lit(True)
    for _, column, op, limit in gates:
        every = every & holds(column, op, limit)
    items = [F.struct(F.lit(n).alias("gate"), F.col(c).cast("double").alias("value"), F.lit(float(x)).alias("gate_limit"),
                      holds(c, op, x).alias("passed")) for n, c, op, x in gates]
    decision = F.when(every, "ACCEPTED").otherwise("REJECTED").alias("decision")
    return summary.select(F.explode(F.array(*items)).alias("_g"), decision).select(
        "_g.gate", "_g.value", "_g.gate_limit", "_g.passed", "decision")


def constants_agree(records: DataFrame, name: str, value: str, tolerance: float) -> DataFrame:
    """Per named constant: spread over all records and whether it is within tolerance."""
    return records.groupBy(name).agg(
        F.count(F.lit(1)).alias("records"), (F.max(value) - F.min(value)).alias("spread")
    ).withColumn("agrees", F.coalesce(F.col("spread") <= tolerance, F.lit(False)))


def expected_rows(spark: SparkSession, column: str, counts: dict) -> DataFrame:
    """A small literal table ``(column, expected_rows)``."""
    return spark.createDataFrame([(k, v) for k, v in counts.items()], f"{column} string, expected_rows long")
