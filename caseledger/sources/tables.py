"""Typed scans, gates and versioned writes."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.errors import AnalysisException


def typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a given schema; identifiers are declared as text and stay text."""
    return spark.read.option("header", True).schema(schema).csv(path)


def typed_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def blind_scan(df: DataFrame, required: Sequence[str], forbidden: Sequence[str]) -> DataFrame:
    """Only the required columns, with proof that no forbidden one is read.

    The header is checked first; then the optimised plan is searched, so a
    label that sneaks back in through a join or filter is refused too.
    """
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"required columns missing: {missing}")
    narrow = df.select(*required)
    assert_not_read(narrow, forbidden)
    return narrow


def assert_not_read(df: DataFrame, forbidden: Sequence[str]) -> None:
    """Fails if any scan of the plan reads a forbidden column."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "ReadSchema" not in line:
            continue
        read = line.split("ReadSchema: ", 1)[1]
        hit = [c for c in forbidden if f"<{c}:" in read or f",{c}:" in read]
        if hit:
            raise ValueError(f"blinded columns are read: {hit}")


def read_protocol(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Multi-line JSON record as a one-row table."""
    return spark.read.option("multiLine", True).schema(schema).json(path)


def gated(df: DataFrame, protocol: DataFrame, condition: Column, what: str) -> DataFrame:
    """The table, readable only if the one-row protocol satisfies ``condition``."""
    verdict = F.when(F.coalesce(condition, F.lit(False)), F.lit(True)).otherwise(F.raise_error(F.lit(f"gate closed: {what}")))
    gate = protocol.agg(F.bool_and(verdict).alias("_open"))
    opened = F.when(F.col("_open"), F.lit(True)).otherwise(F.raise_error(F.lit(f"gate closed: {what}")))
    return df.join(F.broadcast(gate)).where(opened).drop("_open")


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The ledger, or an empty table with its columns when nothing is there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def write_version(df: DataFrame, base: str, partition_by: Sequence[str] = ()) -> str:
    """Writes a new immutable version below ``base`` and returns its path.

    A version is complete when its ``_SUCCESS`` marker exists; readers take a
    path only from the caller or from :func:`latest_version`, so a half-written
    table is never seen. Versions are numbered upwards, half-written ones counted;
    of two writers at once that take one number, the same one is the newer for all.
    """
    taken = [_number(p) for p in _versions(df.sparkSession, base, "")]
    path = f"{base.rstrip('/')}/v-{max(taken, default=0) + 1:012d}-{uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


#: Voxels of a bucket of volumes.
BUCKET_VOXELS = 1 << 26


def write_volumes(voxels: DataFrame, base: str, buckets: int | None = None) -> str:
    """Volumes by hash bucket of the study, ready for bucket-pruned scans. Without a number
    of ``buckets`` there is one per ``BUCKET_VOXELS`` rows, which are counted first.

    Ranges over (bucket, study, slice) keep each task inside few buckets, so
    there are about as many files as tasks, and they cut a very large bucket or
    study into as many tasks as it needs.
    """
    buckets = buckets or max(1, -(-voxels.count() // BUCKET_VOXELS))
    bucket = F.pmod(F.xxhash64("study_id"), F.lit(buckets)).cast("int")
    placed = voxels.withColumn("bucket", bucket).repartitionByRange("bucket", "study_id", "z")
    return write_version(placed.sortWithinPartitions("bucket", "study_id", "z", "y", "x"), base, ["bucket"])


def _versions(spark: SparkSession, base: str, marker: str) -> list[str]:
    """Paths below ``base`` of all versions, or of those that hold ``marker``."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/v-*{marker}"))
    paths = [s.getPath() for s in found or []]
    return [(p.getParent() if marker else p).toString() for p in paths]


def _number(path: str) -> int:
    return int(path.rsplit("/v-", 1)[1].split("-")[0])


def latest_version(spark: SparkSession, base: str) -> str | None:
    """Complete version of the highest number below ``base``."""
    return max(_versions(spark, base, "/_SUCCESS"), key=lambda p: (_number(p), p), default=None)


def record_json(columns: dict[str, Column], numbers: Sequence[str] = ()) -> Column:
    """Nested record to JSON text; NaN and infinite ``numbers`` are written as null."""
    def safe(name: str, c: Column) -> Column:
        if name not in numbers:
            return c
        return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)

    return F.to_json(F.struct(*[safe(n, c).alias(n) for n, c in columns.items()]), {"ignoreNullFields": "false"})
