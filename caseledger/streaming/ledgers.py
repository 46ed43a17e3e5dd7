"""Resumable ledgers as Structured Streaming.

The file source with ``availableNow`` is the resume loop: each run takes what
arrived since the last one, in batches of bounded size, and stops. Every batch
is written as one immutable version folder named after its batch id, so a
replayed batch overwrites itself and the ledger stays exactly-once; the current
ledger is the newest row per key over all versions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.joins import keep_last
from ..operators.ledger import split_good_bad


def arriving_cases(spark: SparkSession, directory: str, schema: T.StructType, pattern: str = "*.parquet",
                   files_per_batch: int | None = None) -> DataFrame:
    """Stream over a case directory; ``files_per_batch`` bounds each batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(directory)


def run_ledger(stream: DataFrame, out: str, version: Sequence[str],
               process: Callable[[DataFrame], DataFrame] = lambda df: df,
               problem: Column | None = None, key: Sequence[str] = ("study_id",)) -> None:
    """Processes all arriving rows into ``out/ledger`` (and ``out/errors``), then stops.

    Within a batch the newest row per key is kept. Rows with a ``problem`` text
    go to the error ledger and the run continues.
    """
    def one_batch(batch: DataFrame, batch_id: int) -> None:
        rows = process(batch).persist()
        good = rows
        if problem is not None:
            good, bad = split_good_bad(rows, problem)
            bad.write.mode("overwrite").parquet(f"{out}/errors/batch={batch_id}")
        keep_last(good, key, version).write.mode("overwrite").parquet(f"{out}/ledger/batch={batch_id}")
        rows.unpersist()

    query = (stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", f"{out}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def current_ledger(spark: SparkSession, out: str, version: Sequence[str],
                   key: Sequence[str] = ("study_id",)) -> DataFrame:
    """Newest row per key over all batches."""
    rows = spark.read.parquet(f"{out}/ledger")
    return keep_last(rows, key, [*version, "batch"]).drop("batch")


def error_ledger(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(f"{out}/errors").drop("batch")


def compact_ledger(spark: SparkSession, out: str, version: Sequence[str], target: str,
                   key: Sequence[str] = ("study_id",)) -> str:
    """Writes the current ledger as one table, so that readers need not fold versions."""
    current_ledger(spark, out, version, key).write.mode("errorifexists").parquet(target)
    return target


def running_counts(stream: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Incremental per-key totals for a progress view of a run."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum(value).alias("total"))
