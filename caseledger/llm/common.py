"""Helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage, fresh_path, ship_package

#: Rows of an Arrow batch.
BATCH_ROWS = 1000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``build(spark, sf_dir)`` and, where SQL can say it, its DuckDB twin."""

    def keep(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return keep


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context: they need not have it installed.
    Texts can be long, so Arrow batches are made short where the session has Spark's default."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, read by any executor."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filled(text: str = "text"):
    return F.coalesce(F.col(text), F.lit(""))


def spare(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with."""
    prefix = "_x"
    while any(c.lower().startswith(prefix) for c in df.columns):
        prefix += "x"
    return prefix


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) of a graph given as edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[:len(a)], at[len(a):]
    top = np.arange(len(nodes))
    while True:
        low = np.minimum(top[x], top[y])
        new = top.copy()
        np.minimum.at(new, top[x], low)
        np.minimum.at(new, top[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == top).all():
            break
        top = new
    own = top != np.arange(len(nodes))
    return nodes[own], nodes[top[own]]


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node that an edge (a, b) touches; the component is its
    smallest node. Alternating large-star and small-star steps: each groups edges by
    a node and keeps only the minimum, so a node of any degree is pre-aggregated, and
    each is checkpointed. Stops when the edges are stars, without a limit of rounds."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = cut_lineage(e)
    while True:
        bad = e.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u") \
            .union(e.join(e.select(F.col("u").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi").select("v"))
        if bad.isEmpty():
            break
        both = e.union(e.select("v", "u"))
        low = both.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m")).select("k", F.least("k", "m").alias("m"))
        e = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .where("u <> v").distinct()
        low = e.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        e = e.join(low, F.col("u") == F.col("k")).select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")) \
            .select("x.u", "x.v").where("u <> v").distinct()
        e = cut_lineage(e)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")) \
        .union(e.select("v", "v").distinct())


def tidy() -> None:
    """Gives memory that a task no longer needs back to the system: Spark keeps its worker."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)


def few(batches, rows: int = 1024):
    """The batches in parts of so many rows, so that what a task makes of a part stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def numbered(df: DataFrame, name: str, *order: str, number: str = "position") -> DataFrame:
    """``df`` with each row's place, from 0, in ascending order of columns. Rows are dealt
    by range; only the row count of each partition reaches the driver."""
    kept = saved(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), name)
    base, bases = 0, [F.lit(-1)]
    for part, n in sorted((r[0], r[1]) for r in kept.groupBy("_part").count().collect()):
        bases += [F.lit(part), F.lit(base)]
        base += n
    start = F.create_map(*bases[1:])[F.col("_part")] if len(bases) > 1 else F.lit(0)
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return kept.withColumn(number, (start + nth - 1).cast("long")).drop("_part")
