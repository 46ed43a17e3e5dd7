"""Session and reliable-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "caseledger", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every query here relies on.

    Cluster sizing (executors, memory, shuffle partitions) stays with the
    submitter; only semantics-bearing settings are fixed.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder for checkpoints and ledgers.

    A folder of our own is made only where the session names none (local masters
    only); executors on other machines could not read that one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(own)
    return own


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, never reused folder for one run's table below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context: those that run its Python need not
    have it installed."""
    context = spark.sparkContext
    if getattr(context, "_caseledger_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    name = f"{os.path.realpath(tempfile.mkdtemp(prefix='spark-ship-'))}/caseledger.zip"  # served as long as the context lives
    with zipfile.ZipFile(name, "w") as bundle:
        for source in sorted((top / "caseledger").rglob("*.py")):
            bundle.write(source, source.relative_to(top))
    context.addPyFile(name)
    context._caseledger_shipped = True


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash-partitions into the full number of shuffle partitions.

    Used right before rows are multiplied (replicates, grid points): adaptive
    execution merges partitions by their present bytes and cannot see the rows
    to come, but it leaves a partition count that was asked for alone.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *columns)


def spread_join(df: DataFrame) -> DataFrame:
    """One side of a join of voxels, which is never broadcast: Spark estimates unfolded arrays
    by the size of their file, so a table far too large for a driver may look small."""
    return df.hint("merge")
