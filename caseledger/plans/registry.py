"""Registry of queries: a Spark plan and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .viewsql import with_views


@dataclass
class Tables:
    """The study tables below one directory, read lazily and column-pruned."""

    spark: SparkSession
    directory: str
    _seen: dict[str, DataFrame] = field(default_factory=dict)

    def __call__(self, name: str) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = self.spark.read.parquet(f"{self.directory}/{name}.parquet")
        return self._seen[name]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits: sums may be added in any order."""
    return df.select(*[F.round(c.name, digits).alias(c.name) if isinstance(c.dataType, T.DoubleType)
                       else F.col(c.name) for c in df.schema.fields])


def query(name: str, sql: str | None = None, uses: str = "", doubles: str = ""):
    """Registers a plan builder. ``sql`` is its DuckDB twin; ``uses`` names the
    adapter views it reads, which are prepended as common table expressions;
    ``doubles`` names its floating-point columns. The body is a SELECT, or
    starts with a comma and more table expressions."""

    def keep(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: rounded(build(Tables(spark, sf_dir)))
        if sql is not None:
            text = with_views(tuple(uses.split()), sql)
            if doubles:
                fixed = ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0::DOUBLE AS {c}"
                                  for c in doubles.split())
                text = f"SELECT * REPLACE ({fixed}) FROM (\n{text}\n)"
            ORACLES[name] = text
        return build

    return keep
