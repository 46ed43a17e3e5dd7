"""File inventories, integrity inputs and transfer plans."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Sequence
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import crc32_hex
from ..session import ship_package

#: Bytes of the largest file that is held as one row (Spark holds 2 GB at most), and of a piece of larger ones.
WHOLE, PIECE = 1 << 30, 4 << 20


def list_files(spark: SparkSession, directory: str, pattern: str = "*") -> DataFrame:
    """Names and sizes only: the content column is pruned from the scan."""
    scan = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return scan.load(directory).select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"),
                                       F.col("length").alias("size_bytes"))


def hashed_files(spark: SparkSession, directory: str, pattern: str = "*", whole: int = WHOLE) -> DataFrame:
    """Size, SHA-256 and CRC-32 of every file. A file of at most ``whole`` bytes is one row of
    Spark's reader; a larger one is read piece by piece in one task, as SHA-256 must be, and its
    URI has to be one that pyarrow opens. Spark's reader lists no empty files."""
    ship_package(spark)
    scan = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(directory)
    small = hashed_payloads(scan.where(F.col("length") <= whole).select("path", "content"))
    large = scan.where(F.col("length") > whole).select("path")  # no content: nothing is read yet
    return small.unionByName(large.mapInArrow(_hashed_streams, "path string, size_bytes long, sha256 string, crc32_hex string"))


def _hashed_streams(batches):
    for batch in batches:
        for path in batch.column("path").to_pylist():
            scheme, _, rest = path.partition(":")
            source, name = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
            digest, crc, size = hashlib.sha256(), 0, 0
            with source.open_input_stream(name, compression=None) as stream:
                while piece := stream.read(PIECE):
                    digest.update(piece)
                    crc, size = zlib.crc32(piece, crc), size + len(piece)
            yield pa.RecordBatch.from_pydict({"path": [path], "size_bytes": [size], "sha256": [digest.hexdigest()], "crc32_hex": [f"{crc:08x}"]})


def hashed_payloads(payloads: DataFrame) -> DataFrame:
    """The same for payloads that already sit in a table (``path``, ``content``)."""
    return payloads.select("path", F.octet_length("content").cast("long").alias("size_bytes"),
                           F.sha2("content", 256).alias("sha256"), crc32_hex(F.col("content")).alias("crc32_hex"))


def inventory_against_ledger(files: DataFrame, ledger: DataFrame, key: str = "file_name",
                             partial_suffix: str = ".part") -> DataFrame:
    """Files and ledger rows that do not meet: ``missing``, ``unexpected``, ``partial``."""
    a = files.select(key, F.lit(True).alias("_f"))
    b = ledger.select(key, F.lit(True).alias("_l"))
    state = (F.when(F.col("_f").isNull(), "missing")
             .when(F.endswith(F.col(key), F.lit(partial_suffix)), "partial")
             .when(F.col("_l").isNull(), "unexpected"))
    return a.join(b, key, "full_outer").select(key, state.alias("state")).where("state IS NOT NULL")


def crc_check(payloads: DataFrame, expected: DataFrame, key: str = "path") -> DataFrame:
    """Recovered content against the archive's CRC-32 (hex text) and size."""
    want = expected.select(key, F.lower("crc32_hex").alias("_crc"), F.col("size_bytes").alias("_size"))
    return hashed_payloads(payloads).join(want, key).select(
        key, (F.col("crc32_hex") == F.lpad("_crc", 8, "0")).alias("crc_matches"),
        (F.col("size_bytes") == F.col("_size")).alias("size_matches"))


def acquisition_plan(members: DataFrame, sources: DataFrame, key: str, endpoints: Sequence[Column]) -> DataFrame:
    """Each pending member with its ordered, de-duplicated list of endpoints."""
    urls = F.array_distinct(F.array_compact(F.array(*endpoints)))
    return members.join(sources, key).withColumn("endpoints", urls)


def cache_population(manifest: DataFrame, cache: DataFrame, key: str = "path") -> DataFrame:
    """What to copy and what to reuse: a cached file counts only with equal size and hash."""
    have = cache.select(key, F.col("size_bytes").alias("_size"), F.col("sha256").alias("_sha"))
    same = F.coalesce((F.col("size_bytes") == F.col("_size")) & (F.col("sha256") == F.col("_sha")), F.lit(False))
    return manifest.join(have, key, "left").withColumn("reused", same).drop("_size", "_sha")


def cache_totals(populated: DataFrame) -> DataFrame:
    return populated.agg(F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("copied"),
                         F.coalesce(F.sum(F.when(~F.col("reused"), F.col("size_bytes"))), F.lit(0)).alias("missing_bytes"))
