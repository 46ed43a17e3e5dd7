"""Operator 1, exact dedup by content-defined chunk recipes.

Texts are cut where a rolling hash of the last 32 bytes says so. Chunks are
de-duplicated to identifiers, and the bytes behind each identifier are compared
once, in one grouping; where two different chunks share a hash, both get an ordinal.
A text is then its ordered list of identifiers: lists are compared, moved and
grouped, and the documents themselves never move.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage
from .common import few, filled, list_array, query, ship, spare, table
from .words import SLICE, text_buffers

#: Bytes of the shortest and longest chunk (a text's last may be shorter), and the
#: bits of the hash that must be zero at a cut: one place in 4,096.
SHORTEST, LONGEST, CUT_BITS = 1024, 16384, 12
WINDOW = 32

_GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Positions after which a chunk may end."""
    found = []
    for lo in range(0, len(data), SLICE):
        back = min(lo, WINDOW - 1)
        h = _GEAR[data[lo - back:lo + SLICE]]
        step = 1
        while step < WINDOW:  # sums of 1, 2, 4, .. 32 shifted terms
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
            step *= 2
        found.append(np.flatnonzero(h[back:] >> np.uint32(32 - CUT_BITS) == 0) + lo + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_bounds(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunk offsets into the bytes, chunk offsets per text)."""
    places = cut_places(data).tolist()
    cuts, counts = [0], [0]
    for lo, hi in zip(offs[:-1].tolist(), offs[1:].tolist()):
        while hi - lo > SHORTEST:
            at = bisect_left(places, lo + SHORTEST)
            lo = min(places[at] if at < len(places) else hi, lo + LONGEST, hi)
            cuts.append(lo)
        if lo < hi:
            cuts.append(hi)
        counts.append(len(cuts) - 1)
    return np.array(cuts, np.int64), np.array(counts, np.int64)


def _hashes(data: np.ndarray, cuts: np.ndarray, bits: int) -> np.ndarray:
    view, at = memoryview(data), cuts.tolist()
    h = np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(at[:-1], at[1:])), np.uint64, len(at) - 1)
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def _recipes(bits: int):
    def run(batches):
        for batch in few(batches):
            data, offs = text_buffers(batch.column(1))
            cuts, counts = chunk_bounds(data, offs)
            view, at = memoryview(data), offs.tolist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([hashlib.sha256(view[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:])], pa.string()),
                list_array(pa.array(_hashes(data, cuts, bits)), counts)], ["doc_id", "text_sha256", "recipe"])

    return run


def _chunks(bits: int):
    def run(batches):
        for batch in few(batches):
            data, offs = text_buffers(batch.column(1))
            cuts, counts = chunk_bounds(data, offs)
            chunk = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
            owner = np.repeat(np.arange(len(offs) - 1), np.diff(counts))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(owner)), pa.array((np.arange(len(owner)) - counts[owner]).astype(np.int32)),
                pa.array(_hashes(data, cuts, bits)), chunk.cast(pa.binary())], ["doc_id", "place", "hash", "chunk"])

    return run


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when their bytes are; null counts as empty, and all empty texts
    are equal. The largest doc_id of a group stays. A null doc_id is smaller than
    any other; a group of nulls alone keeps them. Rows that repeat a doc_id with the
    same text are each counted and share one verdict. No rows give no rows; other
    columns are not read. ``hash_bits`` below 64 makes hashes collide, for tests.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    recipes = slim.mapInArrow(_recipes(hash_bits), f"doc_id {kind}, text_sha256 string, recipe array<bigint>")
    chunks = slim.mapInArrow(_chunks(hash_bits), f"doc_id {kind}, place int, hash bigint, chunk binary")
    # every identifier is verified: one group per distinct (hash, bytes)
    shared = cut_lineage(chunks.groupBy("hash", "chunk").agg(F.count("*").alias("uses"))
                         .groupBy("hash").agg(F.count("*").alias("contents")).where("contents > 1"))
    if not shared.isEmpty():
        recipes = _with_ordinals(recipes, chunks, shared)
    groups = recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")) \
        .select(F.xxhash64("recipe").alias("k"), F.col("recipe").alias("r"), "keep_id", "group_size")
    # both sides are dealt by (k, recipe), which lets Spark split the rows of a hot group
    out = recipes.withColumn("k", F.xxhash64("recipe"))
    return out.join(groups.withColumnRenamed("k", "gk"), (F.col("k") == F.col("gk")) & (F.col("recipe") == F.col("r"))).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256",
        F.size("recipe").alias("n_chunks"))


def _with_ordinals(recipes: DataFrame, chunks: DataFrame, shared: DataFrame) -> DataFrame:
    """Recipes in which each chunk whose hash has several contents also carries the
    ordinal of its content. Rows are told apart by (doc_id, text_sha256)."""
    hit = chunks.join(shared.select("hash"), "hash", "left_semi")
    ranked = hit.select("hash", "chunk").distinct().withColumn(
        "ordinal", F.row_number().over(Window.partitionBy("hash").orderBy("chunk")).cast("long")) \
        .select("hash", F.col("chunk").alias("c"), "ordinal", F.xxhash64("hash", "chunk").alias("ck"))
    steps = recipes.select("*", F.monotonically_increasing_id().alias("row_no"))
    steps = cut_lineage(steps)
    at = steps.select("row_no", "doc_id", F.posexplode("recipe").alias("place", "hash"))
    marks = hit.withColumn("ck", F.xxhash64("hash", "chunk")).join(ranked.drop("hash"), "ck").where("chunk = c") \
        .select(F.col("doc_id").alias("d"), F.col("place").alias("p"), F.col("hash").alias("h"), "ordinal").distinct()
    full = at.join(marks, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("place") == F.col("p")) & (F.col("hash") == F.col("h")), "left") \
        .groupBy("row_no").agg(F.sort_array(F.collect_list(F.struct("place", "hash", F.coalesce("ordinal", F.lit(0)).alias("o")))).alias("s")) \
        .select("row_no", F.flatten(F.transform("s", lambda x: F.array(x["hash"], x["o"]))).alias("full"))
    return steps.join(full, "row_no", "left").select(
        "doc_id", "text_sha256", F.coalesce("full", F.col("recipe")).alias("recipe"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns as they were."""
    own = spare(docs)
    kept = exact_dedup(docs).where("kept").select(F.col("doc_id").alias(own + "id"), F.col("text_sha256").alias(own + "sha"))
    marked = docs.withColumn(own, F.sha2(filled(), 256))
    return marked.join(kept, marked["doc_id"].eqNullSafe(kept[own + "id"]) & (marked[own] == kept[own + "sha"]), "left_semi") \
        .dropDuplicates(["doc_id", own]).drop(own)


@query("op1_exact_dedup", """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("n_chunks")
