"""Operator 10, sharding by histogram sort; DataFrame functions only.

Rows are ordered by a hash of their text, so that equal texts are neighbours.
Splitters of near equal bytes are found by counting: each round sums exact bytes
between candidate boundaries and looks closer only where a splitter must lie,
until each is near enough to its goal or the boundaries can't be finer. Then the
rows are exchanged once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import query, saved, table

#: Bits of the key that a round resolves: at most 2**12 sums per splitter reach the driver.
BITS = 12


def splitters(slim: DataFrame, shards: int, tolerance: float) -> list[int]:
    """Keys at which a new shard begins: ``shards - 1`` of them, ascending. Each cuts
    the bytes within ``tolerance`` of a shard's share from its goal, unless one key
    alone holds more than that."""
    total = slim.agg(F.sum("size")).first()[0] or 0
    goals = [total * j / shards for j in range(1, shards)]
    found: dict[int, int] = {}
    # open ranges: prefix of the key -> (bytes below it, goals inside)
    ranges, left = {None: (0, list(range(len(goals))))}, 64
    while ranges and total:
        step = min(BITS, left)
        below = F.shiftright("key", left) if left < 64 else F.lit(None).cast("long")
        rows = slim if left == 64 else slim.where(F.shiftright("key", left).isin(list(ranges)))
        cell = F.shiftright("key", left - step)
        sums = rows.groupBy(below.alias("range"), cell.alias("cell")).agg(F.sum("size").alias("bytes")).collect()
        left -= step
        inside: dict = {}
        for r in sums:
            inside.setdefault(r["range"], []).append((r["cell"], int(r["bytes"])))
        following: dict = {}
        for name, (base, mine) in ranges.items():
            at, cells = base, sorted(inside[name])
            for cell_no, amount in cells:
                for j in [j for j in mine if at <= goals[j] < at + amount]:
                    low, high = goals[j] - at, at + amount - goals[j]
                    if min(low, high) <= tolerance * total / shards or left == 0:
                        found[j] = (cell_no if low <= high else cell_no + 1) << left
                    else:
                        following.setdefault(cell_no, (at, []))[1].append(j)
                at += amount
        ranges = following
    return [min(found.get(j, 0), 2**63 - 1) for j in range(len(goals))]


def shard_by_bytes(docs: DataFrame, shards: int = 16, tolerance: float = 0.002, run_rows: int = 2048,
                   doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, shard, slot.

    Size is the text's UTF-8 bytes plus one; null counts as none. Equal texts share
    a shard. Slots of a shard run from 0 without gaps, ordered inside runs of about
    ``run_rows`` rows by key and doc_id (nulls first); rows that repeat another take
    slots of their own. No rows give no rows; other columns are not read.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    slim = saved(docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(value) + F.lit(1)).cast("long").alias("size"),
                             F.crc32(F.encode(value, "UTF-8")).cast("long").alias("text_crc32"), F.xxhash64(value).alias("key")), "shards")
    shard = sum((F.when(F.col("key") >= F.lit(s), 1).otherwise(0) for s in splitters(slim, shards, tolerance)), F.lit(0))
    placed = slim.withColumn("shard", shard.cast("int"))
    rows = placed.groupBy("shard").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    placed = placed.withColumn("run", F.pmod(F.xxhash64("doc_id", "key"), F.lit(-(-rows // run_rows) or 1)))
    runs = placed.groupBy(F.col("shard").alias("s"), F.col("run").alias("r")).agg(F.count("*").alias("n")) \
        .withColumn("base", F.sum("n").over(Window.partitionBy("s").orderBy("r")) - F.col("n"))
    inside = Window.partitionBy("shard", "run").orderBy("key", "doc_id")
    return placed.withColumn("nth", F.row_number().over(inside)) \
        .join(runs, (F.col("shard") == F.col("s")) & (F.col("run") == F.col("r"))) \
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("nth") - 1).alias("slot"))


@query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
