"""Deterministic samples: stable-hash top-n, class-balanced epochs, patches, block masks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.constants import MASK_BLOCK, MASK_RATIO, PATCH_SHAPE, SEED
from ..functions.scalars import clamp, hash32, hash_between, hash_uniform, stable_rank
from ..session import spread_join
from .ordering import hash_index

AXES = ("x", "y", "z")


def stratified_by_hash(cases: DataFrame, stratum: str, n: int, seed: int = SEED, role: str = "validation",
                       identity: str = "study_id") -> DataFrame:
    """``n`` cases per stratum with the smallest stable hash; map-side limited by the window."""
    w = Window.partitionBy(stratum).orderBy("_key", identity)
    return (cases.withColumn("_key", stable_rank(seed, role, F.col(identity)))
            .withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_key", "_rn"))


def work_queue(pending: DataFrame, n: int, order: Sequence[Column]) -> DataFrame:
    """The next ``n`` items; ORDER BY + LIMIT keeps only ``n`` rows per task."""
    return pending.orderBy(*order).limit(n)


def balanced_epoch(cases: DataFrame, epoch: int, per_class: int, seed: int = SEED,
                   identity: str = "study_id") -> DataFrame:
    """One epoch: ``per_class`` positives with replacement, as many negatives
    without, in hash order. Columns ``(slot_order, slot, identity, label_binary)``."""
    positives = cases.where("label_binary = 1").select(identity)
    numbered = hash_index(positives, [], [identity], "_i")
    size = positives.agg(F.count(F.lit(1)).alias("_n"))
    slots = cases.sparkSession.range(per_class).select(F.col("id").alias("_slot")).join(F.broadcast(size))
    pick = slots.select("_slot", (hash32(F.lit(seed), F.lit("samples"), F.lit(epoch), F.col("_slot"))
                                  % F.col("_n")).alias("_i"))
    with_replacement = pick.join(numbered, "_i").select(
        F.concat(F.lit("p"), F.col("_slot").cast("string")).alias("slot"), identity, F.lit(1).alias("label_binary"))
    # top-n by a hash: each task keeps n rows, the rest never moves
    without = (cases.where("label_binary = 0").select(
        identity, hash32(F.lit(seed), F.lit("samples"), F.lit(epoch), F.col(identity)).alias("_h"))
        .orderBy("_h", identity).limit(per_class)
        .select(F.concat(F.lit("n"), F.col(identity)).alias("slot"), identity, F.lit(0).alias("label_binary")))
    chosen = with_replacement.unionByName(without)
    # 2 * per_class rows, a number set by the caller
    w = Window.orderBy("_o", "slot")
    return (chosen.withColumn("_o", hash32(F.lit(seed), F.lit("order"), F.lit(epoch), F.col("slot")))
            .withColumn("slot_order", F.row_number().over(w).cast("long")).drop("_o"))


def anchor_voxels(voxels: DataFrame, label: Column, seed: int, epoch: int) -> DataFrame:
    """One hash-picked voxel per study among those where ``label`` holds.

    ``min`` of (hash, voxel) is combined before the shuffle.
    """
    key = hash32(F.lit(seed), F.lit("patch"), F.lit(epoch), F.col("study_id"), *[F.col(a) for a in AXES])
    return (voxels.where(label).groupBy("study_id")
            .agg(F.min(F.struct(key.alias("h"), *AXES)).alias("_a"))
            .select("study_id", *[F.col(f"_a.{a}").alias(f"anchor_{a}") for a in AXES]))


def patch_origin(anchors: DataFrame, jitter: Sequence[int], volume: Sequence[int], patch: Sequence[int],
                 seed: int, epoch: int) -> DataFrame:
    """First corner of the patch around a jittered anchor, kept inside the volume."""
    def start(axis: int) -> Column:
        a = AXES[axis]
        move = hash_between(-jitter[axis], jitter[axis], F.lit(seed), F.lit("jitter"), F.lit(epoch),
                            F.col("study_id"), F.lit(a))
        return clamp(F.col(f"anchor_{a}") + move - patch[axis] // 2, 0, volume[axis] - patch[axis])

    return anchors.select("study_id", *[start(i).alias(f"start_{AXES[i]}") for i in range(3)])


def cut_patch(voxels: DataFrame, origins: DataFrame, patch: Sequence[int] = PATCH_SHAPE) -> DataFrame:
    """Voxels of each study's patch, with patch coordinates ``p_x, p_y, p_z``."""
    inside = F.lit(True)
    for i, a in enumerate(AXES):
        inside = inside & (F.col(a) >= F.col(f"start_{a}")) & (F.col(a) < F.col(f"start_{a}") + patch[i])
    return voxels.join(spread_join(origins), "study_id").where(inside).select(
        *voxels.columns, *[(F.col(a) - F.col(f"start_{a}")).alias(f"p_{a}") for a in AXES])


def augment(patch: DataFrame, value: str, shape: Sequence[int], seed: int, epoch: int,
            scale: tuple[float, float], shift: tuple[float, float]) -> DataFrame:
    """Hash-decided flips of the first two axes and intensity scale and shift, per study."""
    def u(role: str) -> Column:
        return hash_uniform(F.lit(seed), F.lit(role), F.lit(epoch), F.col("study_id"))

    def flip(axis: int) -> Column:
        c = F.col(f"p_{AXES[axis]}")
        return F.when(u(f"flip_{AXES[axis]}") < 0.5, shape[axis] - 1 - c).otherwise(c)

    gain = scale[0] + u("scale") * (scale[1] - scale[0])
    offset = shift[0] + u("shift") * (shift[1] - shift[0])
    return patch.select("study_id", flip(0).alias("p_x"), flip(1).alias("p_y"), "p_z",
                        clamp(F.col(value) * gain + offset, -1.0, 1.0).alias(value))


def block_mask(studies: DataFrame, shape: Sequence[int] = PATCH_SHAPE, block: Sequence[int] = MASK_BLOCK,
               ratio: float = MASK_RATIO, seed: int = SEED, epoch: int = 0) -> DataFrame:
    """Hidden blocks per study: exactly ``round(ratio * blocks)``, without repeats.

    The blocks of a patch are a fixed small number, ordered in one array per study.
    """
    counts = [s // b for s, b in zip(shape, block)]
    total = counts[0] * counts[1] * counts[2]
    hidden = int(round(ratio * total))
    ids = F.sequence(F.lit(0), F.lit(total - 1))
    ordered = F.array_sort(F.transform(ids, lambda b: F.struct(
        hash32(F.lit(seed), F.lit("mask"), F.lit(epoch), F.col("study_id"), b).alias("h"), b.alias("b"))))
    picked = studies.select("study_id", F.explode(F.slice(ordered, 1, hidden)).alias("_m"))
    b = F.col("_m.b")
    return picked.select("study_id", F.floor(b / (counts[1] * counts[2])).cast("int").alias("block_x"),
                         (F.floor(b / counts[2]) % counts[1]).cast("int").alias("block_y"),
                         (b % counts[2]).cast("int").alias("block_z"))


def apply_block_mask(voxels: DataFrame, mask: DataFrame, block: Sequence[int] = MASK_BLOCK) -> DataFrame:
    """Adds ``hidden`` to every voxel of the patch."""
    keyed = voxels
    for a, size in zip(AXES, block):
        keyed = keyed.withColumn(f"block_{a}", F.floor(F.col(f"p_{a}") / size).cast("int"))
    keys = ["study_id", "block_x", "block_y", "block_z"]
    return (keyed.join(spread_join(mask.withColumn("hidden", F.lit(True))), keys, "left")
            .withColumn("hidden", F.coalesce("hidden", F.lit(False))).drop(*keys[1:]))
