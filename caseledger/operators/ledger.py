"""Resumable ledgers: validated completion, upsert, error resolution, run state."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.constants import IMPROVEMENT_MARGIN
from ..session import cut_lineage
from .ordering import BAND, rank_within, with_band


def validated_done(ledger: DataFrame, locks: DataFrame, inventory: DataFrame,
                   key: Sequence[str] = ("study_id",)) -> DataFrame:
    """Ids that may be skipped on resume: the stored hash, signature, threshold and
    payload count still agree with the locks and the file inventory.

    ``locks`` is one row (``signature``, ``threshold``), else the query fails; ``inventory``
    has ``sha256`` and ``payload_rows`` per id.
    """
    have = inventory.select(*key, F.col("sha256").alias("_sha"), F.col("payload_rows").alias("_rows"))
    one = F.when(F.count(F.lit(1)) == 1, F.first(F.struct("signature", "threshold"))).otherwise(F.raise_error(F.lit("there must be one lock row")))
    lock = F.broadcast(locks.agg(one.alias("_l")).select(F.col("_l.signature").alias("_sig"), F.col("_l.threshold").alias("_thr")))  # one row
    locked = (F.col("signature") == F.col("_sig")) & (F.abs(F.col("threshold") - F.col("_thr")) <= 1e-12)
    stored = (F.col("sha256") == F.col("_sha")) & (F.col("payload_rows") == F.col("_rows"))
    return ledger.join(have, list(key)).where(stored).join(lock, locked).select(*key).distinct()


def upsert(ledger: DataFrame, new: DataFrame, key: Sequence[str] = ("study_id",)) -> DataFrame:
    """All ledger rows of the arriving keys are replaced by the new rows."""
    kept = ledger.join(new.select(*key).distinct(), list(key), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def resolve_errors(errors: DataFrame, final: DataFrame, key: Sequence[str] = ("study_id",)) -> DataFrame:
    """An old error is resolved once its id is in the final ledger."""
    done = final.select(*key).distinct().withColumn("_done", F.lit(True))
    return errors.join(done, list(key), "left").withColumn(
        "resolution", F.when(F.col("_done"), "RESOLVED").otherwise("UNRESOLVED")).drop("_done")


def run_state(target: Column, completed: Column, errors: Column) -> Column:
    return (F.when(errors > 0, "STOPPED_WITH_ERROR").when(completed == target, "COMPLETE").otherwise("INCOMPLETE"))


def best_so_far(history: DataFrame, key: str = "arm", order: str = "epoch", score: str = "score",
                margin: float = IMPROVEMENT_MARGIN, fold_rows: int = 20_000) -> DataFrame:
    """Improvements per arm: ``(arm, epoch, score)`` of every new best.

    A score counts only if it beats the *last accepted* best by more than
    ``margin``, so the chain depends on its own past. An accepted score always
    exceeds every score before it; those records are found with banded running
    maxima first, spread over tasks, and only they enter the ordered fold. An
    arm with more than ``fold_rows`` records is folded in consecutive chunks,
    each starting from the best the one before it left.
    """
    records = cut_lineage(_running_records(history, key, order, score))
    longest = records.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if longest <= fold_rows:
        return _fold(records, None, key, order, score, margin)
    chunked = cut_lineage(rank_within(records, [key], [(order, True)], "_n").withColumn(
        "_chunk", F.floor((F.col("_n") - 1) / fold_rows)).drop("_n"))
    gains = None
    for chunk in range(-(-longest // fold_rows)):
        last = None if gains is None else gains.groupBy(key).agg(F.max(score).alias("_best"))
        found = cut_lineage(_fold(chunked.where(F.col("_chunk") == chunk), last, key, order, score, margin))
        gains = found if gains is None else gains.unionByName(found)
    return gains


def _fold(records: DataFrame, last: DataFrame | None, key: str, order: str, score: str, margin: float) -> DataFrame:
    """Accepted records in order, starting from ``last`` (one ``_best`` per key)."""
    rows = records.groupBy(key).agg(F.array_sort(F.collect_list(
        F.struct(F.col(order).alias("o"), F.col(score).cast("double").alias("s")))).alias("_r"))
    rows = rows.withColumn("_best", F.lit(None).cast("double")) if last is None else rows.join(last, key, "left")

    def step(acc, x):
        best = F.when(F.size(acc) > 0, F.get(acc, F.size(acc) - 1)["s"]).otherwise(F.col("_best"))
        return F.when(best.isNull() | (x["s"] > best + margin), F.array_append(acc, x)).otherwise(acc)

    chain = F.aggregate("_r", F.slice("_r", 1, 0), step)
    return rows.select(key, F.explode(chain).alias("_c")).select(
        key, F.col("_c.o").alias(order), F.col("_c.s").alias(score))


def _running_records(history: DataFrame, key: str, order: str, score: str) -> DataFrame:
    """Rows whose score exceeds all earlier scores of their key."""
    banded = with_band(history.select(key, order, score), [(order, True)])
    before = Window.partitionBy(key, BAND).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = banded.withColumn("_b", F.max(score).over(before)).where(
        F.col("_b").isNull() | (F.col(score) > F.col("_b")))
    tops = banded.groupBy(key, BAND).agg(F.max(score).alias("_m"))
    earlier = Window.partitionBy(key).orderBy(BAND).rowsBetween(Window.unboundedPreceding, -1)
    offsets = tops.select(key, BAND, F.max("_m").over(earlier).alias("_e"))
    return local.join(offsets, [key, BAND]).where(
        F.col("_e").isNull() | (F.col(score) > F.col("_e"))).select(key, order, score)


def best_with_stall(history: DataFrame, checked: str, key: str = "arm", order: str = "epoch",
                    score: str = "score", margin: float = IMPROVEMENT_MARGIN) -> DataFrame:
    """Per arm: best score, its epoch, checks in all and checks since the best."""
    seen = history.where(F.col(checked))
    gains = best_so_far(seen, key, order, score, margin)
    best = gains.groupBy(key).agg(F.max(F.struct(F.col(order).alias("o"), F.col(score).alias("s"))).alias("_b"),
                                  F.count(F.lit(1)).alias("improvements"))
    best = best.select(key, F.col("_b.o").alias("best_epoch"), F.col("_b.s").alias("best_score"), "improvements")
    return seen.join(best, key).groupBy(key, "best_epoch", "best_score", "improvements").agg(
        F.count(F.lit(1)).alias("checks"),
        F.count_if(F.col(order) > F.col("best_epoch")).alias("checks_without_improvement"))


def split_good_bad(rows: DataFrame, problem: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without a problem text, and quarantined rows with it."""
    marked = rows.withColumn("error", problem)
    return marked.where(F.col("error").isNull()).drop("error"), marked.where(F.col("error").isNotNull())
