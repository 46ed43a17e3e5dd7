"""Operator 12, filter interaction audit by contingency tensor contractions.

Five filters mark every document with five bits. All that any order of the filters
can do to a part of the corpus lies in its contingency tensor: documents, good
and toxic ones by (fails A, fails B, .., fails E), 2x2x2x2x2. Documents are counted
into tensors by Spark; a contraction of each with one vector per axis (pass, fail or
all) then gives each step of each order, without reading documents again.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import query, saved, ship, table

FILTERS = "ABCDE"
MEASURES = ("docs", "good", "toxic")
#: Parts whose tensors are contracted together.
PARTS = 64

PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> Column:
    """Failures of A (short), B (repeats words), C (shouts), D (symbols) as bits 0 to 3.

    Words are cut at one kind of blank, which needs no regular expression; a text of
    blanks alone has none of them and fails A only."""
    found = F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")
    words, distinct = F.size(found), F.size(F.array_distinct(found))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    bits = [words < 200, F.lit(100) * distinct < F.lit(50) * words,
            F.lit(100) * capitals > F.lit(3) * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0))


def tensors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, cells): for each part its cells of (mask, docs, good, toxic), 32 at most.

    E fails where a smaller doc_id has the same text (told by SHA-256). The rows that
    pass it are found as the minimum of each text, which every task takes ahead of the
    shuffle, so a text that fills the corpus is no hot key; those that fail are the rest.
    A row without doc_id is neither smaller than another nor behind one, and passes.
    """
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    facts = docs.select("doc_id", F.coalesce(F.col("lang"), F.lit("")).alias("part"), text.alias("text")).select(
        "doc_id", "part", text_failures(F.col("text")).alias("bits"), F.sha2("text", 256).alias("sha")) \
        .groupBy("doc_id", "part", "bits", "sha").agg(F.count("*").alias("n"))
    facts = saved(facts, "filter-facts")
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    known = facts.where("doc_id is not null").join(marks, F.col("doc_id") == F.col("label_id"), "left").drop("label_id").fillna(0, ["good", "toxic"])
    unknown = facts.where("doc_id is null").select("*", F.lit(0).alias("good"), F.lit(0).alias("toxic"))
    # an id that occurs twice with one text may lie in two parts
    first = known.groupBy("sha", "doc_id", "bits", "good", "toxic").agg(F.collect_list(F.struct("part", "n")).alias("at")) \
        .groupBy("sha").agg(F.min(F.struct("doc_id", "at", "bits", "good", "toxic")).alias("f")).select("f.*") \
        .select("*", F.explode("at").alias("x")).select("x.part", "bits", "x.n", "good", "toxic")
    sums = [F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")]
    every = known.groupBy("part", "bits").agg(*sums)
    passed = first.unionByName(unknown.select("part", "bits", "n", "good", "toxic")).groupBy("part", "bits").agg(*sums)
    all_rows = every.unionByName(unknown.groupBy("part", "bits").agg(*sums))
    less = [(-F.col(m)).alias(m) for m in MEASURES]
    cells = passed.select("part", "bits", *MEASURES) \
        .unionByName(all_rows.select("part", (F.col("bits") + 16).alias("bits"), *MEASURES)) \
        .unionByName(passed.select("part", (F.col("bits") + 16).alias("bits"), *less)) \
        .groupBy("part", F.col("bits").alias("mask")).agg(*(F.sum(m).alias(m) for m in MEASURES))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))


def _selectors() -> dict[str, np.ndarray]:
    """For each count, the vector that each (order, step) lays on each axis: steps x 5 x 2."""
    shape = (len(ORDERS) * 5, 5, 2)
    out = {name: np.empty(shape, np.int64) for name in ("kept", "removed", "failing", "unique")}
    for i, order in enumerate(ORDERS):
        for step in range(5):
            at = i * 5 + step
            for place, letter in enumerate(order):
                axis = FILTERS.index(letter)
                before, here = place < step, place == step
                out["kept"][at, axis] = PASS if before or here else ALL
                out["removed"][at, axis] = PASS if before else FAIL if here else ALL
                out["failing"][at, axis] = FAIL if here else ALL
                out["unique"][at, axis] = FAIL if here else PASS
    return out


def contract(tensor: np.ndarray) -> np.ndarray:
    """Counts of every step from tensors (parts, measures, 2, 2, 2, 2, 2), axes A to E:
    an array (parts, 600 steps, 7), in the order of ``ORDERS`` and ``COUNTS``."""
    def pick(vectors: np.ndarray) -> np.ndarray:
        return np.einsum("pmabcde,sa,sb,sc,sd,se->psm", tensor, *(vectors[:, axis] for axis in range(5)), optimize=True)

    at = _selectors()
    removed, failing = pick(at["removed"]), pick(at["failing"])
    own = np.array([FILTERS.index(letter) for order in ORDERS for letter in order])
    by_filter = np.stack([removed[:, own == f, 0].sum(1) for f in range(5)], 1)  # over all orders, at any step
    return np.stack([pick(at["kept"])[..., 0], removed[..., 0], (failing - removed)[..., 0], pick(at["unique"])[..., 0],
                     removed[..., 1], removed[..., 2], by_filter[:, own]], -1)


def _steps(batches):
    orders, steps = np.repeat(ORDERS, 5), np.tile(np.arange(1, 6, dtype=np.int32), len(ORDERS))
    for whole in batches:
        for lo in range(0, whole.num_rows, PARTS):
            batch = whole.slice(lo, PARTS)
            tensor = np.zeros((batch.num_rows, len(MEASURES), 32), np.int64)
            for p, cells in enumerate(batch.column(1).to_pylist()):
                for cell in cells:
                    tensor[p, :, cell["mask"]] = [cell[m] for m in MEASURES]
            # bit 0 is A; C order makes the last axis the lowest bit
            tensor = tensor.reshape(-1, len(MEASURES), 2, 2, 2, 2, 2).transpose(0, 1, 6, 5, 4, 3, 2)
            counts = contract(tensor)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(n), len(orders)))), pa.array(np.tile(orders, n), pa.string()), pa.array(np.tile(steps, n))]
                + [pa.array(np.ascontiguousarray(counts[..., i]).ravel()) for i in range(len(COUNTS))], ["part", "filter_order", "step", *COUNTS])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part (value of ``lang``), order of the five filters and step: part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Null text is empty, null lang the part ''. Rows are counted as they come, repeated
    ones too; a repeated row (same doc_id) is no copy of itself and passes E. A row
    without doc_id has no label and passes E. A document is good (toxic) if any of its
    label rows says 1. No rows give no rows; columns but doc_id, text and lang are not read.
    """
    rows = ", ".join(["part string, filter_order string, step int", *(f"{c} bigint" for c in COUNTS)])
    return tensors(docs, labels).mapInArrow(_steps, rows)


_BITS = {"A": "a", "B": "b", "C": "c", "D": "d", "E": "e"}


def _sql() -> str:
    """The same by plain counting: every order, step and cell is a row."""
    letters = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
    orders = " CROSS JOIN ".join(f"{letters} t{i}(f{i})" for i in range(1, 6))
    apart = " AND ".join(f"f{i} <> f{j}" for i in range(1, 6) for j in range(i + 1, 6))
    fails = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _BITS.items()) + " END"
    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
parsed AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
         CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 1 ELSE 0 END AS e FROM texts),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id),
bits AS (
  SELECT part, CASE WHEN len(w) < 200 THEN 1 ELSE 0 END AS a,
         CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 1 ELSE 0 END AS b,
         CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 1 ELSE 0 END AS c,
         CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS d, e,
         coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM parsed LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, a, b, c, d, e, count(*) AS n, sum(good) AS g, sum(toxic) AS x FROM bits GROUP BY ALL),
orders AS (SELECT f1, f2, f3, f4, f5, f1 || f2 || f3 || f4 || f5 AS filter_order FROM {orders} WHERE {apart}),
told AS (
  SELECT part, filter_order, step, n, g, x, a + b + c + d + e AS failures,
         list_extract([f1, f2, f3, f4, f5], step) AS f,
         {fails.format('list_extract([f1, f2, f3, f4, f5], step)')} AS here,
         {' + '.join(f"CASE WHEN step > {i} THEN {fails.format(f'f{i}')} ELSE 0 END" for i in range(1, 5))} AS before
  FROM cells CROSS JOIN orders CROSS JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
counted AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN before = 0 AND here = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN before = 0 AND here = 1 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN before > 0 AND here = 1 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN here = 1 AND failures = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN before = 0 AND here = 1 THEN g ELSE 0 END) AS good_lost,
         sum(CASE WHEN before = 0 AND here = 1 THEN x ELSE 0 END) AS toxic_lost
  FROM told GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""


@query("op12_filter_audit", _sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
