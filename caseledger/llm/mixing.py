"""Operator 2, mixing sources to target weights by entropy balancing.

Document rates are the ones nearest to 1 in relative entropy, within 0 and 3,
whose expected words meet each source's target. The dual has one multiplier per
source: a document of x mean sizes gets the rate min(3, exp(lambda x)). Newton
steps on the multipliers, with a bracket, sum over cells of equal (source, size),
which is exact because a rate depends on nothing else, in integers, so that reruns
agree. Cells are rounded to whole copies, the residual words carried from large
sizes to small; inside a cell a hash of the doc_id says who gets one more.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import cut_lineage
from .common import filled, numbered, query, saved, ship, spare, table

MOST_COPIES = 3
#: Weights of sources in code-point order, repeated.
WEIGHTS = (1, 2, 3)
#: Rates are summed as multiples of 2**-30.
UNIT = 1 << 30
#: Multipliers tried in a round: the Newton point, and those that cut the bracket here.
BRACKET = (1 / 16, 1 / 2, 15 / 16)
CUTS = 1 + len(BRACKET)
#: Rows of a (source, size) cell that are ranked together.
RANK_ROWS = 512


def n_words(text: str = "text"):
    return F.regexp_count(filled(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _key(source: str):
    """A source as a key that is never null: null sorts last."""
    return F.coalesce(F.concat(F.lit("0"), F.col(source)), F.lit("1"))


def source_targets(cells: DataFrame) -> DataFrame:
    """key, source_size, docs, target: shares of all words by weight, none above
    MOST_COPIES times its source; what is cut is shared again among the others."""
    sums = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    sums = numbered(sums, "sources", "key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("position") % len(WEIGHTS) + 1).cast("int"))
    sums = cut_lineage(sums.withColumn("weight", weight).drop("position"))
    total = sums.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    cap = F.col("source_size") * MOST_COPIES
    while True:
        full = cap < F.col("weight") * level
        row = sums.agg(F.sum(F.when(full, 1).otherwise(0)).alias("n"), F.sum(F.when(full, cap).otherwise(0)).alias("cut"),
                       F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if row["n"] is None or row["n"] == capped or not row["open"]:
            break
        level, capped = (total - row["cut"]) / row["open"], row["n"]
    return sums.withColumn("target", F.least(cap.cast("double"), F.col("weight") * level)).drop("weight")


def multipliers(cells: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with each source's lambda: expected words meet the target to half a word."""
    mean = F.col("source_size") / F.col("docs")
    top, bottom = mean * math.log(MOST_COPIES), mean * F.log(F.col("target") / F.col("source_size"))
    state = targets.where("source_size > 0").select(
        "*", F.when(F.col("target") >= F.col("source_size"), 0.0).otherwise(bottom).alias("lo"),
        F.when(F.col("target") >= F.col("source_size"), top).otherwise(0.0).alias("hi"))
    state = cut_lineage(state.select("*", F.when(F.col("target") >= F.col("source_size") * MOST_COPIES, F.col("hi")).otherwise(0.0).alias("lam"),
                                     F.lit(False).alias("done")))
    while not state.where("not done").isEmpty():
        points = [F.col("lam")] + [F.col("lo") + (F.col("hi") - F.col("lo")) * part for part in BRACKET]
        tried = state.where("not done").select("*", *[p.alias(f"p{i}") for i, p in enumerate(points)])
        rows = cells.join(tried.select(F.col("key").alias("k"), (F.lit(1.0) / (F.col("source_size") / F.col("docs"))).alias("per"),
                                       *[f"p{i}" for i in range(CUTS)]), F.col("key") == F.col("k"))
        x = F.col("size") * F.col("per")
        sums = []
        for i in range(CUTS):
            # beyond the bound a larger exponent changes nothing, and it can't overflow
            rate = F.exp(F.least(F.col(f"p{i}") * x, F.lit(math.log(MOST_COPIES))))
            whole = (F.round(rate * UNIT) * F.col("size")).cast("decimal(38,0)") * F.col("n")
            slope = F.when(F.col(f"p{i}") * x < math.log(MOST_COPIES), F.round(rate * x * UNIT) * F.col("size")).otherwise(0)
            sums += [(F.sum(whole) / F.lit(UNIT)).cast("double").alias(f"f{i}"),
                     (F.sum(slope.cast("decimal(38,0)") * F.col("n")) / F.lit(UNIT)).cast("double").alias(f"g{i}")]
        got = tried.join(rows.groupBy("k").agg(*sums), F.col("key") == F.col("k")).drop("k")
        best = F.array_min(F.array(*[F.struct(F.coalesce(F.abs(F.log(F.col(f"f{i}") / F.col("target"))), F.lit(1e300)).alias("ratio"), F.col(f"p{i}").alias("p"),
                                              F.col(f"f{i}").alias("f"), F.col(f"g{i}").alias("g")) for i in range(CUTS)]))
        got = got.select("*", best.alias("best")).select(
            "key", "source_size", "docs", "target", "best",
            F.greatest("lo", *[F.when(F.col(f"f{i}") <= F.col("target"), F.col(f"p{i}")) for i in range(CUTS)]).alias("lo"),
            F.least("hi", *[F.when(F.col(f"f{i}") > F.col("target"), F.col(f"p{i}")) for i in range(CUTS)]).alias("hi"))
        # Newton on the logarithm of the words, which is nearly linear
        step = F.col("best.p") + F.log(F.col("target") / F.col("best.f")) * F.col("best.f") / F.col("best.g")
        done = (F.abs(F.col("best.f") - F.col("target")) <= 0.5) | (F.col("hi") - F.col("lo") <= 1e-13 * (F.abs("hi") + 1))
        inside = (F.col("best.g") > 0) & (F.col("best.f") > 0) & (step > F.col("lo")) & (step < F.col("hi"))
        got = got.select("key", "source_size", "docs", "target", "lo", "hi",
                         F.when(done, F.col("best.p")).when(inside, step).otherwise((F.col("lo") + F.col("hi")) / 2).alias("lam"), done.alias("done"))
        state = cut_lineage(state.where("done").unionByName(got))
    return targets.join(state.select("key", "lam"), "key", "left").fillna(0.0, ["lam"])


def _round_cells(cells: pd.DataFrame) -> pd.DataFrame:
    """Copies of each size class of one source, largest first: each class takes the
    copies that bring the words taken so far nearest to the words due so far."""
    cells = cells.sort_values("size", ascending=False, ignore_index=True)
    due, taken, copies = 0.0, 0, []
    for size, n, lam, per in zip(cells["size"].tolist(), cells["n"].tolist(), cells["lam"].tolist(), cells["per"].tolist()):
        if size == 0:
            copies.append(n)
            continue
        due += n * size * math.exp(min(lam * size * per, math.log(MOST_COPIES)))
        copies.append(min(max(round((due - taken) / size), 0), MOST_COPIES * n))
        taken += copies[-1] * size
    cells["base"] = [c // n for c, n in zip(copies, cells["n"].tolist())]
    cells["extra"] = [c % n for c, n in zip(copies, cells["n"].tolist())]
    return cells[["key", "size", "n", "base", "extra"]]


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    Null text has size 0; a document of size 0 is taken once and adds nothing. Null
    is a source of its own, after all others. Equal rows are rounded apart, so that
    their sum is right, by an arbitrary but fixed order. No rows give no rows; other
    columns are not read.
    """
    ship(docs.sparkSession)
    slim = saved(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), n_words(text).alias("size")), "sizes")
    slim = slim.withColumn("key", _key("source"))
    cells = saved(slim.groupBy("key", "size").agg(F.count("*").alias("n")), "cells")
    rates = cut_lineage(multipliers(cells, source_targets(cells)))
    plan = cells.join(rates, "key").select("key", "size", "n", "lam", F.coalesce(F.col("docs") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0)).alias("per"))
    plan = plan.groupBy("key").applyInPandas(_round_cells, "key string, size long, n long, base long, extra long")
    plan = plan.withColumn("runs", F.ceil(F.col("n") / RANK_ROWS)).join(rates.select("key", "source_size", "target"), "key").withColumn("k", F.xxhash64("key", "size"))
    plan = saved(plan, "plan")
    mine = plan.select("k", F.col("key").alias("pk"), F.col("size").alias("ps"), "base", "extra", "runs", "source_size", "target")
    draw = F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << 40))
    # a cell of many rows is ranked in runs of its hash order; the join is one Spark can split
    rows = slim.withColumn("rk", F.xxhash64("key", "size")).join(mine, (F.col("rk") == F.col("k")) & (F.col("key") == F.col("pk")) & (F.col("size") == F.col("ps"))) \
        .withColumn("draw", draw).withColumn("run", F.floor(F.col("draw") * F.col("runs") / F.lit(1 << 40))) \
        .select("doc_id", "source", "key", "size", "base", "extra", "source_size", "target", "draw", "run")
    before = rows.groupBy(F.col("key").alias("bk"), F.col("size").alias("bs"), F.col("run").alias("br")).agg(F.count("*").alias("here")) \
        .withColumn("before", F.sum("here").over(Window.partitionBy("bk", "bs").orderBy("br")) - F.col("here")).drop("here")
    nth = F.row_number().over(Window.partitionBy("key", "size", "run").orderBy("draw", "doc_id"))
    out = rows.withColumn("nth", nth).join(before, (F.col("key") == F.col("bk")) & (F.col("size") == F.col("bs")) & (F.col("run") == F.col("br")))
    copies = F.col("base") + F.when(F.col("before") + F.col("nth") <= F.col("extra"), 1).otherwise(0)
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeat_mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it, all columns as they were.
    Rows that share doc_id, source and size share their copies out among themselves."""
    own = spare(docs)
    name = {c: own + c for c in ("id", "k", "s", "copies", "rows", "key", "size", "each", "copy")}
    take = mix(docs).groupBy("doc_id", _key("source").alias("key"), "size").agg(F.sum("copies").alias(name["copies"]), F.count("*").alias(name["rows"])) \
        .withColumnsRenamed({"doc_id": name["id"], "key": name["k"], "size": name["s"]})
    marked = docs.withColumns({name["key"]: _key("source"), name["size"]: n_words()})
    both = marked.join(take, marked["doc_id"].eqNullSafe(take[name["id"]]) & (F.col(name["key"]) == F.col(name["k"])) & (F.col(name["size"]) == F.col(name["s"])))
    nth = F.row_number().over(Window.partitionBy("doc_id", name["key"], name["size"]).orderBy("text"))
    copies, rows = F.col(name["copies"]), F.col(name["rows"])
    each = F.floor(copies / rows) + F.when(nth <= copies % rows, 1).otherwise(0)
    return both.withColumn(name["each"], each.cast("int")).where(F.col(name["each"]) > 0) \
        .withColumn(name["copy"], F.explode(F.sequence(F.lit(1), F.col(name["each"])))).select(*docs.columns)


@query("op2_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
