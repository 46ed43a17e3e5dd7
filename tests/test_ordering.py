"""Banded totals, ranks and percentiles on hot keys, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from caseledger.operators import ordering as od


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows, and one value of it half of those."""
    rng = random.Random(11)
    rows = [("hot", 0.5 if rng.random() < 0.5 else round(rng.random(), 3), i) for i in range(3000)]
    rows += [(f"k{i % 20}", round(rng.random(), 2), 10_000 + i) for i in range(600)]
    return rows, spark.createDataFrame(rows, "k string, v double, i long").repartition(6)


@pytest.mark.parametrize("hot_rows", [100, 10**9])
@pytest.mark.parametrize("up", [True, False])
def test_rank_within_hot_key(skewed, hot_rows, up):
    rows, df = skewed
    got = {(r.k, r.i): r.n for r in od.rank_within(df, ["k"], [("v", up), ("i", True)], "n", hot_rows=hot_rows).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        part = sorted((r for r in rows if r[0] == key), key=lambda r: ((r[1] if up else -r[1]), r[2]))
        want.update({(key, r[2]): n for n, r in enumerate(part, 1)})
    assert got == want


def test_heavy_value_is_cut_by_the_next_column(skewed):
    _, df = skewed
    banded = od.with_band(df.where("k = 'hot'"), [("v", True), ("i", True)], 16)
    largest = banded.groupBy(od.BAND).count().agg(F.max("count")).first()[0]
    assert largest < 3000 / 4  # half of the rows share one value
    # bands rise along the order
    ends = banded.groupBy(od.BAND).agg(F.min(F.struct("v", "i")).alias("a"), F.max(F.struct("v", "i")).alias("b")).orderBy(od.BAND).collect()
    assert all(x.b <= y.a for x, y in zip(ends, ends[1:]))


@pytest.mark.parametrize("hot_rows", [100, 10**9])
def test_global_running_totals(skewed, hot_rows):
    rows, df = skewed
    got = {r.i: r.t for r in od.running_totals(df.withColumn("one", F.lit(1).cast("long")), [],
                                               [("v", False), ("i", True)], {"t": "one"}, hot_rows=hot_rows).collect()}
    order = sorted(rows, key=lambda r: (-r[1], r[2]))
    assert got == {r[2]: n for n, r in enumerate(order, 1)}


@pytest.mark.parametrize("hot_rows", [10, 10**9])
def test_text_order(spark, hot_rows):
    names = [f"dir/{c}{i}" for c in "zab" for i in range(40)] + ["é", "Z"]
    df = spark.createDataFrame([(n,) for n in names], "p string").repartition(5)
    got = {r.p: r.n for r in od.rank_within(df, [], [("p", True)], "n", hot_rows=hot_rows).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda s: s.encode()), 1)}


@pytest.mark.parametrize("hot_rows", [100, 10**9])
def test_exact_percentiles(skewed, hot_rows):
    import numpy as np

    rows, df = skewed
    probs = [0.0, 0.01, 0.5, 0.95, 1.0]
    got = {(r.k, r.p): r.percentile_value
           for r in od.exact_percentiles(df, ["k"], "v", probs, hot_rows=hot_rows).collect()}
    for key in {r[0] for r in rows}:
        want = np.percentile([r[1] for r in rows if r[0] == key], [100 * p for p in probs])
        assert [got[(key, p)] for p in probs] == pytest.approx(list(want))


def test_hash_index_is_dense(skewed):
    _, df = skewed
    got = od.hash_index(df, ["k"], ["i"], "n").groupBy("k").agg(
        F.count("*").alias("c"), F.min("n").alias("a"), F.max("n").alias("b"), F.count_distinct("n").alias("d")).collect()
    assert all(r.a == 0 and r.b == r.c - 1 and r.d == r.c for r in got)


def test_band_input_is_read_once(spark):
    """Both sides of the banded join share one exchange."""
    raw = spark.range(5000).select((F.col("id") % 7).alias("k"), (F.col("id") % 501).cast("double").alias("s"))
    grouped = raw.groupBy("k", "s").agg(F.count("*").alias("n"))
    out = od.running_totals(grouped, [], [("s", True)], {"t": "n"}, source=raw, hot_rows=10)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan
