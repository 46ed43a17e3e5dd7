"""Banded ranks equal plain ones for null, NaN, ties, text and one hot key; null keys stay."""

import math

import pytest

from caseledger.operators import ordering as od
from caseledger.operators import resample as rs
from caseledger.operators import volume as vo

ROWS = [(None if i % 5 == 0 else f"k{i % 3}" if i % 4 else "hot", [None, math.nan, 1.0, 1.0, float(i % 9), -0.5][i % 6], None if i % 7 == 0 else i % 4, f"t{i % 11}", i) for i in range(600)]
SHAPE = "k string, a double, b int, t string, i long"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SHAPE).cache()


@pytest.mark.parametrize("keys", [[], ["k"]])
@pytest.mark.parametrize("order", [[("a", True), ("i", True)], [("a", False), ("i", True)], [("a", True), ("b", False), ("i", False)],
                                   [("b", True), ("a", False), ("i", True)], [("t", False), ("i", True)]])
def test_bands_agree_with_a_plain_window(rows, keys, order):
    def ranks(hot):
        return {r["i"]: r["n"] for r in od.rank_within(rows, keys, order, "n", bands=8, hot_rows=hot).collect()}

    plain, banded = ranks(10_000), ranks(1)
    assert plain == banded and len(banded) == len(ROWS)


def test_null_strata_are_drawn(rows):
    index = od.hash_index(rows, ["k"], ["i"], "n", size="size").collect()
    assert len(index) == len(ROWS)
    nulls = sum(r[0] is None for r in ROWS)
    assert {r["size"] for r in index if r["k"] is None} == {nulls}
    drawn = rs.draw_weights(rows, ["k"], "i", 3).groupBy("replicate").agg({"weight": "sum"}).collect()
    assert [r[1] for r in drawn] == [len(ROWS)] * 3
    got = rs.mean_interval(rows.withColumn("v", rows["i"].cast("double")), ["k"], "i", "v", 5).collect()
    assert len(got) == 5 and all(r["lower"] is not None for r in got)


def test_a_gap_in_a_line_fails(spark):
    cube = [("s", x, y, z, 1.0) for x in range(4) for y in range(4) for z in range(4)]
    frame = lambda rows: spark.createDataFrame(rows, "study_id string, x int, y int, z int, v double")
    double = {"w": lambda seen: seen["v"]}
    assert vo.along_axis(frame(cube), "z", ["v"], double).count() == 64
    with pytest.raises(Exception, match="has a gap in study s"):
        vo.along_axis(frame([r for r in cube if r[1:4] != (1, 2, 1)]), "z", ["v"], double).collect()


def test_components_stop_without_sums(spark):
    far = (1 << 20) - 70
    peaks = [("s", far + i, far, far) for i in range(60)] + [("s", 5, 5, 5), ("r", far, far, far)]
    got = vo.connected_plateaus(spark.createDataFrame(peaks, "study_id string, x int, y int, z int")).collect()
    assert len({(r["study_id"], r["plateau"]) for r in got}) == 3 and len(got) == 62
