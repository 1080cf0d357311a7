"""Exact quantiles and running sums, against plain Python."""

import random
from itertools import accumulate

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import ranks


def test_quantiles_are_those_of_numpy(spark):
    rng = random.Random(4)
    data = [("wide", rng.gauss(0, 1e6)) for _ in range(4000)] + [("tied", float(rng.randrange(3))) for _ in range(999)] + [("one", 7.5), ("none", None)]
    rows = spark.createDataFrame(data, "k string, v double").repartition(7)
    qs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = ranks.quantiles(rows, "v", qs, ["k"])
    assert sorted(got) == [("one",), ("tied",), ("wide",)]
    for k in ("wide", "tied", "one"):
        assert np.allclose(got[(k,)], np.quantile([v for n, v in data if n == k], qs), rtol=1e-12)
    assert ranks.quantiles(rows.filter("k = 'none'"), "v", qs) == {}
    assert ranks.quantiles(rows.filter("k = 'wide'"), "v", [0.5]) == {(): got[("wide",)][3:4]}


def test_a_bracket_that_misses_is_widened(spark, monkeypatch):
    """With a sketch far too coarse for its slack the result is still exact."""
    monkeypatch.setattr(ranks, "ACCURACY", 2)
    monkeypatch.setattr(ranks, "SLACK", 1e-9)
    values = [float(i * i) for i in range(5000)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    assert np.allclose(ranks.quantiles(rows, "v", [0.1, 0.5, 0.9])[()], np.quantile(values, [0.1, 0.5, 0.9]))


def test_medians_leave_out_columns_without_a_value(spark):
    rows = spark.createDataFrame([(1.0, None), (4.0, None), (9.0, None)], "a double, b double")
    assert ranks.medians(rows, {"a": F.col("a"), "b": F.col("b")}) == {"a": 4.0}
    assert ranks.medians(rows, {}) == {}


@pytest.mark.parametrize("each", [7, 100, 100_000])
def test_running_sums_in_ranges(spark, each):
    counts = [(float(i), i % 5) for i in range(3000)]
    table = spark.createDataFrame(counts, "v double, n long").repartition(5)
    up = {r["v"]: r["upto_n"] for r in ranks.running(table, "v", ["n"], each=each).collect()}
    assert up == dict(zip([v for v, _ in counts], accumulate(n for _, n in counts), strict=True))
    down = {r["v"]: r["upto_n"] for r in ranks.running(table, "v", ["n"], descending=True, each=each).collect()}
    assert down == dict(zip([v for v, _ in reversed(counts)], accumulate(n for _, n in reversed(counts)), strict=True))
    assert ranks.running(table.limit(0), "v", ["n"]).count() == 0
    gaps = table.unionByName(spark.createDataFrame([(None, 5)], "v double, n long"))
    assert ranks.running(gaps, "v", ["n"], each=each).count() == len(counts)


def test_ranges_follow_the_rows(spark):
    assert [ranks.ranges_for(n, 100) for n in (0, 1, 100, 101, 10_000)] == [1, 1, 1, 2, 100] and ranks.ranges_for(10**9, 100, 50) == 50
    rows = spark.createDataFrame([(float(v),) for v in range(-5, 1100)] + [(None,)], "v double")
    for cuts in ([], [3.0], list(map(float, range(20))), list(map(float, range(0, 1000, 3)))):
        got = rows.select("v", ranks.range_of("v", cuts).alias("r")).collect()
        assert all(r["r"] == (None if r["v"] is None else sum(c <= r["v"] for c in cuts)) for r in got)
