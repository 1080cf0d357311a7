"""Sums of products, correlations, the projection and ridge regression against numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.contract import GraphFrame, GraphSchema
from ledgerloom.operators import gram, impute, ranks
from ledgerloom.operators.sampling import draw
from ledgerloom.plans import blocks, profile

WIDE = 200


@pytest.fixture(scope="module")
def wide(spark):
    """300 nodes of 200 correlated columns with means that are large beside the deviations; one column doesn't vary."""
    source = np.random.default_rng(0)
    x = source.normal(size=(300, 20)) @ source.normal(size=(20, WIDE)) + 1e6 * source.random(WIDE)
    x[:, 3] = 5.0
    frame = spark.createDataFrame([(i, r.tolist(), i % 2) for i, r in enumerate(x)], "node_id long, v array<double>, y int").repartition(7)
    nodes = frame.select("node_id", *[F.col("v")[i].alias(f"x{i}") for i in range(WIDE)], "y")
    return x, GraphFrame(nodes, spark.createDataFrame([], "src long, dst long, edge_type int, day int"), GraphSchema(raw=WIDE, types=1))


def test_correlations_of_many_columns(spark, wide):
    x, g = wide
    got = {(r["feature_a"], r["feature_b"]): r["corr"] for r in profile.feature_corr(g).collect()}
    with np.errstate(invalid="ignore", divide="ignore"):
        want = np.corrcoef(x.T)
    assert len(got) == WIDE * WIDE
    for i in range(0, WIDE, 7):
        for j in range(WIDE):
            assert got[f"x{i}", f"x{j}"] == pytest.approx(want[i, j], abs=1e-9, nan_ok=True), (i, j)
    square = profile.feature_square(g)
    assert square.columns == ["feature", *g.schema.raw_columns] and [r["feature"] for r in square.collect()] == g.schema.raw_columns
    assert math.isnan(square.collect()[0]["x3"]) and square.collect()[0]["x0"] == 1.0


def test_projection_of_many_columns(spark, wide):
    x, g = wide
    got = np.array([list(r)[1:] for r in blocks.projection(g, g.nodes.select("node_id"), 4).orderBy("node_id").collect()])
    spread = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(spread < 1e-6, 1.0, spread)
    _, _, v = np.linalg.svd(z, full_matrices=False)
    for i in range(4):
        own = v[i] if v[i][np.argmax(np.abs(v[i]))] > 0 else -v[i]
        assert got[:, i] == pytest.approx(z @ own, abs=1e-5)


def test_groups_of_moments(spark):
    source = random.Random(1)
    rows = [(i, source.gauss(5, 2), source.choice([0, 1, 2, None])) for i in range(500)] + [(None, 1.0, 0), (3, None, 0), (3, math.nan, 1)]
    frame = spark.createDataFrame(rows, "a long, b double, g int").repartition(9)
    got = gram.moments(frame, [F.col("a"), F.col("b")], F.col("g"))
    for g in (0, 1, 2, None):
        own = np.array([(a, b) for a, b, h in rows if h == g and a is not None and b is not None and b == b], float)
        assert got[g].n == len(own) and got[g].mean == pytest.approx(own.mean(axis=0)) and got[g].products == pytest.approx((own - own.mean(axis=0)).T @ (own - own.mean(axis=0)))
    whole, parts = gram.moments(frame, [F.col("a"), F.col("b")])[None], gram.total(got, 2)
    assert whole.n == parts.n and whole.products == pytest.approx(parts.products) and whole.of([1]).products.shape == (1, 1)
    assert gram.moments(frame.limit(0), [F.col("a")]) == {} and gram.total({}, 2).n == 0


def table(spark, n=400, seed=3, steps=12):
    source = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b = source.normal(3, 1), source.normal(-50, 20)
        t = math.exp(0.5 * a + 0.01 * b + source.normal(0, 0.2))
        rows.append((i, -1.0 if i % 9 == 0 else a, b, -1.0 if i % 5 == 0 else t, int(source.integers(1, steps + 1)), float(source.normal())))
    return rows, spark.createDataFrame(rows, "node_id long, a double, b double, t double, step int, s double").repartition(5)


def by_numpy(rows, late, alphas, clip):
    """(values of the missing, alpha, R2) by the plain formulas."""
    known = [r for r in rows if r[3] != -1.0]
    middle = [np.median([r[c] for r in known if not late(r) and r[c] != -1.0]) for c in (1, 2)]
    x = lambda r: np.array([r[c] if r[c] != -1.0 else middle[c - 1] for c in (1, 2)])
    train, valid = [r for r in known if not late(r)], [r for r in known if late(r)]
    X, y = np.array([x(r) for r in train]), np.log1p([r[3] for r in train])
    V, u = np.array([x(r) for r in valid]), np.log1p([r[3] for r in valid])
    tried = []
    for alpha in alphas:
        z = (X - X.mean(axis=0)) / X.std(axis=0)
        w = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (y - y.mean())) / X.std(axis=0)
        b = y.mean() - w @ X.mean(axis=0)
        tried.append((float(((u - V @ w - b) ** 2).sum()), alpha, w, b))
    error, alpha, w, b = min(tried, key=lambda t: t[:2])
    low, high = np.quantile([r[3] for r in known], [clip, 1 - clip])
    return {r[0]: float(np.clip(np.expm1(x(r) @ w + b), low, high)) for r in rows if r[3] == -1.0}, alpha, 1 - error / ((u - u.mean()) ** 2).sum()


@pytest.mark.parametrize("temporal", [True, False])
def test_ridge_with_a_hold_out(spark, temporal):
    """The chosen penalty and the filled values, held out by time or, with too few rows for that, by a draw."""
    rows, frame = table(spark)
    last = max(r[4] for r in rows if r[3] != -1.0)
    drawn = {r["node_id"]: r["u"] for r in frame.select("node_id", draw(17, "node_id").alias("u")).collect()}
    late = (lambda r: r[4] >= last - 1) if temporal else (lambda r: drawn[r[0]] > 0.8)
    alphas = [0.01, 3.0, 1000.0]
    got, report = impute.ridge_holdout_fill(frame, ["t"], ["a", "b"], "step", alphas=alphas, least_train=100 if temporal else 10_000, least_valid=10, clip=0.01)
    want, alpha, r2 = by_numpy(rows, late, alphas, 0.01)
    values = {r["node_id"]: (r["t"], r["t_filled"]) for r in got.collect()}
    assert len(values) == len(rows)
    for r in rows:
        assert values[r[0]][1] == (r[0] in want) and values[r[0]][0] == pytest.approx(want.get(r[0], r[3]), rel=1e-9)
    told = report.first()
    assert told["alpha"] == alpha and told["r2"] == pytest.approx(r2) and told["fill"] == "ridge_log" and told["train_rows"] + told["validation_rows"] == sum(r[3] != -1.0 for r in rows)


def test_more_penalties_read_no_more(spark):
    _, frame = table(spark)
    jobs = []
    for group, alphas in (("few", [1.0]), ("many", [0.1 * i for i in range(1, 40)])):
        spark.sparkContext.setJobGroup(group, group)
        impute.ridge_holdout_fill(frame, ["t"], ["a", "b"], "step", alphas=alphas)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setJobGroup("", "")
    assert jobs[0] == jobs[1] > 0


def test_targets_that_cannot_be_fitted(spark):
    _, frame = table(spark)
    odd = frame.withColumn("none", F.lit(-1.0)).withColumn("few", F.when(F.col("node_id") < 9, F.col("node_id") * 2.0)).withColumn("signed", F.when(F.col("node_id") % 4 > 0, F.col("s")))
    got, report = impute.ridge_holdout_fill(odd, ["none", "few", "signed"], ["a", "b"], "step")
    told = {r["target"]: r for r in report.collect()}
    assert [told[t]["fill"] for t in ("none", "few", "signed")] == ["zero", "median", "ridge"] and told["none"]["alpha"] is None
    row = got.filter("node_id = 100").first()
    assert (row["none"], row["few"], row["none_filled"], row["few_filled"]) == (0.0, 8.0, True, True)
    empty, report = impute.ridge_holdout_fill(odd.limit(0), ["few"], ["a"], "step")
    assert empty.collect() == [] and report.first()["fill"] == "zero"


def test_ridge_fill_values(spark):
    """ridge_impute's operator against the closed form: the penalty is on standardised columns."""
    rows, frame = table(spark)
    got = {r["node_id"]: r["t"] for r in impute.ridge_fill(frame, "t", ["a", "b"], alpha=5.0).filter("filled").collect()}
    middle = {c: ranks.medians(frame, {c: impute.seen(c)})[c] for c in "ab"}
    x = lambda r: np.array([r[1] if r[1] != -1.0 else middle["a"], r[2] if r[2] != -1.0 else middle["b"]])
    known = [r for r in rows if r[3] != -1.0]
    X, y = np.array([x(r) for r in known]), np.log1p([r[3] for r in known])
    z = (X - X.mean(axis=0)) / X.std(axis=0)
    w = np.linalg.solve(z.T @ z + 5.0 * np.eye(2), z.T @ (y - y.mean()))
    low, high = np.quantile([r[3] for r in known], [0.01, 0.99])
    for r in rows:
        if r[3] == -1.0:
            p = ((x(r) - X.mean(axis=0)) / X.std(axis=0)) @ w + y.mean()
            assert got[r[0]] == pytest.approx(float(np.clip(np.expm1(p), low, high)), rel=1e-9)
