"""The projection against numpy, layers by hand, losses, baselines that learn, and a queue over several batches."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.contract import GraphFrame, GraphSchema
from ledgerloom.operators import impute
from ledgerloom.plans import blocks, models, report
from ledgerloom.streaming import windows as streams


def test_projection_is_that_of_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3)) @ np.array([[2.0, 0.3, 0.0], [0.0, 1.0, 0.5], [0.0, 0.0, 0.2]])
    x[::7, 1] = -1.0
    nodes = spark.createDataFrame([(i, *map(float, r), 0) for i, r in enumerate(x)], "node_id long, x0 double, x1 double, x2 double, y int")
    g = GraphFrame(nodes, spark.createDataFrame([], "src long, dst long, edge_type int, day int"), GraphSchema(raw=3, types=1))
    got = np.array([r[1:] for r in blocks.projection(g, nodes.filter("node_id < 40"), 5).orderBy("node_id").collect()])
    seen = np.where(x == -1.0, np.nan, x)
    filled = np.where(np.isnan(seen), np.nanmedian(seen[:40], axis=0), seen)
    z = (filled - filled[:40].mean(axis=0)) / filled[:40].std(axis=0)
    vectors = np.linalg.svd(z[:40], full_matrices=False)[2]
    vectors *= np.sign(vectors[range(3), np.abs(vectors).argmax(axis=1)])[:, None]
    assert np.allclose(got[:, :3], z @ vectors.T, atol=1e-9) and not got[:, 3:].any()
    none = blocks.projection(g, nodes.limit(0), 2).agg(F.sum(F.abs("utpm_attr_proj_0"))).first()[0]
    assert none == 0.0


def test_profiles_and_their_groups():
    assert blocks.resolve("m1_tabular", ["time", "raw_x"]) == ["raw_x", "missing_mask", "missing_summary", "time"]
    assert set(blocks.resolve("utpm_shift_fused")) <= set(blocks.resolve("utpm_shift_fused_rawmask"))
    known = {*blocks.PADDED, *blocks.PLAIN, "utpm_attr_proj", "utpm_aux_label"}
    assert all(set(groups) <= known for groups in blocks.PROFILES.values())
    with pytest.raises(ValueError):
        blocks.resolve("other")


def test_dense_layers(spark):
    layers = (([[1.0, -2.0], [0.5, 0.5], [-1.0, 0.0]], [0.0, 1.0, 0.5]), ([[1.0, 2.0, -1.0]], [0.25]))
    rows = spark.createDataFrame([(1.0, 2.0), (-3.0, 0.5), (0.0, 0.0)], "a double, b double")
    got = [r["z"] for r in rows.select(models.dense_logit(["a", "b"], layers).alias("z")).collect()]
    h = [np.maximum(np.array(layers[0][0]) @ np.array(v) + np.array(layers[0][1]), 0) for v in ((1.0, 2.0), (-3.0, 0.5), (0.0, 0.0))]
    assert np.allclose(got, [float(np.array(layers[1][0][0]) @ x + 0.25) for x in h])


def test_losses_of_far_logits_and_single_classes(spark):
    rows = spark.createDataFrame([(0, 1, 800.0), (0, 0, -800.0), (1, 1, 2.0)], "batch int, y int, logit double")
    loss = rows.agg(F.sum(models.binary_loss("logit", F.col("y").cast("double"))).alias("l")).first()["l"]
    assert loss == pytest.approx(math.log1p(math.exp(-2)))
    ranked = {r["batch"]: r["loss"] for r in models.ranking_loss(rows, 0.5).collect()}
    assert ranked == {0: pytest.approx(0.0), 1: 0.0}


def test_pseudo_labels_of_nothing_and_of_ties(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([0.1, 0.2, 0.5, 0.9, 0.9])], "node_id long, score double")
    assert sorted((r["node_id"], r["pseudo"]) for r in models.pseudo_labels(rows, 0.25, 0.75).collect()) == [(0, 0), (1, 0), (3, 1), (4, 1)]
    assert models.pseudo_labels(rows.limit(0), 0.2, 0.8).count() == 0
    assert models.pseudo_labels(rows.withColumn("score", F.lit(0.5)), 0.2, 0.8, 0.1).count() == 0


def test_baselines_learn_and_need_both_classes(spark):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, int(i % 4 == 0), float(rng.normal() + 3 * (i % 4 == 0)), float(rng.normal())) for i in range(400)], "node_id long, y int, a double, b double")
    train, rest = rows.filter("node_id < 300"), rows.filter("node_id >= 300")
    for of in (models.linear_baseline, models.boosted_baseline):
        got = of(train, rest, ["a", "b"]).collect()
        right = sum((r["score"] >= 0.5) == (r["y"] == 1) for r in got)
        assert len(got) == 100 and right >= 85
    with pytest.raises(ValueError):
        models.linear_baseline(train.filter("y = 0"), rest, ["a", "b"])


def test_trust_starts_at_one(spark):
    rows = spark.createDataFrame([("m", "d", e, 1.0, 0.035, 0.45, 0.0, 0.5) for e in range(4)], "method string, dataset string, epoch int, available double, classification double, margin double, consistency double, stability double")
    got = [r["trust"] for r in report.trust_score(rows).orderBy("epoch").collect()]
    assert got[:2] == [1.0, 1.0] and got[2:] == [pytest.approx(0.18 + 0.30 * 0.9 + 0.14 + 0.10 + 0.28 * 0.5)] * 2


def test_a_queue_keeps_the_last_values_over_batches(spark, tmp_path):
    for i in range(3):
        spark.createDataFrame([(k, 10 * i + j, float(10 * i + j)) for k in (1, 2) for j in range(k)], "node_id long, at long, value double").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    kinds = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in").schema
    stream = streams.last_values(streams.raw_stream(spark, f"{tmp_path}/in/*", kinds), 3)
    got = {r["node_id"]: list(r["values"]) for r in streams.latest(streams.run_to_end(stream, "update"), "node_id").collect()}
    assert got == {1: [0.0, 10.0, 20.0], 2: [11.0, 20.0, 21.0]}


def test_affine_fill_takes_as_many_predictors_as_the_last_step_wants(spark):
    rng = np.random.default_rng(8)
    a, b, c = (rng.uniform(1, 9, 200) for _ in range(3))
    rows = [(i, i % 4, float(2 * x + y) if i % 5 else -1.0, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(zip(a, b, c, strict=True))]
    nodes = spark.createDataFrame(rows, "node_id long, step int, t double, a double, b double, c double")
    got = {r["node_id"]: r for r in impute.affine_fill(nodes, "t", ["a", "b", "c"], sizes=(1, 2, 3), step="step").collect()}
    assert all(got[i]["t"] == pytest.approx(2 * a[i] + b[i]) for i in range(200)) and sum(r["filled"] for r in got.values()) == 40
    rough = {r["node_id"]: r["t"] for r in impute.affine_fill(nodes, "t", ["a", "b", "c"], sizes=(1,), step="step").collect()}
    assert any(abs(rough[i] - 2 * a[i] - b[i]) > 0.1 for i in range(0, 200, 5))
