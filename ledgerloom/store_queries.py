"""Stored forms of the graph and work over wide tables as queries: archives of arrays, a bucketed adjacency, sums of products; each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import wider_queries  # noqa: F401  its SQL is built upon here
from ledgerloom.contract import GraphFrame
from ledgerloom.functions import scalar
from ledgerloom.more_queries import add
from ledgerloom.operators import graph, impute, prepare, sampling, windows
from ledgerloom.oracles import ORDERS, RAW, r6
from ledgerloom.plans import profile, report
from ledgerloom.queries import ORACLES, on_events, on_orders, register
from ledgerloom.sources import adjacency, archives, tables
from ledgerloom.sources.shared import shared_folder


# Archives of arrays, written and read back.
def archive_phase(g: GraphFrame) -> DataFrame:
    """The graph as archives; its nodes and their degrees as read back, and whether an id was listed for training or testing."""
    spark, path = g.nodes.sparkSession, shared_folder(g.nodes.sparkSession, "phase-archive")
    archives.write_phase(g, path, *prepare.id_lists(g.nodes))
    back = archives.read_phase(spark, path, g.schema)
    listed = lambda name: archives.read_ids(spark, path, name).select("node_id", F.lit(True).alias(name))
    rows = back.nodes.join(graph.degrees(back).select("node_id", "indegree", "outdegree"), "node_id")
    for name in ("train_mask", "test_mask"):
        rows = rows.join(listed(name), "node_id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return rows


def archive_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs' predictions in archives that name their arrays differently, averaged."""
    path = shared_folder(spark, "prediction-archives")
    base = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_nationkey") % 2).cast("byte").alias("y"))
    for i, (k, ids, labels, scores) in enumerate(((1.0, "node_ids", "y_true", "probability"), (2.0, "ids", "labels", "avg_scores"), (4.0, "node_ids", "labels", "probabilities"))):
        run = base.select(F.col("id").alias(ids), F.col("y").alias(labels), scalar.sigmoid(F.lit(k) * F.col("y") - 1.0).alias(scores))
        archives.write(run, f"{path}/run{i}")
    return report.average_predictions(archives.read_predictions(spark, path))


on_orders("archive_phase", archive_phase, kept=True)
register("archive_predictions", archive_predictions)
_DEGREES = "d AS (SELECT center, count(*) FILTER (dir = 'in') AS i, count(*) FILTER (dir = 'out') AS o FROM adj GROUP BY center)"
add("archive_phase", f"WITH {ORDERS}, {_DEGREES} SELECT node_id, {r6('x0', 'x0')}, {r6('x1', 'x1')}, {r6('x2', 'x2')}, y, {r6('coalesce(i, 0)', 'indegree')}, {r6('coalesce(o, 0)', 'outdegree')}, y IN (0, 1) AS train_mask, y = -100 AS test_mask FROM nodes LEFT JOIN d ON center = node_id")
add("archive_predictions", ORACLES["average_predictions"])


# A stored adjacency.
def bucketed(g: GraphFrame) -> GraphFrame:
    """The graph, stored in buckets and read back."""
    spark, name = g.nodes.sparkSession, f"ledgerloom_{uuid.uuid4().hex}"
    return adjacency.read(spark, adjacency.write(g, name, shared_folder(spark, name), rows_a_bucket=1 << 16), g.schema)


on_orders("adjacency_degree", lambda g: graph.degrees(bucketed(g)))
on_orders("adjacency_windows", lambda g: windows.window_counts(bucketed(g)))
on_orders("adjacency_background", lambda g: graph.background_touch(bucketed(g)))
on_events("adjacency_recent", lambda g: sampling.top_recent(bucketed(g), 5))
for _name, _plain in {"adjacency_degree": "graph_degree", "adjacency_windows": "window_counts", "adjacency_background": "background_touch", "adjacency_recent": "topk_recent_neighbors"}.items():
    add(_name, ORACLES[_plain])


# Sums of products.
ALPHAS = (0.1, 10.0, 1000.0)


def ridge_holdout(g: GraphFrame) -> tuple[DataFrame, DataFrame]:
    """x0 by x1 and x2, with the first activity, in steps of 20 days up to the eighth, for the hold-out."""
    steps = graph.activity(g).select("node_id", F.least(F.floor(F.col("first_active") / 20), F.lit(8)).alias("step"))
    return impute.ridge_holdout_fill(g.nodes.join(steps, "node_id"), ["x0"], ["x1", "x2"], "step", alphas=ALPHAS, least_train=50, least_valid=5, least_fit=20)


on_orders("feature_square", profile.feature_square)
on_orders("ridge_holdout", lambda g: ridge_holdout(g)[0])
on_orders("ridge_holdout_report", lambda g: ridge_holdout(g)[1])
add("feature_square", f"WITH {ORDERS} " + " UNION ALL ".join(f"SELECT '{a}' AS feature, {', '.join(r6(f'corr({a}, {b})', b) for b in RAW)} FROM nodes" for a in RAW))
_RIDGE = f"""WITH {ORDERS}, k AS (SELECT n.node_id, x0, x1, x2, least(floor(first_active / 20.0), 8) AS s FROM nodes n JOIN act ON act.node_id = n.node_id),
h AS (SELECT *, s >= max(s) OVER () - 1 AS held FROM k WHERE x0 <> -1),
m AS (SELECT median(x1) FILTER (x1 <> -1 AND NOT held) AS m1, median(x2) FILTER (x2 <> -1 AND NOT held) AS m2 FROM h),
f AS (SELECT k.node_id, k.x0, CASE WHEN k.x1 = -1 THEN m1 ELSE k.x1 END AS a, CASE WHEN k.x2 = -1 THEN m2 ELSE k.x2 END AS b, ln(1 + k.x0) AS y, held FROM k CROSS JOIN m LEFT JOIN h ON h.node_id = k.node_id),
t AS (SELECT count(*)::DOUBLE AS n, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(y) AS my, count(*) * corr(a, b) AS c, count(*) * covar_pop(a, y) / stddev_pop(a) AS p, count(*) * covar_pop(b, y) / stddev_pop(b) AS q FROM f WHERE NOT held),
w AS (SELECT alpha, ((n + alpha) * p - c * q) / ((n + alpha) * (n + alpha) - c * c) AS w1, ((n + alpha) * q - c * p) / ((n + alpha) * (n + alpha) - c * c) AS w2 FROM t, (SELECT unnest({list(ALPHAS)}::DOUBLE[]) AS alpha)),
e AS (SELECT alpha, w1, w2, sum((y - my - w1 * (a - ma) / sa - w2 * (b - mb) / sb) ** 2) AS error, count(*) AS n_held, var_pop(y) * count(*) AS spread FROM f, t, w WHERE held GROUP BY ALL ORDER BY error, alpha LIMIT 1),
z AS (SELECT quantile_cont(x0, 0.001) AS lo, median(x0) AS mid, quantile_cont(x0, 0.999) AS hi, min(x0) AS a0, max(x0) AS b0 FROM h)"""
add("ridge_holdout", f"{_RIDGE} SELECT node_id, {r6('CASE WHEN x0 <> -1 THEN x0 ELSE least(greatest(exp(my + w1 * (a - ma) / sa + w2 * (b - mb) / sb) - 1, lo), hi) END', 'x0')}, x0 = -1 AS x0_filled FROM f, t, e, z")
add("ridge_holdout_report", f"{_RIDGE} SELECT 'x0' AS target, 'ridge_log' AS fill, {r6('alpha', 'alpha')}, t.n::BIGINT AS train_rows, n_held::BIGINT AS validation_rows, {r6('1 - error / spread', 'r2')}, {r6('a0', 'observed_min')}, {r6('mid', 'observed_median')}, {r6('b0', 'observed_max')} FROM e, t, z")
add(
    "ridge_impute",
    f"""WITH {ORDERS}, m AS (SELECT median(x1) FILTER (x1 <> -1) AS m1, median(x2) FILTER (x2 <> -1) AS m2 FROM nodes),
f AS (SELECT node_id, x0, CASE WHEN x1 = -1 THEN m1 ELSE x1 END AS a, CASE WHEN x2 = -1 THEN m2 ELSE x2 END AS b, ln(1 + x0) AS y FROM nodes, m),
t AS (SELECT count(*) + 1.0 AS d, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(y) AS my, count(*) * corr(a, b) AS c, count(*) * covar_pop(a, y) / stddev_pop(a) AS p, count(*) * covar_pop(b, y) / stddev_pop(b) AS q, quantile_cont(x0, 0.01) AS lo, quantile_cont(x0, 0.99) AS hi FROM f WHERE x0 <> -1)
SELECT node_id, {r6('CASE WHEN x0 <> -1 THEN x0 ELSE least(greatest(exp(my + (d * p - c * q) / (d * d - c * c) * (a - ma) / sa + (d * q - c * p) / (d * d - c * c) * (b - mb) / sb) - 1, lo), hi) END', 'x0')}, x0 = -1 AS filled FROM f, t""",
)
