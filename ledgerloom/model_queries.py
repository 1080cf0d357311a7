"""Composed feature profiles, scoring, losses, pseudo labels, trust and baselines as queries, with SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import wider_queries  # noqa: F401  its SQL is built upon here
from ledgerloom.contract import GraphFrame
from ledgerloom.functions.scalar import sigmoid
from ledgerloom.more_queries import add, epochs
from ledgerloom.operators import graph, impute, sampling
from ledgerloom.oracles import EVENTS, ORDERS, RAW, r6
from ledgerloom.plans import blocks, metrics, models, report
from ledgerloom.queries import ORACLES, on_orders, register
from ledgerloom.sources.shared import stored, stored_graph
from ledgerloom.streaming import windows as streams


# Composed profiles. The projection's vectors and the cosines of raw columns have no SQL; tests compare the projection with numpy.
def train_nodes(g: GraphFrame) -> DataFrame:
    return metrics.time_split(g).filter("part = 'train'").select("node_id")


COMPACT = [n for n in blocks.resolve("utpm_shift_compact") if n != "utpm_attr_proj"]
on_orders("neighbor_features", lambda g: blocks.features(g, blocks.resolve("m3_neighbor"))[0])
on_orders("compact_features", lambda g: blocks.features(g, COMPACT)[0])
on_orders("fused_features", lambda g: blocks.features(g, blocks.resolve("utpm_shift_fused_rawmask"), train_nodes(g))[0])
on_orders("attr_projection", lambda g: blocks.projection(g, train_nodes(g), 4))


def _joined(*queries: str) -> str:
    parts = [f"({ORACLES[q].replace(EVENTS, ORDERS)}) b{i}" for i, q in enumerate(queries)]
    return parts[0] + "".join(f" JOIN {p} USING (node_id)" for p in parts[1:])


_CAST = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in ("first_active", "last_active", "active_span"))
add("neighbor_features", f"SELECT * REPLACE ({_CAST}) FROM {_joined('raw_block', 'graph_degree', 'edge_type_counts', 'background_touch', 'graph_activity', 'window_counts', 'neighbor_profile')}")
_PADDED = {f"{name}_{i}": c.replace("tccr_", "tcc_").replace("tcsf_", "tcc_") for name, (_, columns, _) in blocks.PADDED.items() for i, c in enumerate(columns)}
_AUX = sorted(f"aux_label_{y}_{x}" for y in (2, 3) for x in ("out_count", "in_count", "total_count", "out_ratio", "in_ratio", "out_last14", "in_last14"))[:8]
_PADDED |= {f"utpm_aux_label_{i}": c for i, c in enumerate(_AUX)}
_BLOCKS = ("graph_degree", "unique_multi_edges", "edge_age", "recent_counts", "graph_activity", "window_counts", "snapshot_block", "snapshot_recent", "background_touch", "partner_concentration", "motif_lite", "adaptive_window", "dual_scale_delta", "aux_label_counts")
add("compact_features", f"SELECT * FROM (SELECT node_id, {', '.join(f'CAST({c} AS DOUBLE) AS {n}' for n, c in _PADDED.items())} FROM {_joined(*_BLOCKS)}) p JOIN {_joined('row_attr_stats')} USING (node_id) JOIN ({ORACLES['relation_core']}) r USING (node_id)")


# Scoring and losses.
LAYERS = (([[0.02, -0.01, 0.03], [-0.01, 0.02, 0.01]], [0.1, -0.2]), ([[0.5, -0.25]], [0.05]))
on_orders("linear_scores", lambda g: g.nodes.select("node_id", sigmoid(models.linear_logit({"x0": 0.01, "x1": -0.02, "x2": 0.005}, 0.1)).alias("score")))
on_orders("dense_scores", lambda g: g.nodes.select("node_id", sigmoid(models.dense_logit(["x0", "x1", "x2"], LAYERS)).alias("score")))
_H = ["greatest(0.02 * x0 - 0.01 * x1 + 0.03 * x2 + 0.1, 0)", "greatest(-0.01 * x0 + 0.02 * x1 + 0.01 * x2 - 0.2, 0)"]
add("linear_scores", f"WITH {ORDERS} SELECT node_id, {r6('1 / (1 + exp(-(0.01 * x0 - 0.02 * x1 + 0.005 * x2 + 0.1)))', 'score')} FROM nodes")
add("dense_scores", f"WITH {ORDERS} SELECT node_id, {r6(f'1 / (1 + exp(-(0.5 * {_H[0]} - 0.25 * {_H[1]} + 0.05)))', 'score')} FROM nodes")


def judged(g: GraphFrame) -> DataFrame:
    """Labelled nodes with a logit and their batch."""
    logit = models.linear_logit({"x1": 0.1, "x2": -0.05})
    batches = sampling.balanced_batches(g.nodes, {0: 8, 1: 4}, 1).select("node_id", "batch")
    return g.nodes.filter(F.col("y").isin(0, 1)).select("node_id", F.col("y").cast("double").alias("y"), logit.alias("logit")).join(batches, "node_id")


on_orders(
    "row_losses",
    lambda g: judged(g).select(
        "node_id",
        models.binary_loss("logit", "y", 3.0).alias("binary"),
        models.focal_loss("logit", "y", 2.0, 0.25).alias("focal"),
        models.class_loss(F.array(F.lit(0.0), F.col("logit"), -F.col("logit")), "y").alias("class"),
    ),
)
on_orders("ranking_losses", lambda g: models.ranking_loss(judged(g), 0.5))
_SOFT = lambda x: f"(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"
_JUDGED = f"j AS (SELECT node_id, y, 0.1 * x1 - 0.05 * x2 AS s FROM nodes WHERE y IN (0, 1))"
_TRUE = "(CASE WHEN y = 1 THEN p ELSE 1 - p END)"
add(
    "row_losses",
    f"WITH {ORDERS}, {_JUDGED}, k AS (SELECT *, 1 / (1 + exp(-s)) AS p FROM j WHERE node_id IN (SELECT node_id FROM ({ORACLES['balanced_batches']}))) SELECT node_id, {r6(f'CASE WHEN y = 1 THEN 3 * {_SOFT("-s")} ELSE {_SOFT("s")} END', 'binary')}, "
    f"{r6(f'(CASE WHEN y = 1 THEN 0.25 * {_SOFT("-s")} ELSE 0.75 * {_SOFT("s")} END) * pow(1 - {_TRUE}, 2)', 'focal')}, {r6('ln(1 + exp(s) + exp(-s)) - CASE WHEN y = 1 THEN s ELSE 0 END', 'class')} FROM k",
)
add("ranking_losses", f"WITH {ORDERS}, {_JUDGED}, b AS (SELECT j.*, q.batch FROM j JOIN ({ORACLES['balanced_batches']}) q USING (node_id)), l AS (SELECT p.batch, avg({_SOFT('0.5 - (p.s - n.s)')}) AS v FROM b p JOIN b n ON n.batch = p.batch AND p.y = 1 AND n.y = 0 GROUP BY 1) SELECT batch, {r6('coalesce(v, 0)', 'loss')} FROM (SELECT DISTINCT batch FROM b) LEFT JOIN l USING (batch)")


# Pseudo labels and centroids.
def pseudo(g: GraphFrame) -> DataFrame:
    scores = g.nodes.filter("y = -100").select("node_id", sigmoid(F.col("x1") / 50.0 - 0.5).alias("score"))
    return models.pseudo_labels(scores, 0.3, 0.8, 0.02)


on_orders("pseudo_labels", pseudo)
on_orders("pseudo_centroids", lambda g: models.centroids(pseudo(g).join(blocks.filled_vectors(g), "node_id"), ["pseudo"]).select("pseudo", "n", F.posexplode("centroid").alias("component", "x")))
_PSEUDO = "u AS (SELECT node_id, 1 / (1 + exp(-(x1 / 50.0 - 0.5))) AS score FROM nodes WHERE y = -100), t AS (SELECT least(quantile_cont(score, 0.3), 0.48) AS a, greatest(quantile_cont(score, 0.8), 0.52) AS b FROM u), w AS (SELECT node_id, score, CASE WHEN score >= b THEN 1 ELSE 0 END AS pseudo FROM u, t WHERE score >= b OR score <= a)"
add("pseudo_labels", f"WITH {ORDERS}, {_PSEUDO} SELECT node_id, {r6('score', 'score')}, pseudo FROM w")
_FILLED = ", ".join(f"CASE WHEN {c} = -1 THEN 0 ELSE {c} END" for c in RAW)
add(
    "pseudo_centroids",
    f"WITH {ORDERS}, {_PSEUDO}, v AS (SELECT pseudo, [{_FILLED}]::DOUBLE[] AS v FROM w JOIN nodes USING (node_id)), l AS (SELECT pseudo, v, greatest(sqrt(list_dot_product(v, v)), 1e-12) AS l FROM v), m AS (SELECT pseudo, count(*)::BIGINT AS n, [avg(v[1] / l), avg(v[2] / l), avg(v[3] / l)] AS c FROM l GROUP BY 1) "
    f"SELECT pseudo, n, unnest([0, 1, 2])::INTEGER AS component, {r6('unnest([c[1], c[2], c[3]]) / greatest(sqrt(list_dot_product(c, c)), 1e-12)', 'x')} FROM m",
)


# Trust, and learned baselines.
def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("val_auc")
    rows = report.clean_epochs(epochs(spark, sf_dir), ["val_auc"])
    return rows.select("method", "dataset", "epoch", (v * 2).alias("available"), (v * 1.5).alias("classification"), v.alias("margin"), (v / 2).alias("consistency"), (1 - v).alias("stability"))


register("trust_score", lambda spark, sf_dir: report.trust_score(qualities(spark, sf_dir)).select("method", "dataset", "epoch", "trust"))
_M = "(avg(v) OVER b)"
_UNIT = lambda x: f"greatest(0, least(1, {x}))"
add(
    "trust_score",
    "WITH e AS (SELECT o_orderpriority AS method, o_orderstatus AS dataset, o_orderkey AS epoch, avg(o_totalprice / 1e6) AS v FROM orders GROUP BY ALL) SELECT method, dataset, epoch, "
    + r6(f"CASE WHEN count(*) OVER b < 2 THEN 1 ELSE {_UNIT(f'0.18 * 2 * {_M} + 0.30 * {_UNIT(f"1 - 1.5 * {_M} / 0.35")} + 0.14 * {_UNIT(f"{_M} / 0.45")} + 0.10 * {_UNIT(f"1 - {_M} / 2 / 0.25")} + 0.28 * (1 - {_M})')} END", "trust")
    + " FROM e WINDOW b AS (PARTITION BY method, dataset ORDER BY epoch ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)",
)


def baseline(g: GraphFrame, of) -> DataFrame:
    """ROC AUC and the like of a baseline on the validation nodes; degrees are its columns."""
    columns = ["x0", "x1", "x2", "indegree", "outdegree"]
    g = stored_graph(g)
    rows = impute.constant_fill(g.nodes, ["x0", "x1", "x2"]).join(graph.degrees(g), "node_id").join(g.nodes.select("node_id", "y"), "node_id").join(metrics.time_split(g), "node_id")
    rows = stored(rows.select("node_id", "y", "part", *columns), "baseline-rows")  # a learner reads them many times
    return metrics.metrics(of(rows.filter("part = 'train'"), rows.filter("part = 'val'"), columns).select("y", "score"))


on_orders("linear_baseline", lambda g: baseline(g, models.linear_baseline))
on_orders("boosted_baseline", lambda g: baseline(g, models.boosted_baseline))


# The last values of each user in a stream.
def queued(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = streams.raw_stream(spark, f"{sf_dir}/[e]vents.parquet", raw.schema).select(F.col("user_id").cast("long").alias("node_id"), F.col("event_id").cast("long").alias("at"), F.col("value").cast("double").alias("value"))
    out = streams.latest(streams.run_to_end(streams.last_values(rows, 4), "update"), "node_id")
    return out.select("node_id", F.posexplode("values").alias("place", "value"))


register("stream_last_values", queued)
add("stream_last_values", f"WITH r AS (SELECT user_id::BIGINT AS node_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC, value DESC) AS back FROM events), k AS (SELECT * FROM r WHERE back <= 4) SELECT node_id, (row_number() OVER (PARTITION BY node_id ORDER BY back DESC) - 1)::INTEGER AS place, {r6('value', 'value')} FROM k")


# Normalisation, fitted and applied, in SQL: the columns' values as prepared, their names and modes.
_NAMES = ["x0", "x1", "x2", "x0_is_neg1", "missing_count", "indegree", "outdegree", "out_over_in_plus1"]
_MODES = ["raw", "raw", "raw", "identity", "log", "log", "log", "zscore"]
_VALUES = [*(f"CASE WHEN x{i} = -1 THEN a{i} ELSE x{i} END" for i in range(3)), "CASE WHEN x0 = -1 THEN 1 ELSE 0 END", "ln(1 + mc)", "ln(1 + i)", "ln(1 + o)", "o / (i + 1)"]
_SCALES = f"""{wider_queries._PARTS}, ndeg AS (SELECT center, count(*) FILTER (dir = 'in')::DOUBLE AS i, count(*) FILTER (dir = 'out')::DOUBLE AS o FROM adj GROUP BY 1),
nf AS (SELECT n.node_id, x0, x1, x2, {' + '.join(f'CASE WHEN {c} = -1 THEN 1.0 ELSE 0.0 END' for c in RAW)} AS mc, coalesce(i, 0) AS i, coalesce(o, 0) AS o, p.part = 'train' AS fitted FROM nodes n JOIN part p ON p.node_id = n.node_id LEFT JOIN ndeg ON ndeg.center = n.node_id),
nq AS (SELECT {', '.join(f'coalesce(median({c}) FILTER ({c} <> -1 AND fitted), 0) AS a{i}' for i, c in enumerate(RAW))} FROM nf),
nl AS (SELECT node_id, fitted, unnest({_NAMES}) AS name, unnest({_MODES}) AS mode, unnest([a0, a1, a2, 0, 0, 0, 0, 0]) AS median, unnest([{', '.join(_VALUES)}]::DOUBLE[]) AS v FROM nf, nq),
ns AS (SELECT name, mode, median, CASE mode WHEN 'identity' THEN 0 ELSE avg(v) END AS mean, CASE mode WHEN 'identity' THEN 1 ELSE greatest(stddev_pop(v), 1e-6) END AS std FROM nl WHERE fitted GROUP BY name, mode, median)"""
add("normalizer_fit", f"{_SCALES} SELECT name, mode, {r6('median', 'median')}, {r6('mean', 'mean')}, {r6('std', 'std')} FROM ns")
_SCALED = lambda n: f"max(CASE WHEN nl.name = '{n}' THEN (v - mean) / std END)"
add("normalizer_apply", f"{_SCALES} SELECT node_id, {', '.join(r6(_SCALED(n), n) for n in _NAMES)} FROM nl JOIN ns ON ns.name = nl.name GROUP BY node_id")

# How many predictors an affine fill takes, chosen on the nodes that became active last. The search has no SQL; a test wants the right number.
on_orders("affine_impute_chosen", lambda g: impute.affine_fill(g.nodes.join(graph.degrees(g), "node_id").join(graph.activity(g), "node_id"), "x0", ["x1", "x2", "outdegree", "indegree"], step="first_active"))
