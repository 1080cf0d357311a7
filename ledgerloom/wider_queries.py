"""Preparation, files, samples, serving and small expressions as queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.contract import GraphFrame
from ledgerloom.functions import scalar
from ledgerloom.more_queries import LATEST, SEEN, _u, add, epochs, networks
from ledgerloom.operators import graph, impute, prepare, rows, sampling, windows
from ledgerloom.oracles import BG, DIRS, EVENTS, ORDERS, RAW, count, per_node, r6, ratio, z
from ledgerloom.plans import metrics, profile, report, serving
from ledgerloom.queries import ORACLES, on_events, on_orders, register
from ledgerloom.sources import files, tables
from ledgerloom.sources.shared import shared_folder
from ledgerloom.streaming import windows as streams

MID = 120


# From raw tables to a graph.
def stepped(g: GraphFrame) -> DataFrame:
    return graph.activity(g).select(F.col("node_id").alias("key"), "node_id", F.col("first_active").alias("step"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = tables.table(spark, sf_dir, "customer")
    classes = raw.select("c_custkey", F.concat(F.lit(" "), (F.col("c_nationkey") % 3).cast("string")).alias("class"))
    return prepare.with_labels(raw.select(F.col("c_custkey").alias("id")), classes.withColumnsRenamed({"c_custkey": "id"}), "id", "class")


def overlaid(spark: SparkSession, sf_dir: str) -> DataFrame:
    spent = tables.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.max("o_totalprice").alias("top"), F.min("o_totalprice").alias("low"))
    return prepare.overlay(tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c")), spent, "c", ["top", "low"])


def asked(g: GraphFrame) -> DataFrame:
    """Each node, and the first hundred days' sources once more."""
    return g.nodes.select(F.col("node_id").alias("pos"), "node_id").unionByName(g.edges.filter("day <= 100").select((F.col("src") + 10_000_000).alias("pos"), F.col("src").alias("node_id")).distinct())


on_orders("edges_by_id", lambda g: prepare.edges_by_id(g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "edge_type"), stepped(g), "a", "b"))
register("binary_labels", classified)
register("overlay_optional", overlaid)
on_orders("take_rows", lambda g: prepare.take_rows(g.nodes, asked(g), ["x0", "x1"]))
on_orders("align_predictions", lambda g: prepare.aligned(asked(g), g.nodes.select("node_id", scalar.sigmoid(F.col("x1") / 10.0).alias("probability"))))
on_orders("label_codes", lambda g: prepare.label_codes(g.nodes, metrics.time_split(g).filter("part = 'train'"), g.schema.background))
on_orders("historical_background", lambda g: prepare.historical_background(g.nodes, graph.activity(g), g.schema.background, 60))
on_orders("forced_missing", lambda g: impute.forced_missing(g.nodes, ["x0", "x2"], 50).select("node_id", "x0", "x2"))
ASKED = "asked AS (SELECT node_id AS pos, node_id FROM nodes UNION ALL SELECT DISTINCT src + 10000000, src FROM edges WHERE day <= 100)"
add("edges_by_id", f"WITH {ORDERS} SELECT src, dst, edge_type, greatest(a.first_active, b.first_active)::INTEGER AS day FROM edges JOIN act a ON a.node_id = src JOIN act b ON b.node_id = dst")
add("binary_labels", "SELECT c_custkey AS id, CASE c_nationkey % 3 WHEN 1 THEN 1 WHEN 2 THEN 0 ELSE -100 END AS y FROM customer")
add("overlay_optional", f"SELECT c_custkey AS c, {r6('coalesce(t, -1)', 'top')}, {r6('coalesce(l, -1)', 'low')}, t IS NOT NULL AS observed FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS t, min(o_totalprice) AS l FROM orders GROUP BY 1) ON o_custkey = c_custkey")
add("take_rows", f"WITH {ORDERS}, {ASKED} SELECT pos, n.node_id, {r6('x0', 'x0')}, {r6('x1', 'x1')} FROM asked a JOIN nodes n ON n.node_id = a.node_id")
add("align_predictions", f"WITH {ORDERS}, {ASKED} SELECT pos, n.node_id, {r6('1 / (1 + exp(-x1 / 10.0))', 'probability')} FROM asked a JOIN nodes n ON n.node_id = a.node_id")
_PARTS = ORACLES["time_split"].replace("SELECT node_id, CASE WHEN y IN (0, 1) AND first_active >= d THEN", ", part AS (SELECT node_id, y, CASE WHEN y IN (0, 1) AND first_active >= d THEN") + ")"
add("label_codes", f"{_PARTS} SELECT node_id, (CASE WHEN part = 'train' OR y IN (2, 3) THEN y ELSE 4 END)::INTEGER AS code FROM part")
add("historical_background", f"WITH {ORDERS} SELECT n.node_id FROM nodes n JOIN act a ON a.node_id = n.node_id WHERE y IN (2, 3) AND first_active <= 60")
add("forced_missing", f"WITH {ORDERS}, h AS (SELECT node_id FROM nodes WHERE x0 <> -1 AND x2 <> -1 ORDER BY abs(x0) + abs(x2), node_id LIMIT 50) SELECT node_id, {r6('CASE WHEN node_id IN (SELECT * FROM h) THEN -1 ELSE x0 END', 'x0')}, {r6('CASE WHEN node_id IN (SELECT * FROM h) THEN -1 ELSE x2 END', 'x2')} FROM nodes")

# Feature blocks.
on_orders("bucket_norm", windows.bucket_norm)
on_orders("aux_label_block", lambda g: rows.aux_label_block(graph.aux_label_counts(g)))
on_orders("take_named", lambda g: rows.take_named(graph.degrees(g), ["outdegree", "absent", "indegree"], "utpm_graph_core", 4))
on_orders("unified_features", lambda g: unified(g))
on_orders("observed_stats", lambda g: profile.observed_stats(g.nodes, g.schema.raw_columns))
on_orders("consistency_profile", lambda g: profile.consistency_profile(g.nodes, g.schema.raw_columns))
on_orders("phase_summary", lambda g: profile.phase_summary(g.nodes, g.edges))
on_orders("degree_shift", lambda g: profile.degree_shift(g, MID))
on_orders("type_shift", lambda g: profile.type_shift(g, MID))
register("table_counts", lambda spark, sf_dir: table_counts(spark, sf_dir))


def unified(g: GraphFrame) -> DataFrame:
    """The row statistics, the relation profile and a core of graph columns side by side, written as groups and read back."""
    spark = g.nodes.sparkSession
    core = rows.take_named(graph.degrees(g), ["indegree", "outdegree", "total_degree"], "utpm_graph_core", 3)
    groups = {"attr": rows.row_attr_stats(g).select("node_id", "utpm_valid_mean", "utpm_missing_count"), "core": core, "extra": graph.activity(g)}
    path = shared_folder(spark, "groups")
    files.write_feature_groups(groups, path)
    return files.read_feature_groups(spark, path, ["attr", "core", "extra"])


def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name in ("customer", "events", "orders"):
        one = tables.table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def _bucket_norm() -> str:
    aggs = {"i": count("dir = 'in'"), "o": count("dir = 'out'"), "bi": count(f"dir = 'in' AND {BG}"), "bo": count(f"dir = 'out' AND {BG}")}
    m = lambda c: f"(CASE WHEN {c} = -1 THEN 1.0 ELSE 0.0 END)"
    p = lambda c: f"(avg({m(c)}) OVER c)"
    n = lambda c: f"coalesce({c}, 0)"
    i, o, bi, bo = n("i"), n("o"), n("bi"), n("bo")
    cols = {f"tb30_{c}_z": z(c, f"{c} <> -1") for c in RAW} | {f"tb30_{c}_missing_z": f"({m(c)} - {p(c)}) / greatest(sqrt({p(c)} * greatest(1.0 - {p(c)}, 0)), 1e-3)" for c in RAW}
    cols |= {"tb30_missing_count_z": z(" + ".join(m(c) for c in RAW)), "tb30_log_indegree_z": z(f"ln(1 + {i})"), "tb30_log_outdegree_z": z(f"ln(1 + {o})"), "tb30_log_total_degree_z": z(f"ln(1 + {i} + {o})")}
    cols |= {"tb30_bg_in_ratio_z": z(ratio(bi, i)), "tb30_bg_out_ratio_z": z(ratio(bo, o)), "tb30_bg_total_ratio_z": z(ratio(f"{bi} + {bo}", f"{i} + {o}")), "tb30_log_bg_total_z": z(f"ln(1 + {bi} + {bo})")}
    return f"WITH {ORDERS}, a AS (SELECT center, {', '.join(f'{e} AS {k}' for k, e in aggs.items())} FROM ladj GROUP BY center) SELECT n.node_id, {', '.join(r6(e, k) for k, e in cols.items())} FROM nodes n JOIN coh ON coh.node_id = n.node_id LEFT JOIN a ON a.center = n.node_id WINDOW c AS (PARTITION BY cohort)"


add("bucket_norm", _bucket_norm())
_aux = {f"{d}{y}": count(f"dir = '{d}' AND far_y = {y}") for y in (2, 3) for d in DIRS} | {"i": count("dir = 'in'"), "o": count("dir = 'out'")} | {f"l{d}{y}": count(f"dir = '{d}' AND far_y = {y} AND day > (SELECT md FROM md) - 14") for y in (2, 3) for d in DIRS}
# The first eight of the columns' names in order: counts, late counts and shares of label 2, then of label 3.
add("aux_label_block", per_node(ORDERS, _aux, {f"utpm_aux_label_{i}": e for i, e in enumerate(["in2", "lin2", ratio("in2", "i"), "out2", "lout2", ratio("out2", "o"), "in2 + out2", "in3"])}, source="ladj"))
_deg = {"i": count("dir = 'in'"), "o": count("dir = 'out'")}
add("take_named", per_node(ORDERS, _deg, {"utpm_graph_core_0": "o", "utpm_graph_core_1": "0", "utpm_graph_core_2": "i", "utpm_graph_core_3": "0"}))
_seen = "list_filter([x0, x1, x2], lambda v: v <> -1)"
add("unified_features", f"WITH {ORDERS}, d AS (SELECT center, {', '.join(f'{e} AS {k}' for k, e in _deg.items())} FROM adj GROUP BY center) SELECT n.node_id, {r6(f'coalesce(list_sum({_seen}), 0) / greatest(len({_seen}), 1)', 'utpm_valid_mean')}, {r6(f'3 - len({_seen})', 'utpm_missing_count')}, {r6('coalesce(i, 0)', 'utpm_graph_core_0')}, {r6('coalesce(o, 0)', 'utpm_graph_core_1')}, {r6('coalesce(i + o, 0)', 'utpm_graph_core_2')}, first_active, last_active, last_active - first_active AS active_span FROM nodes n JOIN act ON act.node_id = n.node_id LEFT JOIN d ON center = n.node_id")
_OBSERVED = "o AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) FILTER ({c} <> -1)::BIGINT AS n, coalesce(avg({c}) FILTER ({c} <> -1), 0) AS m, CASE WHEN stddev_pop({c}) FILTER ({c} <> -1) > 1e-6 THEN stddev_pop({c}) FILTER ({c} <> -1) ELSE 1 END AS s FROM nodes" for c in RAW) + ")"
add("observed_stats", f"WITH {ORDERS}, {_OBSERVED} SELECT feature, n, {r6('m', 'mean')}, {r6('s', 'std')} FROM o")
_zs = [f"CASE WHEN {c} = -1 THEN 0 ELSE ({c} - (SELECT m FROM o WHERE feature = '{c}')) / (SELECT s FROM o WHERE feature = '{c}') END" for c in RAW]
add("consistency_profile", f"WITH {ORDERS}, {_OBSERVED}, v AS (SELECT node_id, [{', '.join([*_zs, *[f'CASE WHEN {c} = -1 THEN 1.0 ELSE 0.0 END' for c in RAW]])}]::DOUBLE[] AS v FROM nodes), l AS (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-6) AS l FROM v) SELECT node_id, {', '.join(r6(f'v[{i + 1}] / l', f'c{i}') for i in range(6))} FROM l")
add("phase_summary", f"WITH {ORDERS} SELECT count(*)::BIGINT AS nodes, count(*) FILTER (y IN (0, 1))::BIGINT AS labelled, count(*) FILTER (y = -100)::BIGINT AS unknown, count(*) FILTER (y = 1)::BIGINT AS frauds, (SELECT count(*) FROM edges)::BIGINT AS edges, (SELECT md FROM md) AS last_day FROM nodes")
add("degree_shift", f"WITH {ORDERS}, d AS (SELECT center, count(*)::DOUBLE AS t FROM adj GROUP BY center) SELECT CASE WHEN first_active < {MID} THEN 'reference' ELSE 'current' END AS side, count(*)::BIGINT AS nodes, {r6('avg(coalesce(t, 0))', 'mean_degree')}, {r6('avg(first_active)', 'mean_first_active')} FROM act LEFT JOIN d ON center = node_id GROUP BY ALL")
add("type_shift", f"WITH {ORDERS}, c AS (SELECT edge_type, count(*) FILTER (day < {MID}) AS p, count(*) FILTER (day >= {MID}) AS q FROM edges GROUP BY 1), s AS (SELECT edge_type, p / greatest(sum(p) OVER (), 1) AS p, q / greatest(sum(q) OVER (), 1) AS q FROM c) SELECT edge_type, {r6('p', 'reference')}, {r6('q', 'current')}, {r6('q - p', 'shift')} FROM s")
add("table_counts", "SELECT 'customer' AS name, count(*)::BIGINT AS n FROM customer UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'orders', count(*) FROM orders")


# Files, written and read back.
def phase_files(g: GraphFrame) -> DataFrame:
    path = shared_folder(g.nodes.sparkSession, "phase")
    files.write_phase(g, path, *prepare.id_lists(g.nodes))
    return graph.degrees(files.read_phase(g.nodes.sparkSession, path, g.schema)).select("node_id", "indegree", "outdegree")


def delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "customers.csv")
    path = path if path.endswith(".csv") else f"{path}.csv"
    files.write_table(tables.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"), path)
    typed = files.read_table(spark, path, {"c_custkey": "long", "c_acctbal": "double"})
    return typed.join(files.read_upload(spark, path).select(F.col("c_custkey").cast("long").alias("c_custkey"), F.upper("c_name").alias("name")), "c_custkey")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs' predictions under other names, as JSON lines, averaged."""
    path = shared_folder(spark, "predictions")
    base = tables.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ids"), (F.col("c_nationkey") % 2).alias("labels"), F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0))).alias("_k"))
    files.append_json(base.select("ids", "labels", scalar.sigmoid(F.col("_k") * F.col("labels") - 1.0).alias("prob")), path)
    return report.average_predictions(files.read_predictions(spark.read.json(path)))


on_orders("phase_files", phase_files, kept=True)
register("delimited_files", delimited)
register("average_predictions", predictions)
add("phase_files", per_node(ORDERS, _deg, {"indegree": "i", "outdegree": "o"}))
add("delimited_files", f"SELECT c_custkey, {r6('c_acctbal', 'c_acctbal')}, upper(c_name) AS name FROM customer")
add("average_predictions", f"WITH p AS (SELECT c_custkey AS node_id, (c_nationkey % 2)::INTEGER AS y_true FROM customer) SELECT node_id, y_true, {r6('(1 / (1 + exp(1.0 - y_true)) + 1 / (1 + exp(1.0 - 2 * y_true)) + 1 / (1 + exp(1.0 - 4 * y_true))) / 3', 'probability')} FROM p")


# Samples.
def similar_edges(g: GraphFrame) -> DataFrame:
    return g.edges.groupBy(F.col("src").alias("center"), F.col("dst").alias("neighbor")).agg((F.max("day") / 10.0).alias("s"))


def pools(g: GraphFrame) -> tuple[DataFrame, DataFrame]:
    pool = g.nodes.select("node_id", (F.col("node_id") % 4).cast("int").alias("bucket"), (F.col("x0") > 60).alias("hard"))
    return pool, pool.groupBy("bucket").agg((F.min("node_id") % 5 + 2).alias("n"))


def local_nodes(g: GraphFrame) -> DataFrame:
    return sampling.local_ids(sampling.khop(g, g.nodes.select(F.col("node_id").alias("seed")), (3, 2)))


def wanted_background(g: GraphFrame) -> DataFrame:
    w = windows.edge_time_windows(g.edges)
    wanted = g.nodes.sparkSession.createDataFrame([(x.index, x.end, 4 * x.index) for x in w], "bucket int, snapshot int, n int")
    return sampling.background_negatives(g, graph.activity(g), wanted, 5, ratio=1.5)


on_events("consistency_scores", lambda g: sampling.consistency(similar_edges(g), "s", 2.0).select("center", "neighbor", "score"))
on_events("local_ids", local_nodes)
on_events("negatives", lambda g: sampling.negatives(*pools(g), "bucket", 11))
on_orders("background_negatives", wanted_background)
on_events("visual_slice", lambda g: sampling.visual_slice(g, 0.5)[1])
on_orders("pooled_rows", lambda g: sampling.labelled_nodes(g).unionByName(g.nodes.filter(F.col("y").isin(*g.schema.background)).select("node_id", "y")))
on_orders("time_partitions", sampling.time_partitions)


_WEIGHTS = "w AS (SELECT rel_id, w / avg(w) OVER () AS w FROM (SELECT rel_id, 1 / sqrt(count(*)) AS w FROM seen GROUP BY 1))"
_COPIES = "row_number() OVER (PARTITION BY center, neighbor, dir, rel_id, day)"
_DRAWN = lambda seed: _u(seed, "center", "neighbor", "dir", "rel_id", "day", "copy")
add("weighted_fanout", f"WITH {EVENTS}, {SEEN}, {_WEIGHTS}, p AS (SELECT * FROM seen QUALIFY row_number() OVER (PARTITION BY center, dir {LATEST}) <= 12), c AS (SELECT *, ({_COPIES})::INTEGER AS copy FROM p), d AS (SELECT *, {_DRAWN(9)} AS u FROM c), k AS (SELECT d.*, w.w AS weight, -ln(u) / greatest(w.w, 1e-6) AS k FROM d JOIN w ON w.rel_id = d.rel_id), r AS (SELECT *, (row_number() OVER (PARTITION BY center, dir ORDER BY k))::INTEGER AS rank FROM k) SELECT rel_id, center, neighbor, dir, day, copy, {r6('weight', 'weight')}, {r6('k', 'key')}, rank FROM r WHERE rank <= 4")
add("hybrid_fanout", f"WITH {EVENTS}, {SEEN}, c AS (SELECT *, ({_COPIES})::INTEGER AS copy FROM seen), d AS (SELECT *, {_DRAWN(2)} AS u, row_number() OVER (PARTITION BY center, dir {LATEST}, copy) <= 3 AS new FROM c), r AS (SELECT *, (row_number() OVER (PARTITION BY center, dir ORDER BY new DESC, u))::INTEGER AS rank FROM d) SELECT center, neighbor, dir, rel_id, day, copy, {r6('u', 'u')}, rank, CASE WHEN new THEN 'recent' ELSE 'old' END AS part FROM r WHERE rank <= 6")
add("balanced_batches", f"WITH {ORDERS}, k AS (SELECT node_id, y, row_number() OVER (PARTITION BY y ORDER BY {_u(1, 'node_id')}, node_id) - 1 AS i, CASE y WHEN 0 THEN 8 ELSE 4 END AS per FROM nodes WHERE y IN (0, 1)), m AS (SELECT min(n) AS m FROM (SELECT floor(count(*) / any_value(per)) AS n FROM k GROUP BY y)) SELECT node_id, y, floor(i / per)::BIGINT AS batch FROM k, m WHERE floor(i / per) < m")
add("result_delta", f"WITH b AS (SELECT o_orderpriority AS method, o_orderstatus AS dataset, max(o_totalprice) / 1e6 AS v, max(o_orderkey) AS last_epoch FROM orders GROUP BY ALL), e AS (SELECT b.*, (SELECT min(o_orderkey) FROM orders WHERE o_orderpriority = method AND o_orderstatus = dataset AND o_totalprice / 1e6 = v) AS best_epoch, v - max(v) FILTER (method = '1-URGENT') OVER (PARTITION BY dataset) AS d FROM b) SELECT method, dataset, best_epoch, {r6('v', 'val_auc')}, last_epoch, {r6('d', 'delta')}, printf('%.2f%% (%+.2f%%)', v * 100.0, d * 100.0) AS shown FROM e")
add("consistency_scores", f"WITH {EVENTS}, s AS (SELECT src AS center, dst AS neighbor, max(day) / 20.0 AS s FROM edges GROUP BY ALL), e AS (SELECT *, exp(s - max(s) OVER (PARTITION BY center)) AS e FROM s) SELECT center, neighbor, {r6('e / sum(e) OVER (PARTITION BY center)', 'score')} FROM e")
add("local_ids", ORACLES["khop_subgraph_all"].replace(" SELECT * FROM k", ", e AS (SELECT seed, unnest([src, dst]) AS node_id, hop FROM k), d AS (SELECT seed, node_id, min(CASE WHEN node_id = seed THEN 0 ELSE hop END)::INTEGER AS depth FROM e GROUP BY ALL) SELECT seed, node_id, depth, (row_number() OVER (PARTITION BY seed ORDER BY depth, node_id) - 1)::INTEGER AS local_id FROM d"))
add("negatives", f"WITH {EVENTS}, p AS (SELECT node_id, (node_id % 4)::INTEGER AS bucket, x0 > 60 AS hard, {_u(11, 'node_id')} AS u FROM nodes), w AS (SELECT bucket, min(node_id) % 5 + 2 AS n FROM p GROUP BY 1), r AS (SELECT p.*, n, row_number() OVER (PARTITION BY p.bucket, hard ORDER BY u, node_id) AS r FROM p JOIN w ON w.bucket = p.bucket), t AS (SELECT *, CASE WHEN hard AND r <= round(n * 0.5) THEN 0 WHEN NOT hard THEN 1 ELSE 2 END AS turn FROM r) SELECT node_id, bucket, hard FROM t QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY turn, u, node_id) <= n")
add("background_negatives", f"WITH {ORDERS}, k AS (SELECT a.node_id, first_active FROM act a JOIN nodes n ON n.node_id = a.node_id WHERE y IN (2, 3)), c AS (SELECT window_idx AS bucket, k.node_id, row_number() OVER (PARTITION BY end_day ORDER BY {_u(5, 'k.node_id', 'end_day')}, k.node_id) AS r FROM win JOIN k ON first_active <= end_day) SELECT node_id, bucket FROM c WHERE r <= ceil(4 * bucket * 1.5)")
add("visual_slice", f"WITH {EVENTS}, k AS (SELECT node_id FROM nodes ORDER BY node_id LIMIT (SELECT ceil(count(*) * 0.5)::BIGINT FROM nodes)) SELECT src, dst, edge_type, day FROM edges WHERE src IN (SELECT * FROM k) AND dst IN (SELECT * FROM k)")
add("pooled_rows", f"WITH {ORDERS} SELECT node_id, y FROM nodes WHERE y <> -100")
add("time_partitions", f"WITH {ORDERS} SELECT node_id, time_bucket, floor((row_number() OVER (PARTITION BY time_bucket ORDER BY {_u(13, 'node_id')}, node_id) - 1) / 64)::BIGINT AS batch FROM buck")

# Serving and reports.
SHOWN = 40
register("timeline_edges", lambda spark, sf_dir: serving.sequence_edges(tables.table(spark, sf_dir, "orders"), "o_orderkey", ["o_orderdate", "o_orderkey"], "o_custkey"))
on_events("graph_view", lambda g: serving.graph_view(g.edges.select("src", "dst", "day"), g.nodes.filter("x0 > 60").select("node_id", scalar.sigmoid(F.col("x0") / 100.0).alias("score")), g.nodes, SHOWN)[0])
on_events("focus_edges", lambda g: serving.focus_edges(g.edges.select("src", "dst", "day"), serving.neighbor_map(g.edges, 2)))
register("top_counts", lambda spark, sf_dir: serving.top_counts(tables.table(spark, sf_dir, "events"), "user_id", 5))
on_events("degree_ranking", lambda g: serving.degree_ranking(g.edges, 10))
register("cascade_delete", lambda spark, sf_dir: serving.without_dataset({"networks": networks(spark, sf_dir).withColumnRenamed("owner", "dataset")}, 3)["networks"])
register("trailing_trust", lambda spark, sf_dir: report.trailing_mean(report.clean_epochs(epochs(spark, sf_dir), ["val_auc"]), "val_auc", 3))
register("first_rows", lambda spark, sf_dir: report.first_rows(epochs(spark, sf_dir), ["method", "dataset"], ["epoch"]))
register("regression_errors", lambda spark, sf_dir: metrics.regression(tables.table(spark, sf_dir, "orders"), F.col("o_totalprice") / 1e5, (F.col("o_custkey") % 10) / 2.0))
register("stream_recent_counts", lambda spark, sf_dir: streams.latest(streams.run_to_end(streams.recent_counts(streams.event_stream(spark, f"{sf_dir}/[e]vents.parquet", spark.read.parquet(f"{sf_dir}/events.parquet").schema), 3, "3650 days"), "update"), "day", "node_id"))
add("timeline_edges", "SELECT o_orderkey AS source, t AS target FROM (SELECT o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS t FROM orders) WHERE t IS NOT NULL")
add("graph_view", f"WITH {EVENTS} SELECT node_id, {r6('CASE WHEN x0 > 60 THEN 1 / (1 + exp(-x0 / 100.0)) ELSE 0 END', 'score')} FROM nodes ORDER BY node_id LIMIT {SHOWN}")
add("focus_edges", f"WITH {EVENTS}, p AS (SELECT DISTINCT center, neighbor FROM adj), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY center ORDER BY neighbor) <= 2), b AS (SELECT center AS s, neighbor AS t FROM f UNION SELECT neighbor, center FROM f) SELECT src, dst, day, s IS NOT NULL AS highlighted FROM edges LEFT JOIN b ON s = src AND t = dst")
add("top_counts", "SELECT user_id AS value, count(*)::BIGINT AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 5")
add("degree_ranking", f"WITH {EVENTS} SELECT center AS node_id, count(*)::BIGINT AS degree FROM adj GROUP BY 1 ORDER BY degree DESC, node_id LIMIT 10")
add("cascade_delete", "SELECT c_nationkey AS dataset, c_custkey AS id, c_name AS name, 1::BIGINT AS nodes, c_nationkey::BIGINT AS edges, c_custkey % 97 AS created_at FROM customer WHERE c_nationkey IS DISTINCT FROM 3")
_EPOCHS = "e AS (SELECT o_orderpriority AS method, o_orderstatus AS dataset, o_orderkey AS epoch, avg(o_totalprice / 1e6) AS v FROM orders GROUP BY ALL)"
add("trailing_trust", f"WITH {_EPOCHS} SELECT method, dataset, epoch, {r6('v', 'val_auc')}, {r6('avg(v) OVER (PARTITION BY method, dataset ORDER BY epoch ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)', 'trust')} FROM e")
add("first_rows", f"WITH {_EPOCHS} SELECT method, dataset, epoch, {r6('v', 'val_auc')} FROM e QUALIFY row_number() OVER (PARTITION BY method, dataset ORDER BY epoch) = 1")
add("regression_errors", f"WITH p AS (SELECT o_totalprice / 1e5 AS a, (o_custkey % 10) / 2.0 AS b FROM orders) SELECT {r6('1 - sum((a - b) * (a - b)) / (var_pop(a) * count(*))', 'r2')}, {r6('avg(abs(a - b))', 'mae')} FROM p")
add("stream_recent_counts", "SELECT (ts::DATE + k::INTEGER) AS day, user_id AS node_id, count(*)::BIGINT AS n FROM events, range(3) r(k) GROUP BY ALL")


# Small expressions.
def expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = tables.table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    k = F.col("c_nationkey")
    hot = scalar.one_hot(k % 3, 3)
    return c.select(
        "c_custkey",
        scalar.clamped_ratio("c_acctbal", k - 3).alias("clamped"),
        scalar.clean(F.when(k == 2, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))).alias("clean"),
        scalar.relative_time(k, F.lit(20), 25.0).alias("relative"),
        scalar.stable_bucket("c_name", 64).alias("bucket"),
        scalar.time_weight(k, 0.1).alias("time_weight"),
        scalar.class_target((k % 4).cast("int"), 3).alias("target"),
        scalar.blended([k * 1.0, F.lit(2.0)], [1.0, 3.0]).alias("blended"),
        scalar.without_background(k / 100.0, F.lit(0.2)).alias("without_background"),
        scalar.time_position(k, 25).alias("position"),
        *[h.alias(f"hot_{i}") for i, h in enumerate(hot)],
        scalar.cold_prior(k).alias("cold"),
        scalar.risk_scale([k * 0.1, F.lit(1.0)], [0.5, -0.3], 0.8).alias("risk_scale"),
        scalar.trailing_digits("c_name").alias("digits"),
        scalar.has_cjk(F.when(k == 1, F.lit("风险")).otherwise(F.col("c_name"))).alias("cjk"),
        scalar.object_id("c_custkey", k).alias("object_id"),
        scalar.expired(F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_interval(mins=k.cast("int")), F.lit("2024-01-01 00:20:00").cast("timestamp"), 10).alias("expired"),
    )


register("expressions", expressions)
add(
    "expressions",
    f"""WITH c AS (SELECT c_custkey, c_name, c_nationkey AS k, c_acctbal AS b FROM customer) SELECT c_custkey, {r6('b / greatest(k - 3, 1.0)', 'clamped')}, {r6('CASE WHEN k = 2 THEN -1 ELSE b END', 'clean')}, {r6('least(greatest((20 - k) / 25.0, 0), 1)', 'relative')},
(('0x' || substr(sha256(c_name), 1, 12))::BIGINT % 64)::BIGINT AS bucket, {r6('exp(-0.1 * k)', 'time_weight')}, (CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END)::INTEGER AS target, {r6('k * 0.25 + 1.5', 'blended')}, {r6('0.2 / greatest(k / 100.0 + 0.2, 1e-12)', 'without_background')}, {r6('k / 24.0', 'position')},
{', '.join(r6(f'CASE WHEN k % 3 = {i} THEN 1 ELSE 0 END', f'hot_{i}') for i in range(3))}, {r6('1 / (1.0 + k)', 'cold')}, {r6('1 + 0.8 * (1 / (1 + exp(-(0.05 * k - 0.3))) - 0.5)', 'risk_scale')}, regexp_extract(c_name, '(\\d+)$', 1)::BIGINT AS digits, k = 1 AS cjk, printf('P-%04d-%06d', k, c_custkey) AS object_id, k + 10 <= 20 AS expired FROM c""",
)
