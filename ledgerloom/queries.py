"""The graph operators as queries over the test tables.

Doubles are rounded to six decimals, so that two engines that add in different orders agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.contract import GraphFrame
from ledgerloom.functions.scalar import r6
from ledgerloom.operators import graph, pairs, rows, snapshot, windows
from ledgerloom.oracles import FEATURE_ORACLES
from ledgerloom.plans import metrics, profile
from ledgerloom.sources import tables
from ledgerloom.sources.shared import stored, stored_graph

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = dict(FEATURE_ORACLES)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(f"`{n}`")).alias(n) if kind == "double" else F.col(f"`{n}`") for n, kind in df.dtypes])


def register(name: str, of: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(of(spark, sf_dir))


def on_orders(name: str, operator: Callable[[GraphFrame], DataFrame], kept: bool = False) -> None:
    """kept: the graph is written once, for an operator that reads its edges several times."""
    made = (lambda *at: stored_graph(tables.orders_graph(*at))) if kept else tables.orders_graph
    register(name, lambda spark, sf_dir: operator(made(spark, sf_dir)))


def on_events(name: str, operator: Callable[[GraphFrame], DataFrame]) -> None:
    register(name, lambda spark, sf_dir: operator(tables.events_graph(spark, sf_dir)))


def minimum_slice(g: GraphFrame) -> DataFrame:
    """Degrees, activity and the cohort-normalised logarithm of the out-degree of each node."""
    nodes = graph.degrees(g).join(graph.activity(g), "node_id").withColumn("cohort", windows.cohort(F.col("first_active")))
    keep = ("node_id", "indegree", "outdegree", "first_active", "last_active")
    return windows.z_scores(nodes, {"log_outdegree_z": (F.log1p("outdegree"), None)}, keep=(*keep, "cohort"), by="cohort")


def psi_drift(g: GraphFrame) -> DataFrame:
    """Drift of the raw columns between nodes that became active before and from the middle day on."""
    # Read for the middle day, the sketch, the brackets and the bins: written once, the columns that these need.
    nodes = stored(g.nodes.join(graph.activity(g), "node_id").select("node_id", "first_active", *g.schema.raw_columns), "active-nodes")
    mid = int(nodes.agg(F.median("first_active")).first()[0] or 0)
    return profile.psi(nodes.filter(F.col("first_active") < mid), nodes.filter(F.col("first_active") >= mid), g.schema.raw_columns)


#: What reads the edges more than once: for windows, first days, counts and the last day.
KEPT = ("snapshot_block", "snapshot_recent", "snapshot_relation_recent", "early_activity", "neighbor_profile", "snapshot_neighbor_profile", "relation_core")
on_orders("minimum_slice", minimum_slice)
for _name, _operator in {
    "graph_degree": graph.degrees,
    "graph_activity": graph.activity,
    "edge_type_counts": graph.edge_type_counts,
    "background_touch": graph.background_touch,
    "background_by_type": graph.background_by_type,
    "edge_time_windows": windows.windows_table,
    "node_time_bucket": windows.node_time_bucket,
    "window_counts": windows.window_counts,
    "edge_age": graph.edge_age,
    "recent_counts": graph.recent_counts,
    "aux_label_counts": graph.aux_label_counts,
    "snapshot_block": snapshot.snapshot_block,
    "snapshot_recent": snapshot.snapshot_recent,
    "snapshot_relation_recent": snapshot.snapshot_relation_recent,
    "early_activity": snapshot.early_activity,
    "neighbor_profile": snapshot.neighbor_profile,
    "snapshot_neighbor_profile": snapshot.snapshot_neighbor_profile,
    "raw_block": rows.raw_block,
    "row_attr_stats": rows.row_attr_stats,
    "relation_core": rows.relation_core,
    "cohort_zscore": windows.cohort_zscore,
    "missing_zscore": windows.missing_zscore,
    "time_detrend": windows.time_detrend,
    "adaptive_window": windows.adaptive_window,
    "dual_scale_delta": windows.dual_scale_delta,
    "overview": profile.overview,
    "feature_profile": profile.feature_profile,
    "missing_by_group": profile.missing_by_group,
    "feature_corr": profile.feature_corr,
    "degree_stats": profile.degree_stats,
    "node_activity_stats": profile.node_activity_stats,
    "label_pair_matrix": profile.label_pair_matrix,
    "background_bridge": profile.background_bridge,
    "edge_day_series": profile.edge_day_series,
    "time_window_profile": profile.time_window_profile,
    "psi_drift": psi_drift,
    "time_split": metrics.time_split,
    "value_windows": lambda g: profile.value_windows(g.nodes, "x2", 4),
    "cumulative_distribution": lambda g: profile.cumulative_distribution(g.nodes, "x2"),
}.items():
    on_orders(_name, _operator, kept=_name in KEPT)
for _name, _operator in {
    "unique_multi_edges": graph.unique_multi_edges,
    "partner_concentration": pairs.partner_concentration,
    "daily_burst": pairs.daily_burst,
    "motif_lite": pairs.motif_lite,
    "reciprocal_pairs": lambda g: pairs.reciprocal(g.edges),
}.items():
    on_events(_name, _operator)
register("edge_cosine", lambda spark, sf_dir: pairs.edge_cosine(*tables.vectors(spark, sf_dir)))
register("ranking_metrics", lambda spark, sf_dir: metrics.metrics(tables.scored_events(spark, sf_dir)))
