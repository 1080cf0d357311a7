"""Every query that has SQL gives DuckDB's rows; every query runs on the smallest tables."""

import pytest

import __spark_entry__ as entry
from ledgerloom import queries as graph_queries
from tests.compare import differences, oracle


@pytest.mark.parametrize("name", sorted(graph_queries.QUERIES))
def test_query(spark, small_dir, name):
    got = graph_queries.QUERIES[name](spark, small_dir).toPandas()
    assert len(got.columns)
    if name in graph_queries.ORACLES:
        assert differences(got, oracle(small_dir, graph_queries.ORACLES[name])) == ""


def test_entry_points(spark):
    assert entry.entry(spark).columns[0] == "node_id"
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_cross_joins_in_feature_plans(spark, small_dir):
    for name in ("minimum_slice", "snapshot_block", "early_activity", "adaptive_window", "partner_concentration", "motif_lite", "neighbor_profile"):
        plan = graph_queries.QUERIES[name](spark, small_dir)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_every_node_is_a_seed(spark, small_dir):
    """Each node of the events graph has an edge, so each has a subgraph and statistics."""
    nodes = spark.read.parquet(f"{small_dir}/events.parquet").select("user_id").distinct().count()
    for name in ("khop_subgraph_all", "subgraph_stats_all"):
        assert graph_queries.QUERIES[name](spark, small_dir).select("seed").distinct().count() == nodes
