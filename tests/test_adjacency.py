"""A stored graph gives what the graph gives, without a shuffle by node."""

import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.contract import GraphFrame, GraphSchema
from ledgerloom.operators import graph, pairs, sampling, windows
from ledgerloom.sources import adjacency


@pytest.fixture(scope="module")
def stars(spark):
    """A graph with a hub, repeated edges, loops, an edge to no node and nodes without edges."""
    draw = random.Random(2)
    edges = [(draw.randint(0, 60), draw.randint(0, 60), draw.randint(1, 2), draw.randint(1, 50)) for _ in range(400)] + [(7, i % 50, 1, i % 50 + 1) for i in range(300)] + [(1, 1, 1, 5), (2, 999, 2, 6)]
    nodes = [(i, float(i % 5) - 1, (-100, 0, 1, 2)[i % 4]) for i in range(70)]
    return GraphFrame(spark.createDataFrame(nodes, "node_id long, x0 double, y int"), spark.createDataFrame(edges, "src long, dst long, edge_type int, day int"), GraphSchema(raw=1, types=2, background=(2,)))


OPERATORS = {
    "degrees": graph.degrees,
    "activity": graph.activity,
    "background": graph.background_touch,
    "windows": windows.window_counts,
    "recent": graph.recent_counts,
    "labels": graph.aux_label_counts,
    "latest": lambda g: sampling.top_recent(g, 3),
    "partners": pairs.partner_concentration,
}


def exchanges(df):
    return re.findall(r"Exchange \w+\(?[^\n]*", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("most", [10_000, 100])
def test_a_stored_graph_is_the_graph(spark, stars, tmp_path, most):
    tables = adjacency.write(stars, f"star_{most}", str(tmp_path / "g"), rows_a_bucket=300, most=most)
    g = adjacency.read(spark, tables, stars.schema)
    assert tables.buckets == 5 and bool(tables.hubs) == (most == 100)
    try:
        for name, operator in OPERATORS.items():
            assert sorted(map(str, operator(g).collect())) == sorted(map(str, operator(stars).collect())), name
        assert sorted(map(tuple, g.edges.collect())) == sorted(map(tuple, stars.edges.collect()))
        assert g.adjacency.filter("center = 7").count() > 300 and (most > 100 or spark.table(tables.hubs).select("center").distinct().count() == 1)
    finally:
        adjacency.drop(spark, tables)
    assert not spark.catalog.tableExists(tables.adjacency)


def test_no_shuffle_by_node(spark, stars, tmp_path):
    tables = adjacency.write(stars, "plain_star", str(tmp_path / "g"), rows_a_bucket=300, most=10_000)
    g = adjacency.read(spark, tables, stars.schema)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name in ("degrees", "background", "latest", "labels"):
            assert exchanges(OPERATORS[name](g)) == [], name
            assert exchanges(OPERATORS[name](stars)), name
        windows_ = windows.edge_time_windows(g.edges)
        counted = graph.counted(graph.incident(g), {"early": F.col("day") <= windows_[0].end})
        assert exchanges(graph.complete(g.nodes, counted)) == []
        # With hubs, one shuffle of partial counts.
        hubs = adjacency.read(spark, adjacency.write(stars, "hub_star", str(tmp_path / "h"), rows_a_bucket=300, most=100), stars.schema)
        assert len(exchanges(graph.counted(graph.incident(hubs), {"n": F.lit(True)}))) <= 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_an_empty_graph(spark, stars, tmp_path):
    none = GraphFrame(stars.nodes.limit(0), stars.edges.limit(0), stars.schema)
    tables = adjacency.write(none, "empty_star", str(tmp_path / "g"))
    g = adjacency.read(spark, tables, stars.schema)
    assert tables.buckets == 1 and graph.degrees(g).collect() == [] and g.edges.collect() == []
