"""What keeps memory and shuffles in proportion: rows of nodes are never broadcast, what is read often is computed once."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from ledgerloom import model_queries, more_queries, queries, stream_queries  # noqa: F401  all queries are registered
from ledgerloom.functions import texts
from ledgerloom.model_queries import COMPACT, train_nodes
from ledgerloom.operators import impute, rows, snapshot
from ledgerloom.plans import blocks, models
from ledgerloom.sources import tables
from ledgerloom.streaming import memory


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_profiles_broadcast_no_rows_of_nodes(spark, small_dir):
    g = tables.orders_graph(spark, small_dir)
    for groups, train in ((COMPACT, None), (blocks.resolve("m1_tabular", ["utpm_attr_proj", "time"]), train_nodes(g))):
        wide = plan(blocks.features(g, groups, train)[0])
        assert "SortMergeJoin" in wide and "BroadcastHashJoin" not in wide


def counted(spark, df, column):
    """df with a column that passes through Python, and how many of its rows were computed."""
    seen = spark.sparkContext.accumulator(0)

    def pass_on(x):
        seen.add(1)
        return x

    return df.withColumn(column, F.udf(pass_on, df.schema[column].dataType).asNondeterministic()(column)), seen


def test_edges_are_joined_by_merging_and_without_text(spark, small_dir):
    edges = plan(tables.orders_graph(spark, small_dir).edges)
    assert "SortMergeJoin" in edges and "Broadcast" not in edges
    project = edges.index("SortMergeJoin")
    assert "Project" in edges[project:] and "AS edge_type" in edges[project:]


@pytest.mark.parametrize("fill", [lambda n: impute.affine_fill(n, "t", ["a", "b"], step="step"), lambda n: impute.ridge_holdout_fill(n, ["t"], ["a", "b"], "step", least_train=5, least_valid=1, least_fit=5)[0]])
def test_fills_compute_their_rows_once(spark, fill):
    rows = [(i, float(i % 7) if i % 5 else -1.0, float(i % 7), float(i % 3), i % 4) for i in range(100)]
    nodes, seen = counted(spark, spark.createDataFrame(rows, "node_id long, t double, a double, b double, step int"), "a")
    assert fill(nodes).count() == 100 and seen.value == 100


@pytest.mark.parametrize("of", [lambda g: model_queries.baseline(g, models.linear_baseline), lambda g: model_queries.baseline(g, lambda *x: models.boosted_baseline(*x, rounds=2)), lambda g: rows.apply_normalizer(*more_queries.normalized(g))])
def test_learners_and_scales_compute_edges_once(spark, small_dir, of):
    g = tables.orders_graph(spark, small_dir)
    n = g.edges.count()
    edges, seen = counted(spark, g.edges, "day")
    assert of(replace(g, edges=edges, facts={})).count() and seen.value == n


@pytest.mark.parametrize("name", [*queries.KEPT, "phase_files", "archive_phase"])
def test_queries_join_edges_once(spark, small_dir, name, monkeypatch):
    g = tables.orders_graph(spark, small_dir)
    n = g.edges.count()
    edges, seen = counted(spark, g.edges, "day")
    monkeypatch.setattr(tables, "orders_graph", lambda *_: replace(g, edges=edges, facts={}))
    assert queries.QUERIES[name](spark, small_dir).count() == 160 and seen.value == n


def test_a_profile_is_cut_by_rows(spark, small_dir, monkeypatch):
    monkeypatch.setattr(snapshot, "PROFILE_ROWS", 100)
    g = tables.orders_graph(spark, small_dir)
    wanted = -(-2 * g.edges.count() // 100)
    assert "hashpartitioning(neighbor#" in plan(snapshot.neighbor_profile(g)) and f", {wanted}), REPARTITION_BY_NUM" in plan(snapshot.neighbor_profile(g))


def test_a_unit_takes_its_length_once(spark):
    text = str(memory.unit(F.col("v")))
    assert text.count("sqrt") == 1 and "array(" in text
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (0, [0.0, 0.0])], "bucket int, v array<double>")
    assert sorted(r[0] for r in rows.select(memory.unit(F.col("v"))).collect()) == [[0.0, 0.0], [0.6, 0.8]]
    held = spark.createDataFrame([(0, 0, [0.0, 1.0], 1), (0, 1, [1.0, 0.0], 1), (-1, 0, [1.0, 0.0], 2)], memory.SCHEMA)
    assert plan(memory.classified(rows, held)).count("greatest") == 1


def test_objects_are_read_by_tokens(spark):
    texts_ = ['x {"a": "}\\" {", "b": {"c": 1}} {', "{", '{"a', "none", 'é{"k": "\\\\"}z', '\n{\n"a":\n1}', '{"a\\', "", None]
    wanted = ['{"a": "}\\" {", "b": {"c": 1}}', None, None, None, '{"k": "\\\\"}', '{\n"a":\n1}', None, None, None]
    df = spark.createDataFrame(list(enumerate(texts_)), "i int, t string").withColumn("o", texts.balanced_object(F.col("t")))
    assert [r["o"] for r in df.orderBy("i").collect()] == wanted
    assert "regexp_extract_all" in plan(df) and plan(df).count("aggregate(") == 1


def test_json_rows_are_dealt_to_all_cores(spark, small_dir):
    assert "Exchange hashpartitioning(c_custkey" in plan(queries.QUERIES["json_fields"](spark, small_dir))
