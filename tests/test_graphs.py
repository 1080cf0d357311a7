"""Hand-made graphs of a few nodes, and properties that hold on any graph."""

import datetime as dt
import math
import random
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerloom.contract import GraphFrame, GraphSchema, validate
from ledgerloom.operators import graph, impute, pairs, rows, sampling, snapshot, weights, windows
from ledgerloom.plans import metrics, profile, report, serving
from ledgerloom.sources import tables
from ledgerloom.streaming import windows as streams

SCHEMA = GraphSchema(raw=1, types=2, background=(2, 3))


def make(spark, edges, nodes=4, y=None, x=None):
    nodes_df = spark.createDataFrame([(i, float((x or {}).get(i, -1.0)), (y or {}).get(i, 0)) for i in range(nodes)], "node_id long, x0 double, y int")
    return GraphFrame(nodes_df, spark.createDataFrame(edges, "src long, dst long, edge_type int, day int"), SCHEMA)


def by_node(df):
    return {r["node_id"]: r for r in df.collect()}


def test_empty_directions_and_isolated_nodes(spark):
    g = make(spark, [(0, 1, 1, 1)], 3)
    act, age = by_node(graph.activity(g)), by_node(graph.edge_age(g))
    assert (act[2]["first_active"], act[2]["last_active"], act[2]["active_span"]) == (2, 0, -2)
    assert age[0]["days_since_out_last"] == 0 and age[0]["days_since_in_last"] == 2 and age[2]["days_since_out_mean"] == 2
    assert by_node(pairs.motif_lite(g))[2]["tm14_repeat_out_ratio"] == 1.0


def test_reciprocal_pairs_self_loops_and_bursts(spark):
    g = make(spark, [(0, 1, 1, 1), (1, 0, 1, 2), (0, 1, 2, 2), (2, 2, 1, 2)])
    assert {tuple(r) for r in pairs.reciprocal(g.edges).collect()} == {(0, 1), (1, 0), (2, 2)}
    b = by_node(pairs.daily_burst(g))
    assert (b[2]["burst_out_7"], b[2]["burst_in_7"], b[2]["burst_total_7"], b[3]["burst_total_7"]) == (1, 1, 2, 0)
    u = by_node(graph.unique_multi_edges(g))
    assert (u[0]["unique_out"], u[0]["multi_out"]) == (1, 1)


def test_windows_of_a_single_day(spark):
    g = make(spark, [(0, 1, 1, 1)] * 4, 2)
    got = [(w.start, w.end) for w in windows.edge_time_windows(g.edges)]
    assert got == [(1, 1), (2, 2), (3, 3), (4, 1)]
    assert {r["window_end"] for r in windows.node_time_bucket(g).collect()} == {1}


def test_cohort_edges_and_constant_cohorts(spark):
    days = spark.createDataFrame([(1,), (30,), (31,), (61,), (0,)], "d int").select(windows.cohort(F.col("d")).alias("c")).collect()
    assert [r["c"] for r in days] == [0, 0, 1, 2, 0]
    g = make(spark, [(0, 1, 1, 1), (1, 2, 1, 1), (2, 3, 1, 1), (3, 0, 1, 1)])
    assert all(r["tb30_log_total_degree_z"] == 0 for r in windows.cohort_zscore(g).collect())
    assert all(r[c] == 0 for r in windows.missing_zscore(g).collect() for c in ("tb30_x0_z", "tb30_x0_missing_z"))
    assert all(r["taw_out_peak_window"] == 0 for r in windows.adaptive_window(g).collect())


def test_background_labels(spark):
    g = make(spark, [(0, 1, 1, 1), (0, 2, 1, 1), (0, 3, 1, 1)], 4, {1: 2, 2: 3, 3: -100})
    touch = by_node(graph.background_touch(g))
    assert (touch[0]["bg_out_count"], touch[0]["bg_out_ratio"], touch[0]["touch_background"], touch[1]["touch_background"]) == (2, 0.5, 1, 0)


def test_contract(spark):
    validate(make(spark, [(0, 1, 1, 1)]))
    with pytest.raises(ValueError, match="edge_type_in_range"):
        validate(make(spark, [(0, 1, 3, 1)]))
    with pytest.raises(ValueError, match="dst_is_node"):
        validate(make(spark, [(0, 9, 1, 1)]))


EDGES = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.integers(1, 2), st.integers(1, 100)), min_size=1, max_size=25)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(EDGES)
def test_properties(spark, edges):
    g = make(spark, edges, 6)
    d = graph.degrees(g).agg(F.sum("indegree"), F.sum("outdegree")).first()
    assert d[0] == d[1] == len(edges)
    for r in pairs.partner_concentration(g).collect():
        assert all(0 <= r[c] <= 1 + 1e-9 for c in r.asDict() if c != "node_id")
    for r in graph.recent_counts(g).collect():
        assert r["out_last3"] <= r["out_last7"] <= r["out_last30"]
    total = by_node(graph.degrees(g))
    assert all(r["snap_total_count"] <= total[n]["total_degree"] for n, r in by_node(snapshot.snapshot_block(g)).items())


def test_ranking_metrics(spark):
    rows_ = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, None), (2, 0.5)]
    m = metrics.metrics(spark.createDataFrame(rows_, "y int, score double")).first()
    assert (m["positives"], m["negatives"], m["roc_auc"]) == (2, 2, 0.875)
    assert m["average_precision"] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3)
    assert metrics.metrics(spark.createDataFrame([(1, 0.5)], "y int, score double")).first()["roc_auc"] is None


def test_psi_of_equal_samples_is_zero(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    assert profile.psi(df, df, ["v"]).first()["psi"] == pytest.approx(0, abs=1e-9)


def test_normalisation_modes():
    assert [rows.normalization(n) for n in ("x0_is_neg1", "x12", "indegree", "out_last7", "out_last7_ratio_v2", "tb30_x0_z", "bg_in_ratio")] == ["identity", "raw", "log", "log", "zscore", "identity", "zscore"]


def test_samples_are_stable_and_bounded(spark):
    edges = [(0, i % 3 + 1, 1, i % 5 + 1) for i in range(40)] + [(0, 1, 1, 5)] * 3
    g = make(spark, edges)
    a, b = (sorted(map(tuple, sampling.uniform_fanout(x, 4, 1).collect())) for x in (g, g.with_edges(g.edges.repartition(7))))
    assert a == b and max(r[-1] for r in a) == 4
    w = spark.createDataFrame([(0, 1.0), (1, 1.0), (2, 1.0), (3, 1.0)], "rel_id int, weight double")
    assert sampling.weighted_fanout(g, w, 3, 1, pool=5).filter("center = 0").count() == 3
    kept = sampling.hybrid_fanout(g, 4, 1).filter("center = 0")
    assert kept.count() == 4 and kept.filter("part = 'recent'").count() == 2
    batches = sampling.balanced_batches(spark.createDataFrame([(i, int(i < 10)) for i in range(100)], "node_id long, y int"), {0: 4, 1: 2}, 1)
    assert sorted((r["batch"], r["y"], r["count"]) for r in batches.groupBy("batch", "y").count().collect()) == sorted((b, y, n) for b in range(5) for y, n in ((0, 4), (1, 2)))


def test_negatives_fill_their_quota(spark):
    pool = spark.createDataFrame([(i, 0, i < 3) for i in range(12)], "node_id long, bucket int, hard boolean")
    got = sampling.negatives(pool, spark.createDataFrame([(0, 8)], "bucket int, n int"), "bucket", 1).collect()
    assert len(got) == 8 and sum(r["hard"] for r in got) == 3


def test_affine_fill_recovers_a_line(spark):
    nodes = spark.createDataFrame([(i, float(2 * i + 1) if i % 5 else -1.0, float(i), float(i % 3)) for i in range(50)], "node_id long, t double, a double, b double")
    got = {r["node_id"]: r["t"] for r in impute.affine_fill(nodes, "t", ["a", "b"]).collect()}
    assert all(v == pytest.approx(2 * n + 1) for n, v in got.items())
    assert impute.ridge_fill(nodes, "t", ["a", "b"]).filter("filled and t > 0").count() == 10
    assert impute.forced_missing(nodes, ["a"], 4).filter("a = -1").count() == 4


def test_softmax_of_equal_scores(spark):
    df = spark.createDataFrame([(1, 900.0), (1, 900.0), (2, -5.0)], "s int, v double")
    assert sorted(r["softmax"] for r in weights.segment_softmax(df, "s", "v", []).collect()) == [0.5, 0.5, 1.0]


def test_mapping_and_ingest(spark):
    m = serving.guess_mapping(["ID", "name", "Source", "target", "relation", "v"])
    assert m.roles == {"node_id": "ID", "name": "name", "source": "Source", "target": "target", "edge_type": "relation"} and m.features == ("v",)
    raw = spark.createDataFrame([("a", "A", "x", "y", None, "1.5"), (None, "B", "", "y", "r", "2"), ("a", "A", None, "y", "r", "z")], ["ID", "name", "Source", "target", "relation", "v"])
    assert [(r["source"], r["edge_type"]) for r in serving.ingest_edges(raw, m).collect()] == [("x", "relation")]
    assert [r["node_id"] for r in serving.ingest_nodes(raw, m).collect()] == ["a"]


def test_early_stop_and_deltas(spark):
    e = spark.createDataFrame([("m", "d", i, v) for i, v in enumerate([0.1, 0.3, 0.2, 0.3, 0.25])], "method string, dataset string, epoch int, auc double")
    assert [r["waited"] for r in report.early_stop(e, "auc", 3).orderBy("epoch").collect()] == [0, 0, 1, 2, 3]
    best = report.best_epoch(e, "auc")
    assert best.first()["best_epoch"] == 1 and report.with_delta(best, "auc", "m").first()["shown"] == "30.00% (+0.00%)"


def test_prototypes_over_a_stream(spark, tmp_path):
    schema = "label int, v array<double>"
    for i, v in enumerate([[1.0, 0.0], [0.0, 1.0]]):
        spark.createDataFrame([(1, v)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = streams.latest(streams.run_to_end(streams.prototypes(stream, 0.5), "update"), "label").first()
    assert got["n"] == 2 and math.hypot(*got["prototype"]) == pytest.approx(1) and got["prototype"][0] == pytest.approx(math.sqrt(0.5))


def test_streams_over_files_in_any_order(spark, tmp_path):
    """Events dealt at random into files that each span the time range: every row counts."""
    draw = random.Random(4)
    rows = [(draw.randint(0, 5), dt.datetime(2024, 1, 1) + dt.timedelta(hours=draw.randint(0, 24 * 40)), 1.0) for _ in range(300)]
    rows += [(9, dt.datetime(2024, 2, 1), 1.0)] * 3 + [(9, dt.datetime(2024, 1, 28), 1.0), (9, dt.datetime(2024, 1, 20), 1.0)]
    draw.shuffle(rows)
    schema = "user_id long, ts timestamp_ntz, value double"
    folder = str(tmp_path / "events.parquet")
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.mode("append").parquet(folder)
    got = entry.queries()["stream_daily_counts"](spark, str(tmp_path)).collect()
    assert {(r["day"], r["node_id"]): r["n"] for r in got} == Counter((t.date(), u) for u, t, _ in rows)
    epoch, first = dt.date(1970, 1, 1), {}
    for u, t, _ in rows:
        first[u] = min(first.get(u, t.date()), t.date())
    want = {u: ((f - epoch).days, sum(v == u and t.date() < f + dt.timedelta(7) for v, t, _ in rows)) for u, f in first.items()}
    got = entry.queries()["stream_early_activity"](spark, str(tmp_path)).collect()
    assert {r["node_id"]: (r["first_day"], r["early"]) for r in got} == want


def test_customers_and_suppliers_never_share_an_id(spark, tmp_path):
    """Customer keys on both sides of the suppliers' first id, among them those of the suppliers' ids."""
    keys, suppliers = [1, 2, 999_999, 1_000_000, 1_000_001, 1_000_002, 3_000_000], [0, 1, 2]
    put = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    put("customer", [(k, -5.0 if i == 4 else 10.0 * i, i, "BUILDING") for i, k in enumerate(keys)], "c_custkey long, c_acctbal double, c_nationkey int, c_mktsegment string")
    put("supplier", [(k, -3.0 if k == 1 else 7.0 + k, k) for k in suppliers], "s_suppkey long, s_acctbal double, s_nationkey int")
    orders = list(enumerate(k for i, k in enumerate(keys) for _ in range(i % 3 + 1)))
    put("orders", orders, "o_orderkey long, o_custkey long")
    items = [(i, s, "A", "F", dt.date(1995, 1, 2)) for i, _ in orders for s in suppliers]
    put("lineitem", items, "l_orderkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_shipdate date")
    g = tables.orders_graph(spark, str(tmp_path))
    ids = [r["node_id"] for r in g.nodes.collect()]
    assert len(set(ids)) == len(ids) == len(keys) + len(suppliers)
    ends = Counter(x for r in g.edges.collect() for x in (r["src"], r["dst"]))
    assert set(ends) == set(ids) and sorted(ends.values()) == sorted([3 * (i % 3 + 1) for i in range(7)] + [len(orders)] * 3)
    assert g.nodes.filter(tables.is_customer(F.col("node_id"))).count() == len(keys)
    for name, rows_, filled in (("affine_impute", len(ids), 2), ("ridge_impute", len(ids), 2)):
        got = entry.queries()[name](spark, str(tmp_path)).collect()
        assert len({r["node_id"] for r in got}) == len(got) == rows_ and sum(r["filled"] for r in got) == filled
