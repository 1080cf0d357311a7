"""The test tables as graphs: orders as a long bipartite graph, events as a short reciprocal one, vectors as a chain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.contract import GraphFrame, GraphSchema
from ledgerloom.sources.shared import large

ORDERS = GraphSchema(raw=3, types=6, background=(2, 3), strong_pairs=((0, 1),))
EVENTS = GraphSchema(raw=1, types=5)
EVENT_TYPES = ("click", "view", "purchase", "signup", "error")
ORDER_TYPES = ("AF", "AO", "NF", "NO", "RF", "RO")
#: Suppliers' ids are their keys and this; customers' ids are their keys below it and their negative keys from it on,
#: so that no id is both, whatever the size. Keys aren't negative.
SUPPLIERS_FROM = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_id(key: Column) -> Column:
    return F.when(key < SUPPLIERS_FROM, key).otherwise(-key)


def is_customer(node_id: Column) -> Column:
    return node_id < SUPPLIERS_FROM


def _code(value, names: tuple[str, ...]):
    out = F.when(value == names[0], F.lit(1))
    for i, n in enumerate(names[1:], 2):
        out = out.when(value == n, F.lit(i))
    return out


def _days(ts, origin: str):
    return (F.datediff(F.to_date(ts), F.to_date(F.lit(origin))) + 1).cast("int")


def orders_graph(spark: SparkSession, sf_dir: str) -> GraphFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # An item is made an edge's numbers before the join, so that no text is shuffled; orders are as many as customers' edges, so they are merged at any size.
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        (F.col("l_suppkey") + SUPPLIERS_FROM).alias("dst"),
        _code(F.concat("l_returnflag", "l_linestatus"), ORDER_TYPES).alias("edge_type"),
        _days(F.col("l_shipdate"), "1995-01-01").alias("day"),
    )
    edges = items.join(large(orders), items.l_orderkey == orders.o_orderkey).select(customer_id(F.col("o_custkey")).alias("src"), "dst", "edge_type", "day")
    known = lambda x: F.when(x < 0, F.lit(-1.0)).otherwise(x)
    placed = orders.groupBy(F.col("o_custkey").alias("c")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    segment = F.col("c_mktsegment")
    label = F.when(segment == "BUILDING", 1).when(segment.isin("MACHINERY", "AUTOMOBILE"), 0).when(segment == "HOUSEHOLD", 2).otherwise(-100)
    customer = table(spark, sf_dir, "customer")
    customers = customer.join(large(placed), customer.c_custkey == placed.c, "left").select(
        customer_id(F.col("c_custkey")).alias("node_id"), known(F.col("c_acctbal")).alias("x0"), F.col("c_nationkey").cast("double").alias("x1"), F.coalesce("n", F.lit(0.0)).alias("x2"), label.alias("y")
    )
    suppliers = table(spark, sf_dir, "supplier").select(
        (F.col("s_suppkey") + SUPPLIERS_FROM).alias("node_id"), known(F.col("s_acctbal")).alias("x0"), F.col("s_nationkey").cast("double").alias("x1"), F.lit(-1.0).alias("x2"), F.when(F.col("s_nationkey") % 2 == 0, 3).otherwise(-100).alias("y")
    )
    return GraphFrame(customers.unionByName(suppliers), edges, ORDERS)


def events_graph(spark: SparkSession, sf_dir: str) -> GraphFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    later = events.select((F.col("event_id") - 1).alias("_before"), F.col("user_id").alias("dst"), _code(F.col("event_type"), EVENT_TYPES).alias("edge_type"), _days(F.col("ts"), "2024-01-01").alias("day"))
    edges = events.select("event_id", F.col("user_id").alias("src")).join(later, F.col("event_id") == F.col("_before")).select("src", "dst", "edge_type", "day")
    nodes = events.groupBy(F.col("user_id").alias("node_id")).agg(F.count(F.lit(1)).cast("double").alias("x0"), F.lit(-100).alias("y"))
    return GraphFrame(nodes, edges, EVENTS)


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(node_id, v) and (src, dst): each vector linked to the next."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    ids = rows.select("node_id")
    later = ids.select(F.col("node_id").alias("dst"))
    return rows, ids.select(F.col("node_id").alias("src"), (F.col("node_id") + 1).alias("dst")).join(later, "dst", "left_semi").select("src", "dst")


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, score): errors among the events, by a score of their value, with ties."""
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_id").alias("id"), (F.col("event_type") == "error").cast("int").alias("y"), (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("value") / 100.0))).alias("score"))
