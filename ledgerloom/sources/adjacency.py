"""The adjacency as a bucketed table: what is grouped or joined by node needs no shuffle.

A graph is stored as tables of one number of buckets: its nodes by node_id, and by center each edge from both of its ends, with the far
end's label. A bucket is one file, sorted by center and day, so that a scan is partitioned by node.

A bucket is read by one task, so a hub must not fill one: the edges of a center that has more than
`most` are a table of their own, unbucketed, which Spark splits as it likes. A graph with hubs reads
as the union of both, and is grouped with one shuffle again, of one row for each center and task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.contract import GraphFrame, GraphSchema
from ledgerloom.operators.graph import labelled
from ledgerloom.sources.shared import stored

#: Edge ends in a bucket, of which a row takes some 30 bytes, and in a bucket's largest center.
ROWS_A_BUCKET = 1 << 23
#: Hubs that are broadcast at most, when they are told apart.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Stored:
    """The tables of a stored graph."""

    nodes: str
    adjacency: str
    hubs: str | None
    buckets: int


def _bucketed(df: DataFrame, key: str, order: list[str], buckets: int, table: str, path: str) -> None:
    """One file for each bucket: Spark deals rows to buckets as it deals them to as many partitions."""
    dealt = df.repartition(buckets, key).sortWithinPartitions(*order)
    dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(*order).format("parquet").option("path", path).saveAsTable(table)


def write(g: GraphFrame, name: str, path: str, *, rows_a_bucket: int = ROWS_A_BUCKET, most: int | None = None) -> Stored:
    """Store a graph as tables named after `name` with their files below path. most: the edge ends of a center that isn't a hub (rows_a_bucket if not given)."""
    ends = stored(labelled(g).select("center", "neighbor", "dir", "edge_type", "day", "far_y"), "edge-ends")
    sizes = ends.groupBy("center").agg(F.count(F.lit(1)).alias("n"))
    facts = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).first()
    buckets, most = max(1, -(-facts["rows"] // rows_a_bucket)), most or rows_a_bucket
    hubs = None
    if facts["largest"] > most:
        large = sizes.filter(F.col("n") > most).select("center")
        if large.count() <= BROADCAST_ROWS:
            large = F.broadcast(large)
        hubs = f"{name}_hubs"
        ends.join(large, "center", "left_semi").write.mode("overwrite").format("parquet").option("path", f"{path}/hubs").saveAsTable(hubs)
        ends = ends.join(large, "center", "left_anti")
    order = ["center", "day"]
    _bucketed(ends, "center", order, buckets, f"{name}_adjacency", f"{path}/adjacency")
    _bucketed(g.nodes, "node_id", ["node_id"], buckets, f"{name}_nodes", f"{path}/nodes")
    return Stored(f"{name}_nodes", f"{name}_adjacency", hubs, buckets)


def read(spark: SparkSession, tables: Stored, schema: GraphSchema) -> GraphFrame:
    """The stored graph; its edges are those seen from their sources."""
    ends = spark.table(tables.adjacency)
    ends = ends.unionByName(spark.table(tables.hubs)) if tables.hubs else ends
    edges = ends.filter(F.col("dir") == "out").select(F.col("center").alias("src"), F.col("neighbor").alias("dst"), "edge_type", "day")
    return GraphFrame(spark.table(tables.nodes), edges, schema, adjacency=ends)


def drop(spark: SparkSession, tables: Stored) -> None:
    """Forget the tables; their files stay."""
    for table in (tables.nodes, tables.adjacency, tables.hubs):
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
