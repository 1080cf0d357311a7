"""The data model: a temporal graph as DataFrames, and what is required of it."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels: held out or unknown, normal, fraud. Others are background labels of a schema.
UNKNOWN, NORMAL, FRAUD = -100, 0, 1


@dataclass(frozen=True)
class GraphSchema:
    """raw: number of raw columns x0, x1, ... of a node; types: edge types are 1 to types."""

    raw: int
    types: int
    background: tuple[int, ...] = ()
    strong_pairs: tuple[tuple[int, int], ...] = ()

    @property
    def raw_columns(self) -> list[str]:
        return [f"x{i}" for i in range(self.raw)]


@dataclass(frozen=True)
class GraphFrame:
    """nodes (node_id long, x0, x1, ... double with -1 for missing, y int); edges (src, dst long, edge_type, day int), a bag.

    adjacency: each edge from both of its ends, with the far end's label (center, neighbor, dir, edge_type, day, far_y), where it is stored.
    """

    nodes: DataFrame
    edges: DataFrame
    schema: GraphSchema
    facts: dict = field(default_factory=dict, compare=False)
    adjacency: DataFrame | None = None

    def max_day(self) -> int:
        """The last day of any edge, 0 without edges; computed once."""
        if "max_day" not in self.facts:
            self.facts["max_day"] = self.edges.agg(F.max("day")).first()[0] or 0
        return self.facts["max_day"]

    def with_edges(self, edges: DataFrame) -> GraphFrame:
        return replace(self, edges=edges, facts={}, adjacency=None)


def violations(g: GraphFrame, train: DataFrame | None = None, test: DataFrame | None = None) -> DataFrame:
    """(rule, violations): how many rows break each rule of the contract, one aggregate for each table.

    train and test (node_id) are the labelled and the held-out ids.
    """
    nodes, edges, known = g.nodes, g.edges, g.nodes.select("node_id", "y")
    count = lambda df, rule, bad: df.agg(F.count_if(bad).cast("long").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    rules = [
        count(edges, "edge_type_in_range", ~F.col("edge_type").between(1, g.schema.types)),
        count(edges, "edge_has_day", F.col("day").isNull()),
        count(nodes, "label_in_domain", ~F.col("y").isin(UNKNOWN, NORMAL, FRAUD, *g.schema.background)),
        nodes.groupBy("node_id").count().agg(F.count_if(F.col("count") > 1).cast("long").alias("violations")).select(F.lit("node_id_unique").alias("rule"), "violations"),
        count(edges.join(known, edges.src == known.node_id, "left_anti"), "src_is_node", F.lit(True)),
        count(edges.join(known, edges.dst == known.node_id, "left_anti"), "dst_is_node", F.lit(True)),
    ]
    if train is not None:
        rules.append(count(train.join(known, "node_id"), "train_is_labelled", ~F.col("y").isin(NORMAL, FRAUD)))
    if test is not None:
        rules.append(count(test.join(known, "node_id"), "test_is_unknown", F.col("y") != UNKNOWN))
    if train is not None and test is not None:
        rules.append(count(train.join(test, "node_id", "left_semi"), "train_and_test_disjoint", F.lit(True)))
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def validate(g: GraphFrame, train: DataFrame | None = None, test: DataFrame | None = None) -> None:
    """Raise ValueError with the broken rules, if any."""
    broken = {r["rule"]: r["violations"] for r in violations(g, train, test).collect() if r["violations"]}
    if broken:
        raise ValueError(f"the graph breaks its contract: {broken}")
