"""Counts, activity and partners of nodes. Every operator returns a row for each node.

Both directions of an edge become rows of one adjacency, keyed by the node they are seen from,
and an operator is one conditional aggregation over it: one shuffle, combined on the map side,
however many windows, types and labels it counts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.contract import GraphFrame
from ledgerloom.functions.scalar import safe_ratio
from ledgerloom.operators import scales

RECENT_WINDOWS = (3, 7, 14, 30)


def adjacency(edges: DataFrame, *extra: str) -> DataFrame:
    """(center, neighbor, dir, edge_type, day): each edge seen from its source (`out`) and its target (`in`), in one pass over the edges."""
    rest = ["edge_type", "day", *extra]
    seen = lambda center, neighbor, d: F.struct(F.col(center).alias("center"), F.col(neighbor).alias("neighbor"), F.lit(d).alias("dir"))
    both = F.explode(F.array(seen("src", "dst", "out"), seen("dst", "src", "in"))).alias("_seen")
    return edges.select(both, *rest).select("_seen.center", "_seen.neighbor", "_seen.dir", *rest)


def incident(g: GraphFrame) -> DataFrame:
    """The adjacency of a graph's edges, as it is stored if it is."""
    return adjacency(g.edges) if g.adjacency is None else g.adjacency.select("center", "neighbor", "dir", "edge_type", "day")


def labelled(g: GraphFrame) -> DataFrame:
    """The adjacency with the label of the far end, null if it isn't a node."""
    if g.adjacency is not None:
        return g.adjacency
    far = g.nodes.select(F.col("node_id").alias("neighbor"), F.col("y").alias("far_y"))
    return incident(g).join(far, "neighbor", "left")


def complete(nodes: DataFrame, found: DataFrame, defaults: Mapping[str, Column | float] | float = 0.0, key: str = "center") -> DataFrame:
    """A row for each node: what was found, or the defaults."""
    names = [c for c in found.columns if c != key]
    base = nodes.select("node_id").join(found, F.col("node_id") == found[key], "left")
    value = lambda n: defaults[n] if isinstance(defaults, Mapping) else defaults
    return base.select("node_id", *[F.coalesce(F.col(n), value(n) if isinstance(value(n), Column) else F.lit(value(n)).cast(found.schema[n].dataType)).alias(n) for n in names])


def counted(adj: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """For each center the number of its rows that meet each condition."""
    return adj.groupBy("center").agg(*[F.count_if(c).cast("double").alias(n) for n, c in conditions.items()])


def _dir(d: str) -> Column:
    return F.col("dir") == d


@scales.columns(log="indegree outdegree total_degree")
def degrees(g: GraphFrame) -> DataFrame:
    found = counted(incident(g), {"indegree": _dir("in"), "outdegree": _dir("out")})
    total = F.col("indegree") + F.col("outdegree")
    return complete(g.nodes, found).select("node_id", "indegree", "outdegree", total.alias("total_degree"), safe_ratio("outdegree", "indegree").alias("out_over_in_plus1"), safe_ratio("indegree", "outdegree").alias("in_over_out_plus1"))


@scales.columns(log="first_active last_active active_span")
def activity(g: GraphFrame) -> DataFrame:
    """First and last day of any edge, and the span between; a node without edges begins after the last day and ends at 0."""
    found = incident(g).groupBy("center").agg(F.min("day").alias("first_active"), F.max("day").alias("last_active"))
    whole = complete(g.nodes, found, {"first_active": F.lit(g.max_day() + 1), "last_active": F.lit(0)})
    return whole.withColumn("active_span", F.col("last_active") - F.col("first_active"))


@scales.columns(log="{d}_type_{n}_count")
def edge_type_counts(g: GraphFrame) -> DataFrame:
    wanted = {f"{d}_type_{t}_count": _dir(d) & (F.col("edge_type") == t) for t in range(1, g.schema.types + 1) for d in ("in", "out")}
    return complete(g.nodes, counted(incident(g), wanted))


def _background(g: GraphFrame) -> Column:
    return F.coalesce(F.col("far_y").isin(*g.schema.background), F.lit(False)) if g.schema.background else F.lit(False)


@scales.columns(log="bg_{e}_count", identity="touch_background")
def background_touch(g: GraphFrame) -> DataFrame:
    """Edges to neighbours with a background label, their share, and whether there are any."""
    bg = _background(g)
    found = counted(labelled(g), {"bg_in_count": _dir("in") & bg, "bg_out_count": _dir("out") & bg, "_in": _dir("in"), "_out": _dir("out")})
    both = F.col("bg_in_count") + F.col("bg_out_count")
    return complete(g.nodes, found).select(
        "node_id",
        "bg_in_count",
        "bg_out_count",
        both.alias("bg_total_count"),
        safe_ratio("bg_in_count", "_in").alias("bg_in_ratio"),
        safe_ratio("bg_out_count", "_out").alias("bg_out_ratio"),
        safe_ratio(both, F.col("_in") + F.col("_out")).alias("bg_total_ratio"),
        (both > 0).cast("double").alias("touch_background"),
    )


@scales.columns(log="bg_{d}_type_{n}_count")
def background_by_type(g: GraphFrame) -> DataFrame:
    bg = _background(g)
    wanted = {f"bg_{d}_type_{t}_count": _dir(d) & bg & (F.col("edge_type") == t) for t in range(1, g.schema.types + 1) for d in ("in", "out")}
    return complete(g.nodes, counted(labelled(g), wanted))


@scales.columns(log="unique_{d} multi_{d}")
def unique_multi_edges(g: GraphFrame) -> DataFrame:
    """Distinct partners by direction, edges beyond one for each, and the partners' share in the degree."""
    pairs = incident(g).groupBy("center", "neighbor", "dir").agg(F.count(F.lit(1)).alias("n"))
    sums = {}
    for d in ("out", "in"):
        sums[f"unique_{d}"] = F.sum(_dir(d).cast("double"))
        sums[f"_{d}"] = F.sum(F.when(_dir(d), F.col("n")).otherwise(0)).cast("double")
    found = pairs.groupBy("center").agg(*[c.alias(n) for n, c in sums.items()])
    return complete(g.nodes, found).select(
        "node_id",
        "unique_out",
        "unique_in",
        *[F.greatest(F.col(f"_{d}") - F.col(f"unique_{d}"), F.lit(0.0)).alias(f"multi_{d}") for d in ("out", "in")],
        *[safe_ratio(f"unique_{d}", f"_{d}").alias(f"unique_{d}_ratio_v2") for d in ("out", "in")],
    )


@scales.columns(log="days_since_{d}_mean days_since_{d}_last")
def edge_age(g: GraphFrame) -> DataFrame:
    """Days from the mean and the last edge to the last day of all; one more than that without edges."""
    end = g.max_day()
    day = lambda d: F.when(_dir(d), F.col("day"))
    found = incident(g).groupBy("center").agg(
        *[(F.lit(float(end)) - F.avg(day(d))).alias(f"days_since_{d}_mean") for d in ("out", "in")], *[(F.lit(float(end)) - F.max(day(d))).alias(f"days_since_{d}_last") for d in ("out", "in")]
    )
    return complete(g.nodes, found, float(end + 1))


@scales.columns(log="{d}_last{n}")
def recent_counts(g: GraphFrame, windows: tuple[int, ...] = RECENT_WINDOWS) -> DataFrame:
    """Edges of the last days, by direction, and their share in the degree."""
    late = lambda w: F.col("day") > g.max_day() - w
    wanted = {f"{d}_last{w}": _dir(d) & late(w) for w in windows for d in ("out", "in")} | {"_out": _dir("out"), "_in": _dir("in")}
    found = complete(g.nodes, counted(incident(g), wanted))
    columns = []
    for w in windows:
        columns += [F.col(f"{d}_last{w}") for d in ("out", "in")] + [safe_ratio(f"{d}_last{w}", f"_{d}").alias(f"{d}_last{w}_ratio_v2") for d in ("out", "in")]
    return found.select("node_id", *columns)


@scales.columns(log="aux_label_{n}_{e}_count aux_label_{n}_{d}_last14")
def aux_label_counts(g: GraphFrame) -> DataFrame:
    """For each background label: edges to neighbours that have it, in all and of the last 14 days."""
    late = F.col("day") > g.max_day() - 14
    wanted = {"_out": _dir("out"), "_in": _dir("in")}
    for y in g.schema.background:
        for d in ("out", "in"):
            wanted[f"aux_label_{y}_{d}_count"] = _dir(d) & (F.col("far_y") == y)
            wanted[f"aux_label_{y}_{d}_last14"] = _dir(d) & (F.col("far_y") == y) & late
    found = complete(g.nodes, counted(labelled(g), wanted))
    columns = []
    for y in g.schema.background:
        p = f"aux_label_{y}"
        columns += [F.col(f"{p}_out_count"), F.col(f"{p}_in_count"), (F.col(f"{p}_out_count") + F.col(f"{p}_in_count")).alias(f"{p}_total_count")]
        columns += [safe_ratio(f"{p}_{d}_count", f"_{d}").alias(f"{p}_{d}_ratio") for d in ("out", "in")] + [F.col(f"{p}_{d}_last14") for d in ("out", "in")]
    return found.select("node_id", *columns)
