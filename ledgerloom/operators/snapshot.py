"""Point-in-time views: what was known of a node at the end of its own time window, and in its first days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.contract import GraphFrame
from ledgerloom.functions.scalar import missing, safe_ratio
from ledgerloom.operators import scales
from ledgerloom.operators.graph import _background, _dir, activity, complete, counted, incident, labelled
from ledgerloom.operators.ranks import ranges_for
from ledgerloom.operators.windows import node_time_bucket
from ledgerloom.sources.shared import large

SNAPSHOT_RECENT = (14, 60)
SNAPSHOT_TYPES = 30
EARLY = (7, 30)
#: Edge ends that a task joins to their far ends for a profile.
PROFILE_ROWS = 1_000_000


def _at_snapshot(g: GraphFrame, adj: DataFrame) -> DataFrame:
    """The adjacency up to the end of the center's window, with that day."""
    ends = node_time_bucket(g).select(F.col("node_id").alias("center"), "window_end")
    return adj.join(ends, "center").filter(F.col("day") <= F.col("window_end"))


def _sums(p: str) -> list[Column]:
    return [F.col(f"{p}_in_count"), F.col(f"{p}_out_count"), (F.col(f"{p}_in_count") + F.col(f"{p}_out_count")).alias(f"{p}_total_count")]


def _both(p: str) -> Column:
    return F.col(f"{p}_in_count") + F.col(f"{p}_out_count")


@scales.columns(log="snap_{e}_count snap_bg_{e}_count snapshot_day snapshot_age")
def snapshot_block(g: GraphFrame) -> DataFrame:
    bg = _background(g)
    wanted = {f"snap_{d}_count": _dir(d) for d in ("in", "out")} | {f"snap_bg_{d}_count": _dir(d) & bg for d in ("in", "out")}
    found = complete(g.nodes, counted(_at_snapshot(g, labelled(g)), wanted))
    rows = found.join(node_time_bucket(g), "node_id")
    return rows.select(
        "node_id",
        *_sums("snap"),
        safe_ratio("snap_out_count", "snap_in_count").alias("snap_out_over_in_plus1"),
        safe_ratio("snap_in_count", "snap_out_count").alias("snap_in_over_out_plus1"),
        *_sums("snap_bg"),
        *[safe_ratio(f"snap_bg_{d}_count", f"snap_{d}_count").alias(f"snap_bg_{d}_ratio") for d in ("in", "out")],
        safe_ratio(_both("snap_bg"), _both("snap")).alias("snap_bg_total_ratio"),
        F.col("window_end").cast("double").alias("snapshot_day"),
        F.greatest(F.col("window_end") - F.col("first_active"), F.lit(0)).cast("double").alias("snapshot_age"),
    )


@scales.columns(log="recent_{n}_{e}_count recent_{n}_bg_{e}_count")
def snapshot_recent(g: GraphFrame, windows: tuple[int, ...] = SNAPSHOT_RECENT) -> DataFrame:
    """The last days before the snapshot, and their share in it."""
    bg, wanted = _background(g), {"snap_in_count": _dir("in"), "snap_out_count": _dir("out")}
    for w in windows:
        late = F.col("day") > F.col("window_end") - w
        wanted |= {f"recent_{w}_{d}_count": _dir(d) & late for d in ("in", "out")} | {f"recent_{w}_bg_{d}_count": _dir(d) & late & bg for d in ("in", "out")}
    found = complete(g.nodes, counted(_at_snapshot(g, labelled(g)), wanted))
    columns = []
    for w in windows:
        columns += [*_sums(f"recent_{w}"), *_sums(f"recent_{w}_bg")]
        columns += [safe_ratio(_both(f"recent_{w}"), _both("snap")).alias(f"recent_{w}_total_over_snapshot"), safe_ratio(_both(f"recent_{w}_bg"), _both("snap")).alias(f"recent_{w}_bg_total_over_snapshot")]
    return found.select("node_id", *columns)


@scales.columns(log="recent_{n}_{d}_type_{n}_count")
def snapshot_relation_recent(g: GraphFrame, window: int = SNAPSHOT_TYPES) -> DataFrame:
    late = F.col("day") > F.col("window_end") - window
    wanted = {f"recent_{window}_{d}_type_{t}_count": _dir(d) & late & (F.col("edge_type") == t) for t in range(1, g.schema.types + 1) for d in ("in", "out")}
    return complete(g.nodes, counted(_at_snapshot(g, incident(g)), wanted))


@scales.columns(log="start_{n}_{e}_count start_{n}_bg_{e}_count start_{n}_{d}_type_{n}_count")
def early_activity(g: GraphFrame, windows: tuple[int, ...] = EARLY, types_window: int = 30) -> DataFrame:
    """Edges of a node's first days, by direction, background label and type."""
    begins = activity(g).select(F.col("node_id").alias("center"), "first_active")
    adj = labelled(g).join(begins, "center").withColumn("_age", F.col("day") - F.col("first_active")).filter(F.col("_age") < max(*windows, types_window))
    bg, wanted = _background(g), {}
    for w in windows:
        young = F.col("_age") < w
        wanted |= {f"start_{w}_{d}_count": _dir(d) & young for d in ("in", "out")} | {f"start_{w}_bg_{d}_count": _dir(d) & young & bg for d in ("in", "out")}
    wanted |= {f"start_{types_window}_{d}_type_{t}_count": _dir(d) & (F.col("_age") < types_window) & (F.col("edge_type") == t) for t in range(1, g.schema.types + 1) for d in ("in", "out")}
    found = complete(g.nodes, counted(adj, wanted))
    by_type = [F.col(n) for n in wanted if "_type_" in n]
    return found.select("node_id", *[c for w in windows for p in (f"start_{w}", f"start_{w}_bg") for c in _sums(p)], *by_type)


def _profile(g: GraphFrame, adj: DataFrame, prefix: str) -> DataFrame:
    raw = g.schema.raw_columns
    far = large(g.nodes.select(F.col("node_id").alias("neighbor"), *raw))
    # Parts of so many rows each, not of so many bytes: a few bytes of a shuffle become a wide row of each center in a task's memory.
    parts = max(ranges_for(2 * g.edges.count(), PROFILE_ROWS), g.nodes.sparkSession.sparkContext.defaultParallelism)
    seen = adj.repartition(parts, "neighbor").join(far, "neighbor")
    kinds = (("mean", lambda c, d: F.avg(F.when(_dir(d), F.col(c)))), ("max", lambda c, d: F.max(F.when(_dir(d), F.col(c)))), ("missing_ratio", lambda c, d: F.avg(F.when(_dir(d), missing(c)))))
    wanted = [f(c, d).alias(f"{prefix}{d}_neighbor_{k}_{c}") for k, f in kinds for d in ("in", "out") for c in raw]
    return complete(g.nodes, seen.groupBy("center").agg(*wanted))


def neighbor_profile(g: GraphFrame) -> DataFrame:
    """Mean, maximum and missing share of each raw column over the neighbours, sentinels included; 0 without neighbours."""
    return _profile(g, incident(g), "")


def snapshot_neighbor_profile(g: GraphFrame) -> DataFrame:
    return _profile(g, _at_snapshot(g, incident(g)), "snap_")
