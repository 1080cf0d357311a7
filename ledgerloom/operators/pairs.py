"""Operators on pairs of nodes: concentration on partners, bursts, reciprocity, similarity.

Edges are first counted by pair, so that a hub's edges are combined before its row is made.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.contract import GraphFrame
from ledgerloom.functions.scalar import dot, norm
from ledgerloom.operators.graph import _dir, adjacency, complete, counted, incident
from ledgerloom.operators.windows import DIRECTIONS, bursts

CONCENTRATION_WINDOWS = (7, 30, 90)
MOTIF_DAYS, BURST_DAYS = 14, 7


def partner_concentration(g: GraphFrame, windows: tuple[int, ...] = CONCENTRATION_WINDOWS) -> DataFrame:
    """The top partner's share in a node's edges of the last days, and the normalised entropy over partners.

    One pass counts each pair for all windows and directions; the columns of shorter window lists
    are among these.
    """
    end = g.max_day()
    adj = incident(g).filter(F.col("day") > end - max(windows))
    n = {(d, w): F.count_if((_dir(d) if d != "total" else F.lit(True)) & (F.col("day") > end - w)).cast("double").alias(f"{d}_{w}") for w in windows for d in DIRECTIONS}
    pairs = adj.groupBy("center", "neighbor").agg(*n.values())
    sums = []
    for d, w in n:
        c = F.col(f"{d}_{w}")
        sums += [F.sum(c).alias(f"_n_{d}_{w}"), F.max(c).alias(f"_m_{d}_{w}"), F.count_if(c > 0).alias(f"_u_{d}_{w}"), F.sum(F.when(c > 0, c * F.ln(c)).otherwise(0.0)).alias(f"_l_{d}_{w}")]
    found = pairs.groupBy("center").agg(*sums)
    columns = []
    for w in windows:
        for d in DIRECTIONS:
            columns.append((F.col(f"_m_{d}_{w}") / (F.col(f"_n_{d}_{w}") + 1.0)).alias(f"tcc_{d}_top_share_{w}"))
        for d in DIRECTIONS:
            # sum of -p ln p with p = c / n is ln n - sum(c ln c) / n.
            k, u = F.col(f"_n_{d}_{w}"), F.col(f"_u_{d}_{w}")
            h = (F.ln(k) - F.col(f"_l_{d}_{w}") / k) / F.ln(u.cast("double"))
            columns.append(F.when(u > 1, h).otherwise(0.0).alias(f"tcc_{d}_entropy_{w}"))
    return complete(g.nodes, found.select("center", *columns))


def daily_burst(g: GraphFrame, window: int = BURST_DAYS) -> DataFrame:
    return bursts(g, (window,)).select("node_id", *[F.col(f"{d}_b{window}").alias(f"burst_{d}_{window}") for d in DIRECTIONS])


def reciprocal(edges: DataFrame) -> DataFrame:
    """The distinct pairs (src, dst) whose reverse is an edge too; a self-loop is its own reverse."""
    pairs = edges.select("src", "dst").distinct()
    back = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pairs.join(back, ["src", "dst"], "left_semi")


def motif_lite(g: GraphFrame, days: int = MOTIF_DAYS, burst_days: int = BURST_DAYS) -> DataFrame:
    """Reciprocity, repetition, the partners' degrees and bursts among the edges of the last days."""
    recent = g.edges.filter(F.col("day") > g.max_day() - days)
    p = f"tm{days}"
    both = reciprocal(recent)
    mutual = both.groupBy(F.col("src").alias("center")).agg(F.count(F.lit(1)).cast("double").alias(f"{p}_recip_out_unique"))
    # The reverse of a reciprocal pair is one as well, so a node's two counts are the same.
    pairs = adjacency(recent).groupBy("center", "neighbor", "dir").agg(F.count(F.lit(1)).alias("n"))
    degree = counted(incident(g), {"_degree": F.lit(True)}).withColumnRenamed("center", "neighbor")
    seen = pairs.join(degree, "neighbor")
    sums = []
    for d in ("out", "in"):
        n, deg = F.when(_dir(d), F.col("n")).otherwise(0), F.col("_degree")
        sums += [F.sum(_dir(d).cast("double")).alias(f"_unique_{d}"), F.sum(n).cast("double").alias(f"_recent_{d}"), F.sum(n * deg).alias(f"_deg_{d}"), F.sum(n * F.log1p(deg)).alias(f"_log_{d}")]
    found = seen.groupBy("center").agg(*sums)
    rows = complete(g.nodes, found).join(complete(g.nodes, mutual), "node_id").join(bursts(g, (burst_days,)), "node_id")
    recip = F.col(f"{p}_recip_out_unique")
    return rows.select(
        "node_id",
        recip,
        recip.alias(f"{p}_recip_in_unique"),
        *[(recip / (F.col(f"_unique_{d}") + 1.0)).alias(f"{p}_recip_{d}_ratio") for d in ("out", "in")],
        *[(F.lit(1.0) - F.col(f"_unique_{d}") / (F.col(f"_recent_{d}") + 1.0)).alias(f"{p}_repeat_{d}_ratio") for d in ("out", "in")],
        *[(F.col(f"_deg_{d}") / F.greatest(F.col(f"_recent_{d}"), F.lit(1.0))).alias(f"{p}_neighbor_totaldeg_{d}_mean") for d in ("out", "in")],
        *[F.col(f"_log_{d}").alias(f"{p}_neighbor_totaldeg_{d}_logsum") for d in ("out", "in")],
        *[F.col(f"{d}_b{burst_days}").alias(f"tm{burst_days}_{d}_burst_maxday") for d in ("out", "in")],
    )


def edge_cosine(vectors: DataFrame, edges: DataFrame) -> DataFrame:
    """Cosine similarity of the ends of each edge, summed, averaged and maximised by node; vectors is (node_id, v)."""
    length = vectors.select("node_id", "v", norm("v").alias("n"))
    ends = edges.join(length.select(F.col("node_id").alias("src"), F.col("v").alias("a"), F.col("n").alias("na")), "src").join(length.select(F.col("node_id").alias("dst"), F.col("v").alias("b"), F.col("n").alias("nb")), "dst")
    sims = ends.select("src", "dst", (dot("a", "b") / F.greatest(F.col("na") * F.col("nb"), F.lit(1e-6))).alias("s"))
    both = sims.select(F.col("src").alias("center"), F.lit("out").alias("dir"), "s").unionByName(sims.select(F.col("dst").alias("center"), F.lit("in").alias("dir"), "s"))
    mine = lambda d: F.when(_dir(d), F.col("s"))
    kinds = (("sum", F.sum), ("mean", F.avg), ("max", F.max))
    found = both.groupBy("center").agg(*[f(mine(d)).alias(f"{d}_cosine_{k}") for k, f in kinds for d in ("out", "in")])
    return complete(vectors, found)
