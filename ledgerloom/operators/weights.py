"""Weights of relations, classes and edges, and aggregates over segments of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.contract import FRAUD, NORMAL, GraphFrame
from ledgerloom.functions.scalar import col, half_life_weight, total
from ledgerloom.operators.graph import incident


def relation_id(types: int) -> Column:
    """Directed relations from 0: those seen from the target first, then those seen from the source."""
    return F.when(F.col("dir") == "in", F.col("edge_type") - 1).otherwise(F.col("edge_type") - 1 + types)


def relation_risk_weight(g: GraphFrame, train: DataFrame) -> DataFrame:
    """(rel_id, positives, negatives, weight): how much more a relation is seen from fraud nodes than from normal ones.

    Counts begin at 1. The log-odds are clipped to 2, and weights scaled to mean 1 and clipped to 0.25 to 4.
    train: node_id of the nodes whose labels may be used.
    """
    known = g.nodes.select("node_id", "y").join(train, "node_id", "left_semi").select(F.col("node_id").alias("center"), "y")
    rel = relation_id(g.schema.types).cast("int").alias("rel_id")
    seen = incident(g).join(known, "center").groupBy(rel).agg(F.count_if(F.col("y") == FRAUD).alias("p"), F.count_if(F.col("y") == NORMAL).alias("n"))
    every = g.nodes.sparkSession.range(2 * g.schema.types).select(F.col("id").cast("int").alias("rel_id"))  # a row for each relation
    counts = every.join(seen, "rel_id", "left").select("rel_id", (F.coalesce("p", F.lit(0)) + 1.0).alias("positives"), (F.coalesce("n", F.lit(0)) + 1.0).alias("negatives"))
    odds = F.ln(F.col("positives") / F.sum("positives").over(_all())) - F.ln(F.col("negatives") / F.sum("negatives").over(_all()))
    raw = counts.withColumn("_w", F.exp(F.least(F.greatest(odds, F.lit(-2.0)), F.lit(2.0))))
    scaled = F.col("_w") / F.avg("_w").over(_all())
    return raw.select("rel_id", "positives", "negatives", F.least(F.greatest(scaled, F.lit(0.25)), F.lit(4.0)).alias("weight"))


def _all():
    from pyspark.sql import Window

    return Window.partitionBy()


def class_weight(labels: DataFrame, y: str = "y") -> DataFrame:
    """(y, n, weight): one over the root of a class's size, scaled to mean 1."""
    sizes = labels.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    w = F.lit(1.0) / F.sqrt(F.greatest(F.col("n").cast("double"), F.lit(1.0)))
    return sizes.withColumn("_w", w).select(y, "n", (F.col("_w") / F.avg("_w").over(_all())).alias("weight"))


def time_decay_weight(rows: DataFrame, key: str, day: str, end: int, half_life: float, floor: float) -> DataFrame:
    """(key, weight): halved each half_life days before `end`, at least floor, scaled to mean 1 by one aggregate."""
    w = rows.select(key, half_life_weight(F.lit(end) - F.col(day), half_life, floor).alias("_w"))
    mean = w.agg(F.avg("_w")).first()[0] or 1.0
    return w.select(key, (F.col("_w") / F.lit(mean)).alias("weight"))


def segment_weighted_mean(rows: DataFrame, segment: str, value: str, weight: str) -> DataFrame:
    return rows.groupBy(segment).agg((F.sum(F.col(value) * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1e-6))).alias("weighted_mean"))


def segment_softmax(rows: DataFrame, segment: str, score: str, keep: Sequence[str]) -> DataFrame:
    """Softmax of the scores inside each segment, shifted by the segment's maximum.

    Maxima and sums are combined before they are shuffled and joined back, so a hot segment is split.
    """
    top = rows.groupBy(segment).agg(F.max(score).alias("_top"))
    shifted = rows.join(top, segment).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    sums = shifted.groupBy(segment).agg(F.sum("_e").alias("_sum"))
    return shifted.join(sums, segment).select(segment, *keep, (F.col("_e") / F.greatest(F.col("_sum"), F.lit(1e-12))).alias("softmax"))


def segment_pool(segments: DataFrame, rows: DataFrame, segment: str, values: Sequence[str]) -> DataFrame:
    """Mean and maximum of each value for every segment of `segments`; 0 for empty ones."""
    found = rows.groupBy(segment).agg(*[f(v).alias(f"{v}_{k}") for v in values for k, f in (("mean", F.avg), ("max", F.max))])
    names = [c for c in found.columns if c != segment]
    return segments.select(segment).join(found, segment, "left").select(segment, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])


def message_mean(g: GraphFrame, values: DataFrame, column: str) -> DataFrame:
    """(node_id, message): the mean of the sources' values over a node's in-edges, 0 without any."""
    sent = g.edges.join(values.select(F.col("node_id").alias("src"), F.col(column).alias("_v")), "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum("_v").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return g.nodes.select("node_id").join(sent, "node_id", "left").select("node_id", (F.coalesce("_s", F.lit(0.0)) / F.greatest(F.coalesce("_n", F.lit(0)).cast("double"), F.lit(1.0))).alias("message"))


def dirichlet_energy(g: GraphFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the mean squared difference of the ends' columns over all edges."""
    side = lambda x: g.nodes.select(F.col("node_id").alias(x), *[F.col(c).alias(f"{x}_{c}") for c in columns])
    ends = g.edges.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst")
    gap = total([(col(f"src_{c}") - col(f"dst_{c}")) * (col(f"src_{c}") - col(f"dst_{c}")) for c in columns])
    return ends.agg(F.coalesce(F.avg(gap / float(len(columns))), F.lit(0.0)).alias("energy"), F.count(F.lit(1)).alias("edges"))


def subgraph_stats(edges: DataFrame, seed: str = "seed") -> DataFrame:
    """Sizes of sampled subgraphs (seed, src, dst, rel_id, day), as log1p, and the mean day."""
    nodes = edges.select(seed, F.explode(F.array("src", "dst")).alias("n")).distinct().groupBy(seed).agg(F.count(F.lit(1)).alias("_nodes"))
    kinds = edges.select(seed, "rel_id").distinct().groupBy(seed).agg(F.count(F.lit(1)).alias("_kinds"))
    sizes = edges.groupBy(seed).agg(F.count(F.lit(1)).alias("_edges"), F.count_if(F.col("dst") == F.col(seed)).alias("_in"), F.count_if(F.col("src") == F.col(seed)).alias("_out"), F.avg("day").alias("mean_day"))
    joined = sizes.join(nodes, seed).join(kinds, seed)
    return joined.select(seed, *[F.log1p(f"_{x}").alias(f"log_{x}") for x in ("nodes", "edges", "kinds", "in", "out")], "mean_day")
