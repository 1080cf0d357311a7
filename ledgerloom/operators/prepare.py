"""From raw tables to a graph: labels, endpoint ids, days, phases, and optional columns laid over the nodes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.contract import FRAUD, NORMAL, UNKNOWN
from ledgerloom.functions.scalar import binary_label, finite_or


def edges_by_id(edges: DataFrame, nodes: DataFrame, source: str, target: str) -> DataFrame:
    """(src, dst, edge_type, day): edges whose ends are both among nodes (key, node_id, step); a day is the later step of the two."""
    side = lambda x: nodes.select(F.col("key").alias(f"_{x}"), F.col("node_id").alias(x), F.col("step").alias(f"_{x}_step"))
    found = edges.join(side("src"), F.col(source) == F.col("_src")).join(side("dst"), F.col(target) == F.col("_dst"))
    kind = F.col("edge_type") if "edge_type" in edges.columns else F.lit(1)
    return found.select("src", "dst", kind.cast("int").alias("edge_type"), F.greatest("_src_step", "_dst_step").cast("int").alias("day"))


def with_labels(nodes: DataFrame, classes: DataFrame, key: str, raw: str) -> DataFrame:
    """nodes with y from classes (key, raw); the first node without a class fails the job."""
    named = classes.select(F.col(key).alias("_key"), F.col(raw).alias("_raw"))
    joined = nodes.join(named, F.col(key) == F.col("_key"), "left")
    known = F.when(F.col("_key").isNull(), F.raise_error(F.concat(F.lit("no class for "), F.col(key).cast("string")))).otherwise(binary_label("_raw"))
    return joined.withColumn("y", known.cast("int")).drop("_key", "_raw")


def overlay(nodes: DataFrame, extra: DataFrame, key: str, columns: Sequence[str], fill: float = -1.0) -> DataFrame:
    """nodes with optional columns of extra, `fill` where they are absent or not finite, and whether the row was there."""
    side = extra.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(f"_{c}") for c in columns])
    joined = nodes.join(side, F.col(key) == F.col("_key"), "left")
    return joined.select(*nodes.columns, *[finite_or(f"_{c}", fill).alias(c) for c in columns], F.col("_key").isNotNull().alias("observed"))


def dense_ids(nodes: DataFrame, key: str) -> DataFrame:
    """nodes with node_id, 0, 1, ... in order of key: ranges of keys are counted, so that no task numbers all rows."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = nodes.select(F.percentile_approx(key, [i / parts for i in range(1, parts)], 1000).alias("c")).first()["c"] or []
    part = F.lit(0)
    for c in sorted(set(cuts)):
        part = part + (F.col(key) > F.lit(c)).cast("int")
    dealt = nodes.withColumn("_part", part)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each range
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn("node_id", (F.col("_start") + F.col("_own")).cast("long")).drop("_part", "_own", "_start")


def phase_one(nodes: DataFrame, edges: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """Nodes up to a step under dense new ids, and the edges up to it between them."""
    kept = dense_ids(nodes.filter(F.col("step") <= step).withColumnRenamed("node_id", "key"), "key")
    ids = kept.select("key", "node_id")
    side = lambda x: ids.select(F.col("key").alias(f"_{x}"), F.col("node_id").alias(f"_{x}_id"))
    inside = edges.filter(F.col("day") <= step).join(side("s"), F.col("src") == F.col("_s")).join(side("d"), F.col("dst") == F.col("_d"))
    return kept, inside.select(F.col("_s_id").alias("src"), F.col("_d_id").alias("dst"), "edge_type", "day")


def phase_two_labels(nodes: DataFrame, step: int) -> DataFrame:
    """The whole graph's nodes, with labels only behind the step."""
    return nodes.withColumn("y", F.when((F.col("step") > step) & F.col("y").isin(NORMAL, FRAUD), F.col("y")).otherwise(F.lit(UNKNOWN)))


def id_lists(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(train ids, test ids): the labelled nodes and the unknown ones."""
    return nodes.filter(F.col("y").isin(NORMAL, FRAUD)).select("node_id"), nodes.filter(F.col("y") == UNKNOWN).select("node_id")


def take_rows(features: DataFrame, ids: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(pos, node_id, columns) for ids (pos, node_id), repeats included; order by pos where order matters."""
    return ids.join(features.select("node_id", *columns), "node_id").select("pos", "node_id", *columns)


def aligned(reference: DataFrame, predictions: DataFrame) -> DataFrame:
    """Predictions (node_id, probability) in the reference's rows (pos, node_id); a missing one fails the job."""
    joined = reference.join(predictions.select("node_id", "probability"), "node_id", "left")
    value = F.when(F.col("probability").isNull(), F.raise_error(F.concat(F.lit("no prediction for node "), F.col("node_id").cast("string")))).otherwise(F.col("probability"))
    return joined.select("pos", "node_id", value.cast("double").alias("probability"))


def label_codes(nodes: DataFrame, train: DataFrame, background: Sequence[int], unknown: int = 4) -> DataFrame:
    """(node_id, code): a training node's label, a background node's label, and `unknown` for all others."""
    known = nodes.join(train.select(F.col("node_id").alias("_id")).distinct(), F.col("node_id") == F.col("_id"), "left")
    code = F.when(F.col("_id").isNotNull() | F.col("y").isin(*background), F.col("y")).otherwise(F.lit(unknown))
    return known.select("node_id", code.cast("int").alias("code"))


def historical_background(nodes: DataFrame, activity: DataFrame, background: Sequence[int], until: int) -> DataFrame:
    """(node_id): background nodes that were active by a day."""
    early = activity.filter(F.col("first_active") <= until).select("node_id")
    return nodes.filter(F.col("y").isin(*background)).select("node_id").join(early, "node_id", "left_semi")
