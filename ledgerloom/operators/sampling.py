"""Neighbour, node and batch samples. All draws are hashes of ids and a seed, so reruns and lost executors change nothing.

Orders are total: ties in a score or a day go on to the neighbour's id and the remaining columns.
A window over a hub's edges is bounded by a cut before it: each task keeps a group's first k rows
(Spark's window group limit), so that only k rows of a task meet.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.contract import FRAUD, NORMAL, GraphFrame
from ledgerloom.operators.graph import incident
from ledgerloom.operators.ranks import ranges_for, running
from ledgerloom.operators.weights import relation_id
from ledgerloom.operators.windows import node_time_bucket


def draw(seed: int, *columns: str) -> Column:
    """A uniform number above 0 and up to 1 from the MD5 of a seed and columns, the same in any SQL engine."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 1.0) / float(1 << 48)


def first(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group, with their rank."""
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def edges_seen(g: GraphFrame, until: int | None = None) -> DataFrame:
    """(center, neighbor, dir, rel_id, day), up to a day."""
    adj = incident(g).withColumn("rel_id", relation_id(g.schema.types).cast("int"))
    rows = adj if until is None else adj.filter(F.col("day") <= until)
    return rows.select("center", "neighbor", "dir", "rel_id", "day")


def _latest() -> list[Column]:
    return [F.col("day").desc(), F.col("neighbor"), F.col("rel_id")]


def top_recent(g: GraphFrame, k: int, until: int | None = None) -> DataFrame:
    """The k most recent edges of each node and direction."""
    return first(edges_seen(g, until), ["center", "dir"], _latest(), k)


def numbered(rows: DataFrame) -> DataFrame:
    """Edges with `copy`, 1 for all but repeats, so that a hash of the columns tells repeated edges apart."""
    same = Window.partitionBy("center", "neighbor", "dir", "rel_id", "day").orderBy("center")
    return rows.withColumn("copy", F.row_number().over(same))


def uniform_fanout(g: GraphFrame, k: int, seed: int, until: int | None = None) -> DataFrame:
    """k edges of each node and direction, each as likely as the others."""
    rows = numbered(edges_seen(g, until)).withColumn("u", draw(seed, "center", "neighbor", "dir", "rel_id", "day", "copy"))
    return first(rows, ["center", "dir"], [F.col("u"), *_latest(), F.col("copy")], k)


def weighted_fanout(g: GraphFrame, weights: DataFrame, k: int, seed: int, *, pool: int, until: int | None = None) -> DataFrame:
    """k of the `pool` most recent edges of each node and direction, drawn without replacement by the relation's weight.

    weights: (rel_id, weight), a row for each relation. The keys -ln(u) / weight give such a sample.
    """
    recent = numbered(first(edges_seen(g, until), ["center", "dir"], _latest(), max(pool, k), "_recency"))
    rows = recent.join(F.broadcast(weights.select("rel_id", "weight")), "rel_id")
    key = -F.ln(draw(seed, "center", "neighbor", "dir", "rel_id", "day", "copy")) / F.greatest(F.col("weight"), F.lit(1e-6))
    return first(rows.withColumn("key", key), ["center", "dir"], [F.col("key"), *_latest(), F.col("copy")], k).drop("_recency")


def best_fanout(rows: DataFrame, k: int, score: str | None) -> DataFrame:
    """The k edges of each node and direction with the highest score, or the latest without one."""
    order = ([F.col(score).desc()] if score else []) + _latest()
    return first(rows, ["center", "dir"], order, k)


def hybrid_fanout(g: GraphFrame, k: int, seed: int, *, recent_share: float = 0.5, until: int | None = None) -> DataFrame:
    """A share of the fanout from the latest edges, the rest drawn from those before them."""
    n_recent = min(k, math.ceil(k * recent_share))
    rows = numbered(edges_seen(g, until)).withColumn("u", draw(seed, "center", "neighbor", "dir", "rel_id", "day", "copy"))
    edge = ["center", "neighbor", "dir", "rel_id", "day", "copy"]
    new = first(rows, ["center", "dir"], [*_latest(), F.col("copy")], n_recent).withColumn("part", F.lit("recent"))
    old = first(rows.join(new.select(*edge), edge, "left_anti"), ["center", "dir"], [F.col("u"), *_latest()], k).withColumn("part", F.lit("old"))
    is_old = (F.col("part") == "old").cast("int")  # of what is left, at most n_recent + k edges of a node and direction
    return first(new.drop("rank").unionByName(old.drop("rank")), ["center", "dir"], [is_old, F.col("u"), *_latest()], k).select(*rows.columns, "rank", "part")


def consistency(rows: DataFrame, similarity: str, temperature: float = 1.0) -> DataFrame:
    """rows with `score`: softmax of the similarities of a node's edges at a temperature."""
    from ledgerloom.operators.weights import segment_softmax

    scaled = rows.withColumn("_s", F.col(similarity) / F.lit(temperature))
    return segment_softmax(scaled, "center", "_s", [c for c in rows.columns if c != "center"]).withColumnRenamed("softmax", "score")


def khop(g: GraphFrame, seeds: DataFrame, fanouts: Sequence[int], until: int | None = None) -> DataFrame:
    """(seed, hop, src, dst, rel_id, day): for each seed the latest edges of each frontier, as deep as there are fanouts.

    A frontier holds nodes that the seed has not reached before. seeds: (seed).
    """
    adj = best_fanout(edges_seen(g, until), max(fanouts), None).select("center", "neighbor", "dir", "rel_id", "day", "rank")
    front = seeds.select("seed", F.col("seed").alias("center")).distinct()
    seen, out = front, None
    for hop, k in enumerate(fanouts, 1):
        step = front.join(adj.filter(F.col("rank") <= k), "center")
        is_in = F.col("dir") == "in"
        edges = step.select("seed", F.lit(hop).alias("hop"), F.when(is_in, F.col("neighbor")).otherwise(F.col("center")).alias("src"), F.when(is_in, F.col("center")).otherwise(F.col("neighbor")).alias("dst"), "rel_id", "day")
        out = edges if out is None else out.unionByName(edges)
        front = step.select("seed", F.col("neighbor").alias("center")).distinct().join(seen, ["seed", "center"], "left_anti")
        seen = seen.unionByName(front)
    return out


def local_ids(edges: DataFrame) -> DataFrame:
    """(seed, node_id, local_id, depth): a subgraph's nodes numbered from 0, the seed first, then by depth and id."""
    ends = edges.select("seed", F.explode(F.array("src", "dst")).alias("node_id"), "hop").withColumn("hop", F.when(F.col("node_id") == F.col("seed"), 0).otherwise(F.col("hop")))
    depth = ends.groupBy("seed", "node_id").agg(F.min("hop").alias("depth"))
    return depth.withColumn("local_id", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node_id")) - 1)


def uniform_sample(ids: DataFrame, n: int, seed: int, key: str = "node_id") -> DataFrame:
    """n ids, each as likely as the others."""
    return ids.select(key).orderBy(draw(seed, key), key).limit(n)


def stratified_sample(rows: DataFrame, bucket: str, n: int, seed: int, key: str = "node_id") -> DataFrame:
    """n rows, as even over the buckets as they allow: rank r of every bucket comes before rank r + 1 of any.

    Only the first n of each bucket are ranked, and only n rows are ordered at last.
    """
    ranked = first(rows.withColumn("_u", draw(seed, key)), [bucket], [F.col("_u"), F.col(key)], n, "_r")
    return ranked.orderBy("_r", "_u", key).limit(n).drop("_u", "_r")


def hardest(rows: DataFrame, bucket: str, score: str, n: int, key: str = "node_id") -> DataFrame:
    """The n rows of each bucket with the highest scores."""
    return first(rows, [bucket], [F.col(score).desc(), F.col(key)], n)


def negatives(pool: DataFrame, wanted: DataFrame, bucket: str, seed: int, *, hard_share: float = 0.5, key: str = "node_id") -> DataFrame:
    """For each bucket as many of pool (key, bucket, hard) as wanted (bucket, n) says.

    Hard ones come first up to their share of n, then others drawn at random, then whatever is left.
    """
    most = wanted.agg(F.max("n")).first()[0] or 0
    by = Window.partitionBy(bucket, "hard").orderBy("_u", key)
    drawn = pool.withColumn("_u", draw(seed, key)).withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= most)
    quota = F.round(F.col("n") * hard_share)
    joined = drawn.join(wanted.select(bucket, "n"), bucket)
    turn = F.when(F.col("hard") & (F.col("_r") <= quota), 0).when(~F.col("hard"), 1).otherwise(2)
    return first(joined.withColumn("_turn", turn), [bucket], [F.col("_turn"), F.col("_u"), F.col(key)], most, "_k").filter(F.col("_k") <= F.col("n")).select(key, bucket, "hard")


def background_negatives(g: GraphFrame, activity: DataFrame, positives: DataFrame, seed: int, *, ratio: float = 1.0) -> DataFrame:
    """For each bucket of positives (bucket, snapshot, n) background nodes that were active by its snapshot, ceil(n x ratio) of them."""
    known = activity.join(g.nodes.filter(F.col("y").isin(*g.schema.background)).select("node_id"), "node_id", "left_semi").select("node_id", "first_active")
    most = int(math.ceil((positives.agg(F.max("n")).first()[0] or 0) * ratio))
    days = [r["snapshot"] for r in positives.select("snapshot").distinct().collect()]  # a row for each time window
    parts = [first(known.filter(F.col("first_active") <= d).withColumn("snapshot", F.lit(d)).withColumn("_u", draw(seed, "node_id", "snapshot")), ["snapshot"], [F.col("_u"), F.col("node_id")], most) for d in days]
    if not parts:
        return known.select("node_id", F.lit(None).cast("int").alias("bucket")).limit(0)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.join(F.broadcast(positives), "snapshot").filter(F.col("rank") <= F.ceil(F.col("n") * ratio)).select("node_id", "bucket")


def balanced_batches(rows: DataFrame, per_class: Mapping[int, int], seed: int, y: str = "y", key: str = "node_id") -> DataFrame:
    """(key, y, batch): each batch has per_class[c] rows of class c, in seeded order; the scarcest class bounds the batches.

    Classes are cut into ranges of their draws before they are numbered, as many as there are rows for, so that no task orders a whole class.
    """
    kept = rows.filter(F.col(y).isin(*per_class)).select(key, y, draw(seed, key).alias("_u"))
    kept = kept.withColumn("_part", F.floor(F.col("_u") * ranges_for(kept.count())))
    sizes = kept.groupBy(y, "_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each class and range
    starts = sizes.select(y, "_part", F.coalesce(F.sum("_n").over(Window.partitionBy(y).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(y)).alias("_all"))
    own = F.row_number().over(Window.partitionBy(y, "_part").orderBy("_u", key)) - 1
    ranked = kept.withColumn("_own", own).join(F.broadcast(starts), [y, "_part"])
    per = F.lit(None).cast("int")
    for c, n in per_class.items():
        per = F.when(F.col(y) == c, F.lit(n)).otherwise(per)
    batches = starts.groupBy(y).agg(F.max("_all").alias("_all")).select(F.floor(F.col("_all") / per).alias("b")).agg(F.min("b").alias("_most"))
    numbered_rows = ranked.withColumn("batch", F.floor((F.col("_start") + F.col("_own")) / per))
    return numbered_rows.crossJoin(F.broadcast(batches)).filter(F.col("batch") < F.col("_most")).select(key, y, F.col("batch").cast("long").alias("batch"))


def time_partitions(g: GraphFrame, size: int = 64, seed: int = 13) -> DataFrame:
    """(node_id, time_bucket, batch): each bucket's nodes in seeded order, `size` to a batch; ordered in ranges of their draws."""
    nodes = node_time_bucket(g).select("node_id", "time_bucket").withColumn("_u", draw(seed, "node_id"))
    parts = nodes.withColumn("_part", F.floor(F.col("_u") * ranges_for(g.nodes.count())).cast("int"))
    sizes = parts.groupBy("time_bucket", "_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("time_bucket", "_part", F.coalesce(F.sum("_n").over(Window.partitionBy("time_bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy("time_bucket", "_part").orderBy("_u", "node_id")) - 1
    placed = parts.withColumn("_own", own).join(F.broadcast(starts), ["time_bucket", "_part"])  # a row for each bucket and range
    return placed.select("node_id", "time_bucket", F.floor((F.col("_start") + F.col("_own")) / size).cast("long").alias("batch"))


def visual_slice(g: GraphFrame, share: float) -> tuple[DataFrame, DataFrame]:
    """The first nodes by id, a share of all, and the edges between them; nodes are counted in ranges, not ordered by one task."""
    n = math.ceil(g.nodes.count() * share)
    kept = running(g.nodes.select("node_id", F.lit(1).alias("n")), "node_id", ["n"]).filter(F.col("upto_n") <= n).select("node_id")
    return kept, induced(g.edges, kept)


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of which both ends are among nodes (node_id)."""
    ends = lambda x: nodes.select(F.col("node_id").alias(x))
    return edges.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi").select(*edges.columns)


def labelled_nodes(g: GraphFrame) -> DataFrame:
    return g.nodes.filter(F.col("y").isin(NORMAL, FRAUD)).select("node_id", "y")
