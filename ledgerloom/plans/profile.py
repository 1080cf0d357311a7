"""Profiles of a graph: labels, columns, degrees, label mixing, activity over time, and drift between two samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.contract import FRAUD, NORMAL, UNKNOWN, GraphFrame
from ledgerloom.operators import gram
from ledgerloom.operators.graph import activity, degrees, incident
from ledgerloom.operators.ranks import quantiles, running
from ledgerloom.operators.windows import edge_time_windows

QUANTILES = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


def groups(g: GraphFrame) -> DataFrame:
    """(node_id, group_name): the groups a node is counted in; it may be in several."""
    y = F.col("y")
    member = [(y == NORMAL, "train_normal"), (y == FRAUD, "train_fraud"), (y == UNKNOWN, "test_holdout"), *[(y == b, f"background_{b}") for b in g.schema.background]]
    names = F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in member]), lambda x: x.isNotNull())
    return g.nodes.select("node_id", F.explode(names).alias("group_name"))


def unpivoted(df: DataFrame, columns: Sequence[str], *keys: str) -> DataFrame:
    """(keys, feature, value): a row for each column."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("p")).select(*keys, "p.feature", "p.value")


def overview(g: GraphFrame) -> DataFrame:
    """(metric, name, value): label and edge type counts, sizes, the class balance and the range of days."""
    row = lambda df, metric, name, value: df.select(F.lit(metric).alias("metric"), name.alias("name"), value.cast("double").alias("value"))
    labels = row(g.nodes.groupBy("y").count(), "label", F.col("y").cast("string"), F.col("count"))
    types = row(g.edges.groupBy("edge_type").count(), "edge_type", F.col("edge_type").cast("string"), F.col("count"))
    fraud = g.nodes.agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("y") == FRAUD) / F.greatest(F.count_if(F.col("y").isin(NORMAL, FRAUD)), F.lit(1))).alias("r"))
    days = g.edges.agg(F.count(F.lit(1)).alias("n"), F.min("day").alias("a"), F.max("day").alias("b"))
    parts = [labels, types, row(fraud, "nodes", F.lit("all"), F.col("n")), row(fraud, "fraud_rate", F.lit("all"), F.col("r")), row(days, "edges", F.lit("all"), F.col("n")), row(days, "day", F.lit("min"), F.col("a")), row(days, "day", F.lit("max"), F.col("b"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feature_profile(g: GraphFrame, train: DataFrame | None = None) -> DataFrame:
    """For each raw column: mean, deviation, class means and their gap, missing share, and quantiles; with train (node_id), those of its rows too, as train_q.."""
    rows = unpivoted(g.nodes, g.schema.raw_columns, "y")
    of = lambda y: F.avg(F.when(F.col("y") == y, F.col("value")))
    found = rows.groupBy("feature").agg(
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        of(NORMAL).alias("normal_mean"),
        of(FRAUD).alias("fraud_mean"),
        F.avg((F.col("value") == -1.0).cast("double")).alias("missing_ratio"),
    )
    names = [f"q{round(100 * q):02d}" for q in QUANTILES]
    cuts = quantiles(rows, "value", QUANTILES, ["feature"])
    table = _small(g, [(c, *v) for (c,), v in cuts.items()], "feature string, " + ", ".join(f"{n} double" for n in names))
    gap = F.abs(F.col("fraud_mean") - F.col("normal_mean")).alias("mean_gap")
    out = found.join(table, "feature", "left").select("feature", "mean", "std", "normal_mean", "fraud_mean", gap, "missing_ratio", *names)
    if train is None:
        return out
    own = quantiles(unpivoted(g.nodes.join(train.select("node_id"), "node_id", "left_semi"), g.schema.raw_columns), "value", QUANTILES, ["feature"])
    return out.join(_small(g, [(c, *v) for (c,), v in own.items()], "feature string, " + ", ".join(f"train_{n} double" for n in names)), "feature", "left")


def largest_gaps(g: GraphFrame, k: int = 4) -> DataFrame:
    """The k raw columns with the largest gap between the classes' means."""
    return feature_profile(g).select("feature", "mean_gap").orderBy(F.col("mean_gap").desc_nulls_last(), "feature").limit(k)


def _small(g: GraphFrame, rows: list[tuple], kinds: str) -> DataFrame:
    """A table of a few rows, at most one for each column and group."""
    return F.broadcast(g.nodes.sparkSession.createDataFrame(rows, kinds))


def missing_by_group(g: GraphFrame) -> DataFrame:
    rows = unpivoted(g.nodes.join(groups(g), "node_id"), g.schema.raw_columns, "group_name")
    found = rows.groupBy("group_name", "feature").agg(F.avg((F.col("value") == -1.0).cast("double")).alias("missing_ratio"), F.avg("value").alias("mean"))
    medians = quantiles(rows, "value", [0.5], ["group_name", "feature"])
    return found.join(_small(g, [(*k, v[0]) for k, v in medians.items()], "group_name string, feature string, median double"), ["group_name", "feature"], "left")


def feature_corr(g: GraphFrame) -> DataFrame:
    """(feature_a, feature_b, corr) of all pairs of raw columns, in one pass."""
    return gram.pairs(g.nodes, g.schema.raw_columns)


def feature_square(g: GraphFrame) -> DataFrame:
    """The same as a square table: a row and a column for each raw column."""
    return gram.square(g.nodes, g.schema.raw_columns)


def basic_stats(value: Column) -> list[Column]:
    q = F.percentile(value, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.95)))
    return [F.count(value).alias("n"), F.avg(value).alias("mean"), q[0].alias("median"), q[1].alias("p90"), q[2].alias("p95"), F.max(value).cast("double").alias("max")]


def degree_stats(g: GraphFrame) -> DataFrame:
    rows = unpivoted(degrees(g).join(groups(g), "node_id"), ["indegree", "outdegree", "total_degree"], "group_name")
    return rows.groupBy("group_name", "feature").agg(*basic_stats(F.col("value")))


def node_activity_stats(g: GraphFrame) -> DataFrame:
    rows = unpivoted(activity(g).join(groups(g), "node_id"), ["first_active", "last_active", "active_span"], "group_name")
    return rows.groupBy("group_name", "feature").agg(*basic_stats(F.col("value")))


def label_pair_matrix(g: GraphFrame) -> DataFrame:
    """(src_label, dst_label, edges, ratio), zeros included: how labels are joined by edges."""
    y = lambda side: g.nodes.select(F.col("node_id").alias(side), F.col("y").alias(f"{side}_label"))
    counted = g.edges.select("src", "dst").join(y("src"), "src").join(y("dst"), "dst").groupBy("src_label", "dst_label").agg(F.count(F.lit(1)).alias("edges"))
    labels = [UNKNOWN, NORMAL, FRAUD, *g.schema.background]  # the label domain, a handful of values
    spark = g.nodes.sparkSession
    dense = spark.createDataFrame([(a, b) for a in labels for b in labels], "src_label int, dst_label int")
    all_edges = F.sum("edges").over(_everything())
    filled = F.broadcast(dense).join(counted, ["src_label", "dst_label"], "left").select("src_label", "dst_label", F.coalesce("edges", F.lit(0)).alias("edges"))
    return filled.select("src_label", "dst_label", "edges", (F.col("edges") / F.greatest(all_edges, F.lit(1))).alias("ratio"))


def _everything():
    from pyspark.sql import Window

    return Window.partitionBy()


def background_bridge(g: GraphFrame) -> DataFrame:
    """How much the labelled nodes touch the background: edges and distinct nodes, by class."""
    far = g.nodes.select(F.col("node_id").alias("neighbor"), F.col("y").alias("far_y"))
    own = g.nodes.filter(F.col("y").isin(NORMAL, FRAUD)).select(F.col("node_id").alias("center"), "y")
    rows = incident(g).join(far.filter(F.col("far_y").isin(*g.schema.background)), "neighbor").join(own, "center")
    touched = rows.groupBy("y", "center").agg(F.count(F.lit(1)).alias("n")).groupBy("y").agg(F.sum("n").alias("edges"), F.count(F.lit(1)).alias("nodes"))
    sizes = own.groupBy("y").agg(F.count(F.lit(1)).alias("class_nodes"))
    return sizes.join(touched, "y", "left").select("y", "class_nodes", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("nodes", F.lit(0)).alias("nodes"), (F.coalesce("nodes", F.lit(0)) / F.col("class_nodes")).alias("touch_ratio"))


def edge_day_series(g: GraphFrame) -> DataFrame:
    """(day, edges, type_1, ...): every day from 1 to the last, with and without edges."""
    spark = g.edges.sparkSession
    days = spark.range(1, g.max_day() + 1).select(F.col("id").cast("int").alias("day"))
    kinds = range(1, g.schema.types + 1)
    found = g.edges.groupBy("day").agg(F.count(F.lit(1)).alias("edges"), *[F.count_if(F.col("edge_type") == t).alias(f"type_{t}") for t in kinds])
    return days.join(found, "day", "left").select("day", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("edges", *(f"type_{t}" for t in kinds))])


def time_window_profile(g: GraphFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean of each column by class and by the window of the node's first active day."""
    windows = edge_time_windows(g.edges)
    at = F.lit(None).cast("int")
    for w in reversed(windows):
        at = F.when(F.col("first_active").between(w.start, w.end), F.lit(w.index)).otherwise(at)
    rows = g.nodes.filter(F.col("y").isin(NORMAL, FRAUD)).join(activity(g), "node_id").withColumn("window_idx", at).filter(F.col("window_idx").isNotNull())
    long = unpivoted(rows, columns or g.schema.raw_columns, "window_idx", "y")
    return long.groupBy("window_idx", "y", "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def value_windows(df: DataFrame, value: str, n: int) -> DataFrame:
    """(window_idx, start, end, rows) of equal depth: bounds are quantiles, so ties stay together; the last window is closed."""
    cuts = quantiles(df, value, [i / n for i in range(n + 1)]).get(())
    if cuts is None:
        return df.sparkSession.createDataFrame([], "window_idx int, start double, end double, rows long")
    edges = sorted(set(cuts))
    at = F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True), 1):
        last = i == len(edges) - 1
        at = F.when((F.col(value) >= a) & ((F.col(value) <= b) if last else (F.col(value) < b)), F.lit(i)).otherwise(at)
    if len(edges) == 1:
        at = F.lit(1)
    found = df.filter(F.col(value).isNotNull()).groupBy(at.alias("window_idx")).agg(F.min(value).alias("start"), F.max(value).alias("end"), F.count(F.lit(1)).alias("rows"))
    return found


def cumulative_distribution(df: DataFrame, value: str) -> DataFrame:
    """(value, cdf): distinct values and the share of rows up to each. Rows are counted by value before they are ordered, in ranges."""
    counts = df.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return running(counts, "value", ["n"]).select("value", (F.col("upto_n") / F.greatest(F.lit(counts.agg(F.sum("n")).first()[0] or 0), F.lit(1))).alias("cdf"))


def psi(reference: DataFrame, current: DataFrame, columns: Sequence[str], bins: int = 10, top: int | None = None) -> DataFrame:
    """(feature, psi), largest first: the population stability index over the reference's decile bins; the first `top`, or all.

    Values of `current` outside the reference's range aren't counted.
    """
    cuts = {c: v for (c,), v in quantiles(unpivoted(reference, columns), "value", [i / bins for i in range(bins + 1)], ["feature"]).items()}
    tagged = unpivoted(reference, columns).withColumn("side", F.lit("p")).unionByName(unpivoted(current, columns).withColumn("side", F.lit("q")))
    at, last = F.lit(None).cast("int"), {}
    for c in columns:
        inner = sorted(set(cuts.get(c, [])))  # none for a column without a value: it has no index
        edges = [inner[0] - 1e-6, *inner[1:-1], inner[-1] + 1e-6] if inner else []
        last[c] = max(len(edges) - 1, 0)
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            inside = (F.col("value") >= a) & ((F.col("value") <= b) if i == last[c] - 1 else (F.col("value") < b))
            at = F.when((F.col("feature") == c) & inside, F.lit(i)).otherwise(at)
    counts = tagged.withColumn("bin", at).filter(F.col("bin").isNotNull()).groupBy("feature", "bin").agg(F.count_if(F.col("side") == "p").alias("p"), F.count_if(F.col("side") == "q").alias("q"))
    spark = reference.sparkSession
    every = spark.createDataFrame([(c, i) for c in columns for i in range(last[c])], "feature string, bin int")
    filled = every.join(counts, ["feature", "bin"], "left").fillna(0, ["p", "q"])
    totals = filled.groupBy("feature").agg(F.greatest(F.sum("p"), F.lit(1)).alias("tp"), F.greatest(F.sum("q"), F.lit(1)).alias("tq"))
    share = lambda n, t: F.greatest(F.col(n) / F.col(t), F.lit(1e-6))
    terms = filled.join(totals, "feature").select("feature", ((share("p", "tp") - share("q", "tq")) * F.ln(share("p", "tp") / share("q", "tq"))).alias("t"))
    ranked = terms.groupBy("feature").agg(F.sum("t").alias("psi")).orderBy(F.col("psi").desc(), "feature")
    return ranked if top is None else ranked.limit(top)


def observed_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, n, mean, std) of the values that aren't missing; the deviation is 1 where it is all but 0."""
    value = F.when(F.col("value") != -1.0, F.col("value"))
    found = unpivoted(df, columns).groupBy("feature").agg(F.count(value).alias("n"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), F.stddev_pop(value).alias("s"))
    return found.select("feature", "n", "mean", F.when(F.coalesce("s", F.lit(0.0)) > 1e-6, F.col("s")).otherwise(1.0).alias("std"))


def consistency_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(node_id, c0, c1, ...): standardised values, 0 for missing ones, then their missing marks, as a vector of length 1."""
    stats = {r["feature"]: r for r in observed_stats(df, columns).collect()}  # a row for each column
    gone = [(F.col(c) == -1.0).cast("double") for c in columns]
    z = [F.when(F.col(c) == -1.0, 0.0).otherwise((F.col(c) - F.lit(stats[c]["mean"] if c in stats else 0.0)) / F.lit(stats[c]["std"] if c in stats else 1.0)) for c in columns]
    rows = df.select("node_id", F.array(*z, *gone).alias("_v"))
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))
    scaled = rows.select("node_id", "_v", F.greatest(length, F.lit(1e-6)).alias("_l"))
    return scaled.select("node_id", *[(F.col("_v")[i] / F.col("_l")).alias(f"c{i}") for i in range(2 * len(columns))])


def phase_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, labelled and unknown nodes, frauds among the labelled."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("y").isin(NORMAL, FRAUD)).alias("labelled"), F.count_if(F.col("y") == UNKNOWN).alias("unknown"), F.count_if(F.col("y") == FRAUD).alias("frauds"))
    return n.crossJoin(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edges"), F.max("day").alias("last_day"))))  # two single rows


def degree_shift(g: GraphFrame, day: int) -> DataFrame:
    """(side, nodes, mean_degree, mean_first_active): nodes that became active before a day and from it on."""
    rows = degrees(g).join(activity(g), "node_id").withColumn("side", F.when(F.col("first_active") < day, "reference").otherwise("current"))
    return rows.groupBy("side").agg(F.count(F.lit(1)).alias("nodes"), F.avg("total_degree").alias("mean_degree"), F.avg("first_active").alias("mean_first_active"))


def type_shift(g: GraphFrame, day: int) -> DataFrame:
    """(edge_type, reference, current, shift): the share of each edge type before a day and from it on, and the difference."""
    late = F.col("day") >= day
    counts = g.edges.groupBy("edge_type").agg(F.count_if(~late).alias("p"), F.count_if(late).alias("q"))
    share = lambda c: F.col(c) / F.greatest(F.sum(c).over(_everything()), F.lit(1))  # noqa: E731  a row for each type
    return counts.select("edge_type", share("p").alias("reference"), share("q").alias("current"), (share("q") - share("p")).alias("shift"))
