"""Ranking metrics and time-aware splits.

Scores are counted by distinct value first; running sums go over that smaller table, in ranges of
the score: a range's totals are summed on their own, so that no task orders all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.contract import FRAUD, NORMAL, GraphFrame
from ledgerloom.functions.scalar import log_loss
from ledgerloom.operators.graph import activity
from ledgerloom.operators.ranks import running
from ledgerloom.sources.shared import large, stored

CUTS = (0.80, 0.75, 0.70, 0.65, 0.60, 0.55)


def thresholds(scored: DataFrame) -> DataFrame:
    """(score, p, n, tp, fp): positives and negatives at each distinct score, and at it or above.

    scored is (y, score); rows whose y isn't 0 or 1, or without a score, don't count.
    """
    counts = scored.filter(F.col("y").isin(0, 1) & F.col("score").isNotNull()).groupBy("score").agg(F.count_if(F.col("y") == 1).alias("p"), F.count_if(F.col("y") == 0).alias("n"))
    run = running(counts, "score", ["p", "n"], descending=True)
    return run.select("score", "p", "n", F.col("upto_p").alias("tp"), F.col("upto_n").alias("fp"))


def metrics(scored: DataFrame) -> DataFrame:
    """One row: roc_auc, average_precision, pr_auc, log_loss and the counts; null metrics unless both classes are there."""
    t = thresholds(scored)
    sums = t.agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0)).alias("pairs"))
    # Terms of the precision-recall curve need the threshold before: its counts are tp - p and fp - n.
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    earlier = F.when(F.col("tp") + F.col("fp") > F.col("p") + F.col("n"), (F.col("tp") - F.col("p")) / (F.col("tp") + F.col("fp") - F.col("p") - F.col("n"))).otherwise(F.lit(1.0))
    curve = t.agg(F.sum(F.col("p") * here).alias("ap"), F.sum(F.col("p") * (here + earlier) / 2.0).alias("area"))
    loss = scored.filter(F.col("y").isin(0, 1) & F.col("score").isNotNull()).agg(F.avg(log_loss("y", "score")).alias("log_loss"))
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return sums.join(curve).join(loss).select(
        "positives",
        "negatives",
        F.when(both, F.col("pairs") / (F.col("positives") * F.col("negatives").cast("double"))).alias("roc_auc"),
        F.when(both, F.col("ap") / F.col("positives")).alias("average_precision"),
        F.when(both, F.col("area") / F.col("positives")).alias("pr_auc"),
        "log_loss",
    )


def regression(rows: DataFrame, actual: Column, predicted: Column) -> DataFrame:
    """r2 and mean absolute error; r2 is 0 for fewer than two rows or a constant."""
    a = rows.select(actual.cast("double").alias("a"), predicted.cast("double").alias("b"))
    s = a.agg(F.count("a").alias("n"), F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("e"), F.var_pop("a").alias("v"), F.avg(F.abs(F.col("a") - F.col("b"))).alias("mae"))
    return s.select(F.when((F.col("n") < 2) | (F.col("v") <= 1e-12), 0.0).otherwise(1.0 - F.col("e") / (F.col("v") * F.col("n"))).alias("r2"), "mae")


def time_split(g: GraphFrame) -> DataFrame:
    """(node_id, part): training nodes before a threshold day, validation nodes from it on, held-out nodes as test_pool.

    The threshold is the highest of some quantiles of the first active day that leaves both
    classes in validation; all candidates are judged in one aggregate.
    """
    # Read for the candidates, their tests and the result.
    rows = stored(g.nodes.select("node_id", "y").join(activity(g).select("node_id", "first_active"), "node_id"), "active-labels")
    day, theta = F.col("first_active"), threshold_day(rows)
    labelled = F.col("y").isin(NORMAL, FRAUD)
    return large(rows).select("node_id", F.when(labelled & (day >= theta), "val").when(labelled, "train").when(F.col("y") == -100, "test_pool").otherwise("external").alias("part"))


def split_report(g: GraphFrame) -> DataFrame:
    """(part, size, positive_count, positive_rate, first_active_median) of a split by time; an error unless the validation nodes' median is later than the training nodes'."""
    rows = stored(time_split(g).join(g.nodes.select("node_id", "y"), "node_id").join(activity(g).select("node_id", "first_active"), "node_id"), "split-rows")
    # Days are few, so a median of them is a map of few counts.
    found = rows.groupBy("part").agg(F.count(F.lit(1)).alias("size"), F.count_if(F.col("y") == FRAUD).alias("positive_count"), F.median("first_active").alias("first_active_median"))
    out = found.select("part", "size", "positive_count", (F.col("positive_count") / F.col("size")).alias("positive_rate"), "first_active_median")
    middle = {r["part"]: r["first_active_median"] for r in out.filter("part in ('train', 'val')").collect()}
    if not middle.get("val", 0) > middle.get("train", 0):
        raise ValueError(f"the validation nodes don't become active later than the training nodes: {middle}")
    return out


def threshold_day(rows: DataFrame) -> int:
    labelled = rows.filter(F.col("y").isin(NORMAL, FRAUD))
    quantiles = labelled.agg(F.percentile("first_active", F.array(*[F.lit(c) for c in CUTS]))).first()[0]
    if quantiles is None:
        raise ValueError("there are no labelled nodes to split")
    days = [int(q) for q in quantiles]
    late = lambda d: F.col("first_active") >= d
    tests = [f for i, d in enumerate(days) for f in (F.count_if(late(d) & (F.col("y") == 1)).alias(f"p{i}"), F.count_if(late(d) & (F.col("y") == 0)).alias(f"n{i}"), F.count_if(~late(d)).alias(f"t{i}"))]
    row = labelled.agg(*tests).first()
    for i, d in enumerate(days):
        if row[f"p{i}"] and row[f"n{i}"] and row[f"t{i}"]:
            return d
    raise ValueError("no threshold leaves training nodes and both classes in validation")
