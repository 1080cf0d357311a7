"""Run reports: epoch rows cleaned, their best row, early stopping, and results by method and data set."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import percent_with_delta
from ledgerloom.operators.sampling import first

RUN = ("method", "dataset")


def clean_epochs(rows: DataFrame, metrics: Sequence[str], run: Sequence[str] = RUN) -> DataFrame:
    """One row for each run and epoch: the mean of repeated ones."""
    return rows.groupBy(*run, "epoch").agg(*[F.avg(m).alias(m) for m in metrics])


def best_epoch(rows: DataFrame, metric: str, run: Sequence[str] = RUN) -> DataFrame:
    """(run, best_epoch, metric, last_epoch): the first epoch of the highest metric, and the last there is."""
    top = F.max_by("epoch", F.struct(F.col(metric), -F.col("epoch")))
    return rows.filter(F.col(metric).isNotNull()).groupBy(*run).agg(top.alias("best_epoch"), F.max(metric).alias(metric), F.max("epoch").alias("last_epoch"))


def early_stop(rows: DataFrame, metric: str, patience: int, run: Sequence[str] = RUN) -> DataFrame:
    """Epochs with the best so far, how many have passed since it, and whether the run stops here."""
    so_far = Window.partitionBy(*run).orderBy("epoch")
    upto, before = so_far.rowsBetween(Window.unboundedPreceding, 0), so_far.rowsBetween(Window.unboundedPreceding, -1)
    better = rows.withColumn("best", F.max(metric).over(upto)).withColumn("_new", F.col(metric) > F.coalesce(F.max(metric).over(before), F.lit(float("-inf"))))
    since = F.col("epoch") - F.coalesce(F.max(F.when(F.col("_new"), F.col("epoch"))).over(upto), F.col("epoch"))
    waited = better.withColumn("waited", since)
    return waited.withColumn("stops", F.col("waited") == patience).drop("_new")


def volatility(rows: DataFrame, metric: str, run: Sequence[str] = RUN) -> DataFrame:
    """(run, volatility): mean absolute change from epoch to epoch over the mean absolute value."""
    step = F.abs(F.col(metric) - F.lag(metric).over(Window.partitionBy(*run).orderBy("epoch")))
    return rows.withColumn("_d", step).groupBy(*run).agg((F.coalesce(F.avg("_d"), F.lit(0.0)) / F.greatest(F.avg(F.abs(metric)), F.lit(1e-9))).alias("volatility"))


def trailing_mean(rows: DataFrame, metric: str, k: int, run: Sequence[str] = RUN) -> DataFrame:
    """rows with trust: the mean of the k epochs before."""
    before = Window.partitionBy(*run).orderBy("epoch").rowsBetween(-k, -1)
    return rows.withColumn("trust", F.avg(metric).over(before))


# The weight of each quality in the trust score, and the loss or margin that is worth nothing or everything.
TRUST_WEIGHTS = {"available": 0.18, "classification": 0.30, "margin": 0.14, "consistency": 0.10, "stability": 0.28}
TRUST_SCALES = {"classification": 0.35, "margin": 0.45, "consistency": 0.25}


def trust_score(rows: DataFrame, k: int = 3, run: Sequence[str] = RUN) -> DataFrame:
    """rows with trust, 0 to 1, from the means of the k epochs before; 1 where there are fewer than two.

    rows: (run, epoch, available, classification, margin, consistency, stability), classification and consistency
    being losses. A loss nobody recorded counts as none, a margin, share or stability as 0.
    """
    before = Window.partitionBy(*run).orderBy("epoch").rowsBetween(-k, -1)
    mean = lambda c: F.avg(c).over(before)
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    parts = {c: F.coalesce(mean(c), F.lit(0.0)) for c in ("available", "stability")}
    parts["margin"] = F.coalesce(unit(mean("margin") / TRUST_SCALES["margin"]), F.lit(0.0))
    parts |= {c: F.coalesce(unit(1.0 - mean(c) / TRUST_SCALES[c]), F.lit(1.0)) for c in ("classification", "consistency")}
    score = F.lit(0.0)
    for name, weight in TRUST_WEIGHTS.items():
        score = score + weight * parts[name]
    return rows.withColumn("trust", F.when(F.count(F.lit(1)).over(before) < 2, 1.0).otherwise(unit(score)))


def result_pivot(best: DataFrame, metric: str, datasets: Sequence[str]) -> DataFrame:
    """A row for each method, a column for each data set."""
    return best.groupBy("method").pivot("dataset", list(datasets)).agg(F.first(metric))


def with_delta(best: DataFrame, metric: str, reference: str) -> DataFrame:
    """best with delta to the reference method on the same data set, and both as a percentage."""
    base = best.filter(F.col("method") == reference).select("dataset", F.col(metric).alias("_base"))  # a row for each data set
    joined = best.join(base, "dataset", "left").withColumn("delta", F.col(metric) - F.col("_base"))
    return joined.withColumn("shown", percent_with_delta(metric, "delta")).drop("_base")


def average_predictions(predictions: DataFrame) -> DataFrame:
    """(node_id, y_true, probability): the mean over runs."""
    return predictions.groupBy("node_id").agg(F.max("y_true").alias("y_true"), F.avg("probability").alias("probability"))


def ordered_runs(runs: DataFrame, datasets: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Runs (dataset, kind, name) in the order of the given data sets, then kinds, then names; unknown ones last."""
    place = lambda c, names: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), F.col(c)), F.lit(0)), F.lit(len(names) + 1))
    return runs.orderBy(place("dataset", datasets), place("kind", kinds), "name")


def first_rows(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first(rows, by, [F.col(c) for c in order], 1).drop("rank")
