"""Scoring through given weights, evaluation losses, pseudo labels and centroids, and learned baselines.

Scores and losses are expressions; baselines are trained by Spark's own learners on a vector of the named columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import col, sigmoid
from ledgerloom.operators.ranks import quantiles

Layer = tuple[Sequence[Sequence[float]], Sequence[float]]  # weights of each unit, biases


# Scoring.
def linear_logit(weights: Mapping[str, float], bias: float = 0.0) -> Column:
    out = F.lit(float(bias))
    for name, w in weights.items():
        out = out + F.lit(float(w)) * F.col(name).cast("double")
    return out


def dense_logit(columns: Sequence[str], layers: Sequence[Layer]) -> Column:
    """The only output of fully connected layers, with max(x, 0) between them: no Python where rows are."""
    x = F.array(*[F.col(c).cast("double") for c in columns])
    for i, (weights, biases) in enumerate(layers):
        units = F.array(*[F.struct(F.array(*[F.lit(float(w)) for w in row]).alias("w"), F.lit(float(b)).alias("b")) for row, b in zip(weights, biases, strict=True)])
        x = F.transform(units, _unit(x, i == len(layers) - 1))
    return x[0]


def _unit(x: Column, last: bool):
    """What a unit makes of its layer's input."""

    def of(u: Column) -> Column:
        y = F.aggregate(F.zip_with(u["w"], x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) + u["b"]
        return y if last else F.greatest(y, F.lit(0.0))

    return of


# Losses; y is 0 or 1 as a double, and a loss is a row's.
def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def binary_loss(logit: Column | str, y: Column | str, positive_weight: float = 1.0) -> Column:
    """Cross entropy of a logit; errors on positives weigh positive_weight."""
    return positive_weight * col(y) * softplus(-col(logit)) + (1.0 - col(y)) * softplus(col(logit))


def focal_loss(logit: Column | str, y: Column | str, gamma: float, alpha: float | None = None, positive_weight: float = 1.0) -> Column:
    """binary_loss times (1 - p of the true class) ** gamma, and times alpha or 1 - alpha by class if given."""
    p, y = sigmoid(col(logit)), col(y)
    loss = binary_loss(logit, y, positive_weight) * F.pow(1.0 - (p * y + (1.0 - p) * (1.0 - y)), F.lit(max(gamma, 0.0)))
    return loss if alpha is None else loss * (alpha * y + (1.0 - alpha) * (1.0 - y))


def class_loss(logits: Column | str, label: Column | str) -> Column:
    """Cross entropy of an array of logits for a class from 0."""
    z = col(logits)
    top = F.array_max(z)
    return top + F.ln(F.aggregate(z, F.lit(0.0), lambda s, v: s + F.exp(v - top))) - F.element_at(z, col(label).cast("int") + 1)


def ranking_loss(rows: DataFrame, margin: float, by: str = "batch") -> DataFrame:
    """(by, loss): the mean softplus of margin - (positive - negative) over a batch's pairs; 0 without either class.

    rows: (by, y, logit). Pairs are made of the logits of one batch, whose size the batching bounds; never of all rows.
    """
    of = lambda y: F.collect_list(F.when(F.col("y") == y, F.col("logit")))
    sides = rows.groupBy(by).agg(of(1).alias("p"), of(0).alias("n"))
    total = F.aggregate("p", F.lit(0.0), lambda s, a: s + F.aggregate("n", F.lit(0.0), lambda t, b: t + softplus(margin - (a - b))))
    return sides.select(by, (total / F.greatest(F.size("p") * F.size("n"), F.lit(1))).alias("loss"))


# Pseudo labels.
def pseudo_labels(scores: DataFrame, low: float, high: float, gap: float = 0.0) -> DataFrame:
    """scores with `pseudo`, only rows that are sure: 0 up to the low quantile, 1 from the high one; 1 if both hold.

    With a gap, a score must be at least as far from one half on its side.
    """
    if not 0.0 <= low <= 0.5 <= high <= 1.0 or low >= high:
        raise ValueError("quantiles are 0 to 0.5 and 0.5 to 1, and differ")
    found = quantiles(scores, "score", [low, high]).get(())
    if found is None:
        return scores.limit(0).withColumn("pseudo", F.lit(0))
    a, b = found
    if gap > 0:
        a, b = min(a, max(0.5 - gap, 0.0)), max(b, min(0.5 + gap, 1.0))
    label = F.when(F.col("score") >= F.lit(b), 1).when(F.col("score") <= F.lit(a), 0)
    return scores.withColumn("pseudo", label).filter(F.col("pseudo").isNotNull())


def centroids(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, n, centroid): the mean of a group's vectors brought to length one, brought to length one itself; rows: (by, v)."""
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    unit = rows.select(*by, F.transform("v", lambda x: x / F.greatest(length(F.col("v")), F.lit(1e-12))).alias("v"))
    means = unit.select(*by, F.posexplode("v").alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n"))
    whole = means.groupBy(*by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("c"))  # a row for each component
    return whole.select(*by, "n", F.transform("c", lambda x: x / F.greatest(length(F.col("c")), F.lit(1e-12))).alias("centroid"))


# Learned baselines: rows are (node_id, y, columns).
def linear_baseline(train: DataFrame, rows: DataFrame, columns: Sequence[str], penalty: float = 1e-4, rounds: int = 100) -> DataFrame:
    """(node_id, y, score) by logistic regression on standardised columns, both classes weighing the same."""
    return _fitted(train, rows, columns, [StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)], LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=penalty, maxIter=rounds))


def boosted_baseline(train: DataFrame, rows: DataFrame, columns: Sequence[str], rounds: int = 20, depth: int = 4, seed: int = 42) -> DataFrame:
    """(node_id, y, score) by gradient-boosted trees, both classes weighing the same."""
    return _fitted(train, rows, columns, [], GBTClassifier(featuresCol="_raw", labelCol="_y", weightCol="_w", maxIter=rounds, maxDepth=depth, seed=seed))


def _fitted(train: DataFrame, rows: DataFrame, columns: Sequence[str], before: list, learner) -> DataFrame:
    known = train.filter(F.col("y").isin(0, 1)).withColumn("_y", F.col("y").cast("double"))
    n = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if len(n) < 2:
        raise ValueError("a baseline needs both classes")
    weighted = known.withColumn("_w", F.when(F.col("_y") == 1, sum(n.values()) / (2 * n[1.0])).otherwise(sum(n.values()) / (2 * n[0.0])))
    model = Pipeline(stages=[VectorAssembler(inputCols=list(columns), outputCol="_raw"), *before, learner]).fit(weighted)
    return model.transform(rows).select("node_id", "y", vector_to_array("probability")[1].alias("score"))
