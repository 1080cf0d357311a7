"""Filling missing raw columns: by median, by an affine map of observed columns, or by ridge regression on a logarithm."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.gram import Moments, moments, none
from ledgerloom.operators.ranks import medians, quantiles
from ledgerloom.sources.shared import stored

MISSING = -1.0


def seen(c: str):
    """The column's value, null where it is missing."""
    return F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) != MISSING), F.col(c))


def constant_fill(nodes: DataFrame, columns: Sequence[str], how: str = "median") -> DataFrame:
    """nodes with missing values filled by the column's median, by zero, or left missing (how: median, zero, missing)."""
    if how == "median":
        found = medians(nodes, {c: seen(c) for c in columns})
        values = {c: found.get(c, 0.0) for c in columns}
    else:
        values = dict.fromkeys(columns, 0.0 if how == "zero" else MISSING)
    return nodes.select("node_id", *[F.coalesce(seen(c), F.lit(values[c])).alias(c) for c in columns])


def ranked_predictors(rows: DataFrame, target: str, predictors: Sequence[str]) -> list[str]:
    """Predictors by absolute correlation with the target among the rows that have it, one aggregate."""
    row = rows.filter(seen(target).isNotNull()).agg(*[F.corr(target, p).alias(p) for p in predictors]).first()
    return sorted(predictors, key=lambda p: (-abs(row[p] if row[p] is not None and row[p] == row[p] else 0.0), p))


def least_squares(rows: DataFrame, target: str, predictors: Sequence[str]) -> tuple[np.ndarray, float]:
    """(coefficients, intercept), from sums of products in one aggregate; the driver solves a system of a few columns."""
    names = [*predictors, target]
    mean = rows.agg(*[F.avg(n).alias(n) for n in names]).first()
    if mean[target] is None:
        return np.zeros(len(predictors)), 0.0
    centred = {n: F.col(n) - F.lit(float(mean[n])) for n in names}
    moments = [F.sum(centred[a] * centred[b]).alias(f"m_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    row = rows.agg(*moments).first()
    m = np.array([[row[f"m_{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))], float)
    w = np.linalg.lstsq(m[:-1, :-1], m[:-1, -1], rcond=None)[0]
    return w, float(mean[target] - sum(c * mean[p] for c, p in zip(w, predictors, strict=True)))


def _linear(predictors: Sequence[str], w: Sequence[float], b: float):
    out = F.lit(float(b))
    for c, p in zip(w, predictors, strict=True):
        out = out + F.lit(float(c)) * F.col(p)
    return out


def affine_fill(nodes: DataFrame, target: str, predictors: Sequence[str], *, sizes: Sequence[int] = (1, 2, 3, 5, 8, 12, 20), step: str | None = None, whole: bool = False) -> DataFrame:
    """(node_id, target, filled): missing values by least squares on the most correlated predictors.

    How many is chosen on the rows of the latest step that have the target: highest R2, then lowest error; without
    a step column it is the smallest size. Values stay above 0 if all observed are; whole: rounded to integers.
    """
    # Read for the ranking, each number of predictors, the last fit and the result.
    nodes = stored(nodes.select(*dict.fromkeys(["node_id", target, *predictors, *([] if step is None else [step])])), "affine-rows")
    known = nodes.filter(seen(target).isNotNull())
    order = ranked_predictors(known, target, predictors)
    options = sorted({min(k, len(order)) for k in sizes})
    best = options[0]
    if step is not None and len(options) > 1:
        last = known.agg(F.max(step)).first()[0]
        train, held = known.filter(F.col(step) < last), known.filter(F.col(step) == last)
        fits = {k: least_squares(train, target, order[:k]) for k in options}
        errors = [x for k in options for x in (F.sum((F.col(target) - _linear(order[:k], *fits[k])) ** 2).alias(f"e{k}"), F.avg(F.abs(F.col(target) - _linear(order[:k], *fits[k]))).alias(f"a{k}"))]
        row = held.agg(F.var_pop(target).alias("v"), F.count(F.lit(1)).alias("n"), *errors).first()
        r2 = lambda k: 0.0 if row["n"] < 2 or not row["v"] else 1 - row[f"e{k}"] / (row["v"] * row["n"])
        best = min(options, key=lambda k: (-round(r2(k), 9), row[f"a{k}"] if row[f"a{k}"] is not None else 0.0, k))
    chosen = order[:best]
    w, b = least_squares(known, target, chosen)
    low = known.agg(F.min(target)).first()[0]
    value = _linear(chosen, w, b)
    if low is not None and low >= 0:
        value = F.greatest(value, F.lit(0.0))
    value = F.rint(value) if whole else value
    return nodes.select("node_id", F.coalesce(seen(target), value).alias(target), seen(target).isNull().alias("filled"))


def ridge_fill(nodes: DataFrame, target: str, predictors: Sequence[str], *, alpha: float = 1.0) -> DataFrame:
    """(node_id, target, filled): missing values by ridge regression of log1p(target) on standardised predictors, within the quantiles 0.01 and 0.99 of the observed values."""
    base = constant_fill(nodes, predictors)
    rows = base.join(nodes.select("node_id", seen(target).alias("_t")), "node_id")
    known = rows.filter(F.col("_t") >= 0)
    found = moments(known, [*[F.col(p) for p in predictors], F.log1p("_t")]).get(None)
    if found is None:
        return rows.select("node_id", F.coalesce("_t", F.lit(0.0)).alias(target), F.col("_t").isNull().alias("filled"))
    low, high = quantiles(known, "_t", [0.01, 0.99])[()]
    value = F.least(F.greatest(F.expm1(_linear(predictors, *ridge_of(found, alpha))), F.lit(float(low))), F.lit(float(high)))
    return rows.select("node_id", F.coalesce("_t", value).alias(target), F.col("_t").isNull().alias("filled"))


@dataclass(frozen=True)
class Ridge:
    """A linear map and how well it did on the rows held out."""

    alpha: float
    weights: np.ndarray
    intercept: float
    error: float
    r2: float


def ridge_of(train: Moments, alpha: float) -> tuple[np.ndarray, float]:
    """(weights, intercept) of the last column on the others, which are standardised for the penalty alone."""
    spread = np.where(train.deviations()[:-1] > 0, train.deviations()[:-1], 1.0)
    products = train.products[:-1, :-1] / np.outer(spread, spread) + alpha * np.eye(len(spread))
    w = np.linalg.solve(products, train.products[:-1, -1] / spread) / spread
    return w, float(train.mean[-1] - w @ train.mean[:-1])


def held_out(m: Moments, w: np.ndarray, b: float) -> tuple[float, float]:
    """(sum of squared errors, R2) of a map on rows, of which only the moments are needed."""
    if not m.n:
        return 0.0, 0.0
    signs, off = np.append(-w, 1.0), float(m.mean[-1] - w @ m.mean[:-1] - b)
    error = max(float(signs @ m.products @ signs), 0.0) + m.n * off * off
    return error, 1 - error / m.products[-1, -1] if m.products[-1, -1] > 0 else 0.0


def ridge_chosen(train: Moments, valid: Moments, alphas: Sequence[float]) -> Ridge:
    """The penalty with the least error on the rows held out, then the smallest; no rows are read again for any."""
    tried = []
    for alpha in sorted(max(float(a), 1e-6) for a in alphas):
        w, b = ridge_of(train, alpha)
        tried.append(Ridge(alpha, w, b, *held_out(valid, w, b)))
    return min(tried, key=lambda r: (r.error, r.alpha))


REPORT = "target string, fill string, alpha double, train_rows long, validation_rows long, r2 double, observed_min double, observed_median double, observed_max double"


def ridge_holdout_fill(nodes: DataFrame, targets: Sequence[str], predictors: Sequence[str], step: str, *, alphas: Sequence[float] = (1.0,), least_train: int = 1000, least_valid: int = 100, least_fit: int = 100, clip: float = 0.001, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(rows with node_id, and each target and target_filled; a report with a row for each target): missing values by ridge regression, tested on the latest steps.

    Of the rows that have the target, those of the latest two steps are held out; if that leaves too few on either side,
    a fifth drawn by node_id. Predictors are filled by their medians among the training rows. If no observed value is below 0 the
    logarithm of 1 + target is fitted. One pass takes the sums of products of both sides, from which all penalties
    are solved and tested. Values stay within the quantiles `clip` and 1 - `clip` of the observed ones. With fewer than least_fit
    training rows the median is filled in, without observed rows 0. Null and NaN are missing as MISSING is.
    """
    from ledgerloom.operators.sampling import draw

    report, values = [], {}
    # Read for the facts, the quantiles, the medians, the sums and the result.
    nodes = stored(nodes.select(*dict.fromkeys(["node_id", *targets, *predictors, step])), "ridge-rows")
    for target in targets:
        known = nodes.filter(seen(target).isNotNull())
        facts = known.agg(F.count(F.lit(1)).alias("n"), F.max(step).alias("last"), F.min(target).alias("low"), F.max(target).alias("high")).first()
        if not facts["n"]:
            values[target] = F.lit(0.0)
            report.append((target, "zero", None, 0, 0, None, None, None, None))
            continue
        low, middle, high = quantiles(known, target, [clip, 0.5, 1 - clip])[()]
        of = (float(facts["low"]), float(middle), float(facts["high"]))
        late = F.coalesce(F.col(step) >= facts["last"] - 1, F.lit(False)) if facts["last"] is not None else F.lit(False)
        sides = known.agg(F.count_if(~late).alias("train"), F.count_if(late).alias("valid")).first()
        if sides["train"] < least_train or sides["valid"] < least_valid:
            late = draw(seed, "node_id") > 0.8
        between = medians(known.filter(~late), {p: seen(p) for p in predictors})
        filled = [F.coalesce(seen(p), F.lit(float(between.get(p, 0.0)))).cast("double") for p in predictors]
        positive = facts["low"] >= 0
        goal = F.log1p(target) if positive else F.col(target)
        found = moments(known, [*filled, goal], late.cast("int"))
        train, valid = (found.get(k, none(len(predictors) + 1)) for k in (0, 1))
        if train.n < least_fit:
            values[target] = F.lit(float(middle))
            report.append((target, "median", None, int(train.n), int(valid.n), None, *of))
            continue
        best = ridge_chosen(train, valid, alphas)
        value = F.lit(best.intercept)
        for w, x in zip(best.weights, filled, strict=True):
            value = value + F.lit(float(w)) * x
        value = F.expm1(value) if positive else value
        values[target] = F.least(F.greatest(F.coalesce(F.when(~F.isnan(value), value), F.lit(float(middle))), F.lit(float(low))), F.lit(float(high)))
        report.append((target, "ridge_log" if positive else "ridge", best.alpha, int(train.n), int(valid.n), float(best.r2) if valid.n else None, *of))
    rows = nodes.select("node_id", *[x for t in targets for x in (F.coalesce(seen(t), values[t]).alias(t), seen(t).isNull().alias(f"{t}_filled"))])
    return rows, nodes.sparkSession.createDataFrame(report, REPORT)


def forced_missing(nodes: DataFrame, columns: Sequence[str], n: int, key: str = "node_id") -> DataFrame:
    """nodes with the columns marked missing in the n fully observed rows of smallest absolute sum."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.abs(F.col(c))
    whole = F.lit(True)
    for c in columns:
        whole = whole & seen(c).isNotNull()
    chosen = nodes.filter(whole).select(F.col(key).alias("_key"), total.alias("_l1")).orderBy("_l1", "_key").limit(n).select("_key", F.lit(True).alias("_hit"))
    joined = nodes.join(chosen, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.when(F.col("_hit"), F.lit(MISSING)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in nodes.columns])


def with_degrees(rows: DataFrame, degrees: DataFrame, columns: dict[str, str], key: str = "node_id") -> DataFrame:
    """rows whose named columns are replaced by columns of degrees (key, ...), in every row that has one there."""
    found = degrees.select(F.col(key).alias("_key"), *[F.col(d).cast("double").alias(f"_d_{c}") for c, d in columns.items()])
    joined = rows.join(found, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.coalesce(f"_d_{c}", F.col(c)).alias(c) if c in columns else F.col(c) for c in rows.columns])


def missing_to_target(rows: DataFrame, columns: Sequence[str], train: DataFrame, mean: float, *, filled: str, keep: Sequence[str] = (), key: str = "node_id") -> DataFrame:
    """rows with the columns marked missing in as many training rows as bring their mean count of missing values to `mean`.

    Of the training rows (key) whose column `filled` is true, those of smallest absolute sum are taken, ties by key; of
    all training rows, if none was filled. keep: columns that stay as they are, which don't count.
    """
    marked = [c for c in columns if c not in keep]
    wanted = max(round(mean * train.count() / max(len(marked), 1)), 0)
    if mean <= 0 or not wanted:
        return rows
    own = rows.join(train.select(key), key, "left_semi")
    filled_rows = own.filter(F.coalesce(F.col(filled), F.lit(False)))
    own = own if filled_rows.isEmpty() else filled_rows
    total = F.aggregate(F.array(*[F.abs(F.col(c).cast("double")) for c in columns]), F.lit(0.0), lambda a, x: a + x)
    chosen = own.select(F.col(key).alias("_key"), total.alias("_l1")).orderBy("_l1", "_key").limit(wanted).select("_key", F.lit(True).alias("_hit"))
    joined = rows.join(chosen, F.col(key) == F.col("_key"), "left")
    return joined.select(*[F.when(F.col("_hit"), F.lit(MISSING)).otherwise(F.col(c)).alias(c) if c in marked else F.col(c) for c in rows.columns])
