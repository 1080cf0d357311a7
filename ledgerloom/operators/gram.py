"""Means and sums of products of many columns, in one pass: partial matrices of each partition, merged as a tree.

A pair of columns isn't an expression of its own, so that hundreds of columns make no tens of thousands of aggregates.
A task keeps one matrix for each group of its rows, updated by batches; a row of a matrix is then a row of a table, merged
by (group, row) in two levels. Sums are of deviations from the mean and are merged by the difference of the
means, so large means cost no digits. What comes to the driver is a matrix a group: groups are few and given
by the caller, columns are those of a schema.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Groups of partitions that are merged first.
FAN = 64


@dataclass(frozen=True)
class Moments:
    """The number of rows, the columns' means, and the sums of products of deviations from them."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        apart = other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))

    def of(self, at: Sequence[int]) -> Moments:
        """The moments of some of the columns."""
        return Moments(self.n, self.mean[list(at)], self.products[np.ix_(list(at), list(at))])

    def deviations(self) -> np.ndarray:
        """Population deviations; 0 without rows."""
        return np.sqrt(np.maximum(np.diag(self.products), 0.0) / self.n) if self.n else np.zeros(len(self.mean))

    def correlations(self) -> np.ndarray:
        """NaN for a column that doesn't vary, as for no rows."""
        with np.errstate(invalid="ignore", divide="ignore"):
            scale = np.sqrt(np.diag(self.products))
            out = self.products / np.outer(scale, scale)
        np.fill_diagonal(out, np.where(scale > 0, 1.0, np.nan))
        return out


def none(width: int) -> Moments:
    return Moments(0.0, np.zeros(width), np.zeros((width, width)))


def of_rows(values: np.ndarray) -> Moments:
    mean = values.mean(axis=0)
    apart = values - mean
    return Moments(float(len(values)), mean, apart.T @ apart)


def moments(rows: DataFrame, columns: Sequence[Column], by: Column | None = None) -> dict[int | None, Moments]:
    """{group: moments of the columns} over the rows without null and NaN among them; by: a whole number, null is a group; without it the group is None."""
    width = len(columns)
    group = F.lit(None).cast("long") if by is None else by.cast("long")
    # Incomplete rows are left out in the task: as a filter over all columns, Spark would derive its variants for each of their names.
    narrow = rows.select(group.alias("g"), F.array(*[c.cast("double") for c in columns]).alias("v"))
    schema = "part int, g long, i int, n double, mean array<double>, products array<double>"

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[int | None, Moments] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            table = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            groups = np.array([np.nan if x is None else x for x in batch.column(0).to_pylist()], float)
            whole = ~np.isnan(table).any(axis=1)
            table, groups = table[whole], groups[whole]
            for g in np.unique(groups):
                mine = np.isnan(groups) if np.isnan(g) else groups == g
                name = None if np.isnan(g) else int(g)
                held[name] = held.get(name, none(width)) + of_rows(table[mine])
        part = TaskContext.get().partitionId() % FAN
        for g, m in held.items():
            yield pa.RecordBatch.from_pydict({"part": [part] * width, "g": [g] * width, "i": list(range(width)), "n": [m.n] * width, "mean": [m.mean.tolist()] * width, "products": m.products.tolist()}, schema=arrow)

    arrow = pa.schema([("part", pa.int32()), ("g", pa.int64()), ("i", pa.int32()), ("n", pa.float64()), ("mean", pa.list_(pa.float64())), ("products", pa.list_(pa.float64()))])

    def merged(table: pd.DataFrame) -> pd.DataFrame:
        """One row of rows of the same place in the matrices, in order, so that reruns add up alike."""
        n, i, mean, products = 0.0, int(table["i"].iloc[0]), np.zeros(width), np.zeros(width)
        for r in table.sort_values(["part", "n"]).itertuples():
            apart, total = np.asarray(r.mean) - mean, n + r.n
            products = products + np.asarray(r.products) + apart * apart[i] * (n * r.n / total)
            mean, n = mean + apart * (r.n / total), total
        return pd.DataFrame({"part": table["part"].iloc[:1], "g": table["g"].iloc[:1], "i": [i], "n": [n], "mean": [mean], "products": [products]})

    found = narrow.mapInArrow(partial, schema)
    for keys in (["part", "g", "i"], ["g", "i"]):
        found = found.groupBy(*keys).applyInPandas(merged, schema)
    out: dict[int | None, Moments] = {}
    for g, own in pd.DataFrame([r.asDict() for r in found.collect()], columns=["part", "g", "i", "n", "mean", "products"]).groupby("g", dropna=False):
        own = own.sort_values("i")
        out[None if pd.isna(g) else int(g)] = Moments(float(own["n"].iloc[0]), np.array(own["mean"].iloc[0]), np.array(own["products"].tolist()))
    return out


def total(by_group: dict[int | None, Moments], width: int) -> Moments:
    """The moments of all groups together."""
    out = none(width)
    for g in sorted(by_group, key=lambda g: (g is not None, g or 0)):
        out = out + by_group[g]
    return out


def square(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, a column for each feature): the correlations as a square table, in order of the columns."""
    table = total(moments(rows, [F.col(c) for c in columns]), len(columns)).correlations()
    kinds = ", ".join(["feature string", *[f"`{c}` double" for c in columns]])
    return rows.sparkSession.createDataFrame([(c, *table[i].tolist()) for i, c in enumerate(columns)], kinds)


def pairs(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, corr) of all pairs of columns, both orders and each with itself."""
    table = square(rows, columns)
    return table.select(F.col("feature").alias("feature_a"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature_b"), F.col(f"`{c}`").alias("corr")) for c in columns])).alias("p")).select("feature_a", "p.*")
