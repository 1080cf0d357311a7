"""Exact quantiles and running sums of columns with any number of distinct values, without one task that holds them all."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sketch's ranks are off by 1 / ACCURACY of the rows; brackets are twice as wide, and checked.
ACCURACY = 10_000
SLACK = 2.0 / ACCURACY
#: Rows that one task orders, and the most ranges that a running sum has.
ROWS_A_RANGE, MOST_RANGES = 100_000, 1024


def quantiles(rows: DataFrame, value: str, qs: Sequence[float], by: Sequence[str] = ()) -> dict[tuple, list[float]]:
    """{group: values}: interpolated quantiles of the non-null values of each group; a group without one isn't there.

    A sketch brackets every wanted rank; the rows below a bracket are counted, and only those inside,
    some 4 in ACCURACY of all, are ordered. A bracket that misses its rank is widened to the whole range,
    so the result never depends on the sketch. A row for each group and quantile comes to the driver:
    groups are columns and classes, not keys of the data.
    """
    seen = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    low, high = ([min(max(q + s, 0.0), 1.0) for q in qs] for s in (-SLACK, SLACK))
    sketch = lambda ps: F.percentile_approx("_v", [float(p) for p in ps], ACCURACY)
    found = seen.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("a"), F.max("_v").alias("b"), sketch(low).alias("lo"), sketch(high).alias("hi")).collect()
    groups = {tuple(r[k] for k in by): r for r in found if r["n"]}
    wanted = {(g, i): (r["a"] if low[i] <= 0 else r["lo"][i], r["b"] if high[i] >= 1 else r["hi"][i]) for g, r in groups.items() for i in range(len(qs))}
    values: dict[tuple, float] = {}
    while wanted:
        values |= _inside(seen, by, wanted, {(g, i): qs[i] * (groups[g]["n"] - 1) for g, i in wanted})
        wanted = {k: (groups[k[0]]["a"], groups[k[0]]["b"]) for k in wanted if k not in values}
    return {g: [values[g, i] for i in range(len(qs))] for g in groups}


def medians(rows: DataFrame, columns: Mapping[str, Column]) -> dict[str, float]:
    """The median of each named column's non-null values; a column without one isn't there."""
    if not columns:
        return {}
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c.cast("double").alias("value")) for n, c in columns.items()])).alias("p")).select("p.*")
    return {name: found[0] for (name,), found in quantiles(long, "value", [0.5], ["name"]).items()}


def _inside(seen: DataFrame, by: Sequence[str], brackets: Mapping[tuple, tuple[float, float]], positions: Mapping[tuple, float]) -> dict[tuple, float]:
    """The values at fractional positions, of the brackets that hold them."""
    kinds = ", ".join([*[f"`{k}` {seen.schema[k].dataType.simpleString()}" for k in by], "_i int, _lo double, _hi double, _p double"])
    table = seen.sparkSession.createDataFrame([(*g, i, float(a), float(b), float(positions[g, i])) for (g, i), (a, b) in brackets.items()], kinds)
    part = F.struct("_i", "_lo", "_hi")
    lists = table.groupBy(*by).agg(F.collect_list(part).alias("_b"))  # a list of brackets for each group
    joined = seen.join(F.broadcast(lists), list(by)) if by else seen.crossJoin(F.broadcast(lists))  # without groups, lists is one row
    dealt = joined.select(*by, "_v", F.explode(F.filter("_b", lambda b: F.col("_v") <= b["_hi"])).alias("_b"))
    counts = dealt.groupBy(*by, "_b._i", F.when(F.col("_v") >= F.col("_b._lo"), F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*by, "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    run = counts.withColumn("_upto", upto).join(F.broadcast(table.select(*by, "_i", "_p")), [*by, "_i"])
    at = lambda rank: F.min_by("_v", F.when(F.col("_upto") > rank, F.col("_upto")))  # noqa: E731  the first value past a rank; null if that is below
    ends = run.groupBy(*by, "_i").agg(at(F.floor("_p")).alias("x"), at(F.ceil("_p")).alias("y"), F.max(F.col("_v").isNull() & (F.col("_upto") > F.floor("_p"))).alias("missed"))
    out = {}
    for r in ends.collect():
        if not r["missed"] and r["x"] is not None and r["y"] is not None:
            key = (tuple(r[k] for k in by), r["_i"])
            share = positions[key] - int(positions[key])
            out[key] = r["x"] if r["x"] == r["y"] else r["x"] + (r["y"] - r["x"]) * share
    return out


def ranges_for(rows: int, each: int = ROWS_A_RANGE, most: int | None = None) -> int:
    """Into how many ranges so many rows are cut, if one is to have `each` of them or somewhat more."""
    wanted = max(1, -(-rows // each))
    return wanted if most is None else min(wanted, most)


def range_of(value: str, cuts: Sequence) -> Column:
    """How many of the ascending cuts are at most the value, null for null; beyond a few cuts in two steps, so that a row is compared with twice their root."""
    upto = lambda list_: F.size(F.filter(list_, lambda c: c <= F.col(value)))
    literal = lambda xs: F.array(*[F.lit(x) for x in xs])
    if not cuts:
        at = F.lit(0)
    elif len(cuts) <= 32:
        at = upto(literal(cuts))
    else:
        step = math.isqrt(len(cuts) - 1) + 1
        block = upto(literal(cuts[::step]))
        blocks = F.array(*[literal(cuts[i : i + step]) for i in range(0, len(cuts), step)])
        at = F.when(block > 0, (block - 1) * step + upto(F.get(blocks, block - 1))).otherwise(0)
    return F.when(F.col(value).isNotNull(), at)


def running(counts: DataFrame, value: str, sums: Sequence[str], *, descending: bool = False, each: int = ROWS_A_RANGE) -> DataFrame:
    """counts with `upto_<column>` for each of `sums`: its sum over the rows up to and with this value. One row for each value; null values are left out.

    Values are cut into ranges of about `each` rows, MOST_RANGES at most, as many as the rows ask for; a range's totals are summed apart, so
    no task orders all values.
    """
    found = counts.select(F.percentile_approx(value, [i / MOST_RANGES for i in range(1, MOST_RANGES)], ACCURACY).alias("c"), F.count(value).alias("n")).first()
    step = MOST_RANGES // ranges_for(found["n"], each, MOST_RANGES)
    cuts = sorted(set((found["c"] or [])[step - 1 :: step]))
    part = range_of(value, cuts)
    dealt = counts.filter(F.col(value).isNotNull()).withColumn("_part", F.lit(len(cuts)) - part if descending else part)
    totals = dealt.groupBy("_part").agg(*[F.sum(s).alias(f"_t{s}") for s in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = totals.select("_part", *[F.coalesce(F.sum(f"_t{s}").over(before), F.lit(0)).alias(f"_s{s}") for s in sums])
    inside = Window.partitionBy("_part").orderBy(_order(value, descending)).rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.select("*", *[F.sum(s).over(inside).alias(f"_i{s}") for s in sums]).join(F.broadcast(starts), "_part")
    return run.select(*counts.columns, *[(F.col(f"_s{s}") + F.col(f"_i{s}")).alias(f"upto_{s}") for s in sums])


def _order(value: str, descending: bool) -> Column:
    return F.col(value).desc() if descending else F.col(value)
