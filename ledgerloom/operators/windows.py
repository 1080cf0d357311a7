"""Time windows, buckets and cohort-normalised values.

Cohorts are 30-day buckets of the first active day. A hot cohort is no hot task: its mean and
deviation are aggregated, and the small table of cohorts is joined back to the nodes.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.contract import GraphFrame
from ledgerloom.functions.scalar import col, total
from ledgerloom.operators import scales
from ledgerloom.operators.graph import _dir, activity, background_touch, complete, counted, degrees, edge_age, incident, recent_counts

BUCKET_DAYS = 30
ADAPTIVE_WINDOWS = (3, 7, 14, 30, 60, 90)
CONTRAST = (7, 60)
DUAL_PAIRS = ((3, 14), (7, 30), (14, 60))
DIRECTIONS = ("out", "in", "total")


@dataclass(frozen=True)
class Window:
    index: int
    start: int
    end: int


def edge_time_windows(edges: DataFrame, n: int = 4) -> list[Window]:
    """Windows of about as many edges each, of whole days and disjoint; the last ends on the last day."""
    cuts = [i / n for i in range(n + 1)]
    row = edges.agg(F.percentile("day", F.array(*[F.lit(c) for c in cuts])).alias("q"), F.max("day").alias("m")).first()
    if row["q"] is None:
        return []
    out: list[Window] = []
    for i in range(n):
        start = math.floor(row["q"][i])
        if out and start <= out[-1].end:
            start = out[-1].end + 1
        out.append(Window(i + 1, start, max(math.ceil(row["q"][i + 1]), start)))
    return [*out[:-1], Window(n, out[-1].start, int(row["m"]))]


def windows_table(g: GraphFrame, n: int = 4) -> DataFrame:
    rows = [(w.index, w.start, w.end) for w in edge_time_windows(g.edges, n)]
    return g.edges.sparkSession.createDataFrame(rows, "window_idx int, start_day int, end_day int")


def bucket_of(day: Column, windows: list[Window]) -> Column:
    """The zero-based window of a day: the last that holds it, the first if none does."""
    out = F.lit(0)
    for w in windows:
        out = F.when(day.between(w.start, w.end), F.lit(w.index - 1)).otherwise(out)
    return out.cast("int")


def node_time_bucket(g: GraphFrame, n: int = 4) -> DataFrame:
    windows = edge_time_windows(g.edges, n)
    end = F.lit(None).cast("int")
    for w in windows:
        end = F.when(F.col("time_bucket") == w.index - 1, F.lit(w.end)).otherwise(end)
    bucket = activity(g).select("node_id", "first_active", bucket_of(F.col("first_active"), windows).alias("time_bucket"))
    return bucket.withColumn("window_end", end)


@scales.columns(log="window_{n}_{e}_count")
def window_counts(g: GraphFrame, n: int = 4) -> DataFrame:
    windows = edge_time_windows(g.edges, n)
    wanted = {f"window_{w.index}_{d}_count": _dir(d) & F.col("day").between(w.start, w.end) for w in windows for d in ("in", "out")}
    found = complete(g.nodes, counted(incident(g), wanted))
    total = {w.index: F.col(f"window_{w.index}_in_count") + F.col(f"window_{w.index}_out_count") for w in windows}
    half = max(n // 2, 1)
    early, late = (sum((total[i] for i in part), F.lit(0.0)) for part in (range(1, half + 1), range(half + 1, n + 1)))
    columns = [c for i in total for c in (F.col(f"window_{i}_in_count"), F.col(f"window_{i}_out_count"), total[i].alias(f"window_{i}_total_count"))]
    return found.select("node_id", *columns, ((early + 1.0) / (late + 1.0)).alias("early_late_total_ratio"))


def cohort(first_active: Column, days: int = BUCKET_DAYS) -> Column:
    return F.greatest(F.floor((first_active - 1) / F.lit(float(days))).cast("long"), F.lit(0).cast("long"))


def with_cohort(g: GraphFrame) -> DataFrame:
    return activity(g).select("node_id", cohort(F.col("first_active")).alias("cohort"))


def z_scores(rows: DataFrame, columns: Mapping[str, tuple[Column | str, Column | None]], by: str = "cohort", keep: tuple[str, ...] = ("node_id",)) -> DataFrame:
    """For each (value, mask): (value - mean) / deviation among the valid rows of the cohort; 0 where the mask is false.

    Population deviation, at least 1e-6. All means and deviations are one aggregation.
    """
    marks = {n: (col(v).cast("double"), F.lit(True) if m is None else m) for n, (v, m) in columns.items()}
    base = rows.select(*keep, by, *[F.when(m, v).alias(f"_v{i}") for i, (v, m) in enumerate(marks.values())])
    stats = base.groupBy(by).agg(*[f(f"_v{i}").alias(f"{n}{i}") for i in range(len(marks)) for n, f in (("_m", F.avg), ("_s", F.stddev_pop))])
    joined = base.join(stats, by)
    z = lambda i: (F.col(f"_v{i}") - F.col(f"_m{i}")) / F.greatest(F.col(f"_s{i}"), F.lit(1e-6))
    return joined.select(*keep, *[F.coalesce(z(i), F.lit(0.0)).alias(n) for i, n in enumerate(marks)])


@scales.columns(identity=f"tb{BUCKET_DAYS}_{{*}}")
def cohort_zscore(g: GraphFrame) -> DataFrame:
    """log1p degrees normalised within the cohort."""
    rows = degrees(g).join(with_cohort(g), "node_id")
    return z_scores(rows, {f"tb{BUCKET_DAYS}_log_{n}_z": (F.log1p(n), None) for n in ("indegree", "outdegree", "total_degree")})


@scales.columns(identity=f"tb{BUCKET_DAYS}_{{*}}")
def missing_zscore(g: GraphFrame) -> DataFrame:
    """Raw values normalised among the observed of their cohort, and missing marks scaled by the cohort's missing rate."""
    rows = g.nodes.join(with_cohort(g), "node_id")
    raw = g.schema.raw_columns
    marks = rows.select("node_id", "cohort", *raw, *[(F.col(c) == -1.0).cast("double").alias(f"{c}_missing") for c in raw])
    z = z_scores(marks, {f"tb{BUCKET_DAYS}_{c}_z": (c, F.col(c) != -1.0) for c in raw})
    rates = marks.groupBy("cohort").agg(*[F.avg(f"{c}_missing").alias(f"_p_{c}") for c in raw])
    scaled = lambda c: (F.col(f"{c}_missing") - F.col(f"_p_{c}")) / F.greatest(F.sqrt(F.col(f"_p_{c}") * F.greatest(F.lit(1.0) - F.col(f"_p_{c}"), F.lit(0.0))), F.lit(1e-3))
    m = marks.join(rates, "cohort").select("node_id", *[scaled(c).alias(f"tb{BUCKET_DAYS}_{c}_missing_z") for c in raw])
    return z.join(m, "node_id")


@scales.columns(identity=f"tb{BUCKET_DAYS}_{{*}}")
def bucket_norm(g: GraphFrame) -> DataFrame:
    """missing_zscore, and the missing count, log1p degrees, background shares and log1p background total normalised within the cohort."""
    touch = background_touch(g).select("node_id", "bg_in_ratio", "bg_out_ratio", "bg_total_ratio", F.log1p("bg_total_count").alias("log_bg_total"))
    gone = total([(F.col(c) == -1.0).cast("double") for c in g.schema.raw_columns])
    rows = g.nodes.select("node_id", gone.alias("missing_count")).join(degrees(g), "node_id").join(touch, "node_id").join(with_cohort(g), "node_id")
    columns = {"missing_count": "missing_count"} | {f"log_{d}": F.log1p(d) for d in ("indegree", "outdegree", "total_degree")} | {c: c for c in ("bg_in_ratio", "bg_out_ratio", "bg_total_ratio", "log_bg_total")}
    return missing_zscore(g).join(z_scores(rows, {f"tb{BUCKET_DAYS}_{n}_z": (c, None) for n, c in columns.items()}), "node_id")


def time_detrend(g: GraphFrame) -> DataFrame:
    """Edge ages and the share of the last 30 days, normalised within the cohort."""
    rows = edge_age(g).join(recent_counts(g, (30,)), "node_id").join(with_cohort(g), "node_id")
    ages = {f"gtd_days_since_{d}_{k}_z": (f"days_since_{d}_{k}", None) for k in ("mean", "last") for d in ("out", "in")}
    return z_scores(rows, ages | {f"gtd_{d}_last30_ratio_z": (f"{d}_last30_ratio_v2", None) for d in ("out", "in")})


def trailing_counts(g: GraphFrame, windows: tuple[int, ...]) -> DataFrame:
    """{out,in,total}_c{w}: edges of the last w days; {out,in,total}_degree: all; cohort: by the first day of any edge. One aggregate."""
    wanted = {f"{d}_c{w}": _dir(d) & (F.col("day") > g.max_day() - w) for w in windows for d in ("out", "in")} | {"out_degree": _dir("out"), "in_degree": _dir("in")}
    found = incident(g).groupBy("center").agg(*[F.count_if(c).cast("double").alias(n) for n, c in wanted.items()], F.min("day").alias("_first"))
    whole = complete(g.nodes, found, dict.fromkeys(wanted, 0.0) | {"_first": g.max_day() + 1})
    sums = [(F.col(f"out_{x}") + F.col(f"in_{x}")).alias(f"total_{x}") for x in [*(f"c{w}" for w in windows), "degree"]]
    return whole.select("*", *sums, cohort(F.col("_first")).alias("cohort")).drop("_first")


def adaptive_window(g: GraphFrame) -> DataFrame:
    """The trailing window in which a node stands out most from its cohort, by counts and by shares, and which it is."""
    rows = trailing_counts(g, ADAPTIVE_WINDOWS)
    columns: dict = {}
    s, l = CONTRAST  # noqa: E741
    for d in DIRECTIONS:
        active = F.col(f"{d}_degree") > 0
        for w in ADAPTIVE_WINDOWS:
            columns[f"_c_{d}_{w}"] = (f"{d}_c{w}", None)
            columns[f"_r_{d}_{w}"] = (F.col(f"{d}_c{w}") / (F.col(f"{d}_degree") + 1.0), active)
        columns[f"taw_{d}_density_{s}_over_{l}_z"] = (F.log1p(F.col(f"{d}_c{s}") / float(s)) - F.log1p(F.col(f"{d}_c{l}") / float(l)), active)
    z = z_scores(rows, columns)
    peak = lambda kind, d: F.greatest(*[F.col(f"_{kind}_{d}_{w}") for w in ADAPTIVE_WINDOWS])

    def where(d: str) -> Column:
        out = F.lit(None).cast("double")
        for i, w in reversed(list(enumerate(ADAPTIVE_WINDOWS))):
            out = F.when(F.col(f"_c_{d}_{w}") == peak("c", d), F.lit(i / (len(ADAPTIVE_WINDOWS) - 1))).otherwise(out)
        return out

    return z.select(
        "node_id",
        *[peak("c", d).alias(f"taw_{d}_count_peak_z") for d in DIRECTIONS],
        *[peak("r", d).alias(f"taw_{d}_ratio_peak_z") for d in DIRECTIONS],
        *[F.col(f"taw_{d}_density_{s}_over_{l}_z") for d in DIRECTIONS],
        *[where(d).alias(f"taw_{d}_peak_window") for d in DIRECTIONS],
    )


def bursts(g: GraphFrame, windows: tuple[int, ...]) -> DataFrame:
    """{out,in,total}_b{w}: the most edges of a node on one of the last w days; a self-loop counts twice in total."""
    late = incident(g).filter(F.col("day") > g.max_day() - max(windows))
    by_day = late.groupBy("center", "day").agg(*[F.count_if(_dir(d)).cast("double").alias(d) for d in ("out", "in")], F.count(F.lit(1)).cast("double").alias("total"))
    wanted = [F.max(F.when(F.col("day") > g.max_day() - w, F.col(d)).otherwise(0.0)).alias(f"{d}_b{w}") for w in windows for d in DIRECTIONS]
    return complete(g.nodes, by_day.groupBy("center").agg(*wanted))


def dual_scale_delta(g: GraphFrame) -> DataFrame:
    """A short window against a long one, normalised within the cohort: density, share and burst."""
    lengths = tuple(sorted({w for p in DUAL_PAIRS for w in p}))
    rows = trailing_counts(g, lengths).join(bursts(g, tuple(s for s, _ in DUAL_PAIRS)), "node_id")
    columns: dict = {}
    for s, l in DUAL_PAIRS:  # noqa: E741
        for d in DIRECTIONS:
            active = F.col(f"{d}_degree") > 0
            slow = F.log1p(F.col(f"{d}_c{l}") / float(l))
            columns[f"tdd_{d}_density_delta_{s}_{l}"] = (F.log1p(F.col(f"{d}_c{s}") / float(s)) - slow, active)
            columns[f"tdd_{d}_ratio_{s}_{l}"] = (F.col(f"{d}_c{s}") / (F.col(f"{d}_c{l}") + 1.0), active)
            columns[f"tdd_{d}_burst_contrast_{s}_{l}"] = (F.log1p(f"{d}_b{s}") - slow, active)
    return z_scores(rows, columns)
