"""Runs in a tree of folders: configurations, epoch tables and prediction files, recovered as one table.

A run is <root>/<kind>/<name>: a configuration in JSON with `display_name` and the list `datasets`, and for each data set a folder of
epoch tables, <root>/<kind>/<name>/<dataset>. All files are read at once, by pattern, and put together by their paths.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans import report
from ledgerloom.sources.artifacts import hadoop

CONFIG = "display_name string, datasets array<string>"
# The names of a run's prediction files, in order of preference; {} is the split.
PREDICTION_FILES = ("{}_avg_predictions.npz", "{}_predictions.npz", "{}_blend_predictions.npz")


def part_of_path(root: str, place: int, path: str = "_metadata.file_path") -> Column:
    """A part of the file's path below root, counted from 0."""
    plain = F.url_decode(F.replace(F.col(path), F.lit("+"), F.lit("%2B")))  # paths are encoded as in a URI
    below = F.substr(plain, F.locate(f"{root.rstrip('/').split('://')[-1].removeprefix('file:')}/", plain) + len(root.rstrip("/").split("://")[-1].removeprefix("file:")) + 1)
    return F.element_at(F.split(below, "/+"), place + 1)


def configs(spark: SparkSession, root: str, pattern: str = "config.json") -> DataFrame:
    """(kind, name, display_name, datasets) of all configurations."""
    raw = spark.read.schema(CONFIG).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(root)
    return raw.select(part_of_path(root, 0).alias("kind"), part_of_path(root, 1).alias("name"), "display_name", "datasets")


def epochs(spark: SparkSession, root: str, pattern: str = "epoch_metrics.csv") -> DataFrame:
    """(kind, name, dataset, epoch, val_auc) of all epoch tables; rows without an epoch or a value are left out.

    Each file's own header says which columns these are (Spark's reader takes the order of one file for all), so lines are cut
    by commas: the tables hold numbers. A file's header is the line that names `epoch`.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    cells = F.transform(F.split(F.regexp_replace("value", "^\ufeff|\r$", ""), ","), lambda x: F.trim(x))
    lines = raw.select(F.col("_metadata.file_path").alias("path"), cells.alias("cells")).withColumn("heads", F.array_contains("cells", "epoch"))
    heads = lines.filter("heads").groupBy("path").agg(F.min("cells").alias("names"))
    both = lines.filter("not heads").join(heads, "path")
    number = lambda c: F.expr(f"try_cast(try_element_at(cells, nullif(cast(array_position(names, '{c}') AS int), 0)) AS double)")
    rows = both.select(*[part_of_path(root, i, "path").alias(c) for i, c in enumerate(("kind", "name", "dataset"))], F.floor(number("epoch")).cast("int").alias("epoch"), number("val_auc").alias("val_auc"))
    return rows.filter(F.col("epoch").isNotNull() & F.col("val_auc").isNotNull())


def recovered(spark: SparkSession, root: str, *, config_files: str = "config.json", epoch_files: str = "epoch_metrics.csv") -> DataFrame:
    """(kind, name, display_name, dataset, best_epoch, val_auc, last_epoch) of each configured run and data set; null where it has no epochs."""
    asked = configs(spark, root, config_files).select("kind", "name", "display_name", F.explode("datasets").alias("dataset"))
    found = epochs(spark, root, epoch_files).withColumn("method", F.struct("kind", "name"))
    best = report.best_epoch(found.select("method", "dataset", "epoch", "val_auc"), "val_auc").select("method.kind", "method.name", "dataset", "best_epoch", "val_auc", "last_epoch")
    return asked.join(best, ["kind", "name", "dataset"], "left").select("kind", "name", "display_name", "dataset", "best_epoch", "val_auc", "last_epoch")


def predictions_of(spark: SparkSession, run: str, split: str) -> str:
    """The first of a run's prediction files that is there; an error if none is."""
    names = [n.format(split) for n in PREDICTION_FILES]
    for name in names:
        fs, at = hadoop(spark, f"{run}/{name}")
        if fs.exists(at):
            return f"{run}/{name}"
    raise FileNotFoundError(f"{run} has none of {names}")


def summary(rows: DataFrame, datasets: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """Recovered runs that have epochs, in the order of a report."""
    return report.ordered_runs(rows.filter(F.col("best_epoch").isNotNull()), datasets, kinds)
