"""A timeline of events of tasks, to which batches are appended once, and resets that void what came before.

Rows are (dataset, task_type, task, at, reset boolean, ...). The log is append-only: batch n is written whole below its number,
so a batch that is run again replaces itself. A reset is a row of its own; it voids all events of its data set
and task type that stand before it, by batch, then by `at`. Events of other types and data sets stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("dataset", "task_type")


def appender(path: str) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls: the batch's rows, in the log under its number."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number:08d}")

    return run


def log(spark: SparkSession, path: str) -> DataFrame:
    """All rows that were appended, with their batch."""
    return spark.read.option("basePath", path).parquet(path)


def current(rows: DataFrame) -> DataFrame:
    """The events of a log that no later reset voids; without the resets. Null keys are keys.

    The last reset of a data set and task type is a row of an aggregate, so a task type that holds most rows is no hot task.
    """
    safe = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"_{c}") for c in KEYS] + [F.col(c).isNull().alias(f"_no_{c}") for c in KEYS]
    names = [f"_{c}" for c in KEYS] + [f"_no_{c}" for c in KEYS]
    keyed = rows.select("*", *safe)
    last = keyed.filter("reset").groupBy(*names).agg(F.max(F.struct("batch", "at")).alias("_last"))
    place = F.struct("batch", "at")
    return keyed.filter(~F.col("reset")).join(last, names, "left").filter(F.col("_last").isNull() | (place > F.col("_last"))).select(*rows.columns)


def follow(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Append what a stream has to give; the log then."""
    stream.writeStream.foreachBatch(appender(path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return log(stream.sparkSession, path)
