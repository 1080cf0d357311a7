"""The windowed and stateful features as Structured Streaming queries.

Event streams are (node_id, ts timestamp, value double). Watermarks bound the state of windows;
what is kept for each node (first and last day, prototypes) is one small row of state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ledgerloom.sources.shared import shared_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def raw_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files as they are."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files; timestamps without a zone are read as the session's zone, which watermarks need."""
    raw = raw_stream(spark, folder, schema, files_per_batch)
    return raw.select(F.col("user_id").alias("node_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))


def daily_counts(events: DataFrame, delay: str | None = "1 day") -> DataFrame:
    """(day, node_id, n) by event day; rows later than the watermark's delay are left out.

    delay: None has no watermark and counts every row, which suits a replay of files in any order; the state is the result.
    """
    counted = (events if delay is None else events.withWatermark("ts", delay)).groupBy(F.window("ts", "1 day"), "node_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").cast("date").alias("day"), "node_id", "n")


def recent_counts(events: DataFrame, days: int, delay: str = "1 day") -> DataFrame:
    """(day, node_id, n): events of the `days` days that end with each day."""
    counted = events.withWatermark("ts", delay).groupBy(F.window("ts", f"{days} days", "1 day"), "node_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.date_sub(F.col("window.end").cast("date"), 1).alias("day"), "node_id", "n")


def first_last(events: DataFrame) -> DataFrame:
    """(node_id, first_active, last_active); the state is a row for each node."""
    return events.groupBy("node_id").agg(F.min(F.col("ts").cast("date")).alias("first_active"), F.max(F.col("ts").cast("date")).alias("last_active"))


class EarlyActivity(StatefulProcessor):
    """Counts a node's events of its first `days` days, by day, so that an earlier first day that comes late takes over."""

    def __init__(self, days: int):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("early", "first long, counts array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.state.get() if self.state.exists() else None
        on = {int(held[0]) + i: int(n) for i, n in enumerate(held[1])} if held else {}
        # Days behind the window of the first day so far are in no earlier first day's window either.
        for part in rows:
            for day, n in part["day_number"].value_counts().items():
                on[int(day)] = on.get(int(day), 0) + int(n)
            first = min(on)
            on = {day: n for day, n in on.items() if day < first + self.days}
        counts = [on.get(first + i, 0) for i in range(self.days)]
        self.state.update((first, counts))
        yield pd.DataFrame({"node_id": [key[0]], "first_day": [first], "early": [sum(counts)]})

    def close(self) -> None:
        pass


def early_activity(events: DataFrame, days: int = 7) -> DataFrame:
    """(node_id, first_day, early), a row for each node and batch in which it has events; days are numbered from 1970."""
    numbered = events.select("node_id", F.unix_date(F.col("ts").cast("date")).cast("long").alias("day_number"))
    return numbered.groupBy("node_id").transformWithStateInPandas(EarlyActivity(days), outputStructType="node_id long, first_day long, early long", outputMode="Update", timeMode="None")


class Prototype(StatefulProcessor):
    """A class's prototype: the unit mean of its first batch, then an exponential average of unit means, kept at length one."""

    def __init__(self, momentum: float):
        self.momentum = min(max(momentum, 0.0), 0.999)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("prototype", "v array<double>, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        import numpy as np

        unit = lambda x: x / max(float(np.sqrt((x * x).sum())), 1e-12)
        total, n = 0.0, 0
        for part in rows:
            for v in part["v"]:
                total, n = total + unit(np.asarray(v, float)), n + 1
        mean = unit(total / n)
        held = self.state.get() if self.state.exists() else None
        new = mean if held is None else unit(self.momentum * np.asarray(held[0]) + (1 - self.momentum) * mean)
        seen = n + (held[1] if held else 0)
        self.state.update((new.tolist(), seen))
        yield pd.DataFrame({"label": [key[0]], "n": [seen], "prototype": [new.tolist()]})

    def close(self) -> None:
        pass


class Queue(StatefulProcessor):
    """The last `size` values of a key, oldest first: a row's value joins at the end, by its order within a batch."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("queue", "v array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: list[tuple] = []
        for part in rows:
            new = sorted([*new, *zip(part["at"], part["value"], strict=True)])[-self.size :]
        held = [*(self.state.get()[0] if self.state.exists() else []), *(v for _, v in new)][-self.size :]
        self.state.update((held,))
        yield pd.DataFrame({"node_id": [key[0]], "values": [[float(v) for v in held]]})

    def close(self) -> None:
        pass


def last_values(rows: DataFrame, size: int) -> DataFrame:
    """(node_id, values) of a stream of (node_id, at, value): each key's last values in order of arrival, a row for each batch in which it has any.

    Batches follow one another; within one, rows go by `at`, then value.
    """
    return rows.groupBy("node_id").transformWithStateInPandas(Queue(size), outputStructType="node_id long, values array<double>", outputMode="Update", timeMode="None")


def prototypes(vectors: DataFrame, momentum: float = 0.9) -> DataFrame:
    """(label, n, prototype) of a stream of (label, v), a row for each class and batch."""
    return vectors.groupBy("label").transformWithStateInPandas(Prototype(momentum), outputStructType="label int, n long, prototype array<double>", outputMode="Update", timeMode="None")


def run_to_end(stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream over files gives, when it has read what is there: written as Parquet with its batch number."""
    spark = stream.sparkSession
    out, state = shared_folder(spark, "stream-rows"), shared_folder(spark, "stream-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number:08d}")

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")  # what custom state needs
    try:
        stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key by batch: what an update-mode stream stands at."""
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("_r")).select(*keys, "_r.*")
