"""Streams of several files as queries: memories by bucket, a timeline with resets, counts behind a watermark; each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import kept_queries  # noqa: F401  registered before
from ledgerloom.more_queries import add
from ledgerloom.oracles import r6
from ledgerloom.queries import register
from ledgerloom.sources import tables
from ledgerloom.sources.shared import shared_folder, stored
from ledgerloom.streaming import memory, timeline
from ledgerloom.streaming import windows as streams

MOMENTUM, NEAR, COMMON = 0.7, 0.2, 0.3


def in_files(rows: DataFrame, part: Column, parts: int) -> DataFrame:
    """A stream of rows, a batch for each part, in order."""
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, "stream-files")
    for i in range(parts):
        rows.filter(part == i).coalesce(1).write.parquet(f"{path}/part={i}")
    return streams.raw_stream(spark, f"{path}/*", rows.schema)


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.transform("embedding", lambda x: x.cast("double"))
    return tables.table(spark, sf_dir, "embeddings").select("vec_id", (F.col("label") % 5).cast("int").alias("bucket"), F.when(F.col("label") < 5, 0).otherwise(1).alias("label"), v.alias("v"))


def alignment_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The memory of class 0 and 1 by bucket after four batches, its anchors and shifts, one row for each component."""
    path = shared_folder(spark, "memory")
    stream = in_files(embedded(spark, sf_dir), F.col("vec_id") % 4, 4).select("bucket", "label", "v")
    held = memory.follow(stream, path, shared_folder(spark, "memory-state"), MOMENTUM)
    both = held.join(memory.anchors(held, NEAR, COMMON), ["bucket", "label"])
    return both.select("bucket", "label", "n", F.posexplode(F.arrays_zip("v", "anchor", "shift")).alias("i", "x")).select("bucket", "label", "n", "i", F.col("x.v").alias("v"), F.col("x.anchor").alias("anchor"), F.col("x.shift").alias("shift"))


def prototype_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector, as a stream, held against the mean directions of bucket and class; a fifth of the buckets has none of its own."""
    rows = embedded(spark, sf_dir)
    held = memory.moved(spark.createDataFrame([], memory.SCHEMA), memory.centers(rows), 0.5).filter(F.col("bucket") != 4)
    stream = memory.classified(in_files(rows.select("vec_id", "bucket", "v"), F.col("vec_id") % 2, 2), held)
    return streams.run_to_end(stream.select("vec_id", "label_pred", "cosine"), "append").drop("batch")


register("alignment_bank", alignment_bank)
register("prototype_labels", prototype_labels)
_EMBEDDED = "e AS (SELECT vec_id, (label % 5)::INTEGER AS bucket, CASE WHEN label < 5 THEN 0 ELSE 1 END AS label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS u FROM embeddings)"
_UNIT = lambda x: f"list_transform({x}, lambda x: x / greatest(sqrt(list_dot_product({x}, {x})), 1e-12))"
_SUM = lambda a, x, b, y: f"list_transform(range(1, len({x}) + 1), lambda i: {a} * {x}[i] + {b} * {y}[i])"


def _centers(part: str) -> str:
    means = f"SELECT bucket, label, {part} AS part, i, avg(u[i]) AS x, count(*) AS m FROM (SELECT vec_id, unnest([bucket, -1]) AS bucket, label, u FROM e), range(1, 65) r(i) GROUP BY ALL"
    return f"c0 AS (SELECT bucket, label, part, list(x ORDER BY i) AS c, any_value(m) AS m FROM ({means}) GROUP BY ALL), c AS (SELECT bucket, label, part, {_UNIT('c')} AS c, m FROM c0)"


def _bank() -> str:
    steps = ["v0 AS (SELECT bucket, label, c AS v, m AS n FROM c WHERE part = 0)"]
    for k in (1, 2, 3):
        blended = _SUM(MOMENTUM, "v", round(1 - MOMENTUM, 6), "c")
        steps.append(f"w{k} AS (SELECT coalesce(v.bucket, d.bucket) AS bucket, coalesce(v.label, d.label) AS label, CASE WHEN v IS NULL THEN c WHEN c IS NULL THEN v ELSE {blended} END AS v, coalesce(n, 0) + coalesce(m, 0) AS n FROM v{k - 1} v FULL JOIN (SELECT * FROM c WHERE part = {k}) d ON d.bucket = v.bucket AND d.label = v.label)")
        steps.append(f"v{k} AS (SELECT bucket, label, {_UNIT('v')} AS v, n FROM w{k})")
    near0 = f"CASE WHEN a.v IS NULL THEN b.v WHEN b.v IS NULL THEN a.v ELSE {_SUM(1, 'a.v', 1, 'b.v')} END"
    steps.append(f"t0 AS (SELECT o.bucket, o.label, o.v, o.n, {near0} AS near, g.v AS common FROM v3 o LEFT JOIN v3 a ON a.bucket = o.bucket - 1 AND a.bucket >= 0 AND a.label = o.label LEFT JOIN v3 b ON b.bucket = o.bucket + 1 AND b.label = o.label JOIN v3 g ON g.bucket = -1 AND g.label = o.label WHERE o.bucket >= 0)")
    steps.append(f"t1 AS (SELECT bucket, label, v, n, {_UNIT('near')} AS near, common FROM t0)")
    own, near = round(1 - NEAR - COMMON, 6), lambda a, x: f"CASE WHEN near IS NULL THEN list_transform({x}, lambda x: {a} * x) ELSE "
    steps.append(f"t2 AS (SELECT bucket, label, v, n, list_transform(range(1, 65), lambda i: {own} * v[i] + {NEAR} * coalesce(near[i], 0) + {COMMON} * common[i]) AS anchor, list_transform(range(1, 65), lambda i: {NEAR} * coalesce(near[i], 0) + {COMMON} * common[i]) AS ref FROM t1)")
    steps.append(f"t3 AS (SELECT bucket, label, v, n, {_UNIT('anchor')} AS anchor, {_UNIT('ref')} AS ref FROM t2)")
    steps.append(f"t4 AS (SELECT bucket, label, v, n, anchor, {_SUM(1, 'ref', -1, 'v')} AS way FROM t3)")
    return ", ".join(steps)


add("alignment_bank", f"WITH {_EMBEDDED}, {_centers('vec_id % 4')}, {_bank()} SELECT bucket, label, n::BIGINT AS n, (i - 1)::INTEGER AS i, {r6('v[i]', 'v')}, {r6('anchor[i]', 'anchor')}, {r6('way[i] / greatest(sqrt(list_dot_product(way, way)), 1e-6)', 'shift')} FROM t4, range(1, 65) r(i)")
add("prototype_labels", f"WITH {_EMBEDDED}, {_centers('0')}, s AS (SELECT vec_id, c.label, list_dot_product(u, c.c) AS cosine FROM e JOIN c ON c.bucket = CASE WHEN e.bucket = 4 THEN -1 ELSE e.bucket END) SELECT vec_id, label AS label_pred, {r6('cosine', 'cosine')} FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, label) = 1")


# A timeline.
def task_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events by user and type of three files in order of time; an error resets the user's clicks and views of before."""
    e = tables.table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    third = F.least(F.floor(F.col("event_id") / (e.agg(F.max("event_id")).first()[0] // 3 + 1)), F.lit(2))
    kinds = F.when(F.col("event_type") == "error", F.array(F.lit("click"), F.lit("view"))).otherwise(F.array("event_type"))
    rows = e.select("event_id", F.col("user_id").alias("dataset"), F.explode(kinds).alias("task_type"), F.col("event_id").alias("task"), F.col("event_id").alias("at"), (F.col("event_type") == "error").alias("reset"))
    path = shared_folder(spark, "timeline")
    found = timeline.follow(in_files(rows, third, 3), path, shared_folder(spark, "timeline-state"))
    timeline.appender(path)(stored(found.filter("batch = 1").drop("batch"), "again"), 1)  # a batch that is run again
    return timeline.current(timeline.log(spark, path)).select("dataset", "task_type", "task")


register("task_timeline", task_timeline)
add("task_timeline", "WITH r AS (SELECT user_id, max(event_id) AS last FROM events WHERE event_type = 'error' GROUP BY 1) SELECT e.user_id AS dataset, event_type AS task_type, event_id AS task FROM events e LEFT JOIN r ON r.user_id = e.user_id WHERE event_type <> 'error' AND (event_type NOT IN ('click', 'view') OR last IS NULL OR event_id > last)")


# A watermark that is reached.
def watermarked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts of three files: the earlier half, the later half, then a tenth of all, of which what is behind the watermark is left out.

    Spark holds a batch's rows against the watermark with which the batch before it ran: here, that of the first file.
    """
    e = tables.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    middle = e.agg(F.expr("timestamp_micros(cast((unix_micros(min(ts)) + unix_micros(max(ts))) / 2 AS long))")).first()[0]
    part = F.when(F.col("event_id") % 10 == 0, 2).when(F.col("ts") < F.lit(middle), 0).otherwise(1)
    stream = in_files(e, part, 3).select(F.col("user_id").alias("node_id"), "ts", "value")
    return streams.latest(streams.run_to_end(streams.daily_counts(stream, "3 days"), "update"), "day", "node_id")


register("stream_watermark", watermarked)
add("stream_watermark", "WITH w AS (SELECT max(ts) - INTERVAL 3 DAY AS w FROM events WHERE event_id % 10 <> 0 AND epoch_us(ts) < (SELECT floor((epoch_us(min(ts)) + epoch_us(max(ts))) / 2) FROM events)) SELECT ts::DATE AS day, user_id AS node_id, count(*)::BIGINT AS n FROM events, w WHERE event_id % 10 <> 0 OR ts::DATE + INTERVAL 1 DAY > w GROUP BY ALL")
