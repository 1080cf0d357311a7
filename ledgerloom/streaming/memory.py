"""Memories of unit vectors by time bucket and class, moved by each batch of a stream, and rows held against them.

A memory is a table, a row for each (bucket, class); bucket GLOBAL holds what all buckets have in common. A batch's rows
are first summed up to their centers by Spark, so a bucket that holds most rows is no hot task, and only the
centers, a row for each bucket and class, are joined to the memory. Batch n reads version n - 1 and writes
version n whole: a batch that is run again gives the same version. Older versions are evicted.

Vectors are of one length. A vector of zeros has no direction and stays zero. Rows without a bucket, class or vector take no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.artifacts import hadoop

GLOBAL = -1
SCHEMA = "bucket int, label int, v array<double>, n long"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def held(value: Column, of: Callable[[Column], Column]) -> Column:
    """What `of` makes of a value that is computed once for a row, not for each element that it is used for."""
    return F.transform(F.array(value), of)[0]


def unit(v: Column) -> Column:
    """v at length one."""
    return held(F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)), lambda length: F.transform(v, lambda x: x / length))


def blend(parts: list[tuple[Column, Column]]) -> Column:
    """The sum of weighted vectors at length one; a null weight or vector leaves a part out; null if none is left."""
    held = F.filter(F.array(*[F.struct(w.cast("double").alias("w"), v.alias("v")) for w, v in parts]), lambda p: p["w"].isNotNull() & p["v"].isNotNull())
    total = F.aggregate(held, F.transform(held[0]["v"], lambda x: x * 0.0), lambda s, p: F.zip_with(s, p["v"], lambda x, y: x + y * p["w"]))
    return F.when(F.size(held) > 0, unit(total))


def centers(rows: DataFrame) -> DataFrame:
    """(bucket, label, center, m): the unit mean of the unit vectors of rows (bucket, label, v), and how many; of each bucket, and of all."""
    whole = rows.filter(F.col("bucket").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull())
    # `vector` is a vector of Spark's own, whose means are combined before the shuffle.
    both = whole.select(F.explode(F.array(F.col("bucket").cast("int"), F.lit(GLOBAL))).alias("bucket"), F.col("label").cast("int").alias("label"), array_to_vector(unit(F.col("v"))).alias("vector"))
    means = both.groupBy("bucket", "label").agg(Summarizer.mean(F.col("vector")).alias("mean"), F.count(F.lit(1)).alias("m"))
    return means.select("bucket", "label", unit(vector_to_array("mean")).alias("center"), "m")


def moved(memory: DataFrame, fresh: DataFrame, momentum: float) -> DataFrame:
    """The memory after a batch: the first center as it is, then the unit of momentum x memory + (1 - momentum) x center."""
    m = min(max(momentum, 0.0), 0.999)
    both = memory.join(fresh, ["bucket", "label"], "full_outer")
    v = F.when(F.col("v").isNull(), F.col("center")).when(F.col("center").isNull(), F.col("v")).otherwise(blend([(F.lit(m), F.col("v")), (F.lit(1 - m), F.col("center"))]))
    return both.select("bucket", "label", v.alias("v"), (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).cast("long").alias("n"))


def anchors(memory: DataFrame, neighbor_blend: float, global_blend: float) -> DataFrame:
    """(bucket, label, anchor, shift) of each bucket of a memory.

    anchor: the bucket's own, its neighbours' and the common memory, blended; shift: the unit of the way from the bucket's memory to
    the reference that neighbours and the common memory make; null where there is neither.
    """
    own = memory.filter(F.col("bucket") != GLOBAL)
    beside = lambda d, name: own.select((F.col("bucket") - d).alias("bucket"), "label", F.col("v").alias(name))
    common = memory.filter(F.col("bucket") == GLOBAL).select("label", F.col("v").alias("common"))
    rows = own.join(beside(-1, "before"), ["bucket", "label"], "left").join(beside(1, "after"), ["bucket", "label"], "left").join(common, "label", "left")
    rows = rows.withColumn("near", blend([(F.lit(1.0), F.col("before")), (F.lit(1.0), F.col("after"))]))
    rest = min(max(1.0 - neighbor_blend - global_blend, 0.0), 1.0)
    part = lambda w, always: F.lit(w if w > 0 else (1.0 if always else None))
    anchor = blend([(part(rest, True), F.col("v")), (part(neighbor_blend, False), F.col("near")), (part(global_blend, False), F.col("common"))])
    reference = blend([(part(neighbor_blend, True), F.col("near")), (part(global_blend, True), F.col("common"))])
    rows = rows.select("bucket", "label", "v", anchor.alias("anchor"), reference.alias("reference"))
    way = F.zip_with("reference", "v", lambda r, x: r - x)
    long = F.greatest(F.sqrt(dot(way, way)), F.lit(1e-6))
    return rows.select("bucket", "label", "anchor", F.transform(way, lambda x: x / long).alias("shift"))


def shifted(rows: DataFrame, memory: DataFrame, label: int, strength: float, neighbor_blend: float, global_blend: float) -> DataFrame:
    """rows (bucket, v, ...) with `shifted`: v moved by `strength` along its bucket's shift of a class; as it is where there is none."""
    by_bucket = anchors(memory, neighbor_blend, global_blend).filter(F.col("label") == label).select("bucket", "shift")
    s = min(max(strength, 0.0), 10.0)
    return rows.join(by_bucket, "bucket", "left").withColumn("shifted", F.coalesce(F.zip_with("v", "shift", lambda x, y: x + y * s), F.col("v"))).drop("shift")


def losses(fresh: DataFrame, memory: DataFrame, neighbor_blend: float, global_blend: float) -> DataFrame:
    """(bucket, label, m, loss): how far a batch's centers lie from the anchors before the batch, 1 - cosine; the mean by m is the batch's loss."""
    found = fresh.filter(F.col("bucket") != GLOBAL).join(anchors(memory, neighbor_blend, global_blend), ["bucket", "label"])
    return found.filter(F.col("anchor").isNotNull()).select("bucket", "label", "m", (F.lit(1.0) - dot(F.col("center"), F.col("anchor"))).alias("loss"))


def classified(rows: DataFrame, memory: DataFrame) -> DataFrame:
    """rows (bucket, v, ...) with label_pred and cosine: the class of the nearest memory of the row's bucket, or of all where it has none; ties to the smaller class.

    rows may be a stream; the memory, a row for each bucket and class, is joined as a table.
    """
    lists = memory.groupBy("bucket").agg(F.collect_list(F.struct("label", "v")).alias("_memories"))
    common = lists.filter(F.col("bucket") == GLOBAL).select(F.lit(1).alias("_one"), F.col("_memories").alias("_common"))
    joined = rows.join(lists.filter(F.col("bucket") != GLOBAL), "bucket", "left").withColumn("_one", F.lit(1)).join(common, "_one", "left")
    near = lambda u: F.transform(F.coalesce("_memories", "_common"), lambda p: F.struct(dot(u, p["v"]).alias("cosine"), (-p["label"]).alias("label")))
    best = joined.select(*[F.col(c) for c in rows.columns], held(unit(F.col("v")), lambda u: F.array_max(near(u))).alias("_best"))
    return best.select(*[F.col(c) for c in rows.columns], (-F.col("_best.label")).alias("label_pred"), F.col("_best.cosine").alias("cosine"))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The whole versions of a memory, in order."""
    fs, at = hadoop(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and fs.exists(hadoop(spark, f"{path}/{n}/_SUCCESS")[1]))


def version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """A version of a memory, or its last; empty before the first."""
    have = versions(spark, path)
    wanted = (have[-1] if have else None) if number is None else number if number in have else None
    return spark.createDataFrame([], SCHEMA) if wanted is None else spark.read.schema(SCHEMA).parquet(f"{path}/version={wanted}")


def keeper(path: str, momentum: float, keep: int = 2, also: Callable[[DataFrame, DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """What foreachBatch calls with a batch (bucket, label, v) and its number. keep: versions that stay, two at least, so that the last batch can be run again.

    also: is given the batch's centers, the memory before it, and its number.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before, fresh = version(spark, path, number - 1), centers(batch).persist()
        try:
            if also is not None:
                also(fresh, before, number)
            moved(before, fresh, momentum).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={number}")
        finally:
            fresh.unpersist()
        for old in versions(spark, path):
            if old <= number - max(keep, 2):
                fs, at = hadoop(spark, f"{path}/version={old}")
                fs.delete(at, True)

    return run


def follow(stream: DataFrame, path: str, checkpoint: str, momentum: float, keep: int = 2, also: Callable[[DataFrame, DataFrame, int], None] | None = None) -> DataFrame:
    """Read what a stream (bucket, label, v) has to give, batch by batch; the memory then."""
    stream.writeStream.foreachBatch(keeper(path, momentum, keep, also)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return version(stream.sparkSession, path)
