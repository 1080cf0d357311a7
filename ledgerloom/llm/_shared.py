"""Small helpers that several corpus operators use."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The words of every word-based operator: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Files of a kept table of narrow rows.
LEAST_FILES, ROWS_A_FILE = 8, 50_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where that is unset and Spark runs in one process (tests), a temporary folder takes its
    place, and it is set as the checkpoint folder too; on a cluster it would be lost, so an error is raised.
    """
    sc = spark.sparkContext
    known = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = sc.getCheckpointDir()
    if known:
        if held is None:
            sc.setCheckpointDir(known)
        return known.rstrip("/")
    if held is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        made = tempfile.mkdtemp(prefix="ledgerloom-checkpoints-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        sc.setCheckpointDir(f"file://{made}")
        held = sc.getCheckpointDir()
    return held.rstrip("/")


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs no rerun.

    rows: about how many narrow rows it has at most, if that is known: then it is kept in few files, not one for
    each shuffle partition.
    """
    shared_dir(df.sparkSession)
    return (df if rows is None else df.coalesce(max(LEAST_FILES, -(-rows // ROWS_A_FILE)))).checkpoint()


def written(df: DataFrame, name: str, rows: int | None = None) -> tuple[DataFrame, str]:
    """(df, computed once and kept as a table in the shared folder, the table's path).

    As durable, but the plan that reads it knows nothing of the one that made it. A checkpoint keeps its plan's estimated
    size and constraints; in loops with joins both grow with each round (an estimate is a product of sizes) until planning takes longer than the work.
    """
    path = shared_path(df.sparkSession, name)
    (df if rows is None else df.coalesce(max(LEAST_FILES, -(-rows // ROWS_A_FILE)))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def short_batches(spark: SparkSession, most: str = "4m") -> None:
    """Have whole texts sent to Python in Arrow batches of `most` bytes or little more, where the session doesn't say otherwise.

    Spark's default, which is by rows first, makes batches that a worker holds several times.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, most)


def small(df: DataFrame, rows: int, most: int = 200_000) -> DataFrame:
    """df with a broadcast hint if its counted rows are few; else unhinted, for a shuffled join."""
    return F.broadcast(df) if rows <= most else df


def order_key(seed: int, *columns: Column) -> Column:
    """A seeded 60-bit position for a row (the first 15 hex digits of an MD5; nulls are left out)."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in columns]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def row_key(*columns: str) -> list[Column]:
    """_k0 and _k1, 128 bits that tell rows by these columns; nulls are values. Rows alike in all of them share a key."""
    told = [x for c in columns for x in (F.col(c), F.col(c).isNull())]
    return [F.xxhash64(F.lit(i), *told).alias(f"_k{i}") for i in range(2)]


def one_of_each(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row of docs for each key of wanted (_k0, _k1, _n, ...; kept), with its other columns.

    docs has _k0 and _k1. _n: the rows of docs with this key. Only keys with several are made distinct, so a table
    without repeated rows is joined alone.
    """
    keys = ["_k0", "_k1"]
    single = docs.join(wanted.filter("_n = 1"), keys).drop("_n")
    repeated = wanted.filter("_n > 1")
    n = repeated.count()
    if not n:
        return single
    return single.unionByName(docs.join(small(repeated, n), keys).drop("_n").dropDuplicates(keys))


def bucket_bits(rows: int, per_bucket: int = 1024) -> int:
    """How many leading bits of a 60-bit key split rows into buckets of about per_bucket."""
    return min(40, max(0, math.ceil(math.log2(max(1, rows / per_bucket)))))


def running_start(df: DataFrame, group: list[str], key: str, size: str, bits: int, ties: list[str], into: str) -> DataFrame:
    """Add `into`: the sum of `size` over the rows before this one in its group, in order of `key`, then `ties`.

    A group of any size is cut into 2**bits buckets by the leading bits of its key: sums run
    inside a bucket, and the buckets' totals, a small table, are summed over a group. No task
    holds a whole group. Rows of a group are null-safe: a null is a group value of its own.
    """
    cut = df.withColumn("_bucket", F.shiftright(F.col(key), 60 - bits))
    # Null-safe keys: an equi-join on (value or default, is null).
    safe = [x for c in group for x in (F.coalesce(F.col(c).cast("string"), F.lit("")), F.col(c).isNull())]
    cut = cut.select("*", *[x.alias(f"_g{i}") for i, x in enumerate(safe)])
    keys = [f"_g{i}" for i in range(len(safe))]
    totals = cut.groupBy(*keys, "_bucket").agg(F.sum(size).alias("_total"))
    before = F.coalesce(F.sum("_total").over(Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(*keys, "_bucket", before.alias("_bucket_start"))
    inside = F.coalesce(F.sum(size).over(Window.partitionBy(*keys, "_bucket").orderBy(key, *ties).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = cut.withColumn("_inside", inside).join(starts, [*keys, "_bucket"])
    return out.withColumn(into, F.col("_bucket_start") + F.col("_inside")).drop(*keys, "_bucket", "_bucket_start", "_inside")
