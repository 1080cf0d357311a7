"""Results that are kept between runs: made once for a version, parameters and inputs, and rewritten by group.

An artifact is a folder with a manifest and the data that it names. The manifest says what the data
were made from: the version, the parameters, and path, size and time of every input file. It is read before any work:
if it says the same, the data are read; else they are made anew, below a new name, and the manifest is
put in place last, by a rename. So a run that breaks off leaves the former artifact, or none, never half of one.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, which opens whatever Spark's readers open."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def files_of(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time) of the files in and below a path, in order; hidden ones are left out. Their names alone come to the driver."""
    fs, at = hadoop(spark, path)
    if not fs.exists(at):
        raise FileNotFoundError(path)
    out, found = [], fs.listFiles(at, True)
    while found.hasNext():
        x = found.next()
        if x.getPath().getName()[:1] not in ("_", "."):
            out.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return sorted(out)


def said(spark: SparkSession, version: str, params: Mapping[str, object], inputs: Sequence[str]) -> dict:
    """What a manifest says of its data's making."""
    listed = json.dumps([files_of(spark, p) for p in inputs])
    return {"version": version, "params": json.loads(json.dumps(params, sort_keys=True, default=str)), "inputs": list(inputs), "files": hashlib.sha256(listed.encode()).hexdigest()}


def manifest(spark: SparkSession, path: str) -> dict | None:
    """The manifest of an artifact, if there is one and its data are whole."""
    fs, at = hadoop(spark, f"{path}/{MANIFEST}")
    if not fs.exists(at):
        return None
    try:
        found = json.loads(spark.read.text(f"{path}/{MANIFEST}", wholetext=True).first()[0])
        whole = fs.exists(hadoop(spark, f"{path}/{found['data']}/_SUCCESS")[1])
    except (ValueError, KeyError, TypeError):
        return None
    return found if whole else None


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, which appears whole."""
    fs, at = hadoop(spark, path)
    _, aside = hadoop(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    fs.delete(at, False)
    if not fs.rename(aside, at):
        raise OSError(f"{path} couldn't be put in place")


def kept(spark: SparkSession, path: str, build: Callable[[], DataFrame], *, version: str, params: Mapping[str, object], inputs: Sequence[str]) -> tuple[DataFrame, bool]:
    """(the artifact's rows, whether they were made now): build is called only if no whole data of this version, parameters and inputs are there."""
    now, found = said(spark, version, params, inputs), manifest(spark, path)
    if found and {k: found.get(k) for k in now} == now:
        return spark.read.parquet(f"{path}/{found['data']}"), False
    data = f"data-{uuid.uuid4().hex}"
    build().write.parquet(f"{path}/{data}")
    _put(spark, f"{path}/{MANIFEST}", json.dumps(now | {"data": data}))
    fs, top = hadoop(spark, path)
    for x in fs.listStatus(top):  # what former runs left: data that no manifest names
        name = x.getPath().getName()
        if name.startswith("data-") and name != data:
            fs.delete(x.getPath(), True)
    return spark.read.parquet(f"{path}/{data}"), True


def write_groups(groups: Mapping[str, DataFrame], path: str) -> None:
    """Feature groups (node_id, columns) as one table partitioned by group: those given are replaced, all others stay as they are, file by file.

    Columns of a group are in order of `names`; all values are doubles.
    """
    out = None
    for name, df in groups.items():
        columns = [c for c in df.columns if c != "node_id"]
        values = F.array(*[F.col(c).cast("double") for c in columns])
        one = df.select("node_id", values.alias("values"), F.array(*[F.lit(c) for c in columns]).alias("names"), F.lit(name).alias("group"))
        out = one if out is None else out.unionByName(one)
    if out is not None:
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("group").parquet(path)


def read_group(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(node_id, columns) of one group; other groups' files aren't opened."""
    rows = spark.read.parquet(path).filter(F.col("group") == name)
    first = rows.select("names").first()
    if first is None:
        raise ValueError(f"{path} has no group {name}")
    return rows.select("node_id", *[F.col("values")[i].alias(c) for i, c in enumerate(first["names"])])
