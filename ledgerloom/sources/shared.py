"""Where driver and executors can both write."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession

if TYPE_CHECKING:
    from ledgerloom.contract import GraphFrame


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names.

    Only where that is unset and Spark runs in one process, as in tests, a temporary folder takes its place; on a
    cluster other machines wouldn't see it, so an error is raised.
    """
    sc = spark.sparkContext
    top = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if top is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="ledgerloom-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and kept as a table in the shared folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """df, whose rows grow with the data, for joins by key: it is sorted and merged, never broadcast.

    Spark judges a table by its files, and files of counts are some fifty times smaller than the hash table that the driver would build of their rows.
    """
    return df.hint("merge")


def stored_graph(g: GraphFrame) -> GraphFrame:
    """The graph from tables written once, for what reads its edges more than once: they aren't joined from their sources again."""
    return replace(g, nodes=large(stored(g.nodes, "nodes")), edges=stored(g.edges, "edges"), facts={}, adjacency=None)
