"""Reading and writing the graph's files: Parquet phases, delimited tables, JSON and predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.contract import GraphFrame, GraphSchema, validate

PREDICTION_NAMES = {"node_id": ("node_ids", "node_id", "ids"), "y_true": ("y_true", "labels", "y"), "probability": ("probability", "probabilities", "prob", "score")}


def wide_schema(width: int) -> T.StructType:
    """A headerless feature table: an id, a step, then `width` - 2 floats."""
    rest = [T.StructField(f"f{i}", T.FloatType()) for i in range(width - 2)]
    return T.StructType([T.StructField("key", T.LongType()), T.StructField("step", T.ShortType()), *rest])


def read_headerless(spark: SparkSession, path: str) -> DataFrame:
    """A wide table without header; its width is that of the first line."""
    line = spark.read.text(path).first()
    if line is None:
        raise ValueError(f"{path} is empty")
    return spark.read.schema(wide_schema(len(line[0].split(",")))).csv(path)


def read_table(spark: SparkSession, path: str, columns: Mapping[str, str]) -> DataFrame:
    """A table with header: the wanted columns with their types, others left out."""
    raw = spark.read.option("header", True).csv(path)
    if absent := [c for c in columns if c not in raw.columns]:
        raise ValueError(f"{path} lacks {absent}")
    return raw.select(*[F.expr(f"try_cast(`{c}` AS {kind})").alias(c) for c, kind in columns.items()])


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """An uploaded table, all text, with header; an empty one is refused."""
    if not path.lower().endswith(".csv"):
        raise ValueError("only .csv files can be uploaded")
    raw = spark.read.option("header", True).csv(path)
    if raw.isEmpty():
        raise ValueError(f"{path} has no rows")
    return raw


def write_phase(g: GraphFrame, path: str, train: DataFrame | None = None, test: DataFrame | None = None) -> None:
    """Validate a graph, then write its tables below path; edges are sorted by source inside files."""
    validate(g, train, test)
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.sortWithinPartitions("src", "day").write.mode("overwrite").parquet(f"{path}/edges")
    for name, ids in (("train", train), ("test", test)):
        if ids is not None:
            ids.write.mode("overwrite").parquet(f"{path}/{name}")


def read_phase(spark: SparkSession, path: str, schema: GraphSchema) -> GraphFrame:
    """A written graph; only the columns that a plan uses are read."""
    return GraphFrame(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"), schema)


def write_feature_groups(groups: Mapping[str, DataFrame], path: str, only: Sequence[str] | None = None) -> DataFrame:
    """Each group of features as Parquet of its own, or only the named ones; (group, ordinal, name) of the written columns."""
    rows = []
    for name, df in groups.items():
        if only is None or name in only:
            df.write.mode("overwrite").parquet(f"{path}/{name}")
            rows += [(name, i, c) for i, c in enumerate(c for c in df.columns if c != "node_id")]
    spark = next(iter(groups.values())).sparkSession
    return spark.createDataFrame(rows, "`group` string, ordinal int, name string")


def read_feature_groups(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """The groups' columns side by side, joined by node_id; a column of an earlier group comes first."""
    out = None
    for name in dict.fromkeys(names):
        df = spark.read.parquet(f"{path}/{name}")
        out = df if out is None else out.join(df.select("node_id", *[c for c in df.columns if c not in out.columns]), "node_id")
    if out is None:
        raise ValueError("no groups are named")
    return out


def read_predictions(df: DataFrame) -> DataFrame:
    """(node_id, y_true, probability) from a table that may name them otherwise."""
    columns = []
    for name, candidates in PREDICTION_NAMES.items():
        hit = next((c for c in candidates if c in df.columns), None)
        if hit is None and name != "y_true":
            raise ValueError(f"no column for {name}")
        columns.append((F.col(hit) if hit else F.lit(None)).cast({"node_id": "long", "y_true": "int", "probability": "double"}[name]).alias(name))
    return df.select(*columns)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_table(df: DataFrame, path: str) -> None:
    """Delimited text with a header in every part; a report of few rows is one part."""
    df.write.mode("overwrite").option("header", True).csv(path)
