"""Archives of arrays: what is written is read, in parts, and failed writes leave nothing."""

import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.contract import GraphSchema
from ledgerloom.sources import archives


def rows(df, *by):
    return [tuple(r) for r in df.orderBy(*by or ("row",)).collect()]


def test_ranges_of_one_file(spark, tmp_path):
    """One file is cut into ranges of rows; each value stands at its row, whatever its type."""
    draw = np.random.default_rng(0)
    n = 5003
    arrays = {"x": draw.normal(size=(n, 3)).astype(">f4"), "y": draw.integers(-100, 4, (n, 1)).astype(np.int16), "flag": draw.random(n) < 0.5, "name": np.array([f"é{i}" for i in range(n)]), "big": draw.integers(0, 2**32, n).astype(np.uint32)}
    for write, parts in ((np.savez, 7), (np.savez_compressed, 4)):
        path = str(tmp_path / f"{write.__name__}.npz")
        write(path, other=np.zeros((9, 9)), **arrays)
        got = archives.read(spark, path, "x,y,flag,name,big", partitionBytes=n * (12 + 2 + 1 + 4 * 5 + 4) // 7)
        assert got.rdd.getNumPartitions() >= parts and dict(got.dtypes) == {"row": "bigint", "x": "array<float>", "y": "smallint", "flag": "boolean", "name": "string", "big": "bigint"}
        assert rows(got) == [(i, x, y, f, s, b) for i, (x, (y,), f, s, b) in enumerate(zip(*[arrays[k].tolist() for k in arrays], strict=True))]


def test_only_the_asked_arrays_are_read(spark, tmp_path):
    """Arrays that can't be read, by kind or because their bytes are damaged, are no matter to others."""
    path = str(tmp_path / "a.npz")
    np.savez(path, x=np.arange(10), odd=np.array([{}], object), z=np.full(1000, 7, np.int64), f=np.asfortranarray(np.ones((4, 2))), short=np.arange(3))
    data = bytearray(open(path, "rb").read())
    at = data.index(np.full(1000, 7, np.int64).tobytes())
    data[at + 8] = 9
    open(path, "wb").write(data)
    assert [r[1] for r in rows(archives.read(spark, path, "x"))] == list(range(10))
    for name, said in (("odd", "plain values"), ("f", "C order"), ("absent", "no array"), ("x,short", "one length")):
        with pytest.raises(Exception, match=said):
            archives.read(spark, path, name).collect()


@pytest.mark.parametrize("compressed", ["false", "true"])
def test_written_rows_are_read(spark, tmp_path, compressed):
    path = str(tmp_path / "out")
    df = spark.range(1000, numPartitions=7).select("id", (F.col("id") % 3).cast("byte").alias("b"), F.array(F.col("id") / 2, F.lit(1.0)).alias("v"), F.concat(F.lit("s"), "id").alias("s"))
    for _ in range(2):  # the second time replaces the first
        archives.write(df, path, rowsPerFile=60, compressed=compressed)
    files = archives.archives(path)
    assert len(files) == 7 * 3 and os.path.exists(f"{path}/_SUCCESS") and not os.path.exists(f"{path}/_temporary")
    assert {z.compress_type for f in files for z in zipfile.ZipFile(f).infolist()} == {zipfile.ZIP_DEFLATED if compressed == "true" else zipfile.ZIP_STORED}
    assert rows(archives.read(spark, path, "id,b,v,s").drop("row"), "id") == [(i, i % 3, [i / 2, 1.0], f"s{i}") for i in range(1000)]
    with np.load(files[0]) as one:
        assert set(one.files) == {"id", "b", "v", "s"} and one["v"].shape == (60, 2)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    good = spark.range(100, numPartitions=4).withColumn("x", F.col("id") * 2)
    archives.write(good, path)
    before = archives.archives(path)
    bad = good.withColumn("x", F.when(F.col("id") < 90, F.col("x")))  # nulls in the last partition only
    with pytest.raises(Exception, match="no nulls"):
        archives.write(bad, path)
    assert archives.archives(path) == before and not os.path.exists(f"{path}/_temporary")
    ragged = good.select(F.when(F.col("id") > 0, F.array("id")).otherwise(F.array("id", "id")).alias("v"))
    with pytest.raises(Exception, match="one length"):
        archives.write(ragged, str(tmp_path / "ragged"))
    assert archives.archives(str(tmp_path / "ragged")) == []


def test_names_of_predictions(spark, tmp_path):
    for i, names in enumerate([("node_ids", "y_true", "probability"), ("ids", "labels", "scores"), ("node_ids", "labels", "avg_probability")]):
        score = np.full((2, 1), 0.25 * (i + 1), np.float32)
        np.savez_compressed(tmp_path / f"r{i}.npz", **dict(zip(names, [np.array([i, 9], np.int32), np.array([0, 1], np.int8), score], strict=True)), more=np.zeros(5))
    assert rows(archives.read_predictions(spark, str(tmp_path)), "probability", "node_id") == [(i if j == 0 else 9, j, 0.25 * (i + 1)) for i in range(3) for j in range(2)]
    archives.write_predictions(archives.read_predictions(spark, str(tmp_path)), str(tmp_path / "again"))
    assert archives.read_predictions(spark, str(tmp_path / "again")).count() == 6
    np.savez(tmp_path / "bad.npz", node_ids=np.zeros(1))
    with pytest.raises(Exception, match="no array for"):
        archives.read_predictions(spark, str(tmp_path)).collect()


def test_locating_one_archive(tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    with pytest.raises(FileNotFoundError):
        archives.locate(str(tmp_path), "phase1.npz")
    np.savez(tmp_path / "a/b/phase1.npz", x=np.zeros(1))
    assert archives.locate(str(tmp_path), "phase1.npz") == str(tmp_path / "a/b/phase1.npz")
    np.savez(tmp_path / "a/phase1.npz", x=np.zeros(1))
    with pytest.raises(ValueError, match="several"):
        archives.locate(str(tmp_path), "phase1.npz")


def test_a_phase_in_one_archive(spark, tmp_path):
    """The seven arrays of a phase, nodes by position."""
    path = str(tmp_path / "phase1.npz")
    x, y = np.array([[1.0, -1.0], [2.0, 3.0], [4.0, 5.0]]), np.array([[0], [1], [-100]])
    np.savez_compressed(path, x=x, y=y, edge_index=np.array([[0, 1], [2, 1]]), edge_type=np.array([[1], [2]]), edge_timestamp=np.array([5, 6]), train_mask=np.array([0, 1]), test_mask=np.array([2]))
    g = archives.read_phase(spark, path, GraphSchema(raw=2, types=2))
    assert rows(g.nodes, "node_id") == [(0, 1.0, -1.0, 0), (1, 2.0, 3.0, 1), (2, 4.0, 5.0, -100)]
    assert rows(g.edges, "day") == [(0, 1, 1, 5), (2, 1, 2, 6)]
    assert rows(archives.read_ids(spark, path, "train_mask"), "node_id") == [(0,), (1,)]
    out = str(tmp_path / "out")
    archives.write_phase(g, out, archives.read_ids(spark, path, "train_mask"))
    again = archives.read_phase(spark, out, g.schema)
    assert rows(again.nodes, "node_id") == rows(g.nodes, "node_id") and rows(again.edges, "day") == rows(g.edges, "day")
    with pytest.raises(ValueError, match="contract"):
        archives.write_phase(g, out, archives.read_ids(spark, path, "test_mask"))
