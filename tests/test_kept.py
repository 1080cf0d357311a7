"""Kept artifacts, groups, runs in folders and JSON in text, in the cases that the queries don't reach."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.contract import GraphFrame, GraphSchema
from ledgerloom.functions import texts
from ledgerloom.plans import demo
from ledgerloom.sources import artifacts, files, runs


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_an_artifact_is_made_when_something_changed(spark, tmp_path):
    source, path, made = str(tmp_path / "in"), str(tmp_path / "kept"), []
    spark.range(5).write.parquet(source)

    def get(version="1", n=5, inputs=(source,)):
        df, new = artifacts.kept(spark, path, lambda: made.append(1) or spark.read.parquet(source).filter(F.col("id") < n), version=version, params={"n": n}, inputs=list(inputs))
        return ids(df), new

    assert get() == ([0, 1, 2, 3, 4], True) and get() == ([0, 1, 2, 3, 4], False)
    assert get(n=2) == ([0, 1], True) and get(n=2) == ([0, 1], False) and get(version="2", n=2)[1]
    time.sleep(0.01)
    spark.range(1, 3).write.mode("append").parquet(source)
    assert get(version="2", n=2) == ([0, 1, 1], True) and len(made) == 4
    assert len([x for x in os.listdir(path) if x.startswith("data-")]) == 1
    with pytest.raises(FileNotFoundError):
        get(inputs=[str(tmp_path / "absent")])


def test_half_an_artifact_is_none(spark, tmp_path):
    path = str(tmp_path / "kept")
    get = lambda build=lambda: spark.range(3): artifacts.kept(spark, path, build, version="1", params={}, inputs=[])

    def breaks():
        return spark.range(3).select(F.raise_error("stop").alias("x"))

    with pytest.raises(Exception, match="stop"):
        get(breaks)
    assert artifacts.manifest(spark, path) is None and get()[1] and not get()[1]
    data = artifacts.manifest(spark, path)["data"]
    os.remove(f"{path}/{data}/_SUCCESS")  # the data aren't whole
    assert get()[1] and not get()[1]
    with open(f"{path}/manifest.json", "w") as f:
        f.write('{"version": "1"')
    for x in os.listdir(path):
        if x.endswith(".crc"):
            os.remove(f"{path}/{x}")
    assert get()[1] and not get()[1]
    with pytest.raises(Exception, match="stop"):  # a failed rebuild leaves what was there
        artifacts.kept(spark, path, breaks, version="2", params={}, inputs=[])
    assert not get()[1]


def test_other_groups_stay_as_they_are(spark, tmp_path):
    path = str(tmp_path / "groups")
    one = spark.range(4).select(F.col("id").alias("node_id"), (F.col("id") * 2).alias("a"), F.lit(1).alias("b"))
    artifacts.write_groups({"core": one, "neighbor": one.select("node_id", F.col("a").alias("n"))}, path)
    before = {f: t for f, _, t in artifacts.files_of(spark, path)}
    artifacts.write_groups({"core": one.select("node_id", F.lit(9).alias("c"))}, path)
    after = {f: t for f, _, t in artifacts.files_of(spark, path)}
    same = lambda x, name: {f: t for f, t in x.items() if f"group={name}/" in f}
    assert same(before, "neighbor") == same(after, "neighbor") and not set(same(before, "core")) & set(same(after, "core"))
    assert artifacts.read_group(spark, path, "core").columns == ["node_id", "c"]
    assert artifacts.read_group(spark, path, "neighbor").agg(F.sum("n")).first()[0] == 12.0
    with pytest.raises(ValueError):
        artifacts.read_group(spark, path, "absent")
    artifacts.write_groups({}, path)
    assert {f: t for f, _, t in artifacts.files_of(spark, path)} == after


def test_runs_are_recovered(spark, tmp_path):
    """Columns in any order, blank cells, more columns, names with spaces; a data set without a table."""
    root = tmp_path / "a b/experiments"
    for kind, name, datasets, tables in (
        ("ablation", "without x", ["d1", "d2"], {"d1": "epoch,val_auc,more\n1,0.5,\n2, 0.75,1\n3,0.75,1\n,0.9,1\n4,,1\n"}),
        ("comparison", "plain", ["d1"], {"d1": "val_auc,epoch\n0.25,1.0\n0.125,2.0\n"}),
    ):
        top = root / kind / name
        top.mkdir(parents=True)
        (top / "config.json").write_text(json.dumps({"display_name": name.title(), "datasets": datasets, "other": {}}, indent=1))
        for d, text in tables.items():
            (top / d).mkdir()
            (top / d / "epoch_metrics.csv").write_text(text)
    found = runs.configs(spark, str(root))
    assert sorted((r["kind"], r["name"]) for r in found.collect()) == [("ablation", "without x"), ("comparison", "plain")]
    got = sorted((r["name"], r["dataset"], r["best_epoch"], r["val_auc"], r["last_epoch"]) for r in runs.recovered(spark, str(root)).filter("best_epoch is not null").collect())
    assert got == [("plain", "d1", 1, 0.25, 2), ("without x", "d1", 2, 0.75, 3)]
    missing = runs.recovered(spark, str(root)).filter("best_epoch is null").first()
    assert (missing["name"], missing["dataset"], missing["display_name"]) == ("without x", "d2", "Without X")
    told = runs.summary(runs.recovered(spark, str(root)), ["d1"], ["comparison", "ablation"]).select("kind").collect()
    assert [r["kind"] for r in told] == ["comparison", "ablation"]


def test_the_first_prediction_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        runs.predictions_of(spark, str(tmp_path), "val")
    for name in ("val_blend_predictions.npz", "val_predictions.npz", "val_avg_predictions.npz"):
        (tmp_path / name).write_bytes(b"")
        assert runs.predictions_of(spark, str(tmp_path), "val").endswith(name)


def test_objects_in_text(spark):
    cases = [
        ('{"a": 1}', '{"a": 1}'),
        ('say {"a": "}{\\"", "b": {"c": [{}]}} and {"d": 2}', '{"a": "}{\\"", "b": {"c": [{}]}}'),
        ('{"a": "\\\\"} }', '{"a": "\\\\"}'),
        ('{"a": {"b": 1}', None),
        ("no object", None),
        ("}{", None),
        ("", None),
        (None, None),
        ("{}", "{}"),
        ("x" * 50_000 + '{"a": "' + "y" * 50_000 + '"}', '{"a": "' + "y" * 50_000 + '"}'),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(texts.balanced_object(F.col("t"))).collect()] == [w for _, w in cases]


def test_fields_are_null_safe(spark):
    df = spark.createDataFrame([('{"a": 1.5, "b": null, "c": "NaN", "d": {"e": [1, "x"]}}',), ("{broken: }",), ("[1]",), (None,)], "t string")
    v = texts.parsed(F.col("t"))
    got = df.select(texts.field(v, "$.a", "double"), texts.field(v, "$.b", "string"), texts.field(v, "$.c", "double"), texts.field(v, "$.d.e[1]", "string"), texts.field(v, "$.d.e[7]", "string"), texts.field(v, "$.d", "long")).collect()
    assert tuple(got[0]) == (1.5, None, None, "x", None, None) and all(set(r) == {None} for r in got[1:])


def test_keys_of_a_configuration(spark):
    text = 'name = "top"\n# name = "no"\n[a]\nname = "x"\n\n[b.c]\n  name="inner"\nurl = "u"\n'
    row = spark.createDataFrame([(text,)], "t string").select(
        texts.toml_string(F.col("t"), "name"), texts.toml_string(F.col("t"), "absent"), texts.toml_string(texts.toml_block(F.col("t"), "a"), "name"), texts.toml_string(texts.toml_block(F.col("t"), "b.c"), "url"), texts.toml_block(F.col("t"), "bxc")
    ).first()
    assert tuple(row) == ("top", None, "x", "u", None)


def test_maps_with_defaults(spark):
    row = spark.sql("SELECT map('a', '1') AS m, CAST(NULL AS map<string,string>) AS n").select(texts.with_defaults(F.col("m"), {"a": F.lit("x"), "b": F.lit(2)}), texts.updated(F.col("m"), {"a": F.lit("x")}), texts.with_defaults(F.col("n"), {"a": F.lit(None)})).first()
    assert tuple(row) == ({"a": "1", "b": "2"}, {"a": "x"}, {"a": None})


def test_headerless_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text("1,3,0.5,2\n2,4,,1e3\n")
    assert [tuple(r) for r in files.read_headerless(spark, str(tmp_path / "t.csv")).orderBy("key").collect()] == [(1, 3, 0.5, 2.0), (2, 4, None, 1000.0)]
    (tmp_path / "none.csv").write_text("")
    with pytest.raises(ValueError):
        files.read_headerless(spark, str(tmp_path / "none.csv"))


def test_invented_people_do_not_depend_on_partitions(spark):
    features = spark.range(500).select(F.col("id").alias("node_id"), *[(F.col("id") * i).cast("double").alias(f"f{i}") for i in range(14)]).withColumn("f1", F.when(F.col("node_id") == 3, float("nan")).otherwise(F.col("f1")))
    told = []
    for parts in (1, 13):
        for chosen in (spark.range(400).repartition(parts), spark.range(0, 400, 1, parts).union(spark.range(5))):
            rows = demo.people(features.repartition(parts), chosen.withColumnRenamed("id", "node_id"), limit=100).collect()
            told.append(sorted((r["node_id"], r["display_name"], r["id_number"], r["phone"], r["region"], r["occupation"]) for r in rows))
            assert all(len(r["features"]) == 12 and (r["features"]["core_feature_01"] is None) == (r["node_id"] == 3) for r in rows)
    assert told[0] == told[1] == told[2] == told[3] and [t[0] for t in told[0]] == list(range(100))
    for _, name, number, phone, region, work in told[0]:
        assert name[0] in demo.FAMILY_NAMES and name[1:] in demo.GIVEN_NAMES and region in demo.REGIONS and work in demo.OCCUPATIONS
        assert len(number) == 18 and number[:6] in demo.AREAS and 1970 <= int(number[6:10]) <= 2004 and 1 <= int(number[10:12]) <= 12 and 1 <= int(number[12:14]) <= 28
        assert len(phone) == 11 and phone[0] == "1" and phone[1] in demo.PHONES
    assert len({t[2] for t in told[0]}) == 100


def test_relations_of_a_demonstration(spark):
    edges = [(1, 2, 1, 5), (2, 3, 2, 4), (1, 9, 1, 1), (2, 1, 1, 6)]
    g = GraphFrame(spark.createDataFrame([(i, 0.0, 0) for i in range(10)], "node_id long, x0 double, y int"), spark.createDataFrame(edges, "src long, dst long, edge_type int, day int"), GraphSchema(raw=1, types=2))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "node_id long")
    assert sorted(tuple(r) for r in demo.relations(g, ids(1, 2, 3)).collect()) == [(1, 2, "rel_1", 5), (2, 1, "rel_1", 6), (2, 3, "rel_2", 4)]
    assert [tuple(r) for r in demo.relations(g, ids(1, 2, 3), limit=2).collect()] == [(1, 2, "rel_1", 5), (2, 3, "rel_2", 4)]
    assert sorted(tuple(r) for r in demo.relations(g, ids(4, 6, 8)).collect()) == [(4, 6, "sequence", None), (6, 8, "sequence", None)]
