"""The library without its corpus part, and small operators that no query reaches in full."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from ledgerloom.contract import GraphFrame, GraphSchema
from ledgerloom.functions import scalar
from ledgerloom.operators import sampling
from ledgerloom.plans import metrics

ROOT = Path(__file__).resolve().parents[1]


def test_the_rest_works_without_the_corpus_part(tmp_path):
    shutil.copytree(ROOT / "ledgerloom", tmp_path / "ledgerloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert q and set(o) <= set(q) and not [n for n in q if n.startswith('op') or n == 'pipeline'], sorted(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_else_imports_the_corpus_part():
    for path in [*(ROOT / "ledgerloom").rglob("*.py"), *(ROOT / "tests").glob("*.py")]:
        if "llm" not in path.parts and path.name != Path(__file__).name:
            assert "ledgerloom.llm" not in path.read_text(), path


def test_fanout_by_score(spark):
    rows = spark.createDataFrame([(1, i, "out", 0, i, float(i % 3)) for i in range(6)] + [(1, 9, "in", 0, 1, None)], "center long, neighbor long, dir string, rel_id int, day int, s double")
    got = [(r["dir"], r["neighbor"], r["rank"]) for r in sampling.best_fanout(rows, 3, "s").orderBy("dir", "rank").collect()]
    assert got == [("in", 9, 1), ("out", 5, 1), ("out", 2, 2), ("out", 4, 3)]
    assert [r["neighbor"] for r in sampling.best_fanout(rows.filter("dir = 'out'"), 2, None).orderBy("rank").collect()] == [5, 4]


def test_a_split_that_is_not_by_time_is_refused(spark):
    """The validation nodes' median day must be later: here all nodes of both classes begin on one day."""
    nodes = spark.createDataFrame([(i, 0.0, i % 2) for i in range(20)], "node_id long, x0 double, y int")
    edges = spark.createDataFrame([(i, (i + 1) % 20, 1, 3) for i in range(20)], "src long, dst long, edge_type int, day int")
    with pytest.raises(ValueError):
        metrics.split_report(GraphFrame(nodes, edges, GraphSchema(raw=1, types=1)))


def test_names_for_users(spark):
    names = {"feature_17": scalar.NUMBERED_NAMES[1], "core_feature_3x": scalar.NUMBERED_NAMES[3], "feature_a2b7c": scalar.NUMBERED_NAMES[7], "feature_": scalar.OTHER_NAME, " Balance ": "交易金额特征", "风险count": "风险count", "x": scalar.OTHER_NAME, "ip": "账户环境特征", "": scalar.OTHER_NAME}
    df = spark.createDataFrame([(k, v) for k, v in names.items()], "k string, v string")
    assert df.filter(~scalar.shown_name("k").eqNullSafe(df["v"])).collect() == []
