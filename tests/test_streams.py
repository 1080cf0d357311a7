"""Memories and timelines over several files against plain loops; batches that are run again; eviction."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import memory, timeline
from ledgerloom.streaming import windows as streams

VECTORS = "bucket int, label int, v array<double>"


def unit(x):
    return x / max(np.sqrt((x * x).sum()), 1e-12)


def loop(batches, momentum):
    """{(bucket, label): memory} by the plain rule, and the losses of each batch."""
    held, told = {}, []
    for batch in batches:
        fresh = {}
        for b, y, v in batch:
            if b is not None and y is not None and v is not None:
                for key in ((b, y), (-1, y)):
                    fresh.setdefault(key, []).append(unit(np.array(v)))
        fresh = {k: (unit(np.mean(v, axis=0)), len(v)) for k, v in fresh.items()}
        at = {k: 1 - c @ anchor(held, k)[0] for k, (c, _) in fresh.items() if k[0] >= 0 and k in held}
        told.append(at)
        for k, (c, _) in fresh.items():
            held[k] = c if k not in held else unit(momentum * held[k] + (1 - momentum) * c)
    return held, told


def anchor(held, key, near=0.2, common=0.3):
    """(anchor, shift) of a bucket."""
    b, y = key
    beside = [held[k] for k in ((b - 1, y), (b + 1, y)) if k in held and k[0] >= 0]
    n, g = unit(np.mean(beside, axis=0)) if beside else None, held[-1, y]
    parts = [(1 - near - common, held[key]), (common, g)] + ([(near, n)] if n is not None else [])
    reference = unit(common * g + (near * n if n is not None else 0))
    way = reference - held[key]
    return unit(sum(w * v for w, v in parts)), way / max(np.sqrt((way * way).sum()), 1e-6)


def put(spark, folder, batches, schema):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, schema).coalesce(1).write.parquet(f"{folder}/part={i}")
    return streams.raw_stream(spark, f"{folder}/*", schema)


def vectors(seed, batches=3, rows=60):
    draw = random.Random(seed)
    out = [[(draw.choice([0, 1, 2, 7]), draw.choice([0, 1]), [draw.gauss(1, 1) for _ in range(4)]) for _ in range(rows)] for _ in range(batches)]
    out[0] = [r for r in out[0] if r[0] != 2] + [(None, 1, [1.0] * 4), (1, None, [1.0] * 4), (1, 1, None)]  # a bucket that comes later
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_a_memory_over_files(spark, tmp_path, seed):
    batches, told = vectors(seed), {}
    path = str(tmp_path / "memory")

    def also(fresh, before, number):
        told[number] = {(r["bucket"], r["label"]): r["loss"] for r in memory.losses(fresh, before, 0.2, 0.3).collect()}

    stream = put(spark, str(tmp_path / "in"), batches, VECTORS)
    got = memory.follow(stream, path, str(tmp_path / "state"), 0.6, also=also)
    want, losses = loop(batches, 0.6)
    rows = {(r["bucket"], r["label"]): r for r in got.collect()}
    assert set(rows) == set(want) and all(rows[k]["v"] == pytest.approx(want[k]) for k in want)
    assert sum(r["n"] for k, r in rows.items() if k[0] >= 0) == sum(b is not None and y is not None and v is not None for batch in batches for b, y, v in batch)
    assert told[0] == {} and all(told[i] == pytest.approx(losses[i]) for i in (1, 2))
    for r in memory.anchors(got, 0.2, 0.3).collect():
        a, s = anchor(want, (r["bucket"], r["label"]))
        assert r["anchor"] == pytest.approx(a) and r["shift"] == pytest.approx(s)

    # The last batch once more gives the same version; older ones are gone.
    assert memory.versions(spark, path) == [1, 2]
    memory.keeper(path, 0.6)(spark.createDataFrame(batches[2], VECTORS), 2)
    again = {(r["bucket"], r["label"]): r["v"] for r in memory.version(spark, path).collect()}
    assert {k: pytest.approx(v) for k, v in again.items()} == {k: list(v) for k, v in want.items()}
    os.remove(f"{path}/version=2/_SUCCESS")  # half a version is none
    assert memory.versions(spark, path) == [1]


def test_shifts(spark):
    e = np.eye(3)
    held = spark.createDataFrame([(0, 0, e[0].tolist(), 1), (1, 0, e[1].tolist(), 1), (5, 0, e[2].tolist(), 1), (-1, 0, e[2].tolist(), 3)], memory.SCHEMA)
    rows = spark.createDataFrame([(1, 0, [0.0] * 3), (2, 5, [0.0] * 3), (3, 9, [4.0] * 3), (4, None, [4.0] * 3)], "id int, bucket int, v array<double>")
    got = {r["id"]: r["shifted"] for r in memory.shifted(rows, held, 0, 2.0, 0.5, 0.5).collect()}
    way = unit(0.5 * e[1] + 0.5 * e[2]) - e[0]
    assert got[1] == pytest.approx(2 * way / np.sqrt(way @ way)) and got[2] == pytest.approx([0.0] * 3, abs=1e-5) and got[3] == got[4] == [4.0] * 3
    same = memory.shifted(rows, held, 0, -1.0, 0.5, 0.5).filter("id = 1").first()["shifted"]
    assert list(same) == [0.0] * 3
    assert memory.anchors(spark.createDataFrame([], memory.SCHEMA), 0.2, 0.3).collect() == []


def test_classes_by_memory(spark, tmp_path):
    held = spark.createDataFrame([(0, 0, [1.0, 0.0], 1), (0, 1, [0.0, 1.0], 1), (-1, 3, [1.0, 0.0], 1), (-1, 2, [1.0, 0.0], 1)], memory.SCHEMA)
    rows = [(1, 0, [2.0, 1.0]), (2, 0, [1.0, 3.0]), (3, 0, [1.0, 1.0]), (4, 8, [5.0, 0.0]), (5, None, [0.0, 0.0]), (6, 0, None)]
    stream = put(spark, str(tmp_path / "in"), [rows[:3], rows[3:]], "id int, bucket int, v array<double>")
    got = {r["id"]: (r["label_pred"], r["cosine"]) for r in streams.run_to_end(memory.classified(stream, held), "append").collect()}
    assert [got[i][0] for i in range(1, 6)] == [0, 1, 0, 2, 2] and got[2][1] == pytest.approx(3 / np.sqrt(10)) and got[5][1] == 0.0
    assert got[6][1] is None


LOG = "dataset int, task_type string, task int, at int, reset boolean"


def test_a_timeline_with_resets(spark, tmp_path):
    draw = random.Random(4)
    batches = [[(draw.choice([1, 2, None]), draw.choice(["a", "b", None]), draw.randint(1, 9), draw.randint(0, 30), draw.random() < 0.1) for _ in range(80)] for _ in range(3)]
    path = str(tmp_path / "log")
    rows = timeline.follow(put(spark, str(tmp_path / "in"), batches, LOG), path, str(tmp_path / "state"))
    flat = [(n, *r) for n, batch in enumerate(batches) for r in batch]
    last = {}
    for n, d, t, _, at, reset in flat:
        if reset:
            last[d, t] = max(last.get((d, t), (-1, -1)), (n, at))
    want = sorted(((d, t, k, at, n) for n, d, t, k, at, reset in flat if not reset and (n, at) > last.get((d, t), (-1, -1))), key=str)
    told = lambda df: sorted(((r["dataset"], r["task_type"], r["task"], r["at"], r["batch"]) for r in timeline.current(df).collect()), key=str)
    assert told(rows) == want and any(reset for *_, reset in flat)
    timeline.appender(path)(spark.createDataFrame(batches[1], LOG), 1)  # a batch that is run again changes nothing
    assert told(timeline.log(spark, path)) == want and timeline.log(spark, path).count() == len(flat)


def test_rows_behind_the_watermark(spark, tmp_path):
    """What comes later than the delay allows is left out, what is within it is counted."""
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d, 12)
    batches = [[(1, day(2), 0.0), (1, day(10), 0.0)], [(1, day(20), 0.0)], [(1, day(3), 0.0), (1, day(9), 0.0), (1, day(18), 0.0)]]
    stream = put(spark, str(tmp_path / "in"), batches, "node_id long, ts timestamp, value double")
    got = {r["day"].day: r["n"] for r in streams.latest(streams.run_to_end(streams.daily_counts(stream, "3 days"), "update"), "day", "node_id").collect()}
    assert got == {2: 1, 10: 1, 20: 1, 9: 1, 18: 1}
