"""Chat snapshots against brute force; WARC bundles by round trips."""

import random
import struct

import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from ledgerloom.llm import chat, warc

LOGS = "conv_id long, turn long, role string, text string, source string"


def brute_maximal(rows):
    talks, alone = {}, []
    for conv, turn, role, text, *_ in rows:
        entry = (turn if turn is not None else -(1 << 62), role or "unknown", text or "")
        if conv is None:
            alone.append((None, [entry]))
        else:
            talks.setdefault(conv, []).append(entry)
    whole = [(c, [(r, t) for _, r, t in sorted(x)]) for c, x in talks.items()] + [(c, [(r, t) for _, r, t in x]) for c, x in alone]
    kept = {}
    for c, x in whole:
        if any(len(y) > len(x) and y[: len(x)] == x for _, y in whole):
            continue
        kept.setdefault(tuple(x), []).append(c)
    return sorted(((min((c for c in ids if c is not None), default=None), len(x), len(ids)) for x, ids in kept.items()), key=str)


def test_maximal_conversations_match_brute_force(spark):
    draw = random.Random(1)
    rows, turns = [], [("user", "a"), ("assistant", "b"), ("user", None), (None, "c"), ("user", "")]
    for conv in range(60):
        for turn in range(draw.randint(1, 4)):
            rows.append((conv, turn, *draw.choice(turns), "s"))
    rows += [(100, t, "user", "hot", "s") for t in range(50)] + [(101, t, "user", "hot", "s") for t in range(49)]
    rows += [(None, 0, "user", "a", "s"), (None, 0, "user", "a", "s"), (None, 5, "user", "lone", "s"), (None, 6, "user", "lone", "s"), (None, None, None, None, "s"), (7, 0, "user", "a", "s"), (102, None, "user", "x", "s"), (102, None, "user", "x", "s")]
    got = chat.render(chat.maximal(spark.createDataFrame(rows, LOGS).repartition(5))).collect()
    assert sorted(((r["conv_id"], r["n_turns"], r["n_copies"]) for r in got), key=str) == brute_maximal(rows)


def test_rendered_text_and_broken_marks(spark):
    logs = spark.createDataFrame([(1, 0, "user", "<|end|> hi", "s"), (1, 1, None, None, "s")], LOGS)
    (row,) = chat.render(chat.maximal(logs)).collect()
    assert row["rendered"] == "<|turn|>user\n<\\|end|> hi<|end|>\n<|turn|>unknown\n<|end|>"


def test_no_conversations(spark):
    assert chat.render(chat.maximal(spark.createDataFrame([], LOGS))).collect() == []


PAGES = "page_id long, url string, html string, host string"
ROWS = [(5, "http://a/ b", "same", "h"), (3, None, "same", "h"), (9, "http://x", None, "h"), (4, "u", "", "h"), (1, "u", "é" * 300_000, "h"), (1, "u", "é" * 300_000, "h"), (None, "u", "lone", "h"), (8, "u", "x\r\n\r\nWARC/1.1\r\n", "h")]


@pytest.mark.parametrize("frame_bytes", [1, 1 << 18])
def test_archive_round_trip(spark, frame_bytes):
    archive = warc.write_archive(spark.createDataFrame(ROWS, PAGES), frame_bytes=frame_bytes, bundle_bytes=4096)
    got = {}
    for r in warc.read_archive(spark, archive).collect():
        got.setdefault(r["page_id"], []).append(r)
    assert sum(map(len, got.values())) == len(ROWS)
    assert [r["record_type"] for r in got[3]] == ["response"] and got[3][0]["payload"] == b"same"
    assert (got[5][0]["record_type"], got[5][0]["refers_to"], got[5][0]["payload_bytes"]) == ("revisit", 3, 4)
    assert (got[9][0]["refers_to"], got[9][0]["payload_digest"]) == (4, warc.digest(b""))
    assert [r["record_type"] for r in got[1]] == ["response"] * 2 and got[1][0]["payload"] == ("é" * 300_000).encode()
    assert got[8][0]["payload"] == b"x\r\n\r\nWARC/1.1\r\n" and got[None][0]["payload"] == b"lone"
    assert got[5][0]["url"] == "http://a/%20b" and got[3][0]["url"] is None


def test_one_record_by_its_index_row(spark):
    archive = warc.write_archive(spark.createDataFrame(ROWS, PAGES), frame_bytes=64)
    for row in archive.index.filter(F.col("record_id") == "urn:page:8").collect():
        head, block = warc.read_record(archive.folder, row["bundle"], row["frame_at"], row["frame_bytes"], row["at"], row["bytes"])
        assert head["WARC-Record-ID"] == "<urn:page:8>" and block == b"x\r\n\r\nWARC/1.1\r\n"


def test_bundle_ends_with_a_seek_table(spark):
    archive = warc.write_archive(spark.createDataFrame(ROWS[:2], PAGES), frame_bytes=1)
    store, root = fs.FileSystem.from_uri(archive.folder)
    for name in {r["bundle"] for r in archive.index.collect()}:
        with store.open_input_file(f"{root}/{name}") as file:
            bundle = file.read()
        assert struct.unpack("<I", bundle[-4:])[0] == warc.SEEKABLE
        assert sum(n for _, n, _ in warc.frames(bundle)) + 8 + 8 * len(warc.frames(bundle)) + 9 == len(bundle)


def test_smallest_payloads_that_are_linked(spark):
    archive = warc.write_archive(spark.createDataFrame(ROWS, PAGES), least_bytes=5)
    assert {r["refers_to"] for r in warc.read_archive(spark, archive).collect()} == {None}


def test_no_pages(spark):
    archive = warc.write_archive(spark.createDataFrame([], PAGES))
    assert warc.read_archive(spark, archive).collect() == []


def test_very_long_turns_and_clashing_columns(spark):
    logs = spark.createDataFrame([(1, 0, "user", "x" * 2_000_000, 1), (2, 0, "user", "x" * 2_000_000, 1), (2, 1, "user", "end", 1)], "conv_id long, turn long, role string, text string, key int")
    (row,) = chat.render(chat.maximal(logs)).collect()
    assert (row["conv_id"], row["n_turns"]) == (2, 2) and len(row["rendered"]) > 2_000_000


def test_an_index_that_names_another_record_is_an_error(spark):
    archive = warc.write_archive(spark.createDataFrame(ROWS[:2], PAGES))
    wrong = warc.Archive(archive.folder, archive.index.withColumn("record_id", F.lit("urn:page:77")))
    with pytest.raises(Exception, match="isn't where the index has it"):
        warc.read_archive(spark, wrong).collect()
