"""Each stage of the pipeline against a plain loop over its own input."""

import math
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline as pipeline
from ledgerloom.llm import bpe, langid, mixing
from tests.llm.test_mixing_ring import brute_mix
from tests.llm.test_texts import brute_lines
from tests.llm.test_vectors_simhash import brute_components, shingles

COLUMNS = pipeline.COLUMNS


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(name, input rows, output rows) of each stage, as run() chains them, over the smallest table."""
    sf_dir = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, before, docs.collect(), docs.columns))
    return out


def test_columns_and_run(spark, stages):
    assert [s[0] for s in stages] == ["language_id", "line_dedup", "simhash_near_dedup", "mixing", "bpe"]
    assert all(s[3] == COLUMNS for s in stages[:-1])
    whole = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r["doc_id"], r["ids"]) for r in whole) == sorted((r["doc_id"], r["ids"]) for r in stages[-1][2])


def test_language_stage(spark, stages):
    _, before, after, _ = stages[0]
    docs = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"]) for r in before], "doc_id long, text string, lang string")
    model = langid.fit(docs.filter(~langid.held_out(docs["doc_id"])))
    packers = model.packers()
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not model.predict(r["text"], packers)[2]}
    assert len(after) >= 0.9 * sum(any(c.isalpha() for c in r["text"] or "") for r in before)


def test_line_stage(stages):
    _, before, after, _ = stages[1]
    want = {d: t for d, _, t, _ in brute_lines([(r["doc_id"], r["source"], r["text"]) for r in before], 0.02, 5)}
    assert {r["doc_id"]: r["text"] for r in after} == want and all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_duplicate_stage(stages):
    """One document of each component of the links at exactly 0.8, that with the smallest id."""
    _, before, after, _ = stages[2]
    sets = {r["doc_id"]: frozenset(shingles(r["text"], 5)) for r in before}
    ids = sorted(sets)
    near = [(a, b) for a in ids for b in ids if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    assert sorted(r["doc_id"] for r in after) == sorted(set(brute_components(ids, near).values()))


def test_mixing_stage(stages):
    _, before, after, _ = stages[3]
    want = brute_mix([(r["doc_id"], r["text"], r["source"]) for r in before])
    times = Counter(r["doc_id"] for r in after)
    for d, [(size, _, _, taken, _)] in want.items():
        assert size == 0 or math.floor(taken / size) <= times[d] <= math.ceil(taken / size)
    assert set(times) <= set(want)


def test_encoding_stage(stages):
    _, before, after, _ = stages[4]
    known = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r["doc_id"]: r["text"] for r in before}
    assert len(before) == len(after)
    assert all(known.decode(r["ids"]).decode() == texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) for r in after)


def test_copies_survive_line_dedup(spark):
    """A third of all rows are one text, in every source: one of them comes through stages 2 to 4, and real boilerplate goes."""
    own = lambda i: "\n".join(["menu of the site", *[" ".join(f"w{i}x{j}x{k}" for k in range(8)) for j in range(4)]])
    hot = "\n".join(" ".join(f"hot{j}x{k}" for k in range(8)) for j in range(5))
    rows = [(i, own(i) if i % 3 else hot, "en", f"s{i % 2}", 0) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    lines = pipeline.drop_repeated_lines(spark, docs, "")
    texts = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert all(texts[i] == (own(i).split("\n", 1)[1] if i % 3 else hot) for i in range(240))
    kept = pipeline.drop_near_duplicates(spark, lines, "")
    assert [r["doc_id"] for r in kept.collect() if r["text"] == hot] == [0] and kept.count() == 161
    assert 0 in {r["doc_id"] for r in pipeline.mix_sources(spark, kept, "").collect()}


def test_null_and_repeated_ids(spark):
    """Each component keeps one row whether its id is null or repeated; the mix takes repeated rows as rows of their own."""
    text = lambda i: " ".join(f"t{i}x{k}" for k in range(40))
    ids = [None, None, 1, 1, 2, 2, 3, None, 4, None, None]
    texts = [0, 1, 2, 2, 3, 4, 5, 5, 6, 7, 7]
    rows = [(i, text(t), "en", "a" if t % 2 else None, 0) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    kept = pipeline.drop_near_duplicates(spark, docs, "").collect()
    want = [(None, 0), (None, 1), (1, 2), (2, 3), (2, 4), (3, 5), (4, 6), (None, 7)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(((d, text(t)) for d, t in want), key=str)
    taken, got = Counter(), Counter((r["doc_id"], r["text"]) for r in pipeline.mix_sources(spark, docs, "").collect())
    for r in mixing.mix(docs.withColumn("key", docs["text"]), keep=("key",)).rows.collect():
        taken[r["doc_id"], r["key"]] += r["taken"] / r["size"]
    assert len(taken) == 9 and all(math.floor(x) <= got[k] <= math.ceil(x) for k, x in taken.items()) and set(got) <= set(taken)


CLASHING = ["rejected", "score", "lang_pred", "held_out", "lines_dropped", "size", "target", "taken", "rank", "_k0", "_k1", "_n", "component_id", "ids", "n_tokens", "host", "id"]
PROSE = "the cat and the dog went over the hill to see what was there and came back in the evening when it was cold"


def odd_documents():
    """Nulls in every column, empty texts, repeated rows and a text of 200,000 words."""
    rows = [(i, f"{PROSE} {i}", "en", f"s{i % 2}", 0) for i in range(20)]
    rows += [(100, None, "en", "s0", 1), (101, "", "en", "s1", 2), (102, " \n ", None, None, None), (None, f"{PROSE} null id", None, "s0", 5), (103, f"{PROSE} no source", "en", None, 5), (104, f"{PROSE} no label", None, "s1", None)]
    return [*rows, (105, f"{PROSE} again", "en", "s0", 7), (105, f"{PROSE} again", "en", "s0", 7), (106, f"{PROSE} long " * 10_000, "en", "s1", 0), (None, None, None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    frame = spark.createDataFrame(odd_documents(), "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    return frame.select("*", *[frame["n_chars"].alias(c) for c in CLASHING])


def test_odd_rows_in_each_stage(spark, odd):
    rows = odd_documents()
    count = lambda frame: Counter((r["doc_id"], r["text"]) for r in frame.collect())
    assert all(stage(spark, odd, "").columns == COLUMNS for _, stage in pipeline.STAGES[:-1])
    assert count(pipeline.language_id(spark, odd, "")) == Counter((r[0], r[1]) for r in rows if r[1] and r[1].strip())
    lines = pipeline.drop_repeated_lines(spark, odd, "").collect()
    assert Counter((r["doc_id"], r["text"]) for r in lines) == Counter((r[0], r[1]) for r in rows) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in lines)
    kept = count(pipeline.drop_near_duplicates(spark, odd, ""))
    sets = [frozenset(shingles(r[1], 5)) for r in rows]
    near = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    groups = {}
    for i, g in brute_components(range(len(rows)), near).items():
        groups.setdefault(g, []).append(rows[i])
    assert kept == Counter(min(((r[0] is None, r[0] or 0, r[0], r[1]) for r in g), key=lambda x: x[:2])[2:] for g in groups.values())
    mixed = count(pipeline.mix_sources(spark, odd, ""))
    assert set(mixed) <= {(r[0], r[1]) for r in rows if r[1] and r[1].strip()} and (106, rows[-3][1]) in mixed
    known = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    codes = pipeline.encode(spark, odd, "").collect()
    assert Counter((r["doc_id"], known.decode(r["ids"]).decode()) for r in codes) == Counter((r[0], r[1] or "") for r in rows)


def test_empty_tables_in_each_stage(spark, odd):
    assert all(stage(spark, odd.limit(0), "").collect() == [] for _, stage in pipeline.STAGES)
