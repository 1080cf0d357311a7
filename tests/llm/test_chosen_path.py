"""The chosen-path join against all pairs' exact similarity."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import chosen_path

DOCS = "doc_id long, text string, component_id string, n_shingles int"


def shingles(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words += [word] * bool(word)
            word = ""
        else:
            word += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2)) if len(words) >= 3 else frozenset([tuple(words)] * bool(words))


def brute(rows):
    """{doc_id: (set size, smallest doc_id reachable)}; ids are unique."""
    sets, holders, root = {d: shingles(t) for d, t in rows}, {}, {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for d, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(d)
    for d, s in sets.items():
        for e in {e for x in s for e in holders[x] if e < d}:
            if 100 * len(s & sets[e]) >= 85 * len(s | sets[e]):
                a, b = sorted((find(d), find(e)))
                root[b] = a
    return {d: (len(sets[d]), find(d)) for d in sets}


def found(spark, rows, parts=4, **more):
    got = chosen_path.near_duplicates(spark.createDataFrame([(*r, "clash", 1) for r in rows], DOCS).repartition(parts), **more).collect()
    assert len(got) == len(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}


def fresh(draw, n):
    return [f"{draw.choice('bcdfgBCD')}{draw.randint(0, 5000)}" for _ in range(n)]


def test_components_match_brute_force(spark):
    draw, rows = random.Random(8), []
    for i in range(60):
        base = fresh(draw, draw.choice([1, 2, 3, 8, 30, 200]))
        rows.append((5 * i, " ".join(base)))
        rows.append((5 * i + 1, "\t".join(base).upper()))
        changed = list(base)
        changed[draw.randrange(len(base))] = "changed"
        rows.append((5 * i + 2, " ".join(changed)))
        rows.append((5 * i + 3, " ".join(base[: len(base) * 3 // 5] + fresh(draw, 60))))  # a shared passage only
        rows.append((5 * i + 4, " ".join(fresh(draw, draw.randint(0, 3)) + base)))
    assert found(spark, rows) == brute(rows)


def test_the_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(spark, rows) == brute(rows)


def test_recall_and_precision_at_the_threshold(spark):
    """Pairs at 0.85 to 0.87, of 8 to 1,000 words: nearly all found; just below, none."""
    draw, rows, wanted = random.Random(3), [], []
    for i in range(800):
        own = (8, 13, 20, 45, 100, 300, 1000)[i % 7] - 2
        base = fresh(draw, own + 2)
        more = own * 20 // 17 - own + (i % 4 == 0)  # words in front add a shingle each
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(fresh(draw, more) + base))]
        a, b = shingles(rows[-1][1]), shingles(rows[-2][1])
        wanted.append(100 * len(a & b) >= 85 * len(a | b))
    got = found(spark, rows)
    met = [got[2 * i][1] == got[2 * i + 1][1] for i in range(800)]
    assert not any(m for m, w in zip(met, wanted, strict=True) if not w)
    assert sum(wanted) >= 500 and sum(met) >= 0.995 * sum(wanted)


@pytest.mark.parametrize("most", [(16, 2000), (1024, 1 << 20)])
def test_hot_nodes(spark, most):
    """A family of near copies, many texts with one long common passage, and chains: whole, however small leaves are."""
    draw, rows = random.Random(6), []
    base = fresh(draw, 120)
    for _ in range(150):
        text = list(base)
        text[draw.randrange(120)] = f"own{len(rows)}"
        rows.append((len(rows), " ".join(text)))
    for _ in range(120):  # alike to about 0.5, and in twos
        text = base[:80] + fresh(draw, 40)
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join([*text[:-1], "end"]))]
    chain = fresh(draw, 100)
    for _ in range(40):
        chain = chain[3:] + fresh(draw, 3)
        rows.append((len(rows), " ".join(chain)))
    assert found(spark, rows, 3, most_rows=most[0], most_shingles=most[1]) == brute(rows)


def test_a_common_passage_branches(spark):
    """Texts that share a passage but aren't alike come apart in branches: what is compared grows as the rows do."""
    draw, compared = random.Random(9), []
    passage = fresh(draw, 40)
    for n in (500, 1000, 2000):
        rows = [(i, " ".join(fresh(draw, 60) + passage)) for i in range(n)]
        frame = spark.createDataFrame([(*r, "", 1) for r in rows], DOCS)
        prints = frame.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("part"), chosen_path.sketches(F.col("text"), 3, 64, 42).alias("s")).select("id", "part", "s.sketch")
        leaf, family = chosen_path.leaves(prints, range(2), coordinates=64, similarity=0.85, most_rows=32)
        sizes = [r["count"] for r in leaf.groupBy("node").count().collect()]
        assert family.count() == 0 and max(sizes) <= 32
        compared.append(sum(s * s for s in sizes))
    assert compared[2] <= 6 * compared[0]


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (5, "A  B"), (6, "w " * 40_000), (7, "w w w"), (8, "one"), (9, "ONE"), (10, "one\xa0"), (11, " ".join(f"x{i}" for i in range(60_000)))]
    want = {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (1, 6), 7: (1, 6), 8: (1, 8), 9: (1, 8), 10: (1, 10), 11: (59_998, 11)}
    assert found(spark, rows) == want == brute(rows)
    assert found(spark, []) == {}


def test_null_and_repeated_ids(spark):
    same = " ".join(f"x{i}" for i in range(100))
    near = same.replace("x50", "changed")
    rows = [(3, same)] * 40 + [(None, near)] * 40 + [(None, "other words here")] * 3 + [(None, None), (4, near), (5, same)]
    got = chosen_path.near_duplicates(spark.createDataFrame([(*r, "", 1) for r in rows], DOCS)).collect()
    assert len(got) == len(rows)
    told = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert told == {(3, 98, 3, True), (None, 98, 3, False), (None, 1, None, True), (None, 0, None, True), (4, 98, 3, False), (5, 98, 3, False)}


def test_minwise_values():
    draw = np.random.default_rng(0)
    factors = draw.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    values = np.array([xxhash.xxh64_intdigest(str(i)) for i in range(3000)], np.uint64)
    a, b = chosen_path.minwise(values[:2000], factors), chosen_path.minwise(values[1000:], factors)
    assert abs((a == b).mean() - 1 / 3) < 0.03
    want = [min(int(v) * int(f) % (1 << 64) for v in values[:50]) >> 32 for f in factors[:20]]
    assert chosen_path.minwise(values[:50], factors[:20]).view(np.uint32).tolist() == want
