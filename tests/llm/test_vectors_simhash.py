"""Fingerprints, links, components and vector searches against plain loops."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import bsi, permutation, similar, simhash

DOCS = "doc_id long, text string, fp string"


def words_of(text):
    out, word = [], []
    for c in (text or "").translate({i: i + 32 for i in range(65, 91)}):
        if c in " \t\n\x0b\x0c\r":
            out += ["".join(word)] * bool(word)
            word = []
        else:
            word.append(c)
    return out + ["".join(word)] * bool(word)


def shingles(text, n):
    own = words_of(text)
    return [" ".join(own[i : i + n]) for i in range(len(own) - n + 1)] if len(own) >= n else [" ".join(own)] * bool(own)


def brute_fingerprint(text, n=3):
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check_simhash(rows, got):
    prints = {d: brute_fingerprint(t) for d, t in rows}
    ids = sorted(prints)
    want = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {d: (f"{prints[d]:016x}", want[d]) for d in ids}


def test_near_duplicates_match_brute_force(spark):
    draw = random.Random(2)
    base = [" ".join(draw.choice(["alpha", "Beta", "gamma", "DELTA", "é", "É"]) for _ in range(draw.randint(0, 60))) for _ in range(60)]
    rows = [(i, draw.choice(base) + draw.choice(["", " x", "\t", "  Y z"])) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (1004, "one two"), (1005, " \x0b\n"), (1006, "w " * 30_000), (1007, "w " * 30_001)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], DOCS).repartition(5)
    check_simhash(rows, simhash.near_duplicates(frame).collect())


def test_near_duplicates_of_the_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    check_simhash([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()], simhash.near_duplicates(docs).collect())


@pytest.mark.parametrize("most", [8, 4096])
def test_links_are_whole_in_hot_blocks(spark, most):
    """Fingerprints that differ in a few bits only, so that every block is hot."""
    draw = random.Random(4)
    values = {sum(1 << b for b in draw.sample([*range(10), *range(50, 64)], draw.randint(0, 7))) for _ in range(700)}
    signed = sorted(v - (1 << 64) if v >> 63 else v for v in values)
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), most=most).collect()
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2]
    assert all(((r["src"] ^ r["dst"]) & (2**64 - 1)).bit_count() <= 64 for r in edges)
    assert brute_components(signed, [(r["src"], r["dst"]) for r in edges]) == brute_components(signed, near)


def test_carry_save_distances():
    draw = np.random.default_rng(0)
    values = draw.integers(0, 2**63, (300, 2), dtype=np.uint64)
    values[5] = values[9] ^ np.array([7, 1 << 40], np.uint64)
    for radius in (0, 2, 4, 64, 70):
        found = np.unpackbits(simhash.within(values, simhash.planes(values), radius, list(range(128))).view(np.uint8), axis=1, bitorder="little")[:, :300]
        apart = np.bitwise_count(values[:, None] ^ values[None]).sum(axis=2)
        assert (found == (apart <= radius)).all()


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000), (2001, 2000)]
    draw = random.Random(1)
    draw.shuffle(chain)
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert all(got.get(i, i) == 0 for i in range(301)) and got[2001] == 2000


def test_repeated_and_null_ids(spark):
    rows = [(3, "a b c d", ""), (3, "a b c d", ""), (None, "a b c d", ""), (None, "other words here now", "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == 4 and sorted((r["component_id"] is None, r["component_id"] or 0) for r in got) == [(False, 3)] * 3 + [(True, 0)]
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def jaccard(a, b):
    a, b = set(shingles(a, 5)), set(shingles(b, 5))
    return len(a & b) / max(1, len(a | b))


def fresh_words(draw, n):
    return [f"{draw.choice('bcdfg')}{draw.randint(0, 5000)}" for _ in range(n)]


def check_five_words(rows, got):
    """Components as by all pairs' exact similarity; rows are (doc_id, text)."""
    sets = {d: frozenset(shingles(t, 5)) for d, t in rows}
    ids = sorted(sets)
    near = [(a, b) for a in ids for b in ids if a < b and (sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_components(ids, near)


def test_five_word_near_duplicates(spark):
    draw, rows = random.Random(8), []
    for i in range(80):
        base = fresh_words(draw, 200)
        rows.append((4 * i, " ".join(base)))
        changed = list(base)
        for at in range(draw.randint(0, 2)):
            changed[20 + 90 * at] = "changed"
        rows.append((4 * i + 1, " ".join(changed)))
        rows.append((4 * i + 2, " ".join(base[:60] + fresh_words(draw, 140))))  # a shared passage only
        rows.append((4 * i + 3, " ".join(base[:8] + fresh_words(draw, i % 3))))
    check_five_words(rows, similar.near_duplicates(spark.createDataFrame([(*r, "") for r in rows], DOCS).repartition(4)).collect())


def test_recall_and_precision_at_the_threshold(spark):
    """At 0.8 to 0.82, texts of 8 to 1000 words: 0.95 or more of the links found; below 0.8, none."""
    draw, rows, wanted = random.Random(3), [], []
    for i in range(600):
        n = (8, 9, 13, 20, 45, 100, 300, 1000)[i % 8]
        base = fresh_words(draw, n)
        # Words put in front change no shingle and add one each; so many keep just 0.8.
        own = n - 4
        more = own * 5 // 4 - own if i % 3 else own * 5 // 4 - own + 1
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(fresh_words(draw, more) + base))]
        wanted.append(jaccard(rows[-1][1], rows[-2][1]) >= 0.8)
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame([(*r, "") for r in rows], DOCS)).collect()}
    met = [got[2 * i + 1] == got[2 * i] for i in range(600)]
    assert not any(m for m, w in zip(met, wanted, strict=True) if not w)
    for part in range(8):
        of = [m for i, (m, w) in enumerate(zip(met, wanted, strict=True)) if w and i % 8 == part]
        assert len(of) >= 45 and sum(of) >= 0.95 * len(of) - 2, part
    assert sum(met) >= 0.95 * sum(wanted)


@pytest.mark.parametrize("most", [(24, 3000), (8192, 1 << 20)])
def test_large_groups_are_whole(spark, most):
    """A large group of near copies, others that share most of a long passage with it, and chains: all found, however few rows a task compares."""
    draw = random.Random(6)
    base, rows = fresh_words(draw, 120), []
    for _ in range(150):
        text = list(base)
        text[draw.randrange(120)] = f"own{len(rows)}"
        rows.append((len(rows), " ".join(text)))
    for _ in range(40):  # about 0.6 to the base, alike among themselves in twos
        text = base[:90] + fresh_words(draw, 30)
        rows += [(len(rows), " ".join(text)), (len(rows) + 1, " ".join([*text[:-1], "end"]))]
    chain = fresh_words(draw, 100)
    for _ in range(30):
        chain = chain[4:] + fresh_words(draw, 4)
        rows.append((len(rows), " ".join(chain)))
    frame = spark.createDataFrame([(*r, "") for r in rows], DOCS).repartition(3)
    check_five_words(rows, similar.near_duplicates(frame, most_rows=most[0], most_shingles=most[1]).collect())


def test_five_word_edge_cases(spark):
    rows = [(1, None, ""), (2, "", ""), (3, "a b", ""), (4, "A b", ""), (5, "w " * 40_000, ""), (5, "w " * 40_000, ""), (None, " ", ""), (None, "z", ""), (6, "w " * 9, "")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in similar.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (5, 5), (None, 1), (None, None), (6, 5)], key=str)
    assert similar.near_duplicates(spark.createDataFrame([], DOCS)).collect() == []


def vectors(spark, n=900, seed=0):
    draw = np.random.default_rng(seed)
    rows = [(i, draw.normal(0, 1, 16).astype(np.float32).astype(float).tolist(), 0) for i in range(n)]
    rows[60] = (60, rows[40][1], 0)
    rows[77] = (77, rows[40][1], 0)
    rows += [(2000, None, 0), (2020, [None] * 16, 0), (2040, [math.nan] * 16, 0), (2060, [math.inf] + [0.0] * 15, 0), (2080, [], 0), (None, [1.0] * 16, 0), (2100, [0.0] * 16, 0), (2120, [1.0, 2.0], 0), (2150, [2.0, 1.0], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(6)


def usable(rows, zero):
    out = {}
    for i, v, _ in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v)):
            out[i] = v
    return out


def test_top_inner_products_match_brute_force(spark):
    rows, frame = vectors(spark)
    whole = {i: [math.floor(64 * x) for x in v] for i, v in usable(rows, True).items()}
    want = {}
    for q, a in whole.items():
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in whole.items() if i != q and len(a) == len(b))[:20]
            want |= {(q, rank): (i, -s) for rank, (s, i) in enumerate(scored, 1)}
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in bsi.top_inner_products(frame).collect()}
    assert got == want


def test_ties_in_the_index():
    scores = np.array([[0b1011, 0], [0b0011, 0]], np.uint64)  # rows 0 and 1: 3, row 3: 1
    assert bsi.top(scores, np.array([0b1011, 0], np.uint64), 2).tolist() == [0, 1]
    assert bsi.top(scores, np.array([0b1011, 0], np.uint64), 1).tolist() == [0]
    assert bsi.top(scores, np.array([0b1000, 0], np.uint64), 5).tolist() == [3]


def brute_nearest(found):
    want = defaultdict(list)
    for q, a in found.items():
        if q % 50 == 0:
            near = lambda b, a=np.array(a): float(a @ np.array(b) / math.sqrt(a @ a) / math.sqrt(np.array(b) @ np.array(b)))
            want[q] = sorted((-near(b), i) for i, b in found.items() if i != q and len(a) == len(b))[:5]
    return want


def recall(got, want):
    hits = total = 0
    for q, best in want.items():
        mine = [r for r in got if r["query_id"] == q]
        total += len(best)
        hits += len({r["vec_id"] for r in mine} & {i for _, i in best})
        exact = dict((i, -s) for s, i in best)
        assert [r["rank"] for r in sorted(mine, key=lambda r: (-r["score"], r["vec_id"]))] == list(range(1, len(mine) + 1))
        assert all(r["score"] == pytest.approx(exact[r["vec_id"]], abs=1e-12) for r in mine if r["vec_id"] in exact)
    return hits / total


def test_nearest_found(spark):
    rows, frame = vectors(spark)
    got = permutation.nearest(frame).collect()
    want = brute_nearest(usable(rows, False))
    assert {r["query_id"] for r in got} == {q for q, best in want.items() if best} and recall(got, want) >= 0.9
    assert permutation.nearest(frame.limit(0)).collect() == [] and bsi.top_inner_products(frame.limit(0)).collect() == []


@pytest.mark.parametrize("table", ["sf0.01", "sf0.1"])
def test_recall_on_the_table(spark, table):
    """A twentieth of the rows is reranked; the vectors are independent normals, the hardest case."""
    frame = spark.read.parquet(f"/root/testdata/{table}/embeddings.parquet").withColumn("v", F.col("embedding"))
    found = {r["vec_id"]: r["embedding"] for r in frame.collect()}
    assert recall(permutation.nearest(frame).collect(), brute_nearest(found)) >= 0.9


def test_repeated_vector_ids(spark):
    """A repeated id asks with its smallest vector, however the rows are dealt, and isn't its own answer."""
    draw = np.random.default_rng(5)
    rows = [(i % 90, draw.normal(0, 1, 6).tolist()) for i in range(300)] + [(100, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])] * 3
    least = {}
    for i, v in rows:
        least[i] = min(v, least.get(i, v))
    for of, every, k in ((bsi.top_inner_products, 20, 20), (permutation.nearest, 50, 5)):
        told = []
        for order, parts in ((rows, 2), (rows[::-1], 7)):
            frame = spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(parts)
            told.append(sorted(map(tuple, of(frame).collect())))
        assert told[0] == told[1] and {r[0] for r in told[0]} == {i for i in least if i % every == 0} and all(r[0] != r[2] for r in told[0])
        if of is bsi.top_inner_products:
            whole = lambda v: [math.floor(64 * x) for x in v]
            for q in {r[0] for r in told[0]}:
                best = sorted(((-sum(a * b for a, b in zip(whole(least[q]), whole(v), strict=True)), i) for i, v in rows if i != q))[:k]
                assert [(r[2], r[3]) for r in told[0] if r[0] == q] == [(i, -s) for s, i in best]


def test_multiples_of_a_vector_tie(spark):
    """Powers of two times one vector have one cosine, to the last bit, at any size; ties go to the smaller id."""
    v = [0.1, -0.7, 0.3]
    rows = [(50, v), *[(i, [x * 2.0**e for x in v]) for i, e in ((3, 900), (1, -900), (2, 1), (4, 0))]]
    got = permutation.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])] == [1, 2, 3, 4] and len({r["score"] for r in got}) == 1


@pytest.mark.parametrize("large", [16384.0, 2.0**31, 2.0**60])
def test_large_components_take_part(spark, large):
    """Components from 2**20 on, quantised, as query and as candidate; scores stay within 64 bits."""
    draw = random.Random(8)
    # The largest meets zeros only, so that its scores fit.
    first = lambda: draw.uniform(-3, 3) if large < 2**60 else 0.0
    rows = [(i, [first(), *[draw.uniform(-3, 3) for _ in range(4)]]) for i in range(100) if i != 20] + [(20, [large, 0.25, 0.0, 0.0, 1.0])]
    rows += [(101, [-large, 1.0, 1.0, 0.0, 0.0])] if large < 2**30 else []
    got = defaultdict(list)
    for r in sorted(bsi.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda r: r["rank"]):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    whole = {i: [math.floor(64 * x) for x in v] for i, v in rows}
    for q in (i for i in whole if i % 20 == 0):
        best = sorted(((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q))[:20]
        assert got[q] == [(i, -s) for s, i in best]


def test_a_score_beyond_64_bits_is_an_error(spark):
    frame = spark.createDataFrame([(0, [2.0**40, 1.0]), (1, [2.0**40, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        bsi.top_inner_products(frame).collect()
