"""Hard negatives against plain loops over all rows."""

import math
import random

import numpy as np
import pytest

from ledgerloom.llm import hard_negatives
from ledgerloom.llm.hard_negatives import Planes

ROWS = "vec_id long, embedding array<double>, label int, score string, window int"


def brute(rows, every=10, k=5, scale=256):
    """(anchor, positive, rank, negative, positive score, negative score); rows are (vec_id, embedding, label) with one row an id."""
    whole = {i: ([math.floor(scale * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, (v, y) in whole.items():
        if a % every == 0:
            scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), i, z) for i, (w, z) in whole.items() if i != a and len(w) == len(v))
            for s, p, _ in [x for x in scored if x[2] == y][:k]:
                fit = [x for x in scored if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
                out += [(a, p, r, n, -s, -t) for r, (t, n, _) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, parts=3, every=10, **more):
    got = hard_negatives.mine(spark.createDataFrame([(*r, "clash", 7) for r in rows], ROWS).repartition(parts), every=every, **more).collect()
    return sorted(tuple(r)[:6] for r in got)


@pytest.mark.parametrize("block", [1 << 25, 1 << 12])
def test_mined_rows_match_brute_force(spark, monkeypatch, block):
    """Odd rows, ties and a hot label; the blocks don't matter."""
    monkeypatch.setattr(hard_negatives, "BLOCK_BYTES", block)
    draw = random.Random(3)
    rows = [(i, [draw.gauss(0.05, 0.125) for _ in range(16)], draw.choice([1, 1, 1, 2, 3, -4])) for i in range(400)]
    rows[11] = (11, rows[30][1], rows[30][2])  # ties among positives and negatives
    rows[12] = (12, rows[30][1], rows[30][2] + 1)
    rows[13] = (13, rows[30][1], rows[30][2] + 1)
    rows += [(1000, None, 1), (1010, [None] * 16, 1), (1020, [math.nan] * 16, 2), (1030, [math.inf] + [0.0] * 15, 2), (1040, [], 1), (None, [1.0] * 16, 1), (1050, [1.0] * 16, None)]
    rows += [(1060, [0.0] * 16, 1), (1070, [1.0, 2.0], 1), (1071, [1.0, 1.0], 1), (1072, [0.9, 0.9], 2), (1080, [1.0, 2.0, 3.0], 8)]
    got = mined(spark, rows)
    assert got == brute(rows) and {r[0] for r in got} >= {1060, 1070} and 1080 not in {r[0] for r in got}


def test_empty_and_repeated(spark):
    assert mined(spark, []) == []
    draw = random.Random(1)
    v = lambda: [draw.gauss(0.1, 0.1) for _ in range(4)]
    rows = [(0, v(), 1)] * 3 + [(1, v(), 1)] * 2 + [(2, v(), 2)] * 3
    rows = [(i, x, y) for i, x, y in rows] + [(2, [0.2] * 4, 2)]
    told = [sorted(tuple(r) for r in hard_negatives.mine(spark.createDataFrame([(*r, "", 0) for r in order], ROWS)).collect()) for order in (rows, rows[::-1])]
    assert told[0] == told[1] and {r[6] for r in told[0]} <= {1, 2} and all(r[3] == 2 for r in told[0])


@pytest.mark.parametrize("large", [2.0**20, 2.0**50])
def test_large_components(spark, large):
    """Sums beyond doubles are added as whole numbers."""
    draw = random.Random(5)
    first = lambda i: large if i == 20 and large < 2**40 else 0.0
    rows = [(i, [first(i), *[draw.gauss(0.2, 0.3) for _ in range(4)]], i % 3) for i in range(90)]
    if large > 2**40:
        rows.append((91, [large, 0.1, 0.1, 0.1, 0.1], 1))
    assert mined(spark, rows) == brute(rows)


def test_scores_beyond_64_bits_are_an_error(spark):
    with pytest.raises(Exception, match="beyond 64 bits"):
        mined(spark, [(0, [2.0**40, 1.0], 1), (1, [2.0**40, 1.0], 1)])


def test_intervals_drop_rows_and_keep_results():
    """Every window's rows are those of all products, though few pairs are open at the end."""
    draw = np.random.default_rng(0)
    values, queries = np.floor(draw.normal(0, 32, (3000, 24))).astype(np.int64), np.floor(draw.normal(0, 32, (7, 24))).astype(np.int64)
    scores = queries @ values.T
    low = np.array([[5000, 100], [0, 1], [1, 0], [-10**9, 9000], [2**40, 0], [3000, 3100], [0, 0]], object)
    high = np.array([[9000, 200], [10**6, 50], [0, 1], [10**9, 9500], [2**41, 10**5], [3100, 3105], [0, 0]], object)
    allowed = draw.random((7, 3000)) < 0.9
    q, w, row, score = Planes(values).windows(queries, allowed, low, high, 4)
    got = {}
    for a, b, c, s in zip(q.tolist(), w.tolist(), row.tolist(), score.tolist(), strict=True):
        got.setdefault((a, b), []).append((c, int(s)))
    for a in range(7):
        for b in range(2):
            fit = sorted((-int(scores[a, i]), i) for i in range(3000) if allowed[a, i] and low[a, b] <= scores[a, i] <= high[a, b])[:4]
            assert got.get((a, b), []) == [(i, -s) for s, i in fit], (a, b)


def test_noise_moves_labels(spark):
    rows = [(0, 9), (7, 3), (8, 9), (None, 1), (14, None)]
    got = hard_negatives.flipped(spark.createDataFrame(rows, "vec_id long, label int")).collect()
    assert [(r["vec_id"], r["label"]) for r in got] == [(0, 0), (7, 4), (8, 9), (None, 1), (14, None)]
