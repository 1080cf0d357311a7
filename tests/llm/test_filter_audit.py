"""The audit of filters against a plain application of every order, document by document."""

import random
from collections import Counter
from fractions import Fraction
from itertools import permutations

from ledgerloom.llm import filter_audit
from ledgerloom.llm.filter_audit import Polynomial

DOCS, LABELS = "doc_id long, text string, source string, part string, mask int, told string", "doc_id long, quality int, toxic int, good boolean"
SPACE = " \t\n\x0b\x0c\r"


def brute(rows, labels):
    """{(part, order, step): the seven counts}; rows are (doc_id, text, source)."""
    texts = [t or "" for _, t, _ in rows]

    def fails(i):
        text, own = texts[i], []
        for c in text:
            if c in SPACE:
                own.append("")
            else:
                own = own or [""]
                own[-1] += c
        words = [w for w in own if w]
        d = rows[i][0]
        same = any(d is not None and e is not None and e < d and t == text for (e, _, _), t in zip(rows, texts, strict=True))
        return [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text), same]

    masks = [fails(i) for i in range(len(rows))]
    says = lambda i, k: rows[i][0] is not None and any(x[0] == rows[i][0] and x[k] == 1 for x in labels)
    out, removed_by = {}, Counter()
    for part in {s or "" for _, _, s in rows}:
        mine = [i for i in range(len(rows)) if (rows[i][2] or "") == part]
        for order in permutations(range(5)):
            left, name = set(mine), "".join("ABCDE"[f] for f in order)
            for step, f in enumerate(order, 1):
                gone = {i for i in left if masks[i][f]}
                before, left = left, left - gone
                failing = [i for i in mine if masks[i][f]]
                removed_by[part, f] += len(gone)
                out[part, name, step] = [len(left), len(gone), sum(i not in before for i in failing), sum(sum(masks[i]) == 1 for i in failing), sum(says(i, 1) for i in gone), sum(says(i, 2) for i in gone)]
    return {k: (*v, removed_by[k[0], "ABCDE".index(k[1][k[2] - 1])]) for k, v in out.items()}


def audited(spark, rows, labels, parts=4):
    frame = spark.createDataFrame([(*r, "clash", 9, "clash") for r in rows], DOCS).repartition(parts)
    got = filter_audit.audit(frame, spark.createDataFrame([(*x, True) for x in labels], LABELS)).collect()
    assert len(got) == len({tuple(r)[:3] for r in got})
    return {tuple(r)[:3]: tuple(r)[3:] for r in got}


def test_every_order_matches_brute_force(spark):
    draw = random.Random(4)

    def text():
        n = draw.choice([0, 10, 49, 50, 60, 100])
        words = [draw.choice("abcdefghijklmnopqrstuvwxyz") + str(draw.randint(0, draw.choice([5, 1000]))) for _ in range(n)]
        words = [w.upper() if draw.random() < 0.1 else w for w in words] + draw.choice([[], [], ["#"], ["50%"], ["X" * 40]])
        return draw.choice(["", "\n ", "é"]) + draw.choice([" ", "\t", " \x0b"]).join(words) + draw.choice(["", " ", "\xa0"])

    pool = [text() for _ in range(60)]
    rows = [(draw.randint(0, 90), draw.choice(pool), draw.choice(["s1", "s1", "s2", "", None])) for _ in range(120)]
    rows += [(200, None, None), (201, "", "s9"), (201, None, "s9"), (None, pool[0], "s9"), (None, "", "s9"), (203, "w " * 60_000, "long"), (204, " ".join(f"w{i}" for i in range(50_000)), "long")]
    labels = [(i, draw.choice([0, 1, None]), draw.choice([0, 1, None])) for i in range(0, 90, 2)] + [(4, 1, 1), (4, 0, 0), (999, 1, 1), (None, 1, 1), (203, 1, 0)]
    assert audited(spark, rows, labels) == brute(rows, labels)


def test_borders_of_the_conditions(spark):
    fifty, other = " ".join(f"w{i}" for i in range(50)), " ".join(f"v{i}" for i in range(50))
    repeats = " ".join([f"u{i}" for i in range(65)] + ["u0"] * 35)  # 65 of 100 words distinct: kept
    more = " ".join([f"u{i}" for i in range(64)] + ["u0"] * 36)
    capital = "A" * 20 + " " + "b" * 379  # 20 of 400 characters: kept by C
    rows = [(1, fifty, "a"), (2, other[:-4], "a"), (3, repeats, "b"), (4, more, "b"), (5, capital, "c"), (6, "A" + capital, "c"), (7, fifty + " |", "d"), (8, fifty, "d")]
    got, steps = audited(spark, rows, []), {}
    for (part, order, step), v in got.items():
        steps.setdefault((part, order[step - 1]), v[1] + v[2])  # removed and redundant: all that fail
    assert [steps[k] for k in (("a", "A"), ("b", "B"), ("c", "C"), ("d", "D"), ("d", "E"), ("a", "E"))] == [1, 1, 1, 1, 1, 0]


def test_a_hot_text(spark):
    """Copies that are most rows, over several parts: one stays, the smallest id."""
    rows = [(i, "same words", f"s{i % 3}") for i in range(3000)] + [(5000 + i, f"own words {i}", "s0") for i in range(50)]
    got = audited(spark, rows, [], 9)
    assert sum(got[f"s{i}", "EABCD", 1][1] for i in range(3)) == 2999 and got["s0", "EABCD", 1][0] == 51


def test_empty(spark):
    assert audited(spark, [], []) == {} and audited(spark, [], [(1, 1, 1)]) == {}
    assert len(audited(spark, [(1, "a", None)], [])) == 600


def test_polynomial():
    draw = random.Random(2)
    counts = {m: draw.randint(0, 50) for m in range(32)}
    p = Polynomial(counts, 5)
    for corner in range(32):
        assert p.at(corner) == sum(n for m, n in counts.items() if m & corner)
    # By the definition: marginal contributions over all orders.
    for i in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += p.at(before | 1 << i) - p.at(before)
        assert p.shapley(i) * 120 == total and isinstance(p.shapley(i), Fraction)
    assert sum(p.shapley(i) for i in range(5)) == p.at(31)
