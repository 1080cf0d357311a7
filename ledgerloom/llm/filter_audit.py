"""How filters of a corpus interact: survivors after every step of every order, and exact Shapley values.

Each document has a mask of the filters that it fails. All that orders can show of a part of the
corpus hangs on how many documents have each mask, at most 2**n rows a part, so the texts are read
once and only counts are combined. From a part's counts comes its removal polynomial

    R(x) = sum over masks m of count(m) * (1 - product over filters i in m of (1 - x_i)),

the multilinear extension of "how many documents do these filters remove", held by its coefficients:
that of the product of x_i, i in T, is (-1)**(|T| + 1) times the count of the documents failing
all of T. R at a corner of the cube is what the filters of that corner remove, so the corners along
an order give its survivors, step by step; the good and toxic documents have polynomials of their own.
The Shapley value of filter i is the integral over t from 0 to 1 of dR/dx_i at (t, ..., t), taken term by term with
exact rationals; times n! it is the sum of the filter's removals over all orders, a whole number.

Filters A to E: under 50 words; 100 x distinct words < 65 x words; 100 x [A-Z] > 5 x code points; any of
#$%&*|; identical to the text of any smaller doc_id in the table, removed or not. Words are runs of anything but ASCII
white space, case-sensitive.

Defined results: a null text is empty (0 words: fails A), and a null part the empty string; a document with a null
doc_id has no smaller one and is no other's smaller one; repeated rows are documents of their own, and rows of one
doc_id aren't smaller than each other; labels with repeated doc_ids say 1 if any of their rows does; rows of labels
without a document, and those with a null doc_id, say nothing; an empty table gives no rows. Texts of any length are taken whole. Identical means equal in 256 bits of
SHA-2 and in length. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._shared import durable

FILTERS = "ABCDE"
#: What the counts of a mask are taken of.
KINDS = ("n", "good", "toxic")


def conditions(text: Column) -> list[Column]:
    """Whether a text (not null) fails each of the filters A to D; without conditional parts, so that Spark splits a text once."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\f\r"))
    words, none = F.split(trimmed, r"[\x20\x09-\x0D]+"), (trimmed == "").cast("long")  # of nothing, split gives one empty word
    number, distinct = F.size(words) - none, F.size(F.array_distinct(words)) - none
    capitals = (F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long")
    return [number < 50, distinct * 100 < number * 65, capitals * 100 > F.length(text).cast("long") * 5, text.rlike("[#$%&*|]")]


def failures(docs: DataFrame, part: str) -> DataFrame:
    """(doc_id, part, mask) of docs (doc_id, text, part): bit i of mask is set if the document fails filter i."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mask = sum((c.cast("int") * (1 << i) for i, c in enumerate(conditions(text))), F.lit(0))
    told = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("own"), F.unhex(F.sha2(text, 256)).alias("told"), F.length(text).alias("size"))
    told = durable(told)
    # A text that only one row has needs no join; a hot text is one row of `several`, so Spark can split the join.
    several = told.groupBy("told", "size").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1").drop("n")
    again = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return told.join(several, ["told", "size"], "left").select("doc_id", "part", (F.col("own") + again.cast("int") * 16).alias("mask"))


def counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic) of masks (doc_id, part, mask) and labels (doc_id, quality, toxic)."""
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    told = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic")).filter("good or toxic")
    both = masks.join(told, F.col("doc_id") == F.col("_id"), "left")
    number = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long")).alias(c)
    return both.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), number("good"), number("toxic"))


class Polynomial:
    """The removal polynomial of one part's counts: coefficients by mask."""

    def __init__(self, by_mask: dict[int, int], filters: int):
        full = 1 << filters
        self.filters = filters
        self.total = sum(by_mask.values())
        self.coefficients = {t: (-1) ** (t.bit_count() + 1) * sum(n for m, n in by_mask.items() if m & t == t) for t in range(1, full)}

    def at(self, corner: int) -> int:
        """Its value where x_i is 1 for the filters of the mask and 0 for the others: what those remove."""
        return sum(c for t, c in self.coefficients.items() if t & corner == t)

    def shapley(self, i: int) -> Fraction:
        """The integral over t of its derivative by x_i at (t, ..., t): a term of degree d becomes t**(d - 1)."""
        return sum((Fraction(c, t.bit_count()) for t, c in self.coefficients.items() if t >> i & 1), Fraction(0))


def orders(part: str, table: pd.DataFrame, filters: str = FILTERS) -> Iterator[tuple]:
    """The rows of one part, whose table has at most 2**n masks."""
    whole, good, toxic = (Polynomial(dict(zip(table["mask"].tolist(), table[kind].tolist(), strict=True)), len(filters)) for kind in KINDS)
    corners = [[p.at(s) for s in range(1 << len(filters))] for p in (whole, good, toxic)]
    last, scale = (1 << len(filters)) - 1, factorial(len(filters))
    shares = [whole.shapley(i) * scale for i in range(len(filters))]
    for order in permutations(range(len(filters))):
        done, name = 0, "".join(filters[i] for i in order)
        for step, i in enumerate(order, 1):
            removed, lost, bad = (c[done | 1 << i] - c[done] for c in corners)
            fails = corners[0][1 << i]
            done |= 1 << i
            yield part, name, step, whole.total - corners[0][done], removed, fails - removed, corners[0][last] - corners[0][last ^ 1 << i], lost, bad, int(shares[i])


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, *, part: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step, with the columns of SCHEMA.

    removed: by the step; redundant: failing its filter, but removed earlier; unique_fails: failing this filter alone;
    shapley: what the filter removes, summed over all orders.
    """

    def rows(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(orders(key[0], table)), columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return counts(failures(docs, part), labels).groupBy("part").applyInPandas(rows, SCHEMA)
