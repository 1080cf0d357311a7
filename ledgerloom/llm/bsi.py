"""Exact top-k inner products on a bit-sliced index.

Components are quantised to integers. For a block of rows, slice (d, b) is the bitmap of rows
that have bit b in attribute d; values are shifted to be non-negative. A query's score of all
rows is a sum of slices, each weighted by a bit of the query, so it is computed by bitmap
arithmetic alone: slices of one weight are added by carry-save adders, three numbers to two,
64 rows to a word. The top rows are then selected from the most significant slice of the scores
downward, and the rows that tie at the boundary are resolved by id, exactly.

A negative query component weighs the complement of its attribute's slices, and what this and
the shift add is the same for all rows of the query.

Defined results: vectors that are null, empty, or hold null or non-finite components take no
part, nor do rows without vec_id; vectors are compared with those of as many components; an
empty table gives an empty result. Components may be of any size: a block has as many slices as
its values need, and values or scores beyond 62 bits are computed in Python's integers. A score
among a block's best that is itself beyond 64 bits raises an OverflowError.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.blocks import finite, search


def integers(values: np.ndarray) -> np.ndarray:
    """Whole doubles as int64, or as Python's integers where some are beyond 62 bits."""
    return values.astype(np.int64) if not values.size or np.abs(values).max() < 1 << 62 else np.array([int(x) for x in values.ravel()], object).reshape(values.shape)


def slices(values: np.ndarray) -> tuple[np.ndarray, int]:
    """((attributes, bits, words), shift) of non-negative (rows, attributes) + shift."""
    shift = -int(values.min())
    raised = (values + shift).T
    bits = max(1, int(raised.max()).bit_length())
    padded = np.zeros((raised.shape[0], -(-raised.shape[1] // 64) * 64), np.uint8)
    out = np.zeros((raised.shape[0], bits, padded.shape[1] // 64), np.uint64)
    for b in range(bits):
        padded[:, : raised.shape[1]] = (raised >> b) & 1
        out[:, b] = np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)
    return out, shift


def carry_save(numbers: np.ndarray) -> np.ndarray:
    """(2 or 1, bits, words) numbers with the sum of (many, bits, words): full adders turn three into two."""
    while len(numbers) > 2:
        third = len(numbers) // 3
        a, b, c = numbers[:third], numbers[third : 2 * third], numbers[2 * third : 3 * third]
        out = np.zeros((len(numbers) - third, numbers.shape[1] + 1, numbers.shape[2]), np.uint64)
        half = a ^ b
        np.bitwise_xor(half, c, out=out[:third, :-1])
        half &= c
        np.bitwise_or(half, a & b, out=out[third : 2 * third, 1:])
        out[2 * third :, :-1] = numbers[3 * third :]
        numbers = out
    return numbers


def add(a: np.ndarray, b: np.ndarray, shift: int = 0) -> np.ndarray:
    """The sum of a and b << shift, both (bits, words), by rippling carries."""
    bits = max(len(a), len(b) + shift) + 1
    out, carry = np.zeros((bits, a.shape[1]), np.uint64), np.zeros(a.shape[1], np.uint64)
    out[: len(a)] = a
    for i in range(shift, bits):
        x = out[i]
        y = b[i - shift] if i - shift < len(b) else None
        if y is None:
            out[i], carry = x ^ carry, x & carry
        else:
            half = x ^ y
            out[i], carry = half ^ carry, (x & y) | (half & carry)
    while len(out) > 1 and not out[-1].any():
        out = out[:-1]
    return out


def weighted_sum(index: np.ndarray, query: np.ndarray) -> np.ndarray:
    """(bits, words): for each row, the sum over attributes of |query| times the row's value, or its complement if query < 0."""
    total = np.zeros((1, index.shape[2]), np.uint64)
    size = np.abs(query)
    for bit in range(int(size.max()).bit_length()):
        weighed = np.nonzero(size >> bit & 1)[0]
        if len(weighed):
            numbers = index[weighed]
            negative = query[weighed] < 0
            numbers[negative] = ~numbers[negative]
            pair = carry_save(numbers)
            total = add(total, add(pair[0], pair[1]) if len(pair) > 1 else pair[0], bit)
    return total


def top(scores: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores (bits, words) among the allowed rows (a bitmap), ties to the first."""
    sure, tied = np.zeros_like(allowed), allowed.copy()
    for plane in scores[::-1]:
        high = tied & plane
        if int(np.bitwise_count(sure | high).sum()) > k:
            tied = high
        else:
            sure, tied = sure | high, tied & ~plane
    rows = lambda x: np.nonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))[0]
    certain = rows(sure)
    return np.concatenate([certain, rows(tied)[: k - len(certain)]])


def read(scores: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The scores of some rows as integers."""
    bits = (scores[:, at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
    if len(scores) > 62:
        return (bits.astype(object) * np.array([1 << i for i in range(len(scores))], object)[:, None]).sum(axis=0)
    return (bits.astype(np.int64) << np.arange(len(scores), dtype=np.int64)[:, None]).sum(axis=0)


def total(sums: np.ndarray, same: int) -> np.ndarray:
    """sums + same as int64; an error if one doesn't fit."""
    if sums.dtype != object and abs(same) < 1 << 62:
        return sums + same
    exact = sums.astype(object) + same
    if any(not -(1 << 63) <= x < 1 << 63 for x in exact):
        raise OverflowError("an inner product is beyond 64 bits")
    return exact.astype(np.int64)


def indexed(k: int):
    """How blocks.search indexes a block, and asks it for each query's k best rows."""

    def build(ids: np.ndarray, rows: np.ndarray):
        index, shift = slices(integers(rows))
        full = (1 << index.shape[1]) - 1
        everyone = np.zeros(index.shape[2] * 64, bool)
        everyone[: len(ids)] = True
        everyone = np.packbits(everyone, bitorder="little").view(np.uint64)

        def ask(own: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            out = []
            for q, query in enumerate(integers(queries)):
                scores, allowed = weighted_sum(index, query), everyone.copy()
                for at in range(*np.searchsorted(ids, [own[q], own[q] + 1])):
                    allowed[at // 64] &= ~(np.uint64(1) << np.uint64(at % 64))
                at = top(scores, allowed, k)
                exact = [int(x) for x in query]
                same = sum(x for x in exact if x < 0) * full - sum(exact) * shift
                out.append((np.full(len(at), q), ids[at], total(read(scores, at), same)))
            return tuple(np.concatenate(x) for x in zip(*out, strict=True))

        return ask

    return build


def top_inner_products(vectors: DataFrame, *, every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors (vec_id, embedding) quantised to floor(scale * x)."""
    # The floor as a double, which holds every quantised component exactly; longs, which F.floor gives, don't reach as far.
    floor = lambda x: F.rint(x) - F.when(F.rint(x) > x, F.lit(1.0)).otherwise(F.lit(0.0))
    whole = F.transform("embedding", lambda x: floor(x.cast("double") * scale))
    rows = vectors.filter(finite()).select(F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    return search(rows, indexed(k), every=every, k=k, score="long")
