"""SimHash near-dedup with bit-sliced comparison.

A fingerprint has a bit set if over half the hashes of a text's shingles have it. Fingerprints
are compared in blocks. For a block, bit plane p holds bit p of all its fingerprints, 64 of them
to a machine word; the planes that differ from a query's bit are added up by bitwise counters
(a carry-save adder for each word), so that 64 distances grow with each operation, and the
block is abandoned once all have passed the radius.

Blocks come from the pigeonhole: the bits are cut into bands, and fingerprints within the radius
agree in all bands but `radius`. Rows are (choice of bands, value). A block over `most` rows is
split anew by the same rule on its other bits, until it fits or all bits but a few are fixed,
so none is unbounded and no pair is lost. A block gives the edges of a spanning forest, not its
pairs. Equal fingerprints are one row throughout, and components are found by alternating
stars over distinct fingerprints only.

Defined results: a null text has no words; texts without words have fingerprint zero and are
linked like any other; a null doc_id takes part, and is a component's id only if it has no
other; repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._shared import discard, durable, short_batches, small, written

#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of every shingle of the text with A-Z in lower case; of all its words if they are fewer."""
    own = [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.empty(0, np.uint64)
    h, join = xxhash.xxh64_intdigest, b" ".join
    parts = zip(*[own[i:] for i in range(words)], strict=False) if len(own) >= words else [own]
    return np.array([h(join(x), seed) for x in parts], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits: those set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        counts += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def fingerprints(texts: Column, words: int = 3, seed: int = 42) -> Column:
    """The fingerprint of each text, as a signed long."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(shingle_hashes(x, words, seed)) for x in batch], np.uint64).view(np.int64))

    return of(texts)


def planes(values: np.ndarray) -> np.ndarray:
    """(bits, words): bit plane p has bit p of every value, 64 values to a word; values is (rows, 64-bit words)."""
    bits = np.unpackbits(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1), axis=1, bitorder="little").T
    padded = np.zeros((bits.shape[0], -(-len(values) // 64) * 64), np.uint8)
    padded[:, : len(values)] = bits
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def within(queries: np.ndarray, sliced: np.ndarray, radius: int, order: list[int]) -> np.ndarray:
    """(queries, words): for each query, a bitmap of the rows of the block at a distance up to radius.

    queries is (rows, 64-bit words), sliced the planes of the block. Counter k holds bit k of the
    distances; `over` those that have passed the largest number the counters hold.
    """
    shape = (len(queries), sliced.shape[1])
    counters = [np.zeros(shape, np.uint64) for _ in range(max(1, radius.bit_length()))]
    over = np.zeros(shape, np.uint64)
    for step, p in enumerate(order):
        flip = np.where((queries[:, p // 64] >> np.uint64(p % 64)) & np.uint64(1), ~np.uint64(0), np.uint64(0))
        carry = sliced[p][None, :] ^ flip[:, None]
        for k, counter in enumerate(counters):
            counters[k], carry = counter ^ carry, counter & carry
        over |= carry
        if step % 8 == 7 and (over == ~np.uint64(0)).all():
            return np.zeros(shape, np.uint64)
    # Over the radius: over, or above it as a number, compared from the highest bit down.
    equal, above = ~over, over
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal = equal & counters[k]
        else:
            above, equal = above | (equal & counters[k]), equal & ~counters[k]
    return ~above


def forest(values: np.ndarray, radius: int, batch: int = 256) -> list[tuple[int, int]]:
    """The edges (row, first row of its group) of a spanning forest of the block's links.

    Groups are found breadth first: the rows that a batch of queries reaches are the bitwise or
    of their bitmaps, without those reached before. So each row is a query once or twice, and
    no pair is listed. Bitmaps are kept only for blocks of up to `most` rows.
    """
    n, most = len(values), 4096
    sliced = planes(values)
    order = [p for p in range(sliced.shape[0]) if 0 < int(np.bitwise_count(sliced[p]).sum()) < n]
    hits = (lambda rows: within(values[rows], sliced, radius, order)) if n > most else None
    pieces = [within(values[at : at + batch], sliced, radius, order) for at in range(0, n, batch)] if n <= most else []
    linked = np.ones(n, bool)
    if n <= most:
        table = np.concatenate(pieces)
        hits = lambda rows: table[rows]
        linked = np.bitwise_count(table & _valid(n)).sum(axis=1) > 1
    else:
        for at in range(0, n, batch):
            rows = np.arange(at, min(n, at + batch))
            linked[rows] = np.bitwise_count(hits(rows) & _valid(n)).sum(axis=1) > 1
    left, edges = _bitmap(linked), []
    for first in np.nonzero(linked)[0].tolist():
        if not left[first // 64] >> np.uint64(first % 64) & np.uint64(1):
            continue
        front = np.array([first])
        left[first // 64] &= ~(np.uint64(1) << np.uint64(first % 64))
        while len(front):
            reached = np.zeros_like(left)
            for at in range(0, len(front), batch):
                reached |= np.bitwise_or.reduce(hits(front[at : at + batch]), axis=0)
            reached &= left
            left &= ~reached
            front = np.nonzero(np.unpackbits(reached.view(np.uint8), bitorder="little"))[0]
            edges += [(x, first) for x in front.tolist()]
    return edges


def _bitmap(flags: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(flags) // 64) * 64, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def _valid(n: int) -> np.ndarray:
    return _bitmap(np.ones(n, bool))


def near_pairs(values: np.ndarray, blocks: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """The linked pairs (row, earlier row) inside many small blocks, standing one after another.

    For each lag, the differences of all rows to those so much earlier are sliced and added up
    together; a block's size bounds the lags.
    """
    out: list[tuple[int, int]] = []
    sizes = np.bincount(blocks) if len(blocks) else np.zeros(1, int)
    for lag in range(1, int(sizes.max())):
        same = np.nonzero(blocks[lag:] == blocks[:-lag])[0]
        if len(same):
            apart = planes(values[same + lag] ^ values[same])
            near = within(np.zeros((1, values.shape[1]), np.uint64), apart, radius, list(range(apart.shape[0])))
            rows = same[np.unpackbits(near.view(np.uint8), bitorder="little")[: len(same)].astype(bool)]
            out += zip((rows + lag).tolist(), rows.tolist(), strict=True)
    return out


def block_edges(members: pa.ListArray, width: int, radius: int, small: int = 6) -> tuple[np.ndarray, np.ndarray]:
    """(src, dst): positions in members.values (fingerprints of `width` words, flat) of linked rows, by block."""
    starts = members.offsets.to_numpy()
    flat = members.values.to_numpy(zero_copy_only=False)
    words = flat.view(np.uint64).reshape(-1, width)
    sizes = np.diff(starts) // width
    at, edges = starts[:-1] // width, []
    few = np.nonzero(sizes <= small)[0]
    if len(few):
        rows = np.concatenate([np.arange(at[i], at[i] + sizes[i]) for i in few])
        edges.append(rows[np.array(near_pairs(words[rows], np.repeat(np.arange(len(few)), sizes[few]), radius), int).reshape(-1, 2)])
    for i in np.nonzero(sizes > small)[0]:
        edges.append(at[i] + np.array(forest(words[at[i] : at[i] + sizes[i]], radius), int).reshape(-1, 2))
    both = np.concatenate(edges) if edges else np.empty((0, 2), int)
    return both[:, 0], both[:, 1]


def _cuts(free: list[tuple[int, int]], radius: int, size: int) -> list[list[tuple[int, int]]]:
    """The free bits (from, to) cut into bands of about `size` bits, radius + 2 at least where there are so many."""
    bits = [b for low, high in free for b in range(low, high)]
    n = max(radius + 2, -(-len(bits) // size))
    return [[(x, x + 1) for x in part.tolist()] for part in np.array_split(np.array(bits), n) if len(part)]


def _value(fp: Column, bits: list[tuple[int, int]]) -> Column:
    mask = sum(1 << low for low, _ in bits)
    return fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def links(distinct: DataFrame, radius: int = 2, *, band_bits: int = 16, most: int = 4096) -> DataFrame:
    """(src, dst): forest edges between the distinct fingerprints of `distinct` (fp long) at a distance up to radius.

    most: the rows of a block that is compared at once. Larger blocks are split by the bits that
    aren't fixed in them; those left over at the last level, of which all but some 16 bits are
    fixed, have 65,536 rows at most.
    """
    schema = "src long, dst long"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column("fps")
            src, dst = block_edges(members, 1, radius)
            flat = members.values.to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(flat[src]), pa.array(flat[dst])], names=["src", "dst"])

    cuts = _cuts([(0, 64)], radius, band_bits)
    choices = list(combinations(range(len(cuts)), len(cuts) - radius))
    fixed = [[x for i in c for x in cuts[i]] for c in choices]
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), _value(F.col("fp"), bits).alias("value")) for i, bits in enumerate(fixed)])).alias("k")).select("fp", "k.choice", "k.value")
    sizes = durable(keyed.groupBy("choice", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), len(choices) * distinct.count())
    blocks = [_gather(keyed, sizes.filter(F.col("n") <= most), ["choice", "value"])]
    hot = sizes.filter(F.col("n") > most)
    n_hot = hot.count()
    if n_hot:
        large = keyed.join(small(hot.select("choice", "value"), n_hot), ["choice", "value"])
        finer = []
        for i, bits in enumerate(fixed):
            free = [(b, b + 1) for b in range(64) if (b, b + 1) not in bits]
            parts = _cuts(free, radius, max(1, len(free) // (radius + 2)))
            for j, c in enumerate(combinations(range(len(parts)), len(parts) - radius)):
                finer.append(F.when(F.col("choice") == i, F.struct(F.lit(j).alias("sub"), _value(F.col("fp"), [x for k in c for x in parts[k]]).alias("rest"))))
        split = large.select("fp", "choice", "value", F.explode(F.filter(F.array(*finer), lambda x: x.isNotNull())).alias("k")).select("fp", "choice", "value", "k.sub", "k.rest")
        keys = ["choice", "value", "sub", "rest"]
        blocks.append(_gather(split, split.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), keys))
    edges = [b.mapInArrow(compare, schema) for b in blocks]
    return edges[0].unionByName(edges[1]).distinct() if len(edges) > 1 else edges[0].distinct()


def _gather(keyed: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    """(fps): the fingerprints of each block that `sizes` has, all of bounded size."""
    return keyed.join(sizes.select(*keys), keys).groupBy(*keys).agg(F.collect_list("fp").alias("fps")).select("fps")


def components(edges: DataFrame, nodes: int | None = None, rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node that each node of edges (src, dst) reaches.

    Alternating stars: each node's larger neighbours are linked to its smallest one, then its
    smaller neighbours are, until every node hangs on its root. A step is a group-by on nodes
    with a minimum, so a hub is combined before it is shuffled; it is kept in the shared folder.
    nodes: how many there are at most, if known.
    """
    spark = edges.sparkSession
    now, path = written(edges.select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).filter("hi <> lo").distinct(), "stars", nodes and 4 * nodes)
    n, before = now.count(), None
    for _ in range(rounds):
        # Large star: every larger neighbour of a node to the node's smallest neighbour or itself.
        both = now.select(F.col("hi").alias("node"), F.col("lo").alias("near")).unionByName(now.select(F.col("lo").alias("node"), F.col("hi").alias("near")))
        least, least_path = written(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("m")), "least", 2 * n)
        large = both.filter("near > node").join(least, "node").select(F.col("near").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: a node and its smaller neighbours to the smallest of them.
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = large.join(low, "hi")
        star = pairs.select(F.col("lo").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()
        old = (path, least_path)
        now, path = written(star, "stars", 2 * n)
        discard(spark, *old)
        state = now.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = state
    raise RuntimeError(f"the components aren't settled after {rounds} rounds")


def classes(prints: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """prints (doc_id, fp, kept in the shared folder) with component_id, by the links that `find` gives for distinct fps."""
    unique = durable(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), prints.count())
    n = unique.count()
    roots = components(find(unique.select("fp")), n)
    rooted = unique.join(roots, unique.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = durable(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), n)
    named = durable(rooted.join(least, "root").select(F.col("fp").alias("_fp"), "component_id"), n)
    # A group of copies may be a third of the documents; named has one row for it, so Spark can split the join.
    return prints.join(named, F.col("fp") == F.col("_fp")).drop("_fp")


def near_duplicates(docs: DataFrame, *, words: int = 3, radius: int = 2, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint, component_id) of docs (doc_id, text); fingerprint in 16 hex digits."""
    short_batches(docs.sparkSession)
    prints = durable(docs.select("doc_id", fingerprints(F.col("text"), words, seed).alias("fp")))
    found = classes(prints, lambda x: links(x, radius))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
