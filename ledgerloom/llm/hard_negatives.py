"""Hard-negative mining by bit-sliced integer products.

Components are quantised to integers and cut into bit-planes: plane b holds bit b of every
component of every row of a block. An anchor's products with a block are taken plane by plane, the
most significant first. After plane b what is missing of a score lies between (2**b - 1) times the
sums of the anchor's negative and of its positive components, so each plane halves the interval of
every score. A row is dropped as soon as its interval can't reach any of the anchor's windows, or
stands wholly below the k-th best lower end of those rows that are surely in the window; rows still
open after the last plane have exact scores. First planes go over all rows of a block at once, as
products of a 0/1 matrix; once few (anchor, row) pairs are open, planes go over those alone.

Positives are the first rows of a window without ends, among the anchor's own label; negatives are
the first rows of the windows [low share x positive score, positive score], among the other labels,
all windows of an anchor in one pass. Rows are dealt into blocks of bounded bytes, for positives
within each label, so that anchors go to blocks of their own label only. A copy of the anchors goes
to each block that they ask, which makes the work anchors times rows; a block returns at most k rows for each window,
and these are merged by rank. Results don't depend on the blocks.

Defined results: rows with a null vec_id or label, or a vector that is null, empty or holds null or
non-finite components, take no part; vectors are compared with those of as many components; a
vec_id of several rows is an anchor once, with its smallest (vector, label), and none of these rows
is its positive or negative; as candidates repeated rows are rows of their own, and positive_rank
tells repeated positives apart; an anchor without positives, and a positive with a negative score,
give no rows; an empty table gives an empty result. Components may be of any size: what doubles
can't add exactly is added as Python's integers, and a score in the result beyond 64 bits raises an
OverflowError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._shared import durable, small
from ledgerloom.llm.blocks import BLOCK_BYTES, finite, matrix
from ledgerloom.llm.bsi import integers, total

#: Pairs of an anchor and a row whose sums a task holds at once.
CELLS = 1 << 22
#: The planes go over open pairs alone once these are under this share of all.
FEW = 0.125


class Planes:
    """The bit-planes of a block: (bits, rows, components) of values + shift."""

    def __init__(self, values: np.ndarray):
        self.shift = -int(values.min())
        raised = values + self.shift
        self.bits = max(1, int(raised.max()).bit_length())
        self.planes = np.stack([((raised >> b) & 1).astype(np.uint8) for b in range(self.bits)])

    def kind(self, queries: np.ndarray) -> type:
        """Doubles where they hold every sum of products exactly, else Python's integers."""
        most = int(np.abs(queries).max()) * queries.shape[1] * ((1 << self.bits) + abs(self.shift))
        return np.float64 if most < 1 << 52 else object

    def windows(self, queries: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, window, row, score): each query's first k allowed rows in each of its windows (low and high ends, both within).

        allowed: (queries, rows). low, high: (queries, windows); a window that ends before it begins is empty. Rows
        stand in order of id.
        """
        kind = self.kind(queries)
        asked, low, high = queries.astype(kind), low.astype(kind), high.astype(kind)
        endless = not isinstance(low[0, 0], int) and bool(np.isneginf(low[0, 0]))
        down = np.minimum(asked, 0).sum(axis=1)
        up = np.maximum(asked, 0).sum(axis=1)
        sums = np.repeat(-(asked.sum(axis=1) * self.shift)[:, None], allowed.shape[1], axis=1)
        held = (low <= high).astype(bool)
        open_ = allowed & held.any(axis=1)[:, None]
        least, most = np.where(held, low, np.inf).min(axis=1), np.where(held, high, -np.inf).max(axis=1)
        q = row = None
        for b in reversed(range(self.bits)):
            rest = (1 << b) - 1
            if q is None:
                sums += (asked @ self.planes[b].T.astype(kind)) * (1 << b)
                now = self._kth(sums, open_, k) + rest * down if endless else least
                open_ &= ((sums + (rest * up)[:, None] >= now[:, None]) & (sums + (rest * down)[:, None] <= most[:, None])).astype(bool)
                if open_.sum() < FEW * open_.size or not b:
                    q, row = np.nonzero(open_)
                    score = sums[q, row]
                    keep = self._reach(q, score, rest * down, rest * up, low, high, k)
                    q, row, score = q[keep], row[keep], score[keep]
            else:
                score = score + self._products(asked, q, row, b) * (1 << b)
                keep = self._reach(q, score, rest * down, rest * up, low, high, k)
                q, row, score = q[keep], row[keep], score[keep]
        out = []
        for w in range(low.shape[1]):
            within = np.nonzero(((score >= low[q, w]) & (score <= high[q, w])).astype(bool))[0]
            order = within[np.lexsort((row[within], -score[within], q[within]))]
            first = np.searchsorted(q[order], q[order])
            order = order[np.arange(len(order)) - first < k]
            out.append((q[order], np.full(len(order), w), row[order], score[order]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    @staticmethod
    def _kth(sums: np.ndarray, open_: np.ndarray, k: int) -> np.ndarray:
        """The k-th highest open sum of each query; minus infinity if fewer are open."""
        if sums.shape[1] <= k:
            return np.full(len(sums), -np.inf)
        known = np.where(open_, sums, -np.inf)
        return np.partition(known, known.shape[1] - k, axis=1)[:, known.shape[1] - k]

    def _products(self, asked: np.ndarray, q: np.ndarray, row: np.ndarray, b: int, at_once: int = 1 << 15) -> np.ndarray:
        parts = [(asked[q[i : i + at_once]] * self.planes[b][row[i : i + at_once]]).sum(axis=1) for i in range(0, len(q), at_once)]
        return np.concatenate(parts) if parts else np.empty(0, asked.dtype)

    @staticmethod
    def _reach(q: np.ndarray, score: np.ndarray, down: np.ndarray, up: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
        """Which open pairs (in order of q) can still be in a window; raises the low ends by the k-th best of the pairs surely within."""
        keep = np.zeros(len(q), bool)
        starts = np.searchsorted(q, np.arange(len(low) + 1))
        for i in np.unique(q):
            mine = slice(starts[i], starts[i + 1])
            lower, upper = score[mine] + down[i], score[mine] + up[i]
            for w in range(low.shape[1]):
                if low[i, w] <= high[i, w]:
                    sure = lower[((lower >= low[i, w]) & (upper <= high[i, w])).astype(bool)]
                    if len(sure) >= k:
                        low[i, w] = max(low[i, w], np.partition(sure, len(sure) - k)[len(sure) - k])
                    keep[mine] |= ((upper >= low[i, w]) & (lower <= high[i, w])).astype(bool)
        return keep


def _ask(own_label: bool, k: int):
    """For mapInArrow: rows in order of (part, dims, piece, split, asks, vec_id), a block's candidates before the anchors that ask it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, [], None
        for batch in batches:
            order = np.column_stack([batch.column(i).to_numpy() for i in range(5)])
            cuts = [0, *(np.nonzero((order[1:] != order[:-1]).any(axis=1))[0] + 1).tolist(), len(order)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                *key, asks = order[start].tolist()
                if key != now:
                    now, held, block = key, [], None
                part = batch.slice(start, end - start)
                if not asks:
                    held.append(part)
                elif held and block is None:
                    ids, labels = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (5, 6))
                    block, held = Planes(integers(np.concatenate([matrix(x.column(7)) for x in held]))), held[:1]
                if asks and block is not None:
                    step = max(1, CELLS // len(ids))
                    for at in range(0, part.num_rows, step):
                        yield found(part.slice(at, step), ids, labels, block)

    def found(part: pa.RecordBatch, ids: np.ndarray, labels: np.ndarray, block: Planes) -> pa.RecordBatch:
        own, label = part.column(5).to_numpy(), part.column(6).to_numpy()
        allowed = (labels == label[:, None]) == own_label
        allowed &= ids != own[:, None]
        if own_label:
            low, high = np.full((len(own), 1), -np.inf), np.full((len(own), 1), np.inf)
        else:
            low, high = bounds(part.column(8), 1), bounds(part.column(9), 0)  # a window that isn't there is empty
        q, w, row, score = block.windows(integers(matrix(part.column(7))), allowed, low, high, k)
        exact = total(np.array([int(x) for x in score], object), 0) if len(score) else np.empty(0, np.int64)
        columns = [pa.array(own[q]), pa.array((w + 1).astype(np.int32)), pa.array(ids[row]), pa.array(exact.astype(np.int64))]
        return pa.RecordBatch.from_arrays(columns, names=["anchor_id", "window", "vec_id", "score"])

    return run


def bounds(column: pa.Array, beyond: int) -> np.ndarray:
    """The lists of a column of longs as rows of one length, filled up with `beyond`, as Python's integers."""
    lists = column.to_pylist()
    out = np.full((len(lists), max(map(len, lists))), beyond, object)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _meet(candidates: DataFrame, anchors: DataFrame, keys: list[str], own_label: bool, k: int) -> DataFrame:
    """(anchor_id, window, vec_id, score): k rows at most of each block for each anchor's window."""
    pieces = F.ceil(F.sum(F.col("dims").cast("long") * 8) / F.lit(BLOCK_BYTES))
    sizes = durable(candidates.groupBy(*keys).agg(F.greatest(F.lit(1), pieces).cast("int").alias("pieces")))
    n = sizes.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("pieces"), F.lit(0)).alias("blocks")).first()
    sizes = small(sizes, n["groups"])
    # Fewer blocks than cores: a block goes to several tasks, each of which has a part of the anchors.
    cores = candidates.sparkSession.sparkContext.defaultParallelism
    splits = -(-cores // max(1, n["blocks"]))
    order = ["part", "dims", "piece", "split", "asks", "vec_id"]
    loads = ["label", "v", *([] if own_label else ["low", "high"])]
    part = (F.col("label") if own_label else F.lit(0).cast("long")).alias("part")
    none = [] if own_label else [F.lit(None).cast("array<long>").alias(c) for c in ("low", "high")]
    dealt = candidates.join(sizes, keys).select("*", part, *none, F.pmod(F.xxhash64("vec_id", "v"), F.col("pieces")).cast("int").alias("piece"), F.lit(0).alias("asks"))
    dealt = dealt.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))))
    asked = anchors.join(sizes, keys).select("*", part, F.pmod(F.xxhash64("vec_id"), F.lit(splits)).cast("int").alias("split"), F.lit(1).alias("asks"))
    asked = asked.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    met = dealt.select(*order, *loads).unionByName(asked.select(*order, *loads))
    met = met.repartition(max(1, n["blocks"] * splits), *order[:4]).sortWithinPartitions(*order)
    return met.mapInArrow(_ask(own_label, k), "anchor_id long, window int, vec_id long, score long")


def quantised(embedding: str, scale: int) -> Column:
    """floor(scale x component), the component as double, held as a double: longs don't reach as far."""
    return F.transform(embedding, lambda x: F.rint(x.cast("double") * scale) - F.when(F.rint(x.cast("double") * scale) > x.cast("double") * scale, F.lit(1.0)).otherwise(F.lit(0.0)))


def mine(vectors: DataFrame, *, every: int = 100, positives: int = 5, negatives: int = 5, scale: int = 256, low: int = 80, whole: int = 100) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank) of vectors (vec_id, embedding, label).

    Anchors are the rows whose vec_id is divisible by `every`; a negative's score is low / whole of the positive's at
    least, and the positive's at most.
    """
    rows = vectors.filter(finite() & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), quantised("embedding", scale).alias("v")).withColumn("dims", F.size("v"))
    anchors = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("own")).select("vec_id", "own.v", "own.label").withColumn("dims", F.size("v"))

    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.col("score").desc(), "vec_id"))
    near = _meet(rows, anchors, ["dims", "label"], True, positives).withColumn("rank", place("anchor_id")).filter(F.col("rank") <= positives)
    # Below zero a window is empty. Its low end is the least integer of at least low / whole of the score; by remainders, so that no product overflows.
    ends = F.expr(f"score div {whole} * {low}") + F.ceil(F.col("score") % whole * low / whole).cast("long")
    near = durable(near.filter("score >= 0").select("anchor_id", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), ends.alias("low")))
    windows = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("window", "low", "positive_score"))).alias("w"))
    asking = anchors.join(windows, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", "dims", F.col("w.low").alias("low"), F.col("w.positive_score").alias("high"))

    found = _meet(rows, asking, ["dims"], False, negatives).withColumn("rank", place("anchor_id", "window")).filter(F.col("rank") <= negatives)
    out = found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).join(near, ["anchor_id", "window"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", F.col("window").alias("positive_rank"))


def flipped(vectors: DataFrame, each: int = 7, labels: int = 10) -> DataFrame:
    """vectors whose label is the next one where vec_id is divisible by `each`: noise to mine against."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % each == 0, (F.col("label").cast("long") + 1) % labels).otherwise(F.col("label")).cast("long"))
