"""Search a stated query set against all rows in blocks.

Candidates are dealt into blocks of bounded bytes by a hash; a block is indexed in one
task, and the queries, a copy of which goes to every block, stream past it. With fewer blocks than cores a block goes to several
tasks, each of which indexes it and has a part of the queries: what a query is told never depends on how many tasks there are. A block returns each
query's best rows, which are merged by rank. Neither side is broadcast or collected, and what is
copied is the query set, not the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a block's components, as doubles.
BLOCK_BYTES = 1 << 25

#: (query ids, query vectors) -> positions of queries, ids of candidates, scores.
Ask = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
#: (candidate ids in ascending order, candidate vectors) -> how to ask them.
Build = Callable[[np.ndarray, np.ndarray], Ask]


def finite(embedding: str = "embedding") -> F.Column:
    """True for a vector without null and non-finite components, and not null or empty itself."""
    good = F.forall(F.col(embedding), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & (F.size(embedding) > 0), F.lit(False))


def matrix(column: pa.Array) -> np.ndarray:
    """The lists of a column, all of one length, as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def search(vectors: DataFrame, build: Build, *, every: int, k: int, score: str) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id long, v array) with vec_id divisible by `every`, its k best.

    What build returns gives, for some queries, at most k of each one's highest scores with ties to the
    smaller id. score: the type of the scores. Rows are compared with rows of as many components only.
    A vec_id that several rows have asks once, with its smallest vector (by components from the first
    on), and none of these rows is its answer; repeats among candidates are listed each.
    """
    rows = vectors.filter(F.col("vec_id").isNotNull()).select("vec_id", "v", F.size("v").alias("dims"))
    cells = rows.agg(F.coalesce(F.sum("dims"), F.lit(0))).first()[0]
    blocks = max(1, -(-8 * cells // BLOCK_BYTES))
    splits = -(-vectors.sparkSession.sparkContext.defaultParallelism // blocks)
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dims", F.size("v"))
    dealt = lambda key, n: F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = asked.select(each(blocks).alias("block"), dealt(["vec_id"], splits).alias("split"), "dims", F.lit(1).alias("asks"), "vec_id", "v")
    candidates = rows.select(dealt(["vec_id", "v"], blocks).alias("block"), each(splits).alias("split"), "dims", F.lit(0).alias("asks"), "vec_id", "v")
    names, kinds = ["query_id", "vec_id", "score"], [pa.int64(), pa.int64(), pa.int64() if score == "long" else pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of (block, split, dims, asks, vec_id): a block's candidates, then the queries of the split."""
        now, held, ask = None, [], None
        for batch in batches:
            order = np.column_stack([batch.column(i).to_numpy() for i in range(4)])
            cuts = [0, *(np.nonzero((order[1:] != order[:-1]).any(axis=1))[0] + 1).tolist(), len(order)]
            for start, end in zip(cuts[:-1], cuts[1:], strict=True):
                if start == end:
                    continue
                *key, asks = order[start].tolist()
                if key != now:
                    now, held, ask = key, [], None
                part = batch.slice(start, end - start)
                if not asks:
                    held.append(part)
                    continue
                if held and ask is None:
                    ask = build(np.concatenate([x.column(4).to_numpy() for x in held]), np.concatenate([matrix(x.column(5)) for x in held]))
                    held = held[:1]
                if ask is not None:
                    own = part.column(4).to_numpy()
                    at, found, scores = ask(own, matrix(part.column(5)))
                    yield pa.RecordBatch.from_arrays([pa.array(own[at]), pa.array(found), pa.array(scores, kinds[2])], names=names)

    met = candidates.unionByName(queries).repartition(blocks * splits, "block", "split", "dims").sortWithinPartitions("block", "split", "dims", "asks", "vec_id")
    parts = met.mapInArrow(run, f"query_id long, vec_id long, score {score}")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return parts.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
