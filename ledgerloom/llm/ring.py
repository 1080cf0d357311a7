"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `virtual` points of a ring, and a document goes to the shard of the first
point clockwise of the hash of its doc_id. A shard takes no more rows than its bound; keys that
would overflow it continue clockwise to the next shard that has room. The bounds add up to the
rows, so that the counts of any two shards differ by one at most.

All keys on one arc (between two points) try the shards in the same order, so the overflow is
settled on the counts of the arcs, a table of shards x virtual rows however large the corpus
is: it says how many keys of an arc go where, and a key finds its shard by its rank on the arc.

Defined results: a null doc_id has the hash of an empty string; a null text has size 1 and a null
checksum; texts of any length count whole; repeated rows are rows of their own, and their order
doesn't matter; an empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._shared import bucket_bits, durable, order_key, running_start

#: Positions on the ring.
RING = 1 << 60


def points(shards: int, virtual: int, seed: int) -> list[tuple[int, int]]:
    """(position, shard) of all virtual nodes, in clockwise order; a shard's don't depend on the other shards."""
    return sorted((int(md5(f"{seed}/{s}/{v}".encode()).hexdigest()[:15], 16), s) for s in range(shards) for v in range(virtual))


def routes(shards: int, virtual: int, seed: int) -> list[list[int]]:
    """For each arc, the shards in the order in which its keys try them."""
    owners = [s for _, s in points(shards, virtual, seed)]
    return [list(dict.fromkeys(owners[i:] + owners[:i])) for i in range(len(owners))]


def settle(counts: dict[int, int], shards: int, virtual: int, seed: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, from rank, to rank, shard, first slot): where the keys of each arc go.

    Arcs are served in a seeded order, as if their keys had arrived in it.
    """
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used, out = [0] * shards, []
    way = routes(shards, virtual, seed)
    for arc in sorted(counts, key=lambda a: md5(f"{seed}/arc/{a}".encode()).digest()):
        at = 0
        for s in way[arc]:
            n = min(counts[arc] - at, room[s] - used[s])
            if n > 0:
                out.append((arc, at, at + n, s, used[s]))
                used[s], at = used[s] + n, at + n
    return out


def assign(docs: DataFrame, shards: int = 8, *, virtual: int = 128, seed: int = 11) -> DataFrame:
    """docs (doc_id, text) with size, text_crc32, shard and slot. virtual: points of each shard on the ring."""
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        order_key(seed, F.col("doc_id")).alias("_position"),
        order_key(seed, F.col("doc_id"), F.col("text")).alias("_key"),
    )
    ends = np.array([p for p, _ in points(shards, virtual, seed)])

    @F.pandas_udf("int")
    def arc_of(position: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(ends, position.to_numpy()) % len(ends), dtype="int32")

    placed = durable(sized.withColumn("_arc", arc_of("_position")))
    counts = placed.groupBy("_arc").agg(F.count(F.lit(1)).alias("n"))  # shards x virtual rows at most

    def plan(table: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(settle(dict(zip(table["_arc"].tolist(), table["n"].tolist(), strict=True)), shards, virtual, seed), columns=["_a", "_from", "_to", "shard", "_first"])

    pieces = counts.groupBy().applyInPandas(plan, "_a int, _from long, _to long, shard int, _first long")
    ranked = running_start(placed.withColumn("_one", F.lit(1)), ["_arc"], "_key", "_one", max(0, bucket_bits(placed.count()) - 4), ["doc_id", "size"], "_rank")
    # At most shards + shards x virtual pieces.
    home = ranked.join(F.broadcast(pieces), (F.col("_arc") == F.col("_a")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return home.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_first") + F.col("_rank") - F.col("_from")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

