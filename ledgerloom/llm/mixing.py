"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The texts of a source, laid end to end in a seeded order, are a stream of words. It is cut
into blocks of an equal number of words. Seats of the mix, one block each, go to the sources
by highest quotient w / (2k - 1); a source that is bound to `most` times its size has all its
blocks so often. This method is house-monotone: the first seats of a mix are the mix of a smaller
house, so the shards, which get runs of seats, have integer quotas of each source. A shard's quota
of a source takes its blocks in a seeded order, from where the shard before it ended, and starts
over at the end.

Everything is DataFrame functions. Defined results: a null text has no words; a null source is
a source of its own, last in order; documents without words take nothing; texts of any length are
counted whole and may lie in many blocks; a repeated row is one more document; an empty table
gives an empty result. Other columns are left out, unless `keep` names them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._shared import WORD, bucket_bits, durable, one_of_each, order_key, running_start, small

#: Weights of the sources in code-point order, repeating.
CYCLE = (5, 2, 1)


@dataclass(frozen=True)
class Mix:
    """rows: (doc_id, source, size, taken, source_size, target, shard_taken, ...) per document, shard_taken with the words
    that each shard takes, which add up to taken;
    sources: (source, weight, source_size, target, seats, n_blocks, block_words, quotas) per source;
    quotas: (shard, source, blocks), the integer quota of each source in each shard, where it has any."""

    rows: DataFrame
    sources: DataFrame
    quotas: DataFrame


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: tuple[int, ...], most: int) -> DataFrame:
    """Share all words by weight; a source stops at `most` times its size, its excess is reshared.

    In order of the share at which a source is full, the full ones come first, and a source is
    full if its bound is no more than the share of those before it: one pass of running sums.
    sizes has a row for each source.
    """
    everything = Window.partitionBy()
    named = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(named) - 1).alias("rank")
    ranked = sizes.select("source", "source_size", at)
    weighed = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), (F.col("rank") % len(cycle) + 1).cast("int")))
    earlier = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    bound = F.col("source_size").cast("double") * most
    shared = (
        weighed.withColumn("bound", bound)
        .withColumn("full_at", F.col("bound") / F.col("weight"))
        .withColumn("words", F.sum("source_size").over(everything).cast("double"))
        .withColumn("share", (F.col("words") - F.coalesce(F.sum("bound").over(earlier), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
        .withColumn("full", F.col("full_at") <= F.col("share"))
    )
    free_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    free_words = F.col("words") - F.coalesce(F.sum(F.when(F.col("full"), F.col("bound"))).over(everything), F.lit(0.0))
    return (
        shared.withColumn("free_weight", free_weight)
        .withColumn("free_words", free_words)
        .withColumn("free_sources", F.sum(F.when(~F.col("full"), F.lit(1)).otherwise(F.lit(0))).over(everything))
        .withColumn("target", F.when(F.col("full"), F.col("bound")).otherwise(F.col("free_words") / F.col("free_weight") * F.col("weight")))
        .select("source", "rank", "weight", "source_size", "target", "full", "free_weight", "free_words", "free_sources")
    )


def seats(plan: DataFrame, shards: int) -> DataFrame:
    """(rank, upto): for each source that isn't full, its seats in the houses that end with each shard, by highest quotient.

    A seat wins if its quotient is no less than a divisor; the divisor of a house lies between two that would give all
    sources half a seat more or less. Seats over the first are sure and are only counted; those between, two for each
    source and a few, are ranked. Ties go to the source that comes first.
    """
    shard = F.explode(F.sequence(F.lit(1), F.lit(shards))).alias("shard")
    free = plan.filter(~F.col("full")).select("rank", "weight", "free_weight", "free_sources", "house", (F.col("n_blocks") * F.col("most")).alias("bound"), shard)
    free = free.withColumn("size", F.floor(F.col("house") * F.col("shard") / shards))
    half = F.col("free_sources") / 2.0
    # Seats of a source whose quotient w / (2k - 1) is at least W / (2h) are those with k up to w / W h + 1 / 2.
    upto = lambda h: F.floor(F.col("weight") / F.col("free_weight") * h + 0.5)
    sure = F.greatest(F.least(upto(F.col("size") - half) - 1, F.col("bound")), F.lit(0))
    most = F.least(upto(F.col("size") + half) + 1, F.col("bound"))
    listed = free.withColumn("sure", sure).withColumn("between", F.greatest(most, F.col("sure")))
    house = Window.partitionBy("shard")
    left = listed.withColumn("left", F.col("size") - F.sum("sure").over(house))
    seat = F.explode(F.sequence(F.col("sure"), F.col("between"))).alias("seat")  # `sure` itself stands for what is sure
    quotient = F.col("weight") / (2.0 * F.col("seat") - 1.0)
    open_ = left.select("rank", "weight", "shard", "sure", "left", seat).withColumn("listed", F.col("seat") > F.col("sure"))
    place = F.row_number().over(Window.partitionBy("shard", "listed").orderBy(quotient.desc(), "rank"))
    won = open_.withColumn("won", (F.col("listed") & (place <= F.col("left"))).cast("long"))
    totals = won.groupBy("rank", "shard").agg((F.max("sure") + F.sum("won")).alias("n"))
    return totals.groupBy("rank").agg(F.transform(F.sort_array(F.collect_list(F.struct("shard", "n"))), lambda x: x["n"]).alias("upto"))


def mix(docs: DataFrame, *, cycle: tuple[int, ...] = CYCLE, most: int = 3, blocks_per_weight: int = 1024, shards: int = 8, seed: int = 17, keep: tuple[str, ...] = ()) -> Mix:
    """Mix all of docs (doc_id, source, text). keep: other columns that rows has too. blocks_per_weight: seats for each unit of weight at least,
    so a source's taken words are within about 1 / blocks_per_weight of its target."""
    base = durable(docs.select("doc_id", *keep, "source", word_count(F.col("text")).alias("size"), order_key(seed, F.col("doc_id"), F.col("text")).alias("_key")))
    bits = bucket_bits(base.count())
    plan = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), cycle, most)
    words = F.greatest(F.lit(1).cast("long"), F.floor(F.col("free_words") / (F.col("free_weight") * blocks_per_weight)))
    plan = (
        plan.withColumn("block_words", F.coalesce(words, F.lit(1).cast("long")))
        .withColumn("n_blocks", F.ceil(F.col("source_size") / F.col("block_words")).cast("long"))
        .withColumn("house", F.rint(F.col("free_words") / F.col("block_words")).cast("long"))
        .withColumn("most", F.lit(most))
    )
    plan = durable(plan)
    n_sources = plan.count()
    whole = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda q: F.floor(F.col("n_blocks") * most * q / shards))
    upto = F.when(F.col("full"), whole).otherwise(F.coalesce("upto", F.array_repeat(F.lit(0).cast("long"), shards)))
    plan = durable(plan.join(seats(plan, shards), "rank", "left").withColumn("upto", upto).withColumn("seats", F.element_at("upto", -1)))
    quota = F.transform("upto", lambda n, i: n - F.when(i > 0, F.get("upto", i - 1)).otherwise(F.lit(0)))
    plan = plan.withColumn("quotas", quota)

    # How often each shard takes each block: a seeded order of a source's blocks, gone through again and again.
    in_source = Window.partitionBy("rank")
    blocks = plan.select("rank", "source_size", "block_words", "n_blocks", "upto", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block")).filter("n_blocks > 0")
    blocks = blocks.withColumn("turn", F.row_number().over(in_source.orderBy(order_key(seed, F.col("rank"), F.col("block")), "block")) - 1)
    # Of the first n seats, those that fall to the block that is `turn`-th in order.
    so_far = lambda n: F.floor((n + F.col("n_blocks") - 1 - F.col("turn")) / F.col("n_blocks"))
    blocks = blocks.withColumn("repeats", F.transform("upto", lambda n, i: so_far(n) - F.when(i > 0, so_far(F.get("upto", i - 1))).otherwise(F.lit(0))))
    length = F.least(F.col("block_words"), F.col("source_size") - F.col("block") * F.col("block_words"))
    earlier = in_source.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.array(*[F.coalesce(F.sum(F.col("repeats")[q] * length).over(earlier), F.lit(0)) for q in range(shards)])
    blocks = durable(blocks.select("rank", "block", "repeats", before.alias("before")))
    n_blocks = blocks.count()

    placed = running_start(base, ["source"], "_key", "size", bits, ["doc_id"], "_start")
    facts = plan.select(F.col("source").alias("_source"), "rank", "block_words", "source_size", "target")
    placed = placed.join(small(facts, n_sources), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ends = F.col("_start") + F.col("size")
    for name, at in (("first", F.col("_start")), ("last", F.greatest(ends - 1, F.col("_start")))):
        side = small(blocks.select(F.col("rank").alias("_r"), F.col("block").alias("_b"), F.col("repeats").alias(f"_{name}_repeats"), F.col("before").alias(f"_{name}_before")), n_blocks)
        here = F.floor(at / F.col("block_words"))
        placed = placed.withColumn(f"_{name}_block", here).join(side, (F.col("rank") == F.col("_r")) & (F.col(f"_{name}_block") == F.col("_b")), "left").drop("_r", "_b")
    up_to = lambda name, x: F.zip_with(f"_{name}_before", f"_{name}_repeats", lambda b, r: b + r * (x - F.col(f"_{name}_block") * F.col("block_words")))
    own = F.zip_with(up_to("last", ends), up_to("first", F.col("_start")), lambda b, a: (b - a).cast("long"))
    nothing = F.array_repeat(F.lit(0).cast("long"), shards)
    placed = placed.withColumn("shard_taken", F.when(F.col("size") > 0, own).otherwise(nothing))
    taken = F.aggregate("shard_taken", F.lit(0).cast("long"), lambda a, x: a + x)
    rows = placed.select("doc_id", *keep, "size", "source_size", "target", taken.alias("taken"), "source", "shard_taken")
    quotas = plan.select("source", F.posexplode("quotas").alias("shard", "blocks")).filter("blocks > 0").select("shard", "source", "blocks")
    return Mix(rows, plan.select("source", "weight", "source_size", "target", "seats", "n_blocks", "block_words", "quotas"), quotas)


def copies(docs: DataFrame, mixed: DataFrame, *, seed: int = 17) -> DataFrame:
    """The documents of the mix: each as often as its words are taken, the fraction rounded by a seeded draw.

    docs needs unique doc_ids here. Documents of which nothing is taken, those without words among them, go.
    """
    draw = order_key(seed + 1, F.col("_id")) / float(1 << 60)
    times = F.floor(F.col("taken") / F.col("size") + draw).cast("int")
    times = mixed.filter(F.col("taken") > 0).select(F.col("doc_id").alias("_id"), "taken", "size").select("_id", times.alias("_times")).filter(F.col("_times") > 0)
    joined = docs.join(times, F.col("doc_id").eqNullSafe(F.col("_id"))).drop("_id")
    return joined.withColumn("_times", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("_times")


def copies_by_key(docs: DataFrame, mixed: DataFrame, *, seed: int = 17) -> DataFrame:
    """As copies, for doc_ids that may be null or repeated: docs and mixed have _k0 and _k1 (row_key of all columns).

    Rows with one key are alike, so what is taken of them is summed and one of them is repeated.
    """
    draw = order_key(seed + 1, F.col("_k0"), F.col("_k1")) / float(1 << 60)
    taken = mixed.groupBy("_k0", "_k1").agg(F.sum("taken").alias("taken"), F.max("size").alias("size"), F.count(F.lit(1)).alias("_n")).filter(F.col("taken") > 0)
    times = durable(taken.select("_k0", "_k1", "_n", F.floor(F.col("taken") / F.col("size") + draw).cast("int").alias("_times")).filter(F.col("_times") > 0))
    return one_of_each(docs, times).withColumn("_times", F.explode(F.array_repeat(F.lit(0), F.col("_times")))).drop("_times")
