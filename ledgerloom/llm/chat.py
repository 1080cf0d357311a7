"""Chat formatting: collapse cumulative snapshots, then render what remains.

A service that logs a conversation after each turn logs every prefix of it. Each conversation
gets a rolling hash over its turns (SHA-256 of the hash so far and the turn), so its prefixes
are known by the hashes along the way. Equal conversations collapse to the one with the
smallest id, and an anti-join against the prefix hashes of longer ones leaves the maximal
conversations. These are rendered in a chat-template form.

Everything is DataFrame functions. Hot prefixes (one first turn in a third of all logs) are
reduced by a map-side distinct before the join, and equal conversations by a map-side minimum;
only hashes and keys take part in these, and the turns, dealt out by conversation once, join what is left.
A conversation's turns meet in one task, as they must to be rendered as one text.

Defined results: turns are in order of (turn, role, text), nulls first; repeated rows are
turns of their own; a null role is `unknown` and a null text is empty, also for the hashes; a
turn without conv_id is a conversation of its own, so rows alike are copies of it; an empty table
gives an empty result. A control mark in a role or text is broken by a backslash, so no text can
open or end a turn. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>"


def _plain(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def rolling(turns: Column) -> Column:
    """The array of prefix hashes of an array of (turn, role, text): one for each turn, the last for the whole."""
    step = lambda done, t: F.concat(done, F.array(F.sha2(F.concat_ws("\n", F.coalesce(F.element_at(done, -1), F.lit("")), F.length(t["role"]).cast("string"), t["role"], t["text"]), 256)))
    return F.slice(F.aggregate(turns, F.array(F.lit("")), step), 2, F.size(turns))


def conversations(logs: DataFrame) -> DataFrame:
    """(key, conv_id, turns, copies): the conversations of logs (conv_id, turn, role, text); key is one column that stands for each."""
    told = logs.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.struct("turn", "role", "text")
    named = told.filter("conv_id is not null").select(F.concat(F.lit("="), F.col("conv_id").cast("string")).alias("key"), turn.alias("t"))
    whole = named.groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    whole = whole.select("key", F.substring("key", 2, 1 << 30).cast(logs.schema["conv_id"].dataType).alias("conv_id"), "turns", F.lit(1).cast("long").alias("copies"))
    # Without a conv_id, the turn is its own key, the same in a task that runs again.
    own = F.sha2(F.concat_ws("\n", F.coalesce(F.col("turn").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "text"), 256)
    alone = told.filter("conv_id is null").groupBy(own.alias("key")).agg(F.first(turn).alias("t"), F.count(F.lit(1)).alias("copies"))
    return whole.unionByName(alone.select("key", F.lit(None).cast(logs.schema["conv_id"].dataType).alias("conv_id"), F.array("t").alias("turns"), "copies"))


def maximal(logs: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, turns) of the conversations that are no proper prefix of another."""
    whole = conversations(logs).withColumn("_hashes", rolling("turns")).withColumn("_hash", F.element_at("_hashes", -1))
    first = F.min_by("key", F.struct(F.col("conv_id").isNull(), F.col("conv_id"), F.col("key")))
    unique = whole.groupBy("_hash").agg(first.alias("key"), F.sum("copies").alias("n_copies"))
    prefixes = whole.select(F.explode(F.slice("_hashes", 1, F.size("_hashes") - 1)).alias("_hash")).distinct()
    kept = unique.join(prefixes, "_hash", "left_anti").select("key", "n_copies")
    return whole.join(kept, "key").select("conv_id", F.size("turns").alias("n_turns"), "n_copies", "turns")


def render(kept: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered)."""
    part = lambda t: F.concat(F.lit(OPEN), _plain(t["role"]), F.lit("\n"), _plain(t["text"]), F.lit(CLOSE))
    return kept.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", part), "\n").alias("rendered"))
