"""MinHash near-dedup by a chosen-path similarity join.

A text's set of shingles is described by a sketch: `coordinates` minwise values, each of which two
sets share with a chance of their Jaccard similarity. Documents walk down random trees. A node picks
coordinates by a hash of its path, 1 / similarity of them on average, and a document goes to one child for each, named by its minwise
value there. So a pair at the threshold is expected in one child of a node that holds both: it stays
together down to the leaves with a chance that falls slowly with depth (0.87, 0.78, 0.70, ...), while
less similar ones part. Each tree is drawn anew, and `rounds` of some trees each bring the
chance that no tree holds a pair together under 1 in 1,000 at a depth of three, and far lower
above the threshold.

A node of up to `most_rows` documents is a leaf: all its sketches are compared, and those that have a
likely partner there (within 3.3 deviations of the threshold) are compared by their full
sets. A larger node branches, by a coordinate its path hasn't used. A child that keeps three quarters of a large node
doesn't come apart: it is a family of near copies, and is compared by full sets through a few
pivots (`similar.linked`), which takes work in proportion to its rows if they are alike. So no node is too large to be compared, none is cut short, and no
link is made without the full sets. Nodes whose documents an earlier round has put in one component are passed over.

Equal sets are one row throughout. Documents are named by class; no pairs are listed: a group's
task gives spanning edges.

Defined results: null and empty texts, and those of white space only, have no shingles: each is a component of its own, linked
with nothing; a null doc_id takes part, and names a component only if it has no other; repeated rows are rows of their
own; an empty table gives an empty result. Texts of any length are taken whole. Only the columns doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._shared import durable, short_batches, small, written
from ledgerloom.llm.blocks import matrix
from ledgerloom.llm.similar import _whole_groups, confirmed
from ledgerloom.llm.simhash import components, shingle_hashes

#: A child with this share of a large node's documents doesn't come apart from them.
FAMILY = 0.75
#: How many deviations below the threshold an estimate still makes a candidate.
DEVIATIONS = 3.3


def minwise(own: np.ndarray, factors: np.ndarray, at_once: int = 1024) -> np.ndarray:
    """For each factor the least of its products with the hashes (modulo 2**64), its upper 32 bits."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(own), at_once):
            np.minimum(least, (own[i : i + at_once, None] * factors).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def sketches(texts: Column, shingle: int, coordinates: int, seed: int) -> Column:
    """A struct for each text: the number of distinct shingles, a 128-bit hash of their set, and the sketch."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    @F.pandas_udf("n long, h0 long, h1 long, sketch array<int>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            rows = []
            for text in batch:
                own = np.unique(shingle_hashes(text, shingle, seed))
                same = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64).tolist()
                rows.append((len(own), *same, minwise(own, factors)))
            yield pd.DataFrame(rows, columns=["n", "h0", "h1", "sketch"])

    return of(texts)


def children(node: Column, used: Column, sketch: Column, coordinates: int, similarity: float) -> Column:
    """An array of (node, used): the children of a node to which a document goes. used: the coordinates of the path."""
    free = F.array_except(F.sequence(F.lit(0), F.lit(coordinates - 1)), used)
    start = F.pmod(F.xxhash64(node), F.size(free).cast("long"))
    sure = int(1 / similarity)
    more = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(1_000_000)) < int((1 / similarity - sure) * 1_000_000)

    def child(j: int) -> Column:
        at = F.get(free, F.pmod(start + j, F.size(free).cast("long")).cast("int"))
        return F.struct(F.xxhash64(node, at, F.get(sketch, at)).alias("node"), F.concat(used, F.array(at)).alias("used"))

    all_ = F.array(*[child(j) for j in range(sure + 1)])
    return F.slice(all_, 1, F.least(F.size(free), F.when(more, sure + 1).otherwise(sure)))


def likely(nodes: np.ndarray, parts: np.ndarray, sketch: np.ndarray, need: int) -> np.ndarray:
    """Which rows have a row of another part in their node (nodes stand one after another) whose sketch agrees in `need` coordinates."""
    hit = np.zeros(len(nodes), bool)
    lag, at = 1, np.arange(len(nodes))
    while len(at := at[at + lag < len(nodes)]) and len(at := at[nodes[at] == nodes[at + lag]]):
        for i in range(0, len(at), 1 << 14):
            a = at[i : i + (1 << 14)]
            near = a[(parts[a] != parts[a + lag]) & ((sketch[a] == sketch[a + lag]).sum(axis=1) >= need)]
            hit[near] = hit[near + lag] = True
        lag += 1
    return hit


def leaves(unique: DataFrame, trees: range, *, coordinates: int, similarity: float, most_rows: int) -> tuple[DataFrame, DataFrame]:
    """(leaf, family): the members (node, id) of the nodes where documents (id, part, sketch) of more than one part meet."""
    root = F.explode(F.array(*[F.xxhash64(F.lit("tree"), F.lit(t)) for t in trees])).alias("above")
    below = lambda df: df.select("id", "part", "size", F.explode(children(F.col("above"), F.col("used"), F.col("sketch"), coordinates, similarity)).alias("c")).select("id", "part", "size", "c.*")
    level = below(unique.select("id", "part", "sketch", root, F.array().cast("array<int>").alias("used"), F.lit(None).cast("long").alias("size")))
    leaf, family = [], []
    while True:
        met = level.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("of"), F.first(F.size("used")).alias("depth"), F.min("part").alias("least"), F.max("part").alias("most"))
        kind = F.when(F.col("n") <= most_rows, "leaf").when((F.col("n") >= FAMILY * F.col("of")) | (F.col("depth") == coordinates), "family").otherwise("branch")
        sizes = written(met.filter("least < most").select("node", "n", kind.alias("kind")), "nodes")[0]
        seen = {r["kind"]: r["count"] for r in sizes.groupBy("kind").count().collect()}
        of = lambda which, level=level, sizes=sizes, seen=seen: level.join(small(sizes.filter(F.col("kind") == which).select("node", "n"), seen.get(which, 0)), "node")
        leaf.append(of("leaf").select("node", "id", "part"))
        family += [of("family").select("node", "id")] * ("family" in seen)
        if "branch" not in seen:
            break
        kept = of("branch").select("id", F.col("node").alias("above"), "used", F.col("n").alias("size"))
        level = written(below(kept.join(unique.select("id", "part", "sketch"), "id")), "branches")[0]
    all_ = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(all_(parts[1:]))
    return all_(leaf), all_(family) if family else leaf[0].select("node", "id").limit(0)


def near_duplicates(docs: DataFrame, *, shingle: int = 3, similarity: float = 0.85, coordinates: int = 64, rounds: tuple[int, ...] = (2, 4), most_rows: int = 1024, most_shingles: int = 1 << 20, seed: int = 42) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of docs (doc_id, text): texts linked at `similarity` or more, directly or by others.

    doc_id is of any type that has an order; component_id is the smallest of a component that isn't null; kept: it is
    the row's own. rounds: how many trees are walked at once. most_rows: the documents of a node that are compared by sketches at once. most_shingles:
    what one task compares at once by full sets.
    """
    short_batches(docs.sparkSession)
    told = [F.xxhash64("text").alias("t0"), F.xxhash64(F.lit(1), "text").alias("t1")]
    prints = durable(docs.select("doc_id", *told, sketches(F.col("text"), shingle, coordinates, seed).alias("s")).select("doc_id", "t0", "t1", "s.*"))
    # Equal sets of shingles are one row from here on; its smallest document speaks for it.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t0", "t1")).alias("first")
    by_set = prints.filter("n > 0").groupBy("h0", "h1").agg(first, F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    unique = durable(by_set.select(F.monotonically_increasing_id().alias("id"), "*"))
    n = unique.count()

    need = math.floor(coordinates * similarity - DEVIATIONS * math.sqrt(coordinates * similarity * (1 - similarity)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            nodes, ids, parts = (table.column(i).to_numpy() for i in range(3))
            hit = np.nonzero(likely(nodes, parts, matrix(table.column(3).combine_chunks()), need))[0]
            yield pa.RecordBatch.from_arrays([pa.array(nodes[hit]), pa.array(ids[hit])], names=["node", "id"])

    edges, roots, trees = None, None, 0
    for count in rounds:
        parted = unique.withColumn("part", F.col("id"))
        if roots is not None:
            parted = unique.join(roots, unique.id == roots.node, "left").withColumn("part", F.coalesce("root", "id")).drop("node", "root")
        leaf, family = leaves(parted, range(trees, trees + count), coordinates=coordinates, similarity=similarity, most_rows=most_rows)
        met = leaf.join(unique.select("id", "sketch"), "id").select("node", "id", "part", "sketch").repartition("node").sortWithinPartitions("node")
        meeting = durable(met.mapInArrow(compare, "node long, id long").unionByName(family))
        own = durable(_confirm(docs.select("doc_id", "text", *told), prints, unique, meeting, n, shingle, similarity, most_shingles, seed))
        edges, trees = own if edges is None else edges.unionByName(own), trees + count
        roots = components(edges, n)

    rooted = unique.join(roots, unique.id == roots.node, "left").select("h0", "h1", "first", F.coalesce("root", "id").alias("root"))
    least = durable(rooted.groupBy("root").agg(F.min("first").alias("least")), n)
    classes = durable(rooted.join(least, "root").select("h0", "h1", F.col("least.doc_id").alias("component_id")), n)
    # A group of copies may be a third of the documents; it is one row of classes, so Spark can split the join.
    linked = prints.filter("n > 0").select("doc_id", "n", "h0", "h1").join(classes, ["h0", "h1"]).select("doc_id", "n", "component_id")
    alone = prints.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _confirm(docs: DataFrame, prints: DataFrame, unique: DataFrame, meeting: DataFrame, n: int, shingle: int, similarity: float, most: int, seed: int) -> DataFrame:
    """(src, dst): edges that connect what full sets link in each node of meeting (node, id). docs: (doc_id, text, t0, t1)."""
    chosen = durable(unique.join(meeting.select("id").distinct(), "id").select("id", F.col("n").alias("weight"), F.col("first.doc_id").alias("_doc"), F.col("first.t0").alias("_t0"), F.col("first.t1").alias("_t1")), n)
    chosen = small(chosen, chosen.count())
    speaks = lambda df: (df["t0"] == F.col("_t0")) & (df["t1"] == F.col("_t1")) & df["doc_id"].eqNullSafe(F.col("_doc"))
    narrow = prints.select("doc_id", "t0", "t1")
    repeated = durable(narrow.join(chosen, speaks(narrow)).groupBy("id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("id"))
    many = repeated.count()
    texts = docs.join(chosen, speaks(docs)).select("id", "weight", "text")
    if many:  # rows that repeat in id and text: one of them
        again = small(repeated, many)
        texts = texts.join(again, "id", "left_anti").unionByName(texts.join(again, "id").dropDuplicates(["id"]))
    grouped = meeting.withColumnRenamed("node", "group")
    sizes = grouped.join(chosen.select("id", "weight"), "id").select("group", "weight")
    return confirmed(texts.join(grouped, "id").select("group", "id", "weight", "text"), sizes, shingle=shingle, similarity=similarity, most=most, seed=seed)
