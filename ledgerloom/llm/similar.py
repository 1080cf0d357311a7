"""Near-dedup at a given similarity of word shingles: SimHash finds candidates, Jaccard decides.

Two sets of shingles with Jaccard similarity J have a cosine of about 2J / (1 + J), and a bit of
their fingerprints differs with the angle's share of a half-turn: 15 % of all bits at 0.8.
Fingerprints have 64 x `words` bits here, over distinct shingles, and the radius is that share with
room for its estimate's deviation. Fingerprints meet in a block if they agree in all bits
of one of many bands of drawn bits; the bands are as many as find a pair at the threshold, with
its estimate's deviation, with a chance of `recall`. Of few shingles a fingerprint tells little:
texts of up to `short` shingles also meet, with certainty, by the smallest hashes of their
shingles, as many as a similar set can't lack. A block is compared by bit-sliced counters.

What meets within the radius is only a candidate. Candidates' texts are gathered by connected
component and linked by the exact Jaccard similarity of their shingle hashes, so no link is wrong,
and those of a component are all looked at, not just the pairs that met.

Both steps link rows inside groups (`linked`), and neither lists a group's pairs: a task finds a
spanning forest. A group over its bound is dealt into tiles; a few pivots go to every tile, so
that a dense group is one component after that; rows of its smaller components then meet all
tiles. So no link is lost, and the work grows with the rows of a dense group, not their square.

Defined results: null and empty texts have no shingles and are alike; texts with equal shingles,
repeats aside, are alike; a null doc_id takes part, and names a component only if it has no other;
repeated rows are rows of their own; an empty table gives an empty result. Texts of any length are
taken whole. Only the doc_id and text columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm._shared import durable, short_batches, small
from ledgerloom.llm.simhash import components, planes, shingle_hashes, within

# Fixed values of the splitmix64 generator: its step and the multipliers of its output function.
STEP, MIX_1, MIX_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: What the radius is over the expected share of differing bits, for the ties of few shingles (0.1875 for 4 of 5, not 0.1514), and the deviations it leaves room for.
TIES, ROOM = 1.25, 2.0


def wide_fingerprint(own: np.ndarray, words: int) -> np.ndarray:
    """words x 64 bits: those set in over half of the values that each of the distinct hashes seeds."""
    counts = np.zeros(words * 64, np.int64)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), 255):  # so that a byte holds the counts
            x = own[at : at + 255, None] + STEP * np.arange(1, words + 1, dtype=np.uint64)
            x = (x ^ (x >> np.uint64(30))) * MIX_1
            x = (x ^ (x >> np.uint64(27))) * MIX_2
            bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(own), bitorder="little").view(np.uint64)


def prefix_length(n: int, similarity: float) -> int:
    """How many of the smallest of n hashes hold at least one that a set of this similarity has among its own smallest."""
    return n - math.ceil(similarity * n - 1e-9) + 1 if n else 0


def sketches(texts: Column, shingle: int, words: int, similarity: float, short: int, seed: int = 42) -> Column:
    """A struct for each text: the number of distinct shingles, a 128-bit hash of their set, the fingerprint, and a short text's smallest hashes."""
    # A set of `short` hashes may be similar to one of this size.
    most = math.floor(short / similarity)

    @F.pandas_udf(f"n int, h0 long, h1 long, {', '.join(f'w{i} long' for i in range(words))}, least array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            rows = []
            for text in batch:
                own = np.unique(shingle_hashes(text, shingle, seed))
                print_ = wide_fingerprint(own, words).view(np.int64).tolist()
                same = np.frombuffer(xxhash.xxh3_128_digest(own.tobytes()), np.int64).tolist()
                least = own[: prefix_length(len(own), similarity)].view(np.int64) if len(own) <= most else np.empty(0, np.int64)
                rows.append((len(own), *same, *print_, least))
            yield pd.DataFrame(rows, columns=["n", "h0", "h1", *[f"w{i}" for i in range(words)], "least"])

    return of(texts)


def differing(similarity: float) -> float:
    """The share of bits in which fingerprints at this Jaccard similarity are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_of(width: int, similarity: float) -> int:
    """Bits that may differ: nearly four deviations over the expected share for long texts, two for the shortest."""
    share = TIES * differing(similarity)
    return int(width * (share + ROOM * math.sqrt(share * (1 - share) / width)))


def meeting(width: int, bits: int, share: float) -> list[tuple[float, float]]:
    """(chance, chance to agree in a band of drawn bits) for each number of bits that may differ."""
    log = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    chance = lambda d: math.exp(log(width, d) + d * math.log(share) + (width - d) * math.log(1 - share))
    return [(chance(d), math.exp(log(width - d, bits) - log(width, bits)) if width - d >= bits else 0.0) for d in range(width + 1)]


def drawn_bands(rows: int, width: int, similarity: float, recall: float, seed: int) -> np.ndarray:
    """(bands, bits): the drawn bits of each band."""
    bits = max(14, math.ceil(math.log2(max(2, rows))) - 10)
    apart, n = meeting(width, bits, differing(similarity)), 1
    while sum(p * (1 - (1 - meet) ** n) for p, meet in apart) < recall:
        n += 1
    draw = np.random.default_rng(seed)
    return np.array([draw.permutation(width)[:bits] for _ in range(n)])


def _pairs(words: np.ndarray, blocks: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Linked rows inside small blocks that stand one after another: each lag's rows are compared all at once."""
    for lag in range(1, int(np.bincount(blocks).max())):
        at = np.nonzero(blocks[lag:] == blocks[:-lag])[0]
        at = at[np.bitwise_count(words[at, :2] ^ words[at + lag, :2]).sum(axis=1) <= radius]
        if len(at):
            apart = planes(words[at] ^ words[at + lag])
            near = within(np.zeros((1, words.shape[1]), np.uint64), apart, radius, list(range(len(apart))))
            hit = at[np.unpackbits(near.view(np.uint8), bitorder="little")[: len(at)].astype(bool)]
            yield from zip((hit + lag).tolist(), hit.tolist(), strict=True)


def _groups(words: np.ndarray, radius: int, batch: int = 256) -> np.ndarray:
    """The first row of the group of each row of one large block; rows are compared with those from them on."""
    n = len(words)
    label, sliced = np.arange(n), planes(words)
    ones = np.bitwise_count(sliced).sum(axis=1)
    order = [p for p in range(len(sliced)) if 0 < ones[p] < n]
    for start in range(0, n, batch):
        from_word = start // 64
        hits = within(words[start : start + batch], sliced[:, from_word:], radius, order)
        near = np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little")[:, : n - from_word * 64]
        for q in np.nonzero(near.sum(axis=1) > 1)[0]:
            met = np.unique(label[from_word * 64 + np.nonzero(near[q])[0]])
            if len(met) > 1:
                label[np.isin(label, met[1:])] = met[0]
        if (label == label[0]).all():
            break
    return label


def block_links(starts: np.ndarray, words: np.ndarray, radius: int, few: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(rows, first rows): spanning edges of the links inside the blocks, which begin at `starts` (and the end)."""
    sizes, root = np.diff(starts), {}

    def find(x: int) -> int:
        while x in root:
            root[x] = root.get(root[x], root[x])
            x = root[x]
        return x

    in_small = np.repeat(sizes <= few, sizes)
    rows = np.nonzero(in_small)[0] + starts[0]
    if len(rows):
        for a, b in _pairs(words[rows], np.repeat(np.arange(len(sizes)), sizes)[in_small], radius):
            a, b = find(int(rows[a])), find(int(rows[b]))
            if a != b:
                root[max(a, b)] = min(a, b)
    edges = [np.array([(x, find(x)) for x in list(root)], int).reshape(-1, 2)]
    for i in np.nonzero(sizes > few)[0]:
        label = _groups(words[starts[i] : starts[i + 1]], radius)
        moved = np.nonzero(label != np.arange(len(label)))[0]
        edges.append(starts[i] + np.column_stack([moved, label[moved]]))
    both = np.concatenate(edges)
    return both[:, 0], both[:, 1]


def set_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Spanning edges of the pairs of sets (ascending distinct values) with at least this Jaccard similarity.

    Shared values are counted along the lists of the sets that hold a value, for one set and all others
    at once; sets that are of one component with all others are passed over.
    """
    sizes = np.array([len(x) for x in sets])
    values, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    fresh = np.ones(len(values), bool)
    fresh[1:] = values[order][1:] != values[order][:-1]
    name, starts = np.empty(len(values), int), np.append(np.nonzero(fresh)[0], len(values))
    name[order] = np.cumsum(fresh) - 1
    holders, ends = own[order], np.append(0, np.cumsum(sizes))
    label, edges = np.arange(len(sets)), []
    for i in range(len(sets)):
        if (label == label[i]).all():
            break
        mine = name[ends[i] : ends[i + 1]]
        mine = mine[starts[mine + 1] - starts[mine] > 1]
        if not len(mine):
            continue
        shared = np.bincount(np.concatenate([holders[starts[m] : starts[m + 1]] for m in mine.tolist()]), minlength=len(sets))
        close = np.nonzero((label != label[i]) & (shared >= similarity * (sizes[i] + sizes - shared) - 1e-9))[0]
        for j in close.tolist():
            if label[j] != label[i]:
                edges.append((i, j))
                label[label == label[j]] = label[i]
    return edges


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, which come in order of their first column, in tables that end where its value changes."""
    held = []
    for batch in batches:
        g = batch.column(0).to_numpy()
        if len(g):
            last = int(np.searchsorted(g, g[-1]))  # where the batch's last value begins
            if last or held and held[-1].column(0)[-1].as_py() != g[0]:
                yield pa.Table.from_batches([*held, batch.slice(0, last)])
                held = [batch.slice(last)]
            else:
                held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


Compare = Callable[[np.ndarray, pa.Table], tuple[np.ndarray, np.ndarray]]


def linked(rows: DataFrame, compare: Compare, *, most: int, sizes: DataFrame | None = None, pivots: int = 64) -> DataFrame:
    """(src, dst): edges between ids of rows (group long, id long, weight long, and what is compared), kept.

    They connect what compare links inside each group, directly or by others. compare gets the starts of some groups
    and their rows, and gives the positions of the two ends of spanning edges. most: the weight that one task compares
    at once, if a group has several rows. sizes: (group, weight) of the rows, where that is had more cheaply.
    """
    sizes = rows if sizes is None else sizes
    big = durable(sizes.groupBy("group").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n")).filter(f"n > 1 and w > {most}"))
    n_big = big.count()
    loads = [c for c in rows.columns if c not in ("group", "weight")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            g, ids = table.column("g").to_numpy(), table.column("id").to_numpy()
            starts = np.append(np.nonzero(np.append(True, g[1:] != g[:-1]))[0], len(g))
            src, dst = compare(starts, table)
            yield pa.RecordBatch.from_arrays([pa.array(ids[src], pa.int64()), pa.array(ids[dst], pa.int64())], names=["src", "dst"])

    def met(df: DataFrame, *keys: str) -> DataFrame:
        return df.select(F.xxhash64(*keys).alias("g"), *loads).repartition("g").sortWithinPartitions("g").mapInArrow(run, "src long, dst long")

    if not n_big:
        return durable(met(rows, "group"))
    tiles = F.ceil(F.col("w") / (most // 2)).cast("int")
    dealt = rows.join(small(big.select("group", tiles.alias("tiles")), n_big), "group").withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    every = lambda df, name, of: df.withColumn(name, F.explode(F.sequence(F.lit(0), F.col(of) - 1)))
    first = Window.partitionBy("group").orderBy(F.xxhash64("id", F.lit(1)), "id")
    drawn = dealt.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= pivots)
    drawn = drawn.withColumn("_w", F.sum("weight").over(first.rowsBetween(Window.unboundedPreceding, 0))).filter((F.col("_r") == 1) | (F.col("_w") <= most // 4))
    with_pivots = dealt.unionByName(every(drawn.drop("_r", "_w", "tile"), "tile", "tiles"))
    alone = met(rows.join(small(big.select("group"), n_big), "group", "left_anti"), "group")
    edges = durable(alone.unionByName(met(with_pivots, "group", "tile")))

    # In each large group, what isn't of its heaviest component so far meets everything.
    roots = components(edges)
    named = dealt.join(roots.select(F.col("node").alias("id"), "root"), "id", "left").withColumn("part", F.coalesce("root", "id")).drop("root")
    weights = named.groupBy("group", "part").agg(F.sum("weight").alias("w"))
    heaviest = weights.groupBy("group").agg(F.max(F.struct("w", "part")).alias("top"), F.sum("w").alias("w"))
    open_ = heaviest.select("group", F.col("top.part").alias("_top"), (F.col("w") - F.col("top.w")).alias("_rest")).filter("_rest > 0")
    open_ = durable(open_.withColumn("rests", F.ceil(F.col("_rest") / (most // 2)).cast("int")), n_big)
    n_open = open_.count()
    if not n_open:
        return edges
    named = named.join(small(open_, n_open), "group")
    rest = named.filter("part <> _top").withColumn("rest", F.pmod(F.xxhash64("id", F.lit(2)), F.col("rests")).cast("int"))
    meet = every(rest.drop("tile"), "tile", "tiles").unionByName(every(named, "rest", "rests"))
    return durable(edges.unionByName(met(meet, "group", "tile", "rest")))


def candidates(unique: DataFrame, n: int, *, words: int, similarity: float, recall: float, most: int, seed: int = 1) -> DataFrame:
    """(src, dst): edges that connect the n rows of unique (id, n, w0, w1, ..., least) whose fingerprints are near."""
    width, names = 64 * words, [f"w{i}" for i in range(words)]
    radius, bands = radius_of(width, similarity), drawn_bands(n, width, similarity, recall, seed)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, table = part.column("id").to_numpy(), np.column_stack([part.column(c).to_numpy() for c in names])
                bits = np.unpackbits(table.view(np.uint8), axis=1, bitorder="little")
                keys = [(bits[:, band].astype(np.int64) << np.arange(len(band))).sum(axis=1) + (b << len(band)) for b, band in enumerate(bands)]
                least = part.column("least")
                holders = np.repeat(np.arange(len(ids)), np.diff(least.offsets.to_numpy()))
                rows = np.concatenate([np.tile(np.arange(len(ids)), len(bands)), holders])
                group = np.concatenate([*keys, least.flatten().to_numpy()])
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(ids[rows]), *[pa.array(table[rows, i]) for i in range(words)]], names=["group", "id", *names])

    def compare(starts: np.ndarray, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return block_links(starts, np.column_stack([table.column(c).to_numpy() for c in names]).view(np.uint64), radius)

    keyed = unique.select("id", *names, "least").mapInArrow(meet, f"group long, id long, {', '.join(f'{c} long' for c in names)}")
    return linked(keyed.withColumn("weight", F.lit(1).cast("long")), compare, most=most)


def confirmed(texts: DataFrame, sizes: DataFrame, *, shingle: int, similarity: float, most: int, seed: int = 42) -> DataFrame:
    """(src, dst): edges that connect the texts (group, id, weight, text) of each group with at least this Jaccard similarity. sizes: (group, weight)."""

    def compare(starts: np.ndarray, table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if end - start > 1:
                sets = [np.unique(shingle_hashes(x, shingle, seed)) for x in table.column("text")[start:end].to_pylist()]
                out += [(start + i, start + j) for i, j in set_links(sets, similarity)]
        both = np.array(out, int).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    return linked(texts, compare, most=most, sizes=sizes)


def near_duplicates(docs: DataFrame, *, shingle: int = 5, similarity: float = 0.8, words: int = 4, short: int = 32, recall: float = 0.98, most_rows: int = 8192, most_shingles: int = 1 << 20) -> DataFrame:
    """(doc_id, component_id) of docs (doc_id, text): texts linked at `similarity` or more, directly or by others.

    doc_id is of any type that has an order; component_id is the smallest of a component that isn't null.
    recall: the chance that a pair just at the threshold is found by itself. most_rows, most_shingles: what one task
    compares at once by fingerprints and by shingles.
    """
    short_batches(docs.sparkSession)
    told = [F.xxhash64("text").alias("t0"), F.xxhash64(F.lit(1), "text").alias("t1")]
    prints = durable(docs.select("doc_id", *told, sketches(F.col("text"), shingle, words, similarity, short).alias("s")).select("doc_id", "t0", "t1", "s.*"))
    rows = prints.count()
    # Equal sets of shingles are one row from here on; its smallest document speaks for it.
    same = ["n", *[f"w{i}" for i in range(words)], "least"]
    by_set = prints.groupBy("h0", "h1").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t0", "t1")).alias("first"), *[F.first(c).alias(c) for c in same])
    unique = durable(by_set.select(F.monotonically_increasing_id().alias("id"), "*"), rows)
    n = unique.count()

    near = components(candidates(unique.filter("n > 0"), n, words=words, similarity=similarity, recall=recall, most=most_rows), n)
    near = near.unionByName(near.select(F.col("root").alias("node"), "root").distinct())
    found = durable(unique.join(near, unique.id == near.node).select("id", F.col("root").alias("group"), F.col("n").cast("long").alias("weight"), F.col("first.doc_id").alias("_doc"), "first.t0", "first.t1"), n)
    chosen = small(found.withColumnsRenamed({"t0": "_t0", "t1": "_t1"}), found.count())
    both = docs.select("doc_id", "text", *told).join(chosen, (F.col("t0") == F.col("_t0")) & (F.col("t1") == F.col("_t1")) & F.col("doc_id").eqNullSafe(F.col("_doc")))
    both = both.select("group", "id", "weight", "text").dropDuplicates(["id"])
    roots = components(confirmed(both, found.select("group", "weight"), shingle=shingle, similarity=similarity, most=most_shingles), n)

    rooted = unique.join(roots, unique.id == roots.node, "left").select("h0", "h1", "first", F.coalesce("root", "id").alias("root"))
    least = durable(rooted.groupBy("root").agg(F.min("first").alias("least")), n)
    classes = durable(rooted.join(least, "root").select("h0", "h1", F.col("least.doc_id").alias("component_id")), n)
    # A group of copies may be a third of the documents; it is one row of classes, so Spark can split the join.
    return prints.select("doc_id", "h0", "h1").join(classes, ["h0", "h1"]).select("doc_id", "component_id")
