"""Risk serving: any table with a column mapping becomes nodes and edges; scores are tiered, explained, listed and rolled up."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.scalar import risk_tier, sigmoid
from ledgerloom.operators.graph import adjacency
from ledgerloom.operators.ranks import quantiles
from ledgerloom.operators.sampling import first

# Names by which a column's role is known, in order of preference.
ROLE_NAMES = {
    "node_id": ("node_id", "id", "user_id", "account_id", "person_id"),
    "name": ("name", "display_name", "full_name"),
    "source": ("source", "source_id", "src", "from"),
    "target": ("target", "target_id", "dst", "to"),
    "edge_type": ("edge_type", "relation", "relation_type", "type"),
    "amount": ("amount", "value", "money"),
    "timestamp": ("timestamp", "time", "date", "created_at"),
}


@dataclass(frozen=True)
class Mapping_:
    """Which column has which role, and which columns are features."""

    roles: dict[str, str] = field(default_factory=dict)
    features: tuple[str, ...] = ()


def guess_mapping(headers: Sequence[str], names: Mapping[str, Sequence[str]] = ROLE_NAMES) -> Mapping_:
    """Roles by column name, case aside; what has no role is a feature."""
    by_name: dict[str, str] = {}
    for h in headers:
        by_name.setdefault(h.strip().lower(), h)
    roles = {}
    for role, wanted in names.items():
        hit = next((by_name[n] for n in wanted if n in by_name and by_name[n] not in roles.values()), None)
        if hit:
            roles[role] = hit
    return Mapping_(roles, tuple(h for h in headers if h not in roles.values()))


def checked_mapping(headers: Sequence[str], roles: Mapping[str, str], features: Sequence[str] | None = None) -> Mapping_:
    """A given mapping without columns that aren't there; roles and features it leaves open are guessed."""
    guessed = guess_mapping(headers)
    kept = {r: c for r, c in roles.items() if c in headers}
    kept |= {r: c for r, c in guessed.roles.items() if r not in kept and c not in kept.values()}
    wanted = [c for c in (headers if features is None else features) if c in headers and c not in kept.values()]
    return Mapping_(kept, tuple(wanted))


def ingest_nodes(raw: DataFrame, mapping: Mapping_) -> DataFrame:
    """(node_id, display_name, features map<string, double>): the first row of each id; features are what reads as a number."""
    role = mapping.roles
    if "node_id" not in role:
        raise ValueError("the mapping has no node_id")
    cast = [F.expr(f"try_cast(`{c}` AS double)") for c in mapping.features]
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in mapping.features]), F.array(*cast)) if cast else F.create_map().cast("map<string,double>")
    name = F.col(role["name"]).cast("string") if "name" in role else F.lit(None).cast("string")
    rows = raw.select(F.trim(F.col(role["node_id"]).cast("string")).alias("node_id"), name.alias("display_name"), F.map_filter(pairs, lambda k, v: v.isNotNull() & ~F.isnan(v)).alias("features"))
    kept = rows.filter(F.col("node_id").isNotNull() & (F.col("node_id") != ""))
    least = F.min(F.struct(F.coalesce("display_name", F.lit("")).alias("a"), F.to_json("features").alias("b"), F.col("display_name").alias("n")))
    return kept.groupBy("node_id").agg(least.alias("m")).select("node_id", F.col("m.n").alias("display_name"), F.from_json("m.b", "map<string,double>").alias("features"))


def ingest_edges(raw: DataFrame, mapping: Mapping_) -> DataFrame:
    """(source, target, edge_type, amount, timestamp); rows without both ends are left out, a missing type is `relation`."""
    role = mapping.roles
    text = lambda r, default=None: F.col(role[r]).cast("string") if r in role else F.lit(default).cast("string")
    amount = F.expr(f"try_cast(`{role['amount']}` AS double)") if "amount" in role else F.lit(None).cast("double")
    rows = raw.select(F.trim(text("source")).alias("source"), F.trim(text("target")).alias("target"), F.coalesce(text("edge_type"), F.lit("relation")).alias("edge_type"), amount.alias("amount"), text("timestamp").alias("timestamp"))
    return rows.filter((F.col("source") != "") & (F.col("target") != ""))


def sequence_edges(rows: DataFrame, key: str, order: Sequence[str], by: str) -> DataFrame:
    """(source, target): consecutive rows of a group, where a table has no edges of its own."""
    after = F.lead(key).over(Window.partitionBy(by).orderBy(*order))
    return rows.select(F.col(key).alias("source"), after.alias("target")).filter(F.col("target").isNotNull())


def fallback_score(nodes: DataFrame) -> DataFrame:
    """(node_id, score): the sigmoid of a node's mean feature; one half without features."""
    values = F.map_values("features")
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(values).cast("double"), F.lit(1.0))
    return nodes.select("node_id", sigmoid(mean).alias("score"))


def threshold(scores: DataFrame, quantile: float = 0.85, least: float = 0.5) -> float:
    """The score from which a node is suspicious: a quantile of all scores, at least one half."""
    return max([least, *quantiles(scores, "score", [quantile]).get((), [])])


def labelled_scores(scores: DataFrame) -> DataFrame:
    """scores with risk_label (suspicious or normal) and tier."""
    label = F.when(F.col("score") >= F.lit(threshold(scores)), "suspicious").otherwise("normal")
    return scores.withColumn("risk_label", label).withColumn("tier", risk_tier("score", "risk_label"))


def tier_counts(labelled: DataFrame) -> DataFrame:
    """(tier, n) for all three tiers."""
    tiers = labelled.sparkSession.createDataFrame([("suspicious",), ("low_risk",), ("no_risk",)], "tier string")
    return tiers.join(labelled.groupBy("tier").agg(F.count(F.lit(1)).alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def explain(nodes: DataFrame, k: int = 3) -> DataFrame:
    """(node_id, place, feature, value): the features of largest absolute value, ties by name."""
    entries = F.transform(F.map_entries("features"), lambda e: F.struct((-F.abs(e["value"])).alias("o"), e["key"].alias("feature"), e["value"].alias("value")))
    top = F.slice(F.array_sort(entries), 1, k)
    return nodes.select("node_id", F.posexplode(top).alias("place", "e")).select("node_id", (F.col("place") + 1).alias("place"), "e.feature", "e.value")


def neighbor_map(edges: DataFrame, k: int = 6) -> DataFrame:
    """(node_id, neighbors): the first k distinct neighbours of each node by id, either way; edges are (src, dst)."""
    both = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("neighbor")).unionByName(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("neighbor"))).distinct()
    kept = first(both, ["node_id"], [F.col("neighbor")], k)
    return kept.groupBy("node_id").agg(F.sort_array(F.collect_list("neighbor")).alias("neighbors"))


def ledger(labelled: DataFrame, nodes: DataFrame, search: str | None = None, limit: int | None = 30) -> DataFrame:
    """Results with the node's name, `unknown` for none, highest score first; a search looks for a keyword in the row's text.

    limit: the rows of a ledger's page.
    """
    named = labelled.join(nodes.select("node_id", F.col("display_name").alias("_name")), "node_id", "left").withColumn("display_name", F.coalesce("_name", F.lit("unknown"))).drop("_name")
    if search:
        text = F.lower(F.concat_ws(" ", F.col("node_id").cast("string"), "display_name", "risk_label", "tier"))
        named = named.filter(text.contains(search.strip().lower()))
    ordered = named.orderBy(F.col("score").desc(), "node_id")
    return ordered.limit(limit) if limit is not None else ordered


def graph_view(edges: DataFrame, scores: DataFrame, nodes: DataFrame, max_nodes: int = 300, max_edges: int = 3000) -> tuple[DataFrame, DataFrame]:
    """The first nodes by id with their scores (0 for none), and edges between them, in order of their ends."""
    shown = nodes.select("node_id").orderBy("node_id").limit(max_nodes)
    ends = lambda x: shown.select(F.col("node_id").alias(x))
    inside = edges.join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi")
    return shown.join(scores.select("node_id", "score"), "node_id", "left").select("node_id", F.coalesce("score", F.lit(0.0)).alias("score")), inside.orderBy("src", "dst", *[c for c in edges.columns if c not in ("src", "dst")]).limit(max_edges)


def focus_edges(edges: DataFrame, focus: DataFrame) -> DataFrame:
    """edges (src, dst) with `highlighted`: whether the pair, either way, is in focus (node_id, neighbors)."""
    pairs = focus.select(F.col("node_id").alias("a"), F.explode("neighbors").alias("b"))
    both = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(pairs.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct().withColumn("_hit", F.lit(True))
    return edges.join(both, ["src", "dst"], "left").withColumn("highlighted", F.coalesce("_hit", F.lit(False))).drop("_hit")


def top_counts(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """(value, n): the k most frequent values, ties by value."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(k)


def owner_rollup(networks: DataFrame) -> DataFrame:
    """For each owner: networks, their nodes and edges in all, and the latest by creation; networks is (owner, id, name, nodes, edges, created_at)."""
    latest = F.max(F.struct("created_at", "id", "name"))
    return networks.groupBy("owner").agg(F.count(F.lit(1)).alias("networks"), F.sum("nodes").alias("nodes"), F.sum("edges").alias("edges"), latest.alias("_l")).select("owner", "networks", "nodes", "edges", F.col("_l.name").alias("latest"))


def latest_task(tasks: DataFrame, events: DataFrame) -> DataFrame:
    """Of each dataset's tasks (dataset, id, updated_at) the latest that has events (task_id), or else the latest."""
    busy = events.select(F.col("task_id").alias("id")).distinct().withColumn("_busy", F.lit(1))
    ranked = tasks.join(busy, "id", "left").withColumn("_busy", F.coalesce("_busy", F.lit(0)))
    return first(ranked, ["dataset"], [F.col("_busy").desc(), F.col("updated_at").desc(), F.col("id").desc()], 1).select("dataset", "id", F.col("_busy").cast("boolean").alias("has_events"))


def without_dataset(tables: Mapping[str, DataFrame], dataset: int) -> dict[str, DataFrame]:
    """All tables without the rows of one data set: what a cascading delete leaves."""
    return {n: df.filter(~F.col("dataset").eqNullSafe(F.lit(dataset))) for n, df in tables.items()}


def degree_ranking(edges: DataFrame, k: int) -> DataFrame:
    """(node_id, degree): the k nodes of highest degree."""
    return adjacency(edges).groupBy(F.col("center").alias("node_id")).agg(F.count(F.lit(1)).alias("degree")).orderBy(F.col("degree").desc(), "node_id").limit(k)
