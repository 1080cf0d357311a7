"""Kept artifacts, partial rewrites, runs in folders, JSON in text and a demonstration network as queries, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom import store_queries  # noqa: F401  its SQL is registered before
from ledgerloom.contract import GraphFrame
from ledgerloom.functions import scalar, texts
from ledgerloom.more_queries import _u, add, epochs
from ledgerloom.operators import graph, impute, rows
from ledgerloom.oracles import ORDERS, RAW, r6
from ledgerloom.plans import demo, metrics, profile
from ledgerloom.queries import ORACLES, on_orders, register
from ledgerloom.sources import artifacts, files, runs, tables
from ledgerloom.sources.shared import shared_folder


# Artifacts.
def cached_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistency profile, made once and read by the second call, whose build would fail."""
    path = shared_folder(spark, "artifact")
    asked = {"version": "1", "params": {"columns": 3}, "inputs": [f"{sf_dir}/{t}.parquet" for t in ("customer", "supplier", "orders", "lineitem")]}
    g = tables.orders_graph(spark, sf_dir)
    artifacts.kept(spark, path, lambda: profile.consistency_profile(g.nodes, g.schema.raw_columns), **asked)

    def never() -> DataFrame:
        raise AssertionError("what is kept is made again")

    return artifacts.kept(spark, path, never, **asked)[0]


def group_rewrite(g: GraphFrame) -> DataFrame:
    """Two groups written, one of them wrong and written again; both side by side."""
    spark, path = g.nodes.sparkSession, shared_folder(g.nodes.sparkSession, "groups")
    core = graph.degrees(g).select("node_id", "indegree", "outdegree")
    stale = core.select("node_id", (F.col("indegree") + 1).alias("indegree"), "outdegree")
    artifacts.write_groups({"core": stale, "attr": rows.row_attr_stats(g).select("node_id", "utpm_missing_count")}, path)
    artifacts.write_groups({"core": core}, path)
    return artifacts.read_group(spark, path, "core").join(artifacts.read_group(spark, path, "attr"), "node_id")


register("cached_profile", cached_profile)
on_orders("group_rewrite", group_rewrite)
add("cached_profile", ORACLES["consistency_profile"])
add("group_rewrite", f"WITH {ORDERS}, d AS (SELECT center, count(*) FILTER (dir = 'in') AS i, count(*) FILTER (dir = 'out') AS o FROM adj GROUP BY center) SELECT node_id, {r6('coalesce(i, 0)', 'indegree')}, {r6('coalesce(o, 0)', 'outdegree')}, {r6('len(list_filter([x0, x1, x2], lambda v: v = -1))', 'utpm_missing_count')} FROM nodes LEFT JOIN d ON center = node_id")


# Runs in folders.
def recovered_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Priorities as runs, states as data sets, orders as epochs, written as a tree of files; one data set of each run has no epochs."""
    path = shared_folder(spark, "runs")
    rows_ = epochs(spark, sf_dir).withColumn("val_auc", F.col("val_auc").cast("string"))
    kinds = rows_.select("method", "dataset").distinct().collect()
    for method in sorted({r["method"] for r in kinds}):
        top = f"{path}/comparison/{method}"
        names = sorted(r["dataset"] for r in kinds if r["method"] == method)
        spark.createDataFrame([(f"run {method}", [*names, "absent"])], runs.CONFIG).coalesce(1).write.json(f"{top}/config")
        for name in names:
            rows_.filter((F.col("method") == method) & (F.col("dataset") == name)).select("epoch", "val_auc").write.option("header", True).csv(f"{top}/{name}")
    return runs.recovered(spark, path, config_files="*.json", epoch_files="*.csv")


register("recovered_runs", recovered_runs)
_RUNS = "r AS (SELECT o_orderpriority AS name, o_orderstatus AS dataset, o_orderkey AS epoch, o_totalprice / 1e6 AS v FROM orders), b AS (SELECT name, dataset, arg_min(epoch, (-v, epoch)) AS best, max(v) AS v, max(epoch) AS last FROM r GROUP BY ALL)"
add("recovered_runs", f"WITH {_RUNS}, a AS (SELECT name, dataset FROM b UNION SELECT name, 'absent' FROM b) SELECT 'comparison' AS kind, a.name, 'run ' || a.name AS display_name, a.dataset, best::INTEGER AS best_epoch, {r6('v', 'val_auc')}, last::INTEGER AS last_epoch FROM a LEFT JOIN b ON b.name = a.name AND b.dataset = a.dataset")


# A wide table without header.
def headerless(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "headerless")
    c = tables.table(spark, sf_dir, "customer")
    c.select("c_custkey", (F.col("c_nationkey") + 1).alias("step"), F.col("c_acctbal").cast("float").alias("a"), (F.col("c_custkey") % 8 / 4).alias("b")).write.csv(path)
    read = files.read_headerless(spark, path)
    return read.select("key", F.col("step").cast("int").alias("step"), F.round("f0", 0).alias("f0"), F.col("f1").cast("double").alias("f1"))


register("headerless_table", headerless)
add("headerless_table", f"SELECT c_custkey AS key, (c_nationkey + 1)::INTEGER AS step, {r6('round(c_acctbal::FLOAT)::DOUBLE', 'f0')}, {r6('c_custkey % 8 / 4.0', 'f1')} FROM customer")


# JSON in text.
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as objects inside an answer's text, every fifth nation's cut short, every seventh's without any."""
    # Few bytes make much work here, so rows are dealt to all cores, not left in the few parts that a small file has.
    c = tables.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name", "c_acctbal").repartition("c_custkey")
    object_ = F.concat(F.lit('{"id": '), F.col("c_custkey"), F.lit(', "who": {"name": "'), F.col("c_name"), F.lit('", "note": "a } and \\"{"}, "balance": '), F.format_string("%.2f", "c_acctbal"), F.lit(', "tags": ["x", "y"]}'))
    whole = F.concat(F.lit("Here it is:\n```json\n"), object_, F.lit("\n``` {not this}"))
    text = F.when(F.col("c_nationkey") % 5 == 0, F.substr(whole, F.lit(1), F.lit(60))).when(F.col("c_nationkey") % 7 == 0, F.lit("none")).otherwise(whole)
    toml = F.concat(F.lit('model = "m'), F.col("c_nationkey"), F.lit('"\n[providers.a]\nurl = "first"\n[providers.b]\nurl = "u'), F.col("c_custkey"), F.lit('"\n'))
    v = c.select("*", texts.parsed(text).alias("v"), toml.alias("toml"))
    summary = F.when(F.col("c_nationkey") % 2 == 0, F.create_map(F.lit("name"), F.col("c_name")))
    merged = texts.updated(texts.with_defaults(summary, {"name": F.lit("none"), "kind": F.lit("person")}), {"id": F.col("c_custkey")})
    return v.select(
        "c_custkey",
        texts.field(F.col("v"), "$.id", "long").alias("id"),
        texts.field(F.col("v"), "$.who.name", "string").alias("name"),
        texts.field(F.col("v"), "$.balance", "double").alias("balance"),
        texts.field(F.col("v"), "$.tags[1]", "string").alias("tag"),
        texts.field(F.col("v"), "$.who", "double").alias("wrong"),
        texts.toml_string(F.col("toml"), "model").alias("model"),
        texts.toml_string(texts.toml_block(F.col("toml"), "providers.b"), "url").alias("url"),
        F.concat_ws("|", *[F.concat(F.lit(f"{k}="), merged[k]) for k in ("id", "kind", "name")]).alias("summary"),
    )


register("json_fields", json_fields)
add("json_fields", f"SELECT c_custkey, CASE WHEN k THEN c_custkey END::BIGINT AS id, CASE WHEN k THEN c_name END AS name, {r6('CASE WHEN k THEN c_acctbal END', 'balance')}, CASE WHEN k THEN 'y' END AS tag, NULL::DOUBLE AS wrong, 'm' || c_nationkey AS model, 'u' || c_custkey AS url, 'id=' || c_custkey || '|kind=person|name=' || CASE c_nationkey % 2 WHEN 0 THEN c_name ELSE 'none' END AS summary FROM (SELECT *, c_nationkey % 5 <> 0 AND c_nationkey % 7 <> 0 AS k FROM customer)")


# A demonstration network: the validation nodes as people, and all nodes' relations.
def validation(g: GraphFrame) -> DataFrame:
    return metrics.time_split(g).filter("part = 'val'").select("node_id")


def demo_people(g: GraphFrame) -> DataFrame:
    found = demo.people(graph.degrees(g), validation(g))
    return found.select("node_id", "display_name", "id_number", "phone", "region", "occupation", F.col("features")["core_feature_00"].alias("first"), F.size("features").alias("shown"))


on_orders("demo_people", demo_people)
on_orders("demo_relations", lambda g: demo.relations(g, g.nodes.select("node_id")))
_PICKED = lambda n: f"([{', '.join(repr(x) for x in demo.LISTS[n])}])[least(floor({_u(demo.SEEDS[n], 'node_id')} * {len(demo.LISTS[n])}), {len(demo.LISTS[n]) - 1})::INTEGER + 1]"
_NUMBER = lambda n, a, b, d: f"lpad((least(floor({_u(demo.SEEDS[n], 'node_id')} * {b - a + 1}), {b - a}) + {a})::BIGINT::VARCHAR, {d}, '0')"
_N = {n: _NUMBER(n, *x) for n, x in demo.NUMBERS.items()}
_VAL = ORACLES["time_split"].replace("SELECT node_id, CASE WHEN y IN (0, 1) AND first_active >= d THEN", ", part AS (SELECT node_id, CASE WHEN y IN (0, 1) AND first_active >= d THEN") + ")"
add(
    "demo_people",
    f"{_VAL}, dg AS (SELECT center, count(*) FILTER (dir = 'in') AS i FROM adj GROUP BY center) SELECT node_id, {_PICKED('family')} || {_PICKED('given')} AS display_name, {_PICKED('area')} || {_N['year']} || {_N['month']} || {_N['day']} || {_N['sequence']} || {_N['check']} AS id_number, '1' || {_PICKED('carrier')} || {_N['phone']} AS phone, {_PICKED('region')} AS region, {_PICKED('occupation')} AS occupation, {r6('coalesce(i, 0)', 'first')}, 5 AS shown FROM part LEFT JOIN dg ON center = node_id WHERE part = 'val'",
)
add("demo_relations", f"WITH {ORDERS} SELECT src AS source, dst AS target, 'rel_' || edge_type AS edge_type, day FROM edges WHERE src IN (SELECT node_id FROM nodes) AND dst IN (SELECT node_id FROM nodes)")


# Reports of a split, profiles of training rows, names for users, and forced gaps.
def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of each customer's nation and number."""
    c = tables.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    words = F.array(*[F.lit(x) for x in (" Core_Feature_", "feature_x", "Amount", "风险 amount", "midday", "cities", "edge_", "OUT_", "riskier", "device", "zzz", "degree_of_risk")])
    name = F.concat(F.get(words, (F.col("c_nationkey") % 12).cast("int")), F.when(F.col("c_nationkey") % 12 == 1, F.lit("")).otherwise(F.col("c_custkey").cast("string")))
    return c.select("c_custkey", scalar.shown_name(name).alias("shown"))


def gaps(g: GraphFrame) -> DataFrame:
    """x0 and x1 missing in some of the training nodes that lack x0, until 0.05 values are missing in each on average; x2 is the degree throughout."""
    rows_ = g.nodes.select("node_id", "x0", "x1", "x2", (F.col("x0") == -1.0).alias("filled"))
    made = impute.missing_to_target(rows_, ["x0", "x1", "x2"], metrics.time_split(g).filter("part = 'train'").select("node_id"), 0.05, filled="filled", keep=["x2"])
    return impute.with_degrees(made, graph.degrees(g), {"x2": "outdegree"}).select("node_id", "x0", "x1", "x2")


on_orders("split_report", metrics.split_report)
on_orders("feature_profile_train", lambda g: profile.feature_profile(g, metrics.time_split(g).filter("part = 'train'")))
on_orders("largest_gaps", lambda g: profile.largest_gaps(g, 2))
register("shown_names", named)
on_orders("missing_to_target", gaps)
_PART = ORACLES["time_split"].replace("SELECT node_id, CASE WHEN y IN (0, 1) AND first_active >= d THEN", ", part AS (SELECT node_id, y, first_active, CASE WHEN y IN (0, 1) AND first_active >= d THEN") + ")"
add("split_report", f"{_PART} SELECT part, count(*)::BIGINT AS size, count(*) FILTER (y = 1)::BIGINT AS positive_count, {r6('count(*) FILTER (y = 1) / count(*)', 'positive_rate')}, {r6('median(first_active)', 'first_active_median')} FROM part GROUP BY part")
_QS = {f"q{round(100 * q):02d}": q for q in profile.QUANTILES}
_TRAINED = lambda q: f"quantile_cont(value, {q}) FILTER (part = 'train')"
add(
    "feature_profile_train",
    f"{_PART}, long AS (SELECT n.y, p.part, unnest({list(RAW)}) AS feature, unnest([{', '.join(f'n.{c}::DOUBLE' for c in RAW)}]) AS value FROM nodes n JOIN part p ON p.node_id = n.node_id) SELECT feature, {r6('avg(value)', 'mean')}, {r6('stddev_pop(value)', 'std')}, {r6('avg(value) FILTER (y = 0)', 'normal_mean')}, {r6('avg(value) FILTER (y = 1)', 'fraud_mean')}, {r6('abs(avg(value) FILTER (y = 1) - avg(value) FILTER (y = 0))', 'mean_gap')}, {r6('avg(CASE WHEN value = -1 THEN 1.0 ELSE 0.0 END)', 'missing_ratio')}, {', '.join(r6(f'quantile_cont(value, {q})', n) for n, q in _QS.items())}, {', '.join(r6(_TRAINED(q), f'train_{n}') for n, q in _QS.items())} FROM long GROUP BY feature",
)
add("largest_gaps", f"SELECT feature, mean_gap FROM ({ORACLES['feature_profile']}) ORDER BY mean_gap DESC, feature LIMIT 2")
_WORDS = ["amount", "", "交易金额特征", "", "时间行为特征", "业务行为特征", "关系网络特征", "资金流向特征", "历史风险特征", "账户环境特征", "业务行为特征", "交易频次特征"]
add("shown_names", f"SELECT c_custkey, CASE c_nationkey % 12 WHEN 0 THEN ({list(scalar.NUMBERED_NAMES)})[c_custkey % 16 + 1] WHEN 1 THEN '业务行为特征' WHEN 3 THEN '风险 amount' || c_custkey ELSE ({_WORDS})[(c_nationkey % 12)::INTEGER + 1] END AS shown FROM customer")
add(
    "missing_to_target",
    f"""{_PART}, tr AS (SELECT n.* FROM nodes n JOIN part p ON p.node_id = n.node_id AND p.part = 'train'), w AS (SELECT round_even(0.05 * count(*) / 2, 0)::BIGINT AS n FROM tr), f AS (SELECT * FROM tr WHERE x0 = -1 OR (SELECT count(*) FROM tr WHERE x0 = -1) = 0),
h AS (SELECT node_id FROM f QUALIFY row_number() OVER (ORDER BY abs(x0) + abs(x1) + abs(x2), node_id) <= (SELECT n FROM w)), d AS (SELECT center, count(*) FILTER (dir = 'out') AS o FROM adj GROUP BY center)
SELECT n.node_id, {r6('CASE WHEN n.node_id IN (SELECT * FROM h) THEN -1 ELSE x0 END', 'x0')}, {r6('CASE WHEN n.node_id IN (SELECT * FROM h) THEN -1 ELSE x1 END', 'x1')}, {r6('coalesce(o, 0)', 'x2')} FROM nodes n LEFT JOIN d ON center = n.node_id""",
)
