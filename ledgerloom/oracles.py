"""DuckDB SQL that says the same as the graph queries, over the same tables.

`ORDERS` and `EVENTS` are common table expressions for the two test graphs: nodes, edges, and adj,
which sees each edge from both ends.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

_ADJ = """
adj AS (SELECT src AS center, dst AS neighbor, 'out' AS dir, edge_type, day FROM edges UNION ALL SELECT dst, src, 'in', edge_type, day FROM edges),
ladj AS (SELECT adj.*, n.y AS far_y FROM adj LEFT JOIN nodes n ON n.node_id = adj.neighbor),
md AS (SELECT max(day) AS md FROM edges),
act AS (SELECT n.node_id, coalesce(a.first_active, (SELECT md FROM md) + 1)::INTEGER AS first_active, coalesce(a.last_active, 0)::INTEGER AS last_active
  FROM nodes n LEFT JOIN (SELECT center, min(day) AS first_active, max(day) AS last_active FROM adj GROUP BY center) a ON a.center = n.node_id),
coh AS (SELECT node_id, greatest(floor((first_active - 1) / 30.0), 0)::BIGINT AS cohort FROM act),
w0 AS (SELECT quantile_cont(day, [0, 0.25, 0.5, 0.75, 1]) AS q, max(day) AS md FROM edges),
w1 AS (SELECT *, floor(q[1]) AS s1, greatest(ceil(q[2]), floor(q[1])) AS e1 FROM w0),
w2 AS (SELECT *, greatest(floor(q[2]), e1 + 1) AS s2, greatest(ceil(q[3]), greatest(floor(q[2]), e1 + 1)) AS e2 FROM w1),
w3 AS (SELECT *, greatest(floor(q[3]), e2 + 1) AS s3, greatest(ceil(q[4]), greatest(floor(q[3]), e2 + 1)) AS e3 FROM w2),
w4 AS (SELECT *, greatest(floor(q[4]), e3 + 1) AS s4, md AS e4 FROM w3),
win AS (SELECT unnest([1, 2, 3, 4])::INTEGER AS window_idx, unnest([s1, s2, s3, s4])::INTEGER AS start_day, unnest([e1, e2, e3, e4])::INTEGER AS end_day FROM w4),
buck AS (SELECT node_id, first_active, (coalesce(max(window_idx) FILTER (first_active BETWEEN start_day AND end_day), 1) - 1)::INTEGER AS time_bucket FROM act CROSS JOIN win GROUP BY ALL),
snap AS (SELECT b.*, w.end_day AS window_end FROM buck b JOIN win w ON w.window_idx = b.time_bucket + 1)"""

ORDERS = (
    """
edges AS (SELECT o_custkey AS src, 1000000 + l_suppkey AS dst, list_position(['AF', 'AO', 'NF', 'NO', 'RF', 'RO'], l_returnflag || l_linestatus) AS edge_type,
  (date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) + 1)::INTEGER AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
nodes AS (SELECT c_custkey AS node_id, CASE WHEN c_acctbal < 0 THEN -1.0 ELSE c_acctbal END AS x0, c_nationkey::DOUBLE AS x1, coalesce(n, 0)::DOUBLE AS x2,
  CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 0 WHEN 'AUTOMOBILE' THEN 0 WHEN 'HOUSEHOLD' THEN 2 ELSE -100 END AS y
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
  UNION ALL SELECT 1000000 + s_suppkey, CASE WHEN s_acctbal < 0 THEN -1.0 ELSE s_acctbal END, s_nationkey::DOUBLE, -1.0, CASE WHEN s_nationkey % 2 = 0 THEN 3 ELSE -100 END FROM supplier),"""
    + _ADJ
)
EVENTS = (
    """
edges AS (SELECT a.user_id AS src, b.user_id AS dst, list_position(['click', 'view', 'purchase', 'signup', 'error'], b.event_type) AS edge_type,
  (date_diff('day', DATE '2024-01-01', CAST(b.ts AS DATE)) + 1)::INTEGER AS day FROM events a JOIN events b ON b.event_id = a.event_id + 1),
nodes AS (SELECT user_id AS node_id, count(*)::DOUBLE AS x0, -100 AS y FROM events GROUP BY 1),"""
    + _ADJ
)
DIRS, ALL = ("in", "out"), ("out", "in", "total")
RAW = ("x0", "x1", "x2")
BG = "far_y IN (2, 3)"


def r6(expr: str, name: str) -> str:
    """Six decimals, by the same rule as functions.scalar.r6."""
    return f"round(CAST({expr} AS DOUBLE) + 3e-9, 6) + 0.0 AS {name}"


def ratio(n: str, d: str) -> str:
    return f"({n}) / (({d}) + 1.0)"


def d_(d: str) -> str:
    return "true" if d == "total" else f"dir = '{d}'"


def per_node(graph: str, aggs: Mapping[str, str], out: Mapping[str, str] | Sequence[str], source: str = "adj", default: str = "0", more: str = "", joins: str = "") -> str:
    """A row for each node: `aggs` over the rows of `source` by center, defaults where there are none, then `out` of them."""
    out = out if isinstance(out, Mapping) else {x: x for x in out}
    return f"""WITH {graph}{more},
a AS (SELECT center, {", ".join(f"{e} AS {n}" for n, e in aggs.items())} FROM {source} GROUP BY center),
f AS (SELECT n.node_id, {", ".join(f"coalesce(a.{n}, {default}) AS {n}" for n in aggs)} FROM nodes n LEFT JOIN a ON a.center = n.node_id)
SELECT f.node_id, {", ".join(r6(e, n) for n, e in out.items())} FROM f{joins}"""


def count(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})::DOUBLE"


def z(value: str, mask: str = "true") -> str:
    v = f"CASE WHEN {mask} THEN ({value})::DOUBLE END"
    return f"coalesce((({v}) - avg({v}) OVER c) / greatest(stddev_pop({v}) OVER c, 1e-6), 0)"


def _degree() -> str:
    return per_node(ORDERS, {"i": count("dir = 'in'"), "o": count("dir = 'out'")}, {"indegree": "i", "outdegree": "o", "total_degree": "i + o", "out_over_in_plus1": ratio("o", "i"), "in_over_out_plus1": ratio("i", "o")})


SNAP = ",\nsadj AS (SELECT l.*, s.window_end, s.first_active FROM ladj l JOIN snap s ON s.node_id = l.center WHERE l.day <= s.window_end)"
FAR = ",\nfadj AS (SELECT a.*, n.x0, n.x1, n.x2 FROM adj a JOIN nodes n ON n.node_id = a.neighbor),\nfsnap AS (SELECT a.* FROM fadj a JOIN snap s ON s.node_id = a.center WHERE a.day <= s.window_end)"
BORN = ",\nyoung AS (SELECT l.*, l.day - b.first_active AS age FROM ladj l JOIN act b ON b.node_id = l.center)"


def _profile(source: str, prefix: str) -> str:
    kinds = {"mean": "avg({c})", "max": "max({c})", "missing_ratio": "avg(CASE WHEN {c} = -1 THEN 1.0 ELSE 0.0 END)"}
    aggs = {f"{prefix}{d}_neighbor_{k}_{c}": e.format(c=c) + f" FILTER (WHERE dir = '{d}')" for k, e in kinds.items() for d in DIRS for c in RAW}
    return per_node(ORDERS, aggs, list(aggs), source=source, more=FAR)


def _sums(p: str) -> dict[str, str]:
    return {f"{p}_in_count": f"{p}_in_count", f"{p}_out_count": f"{p}_out_count", f"{p}_total_count": f"{p}_in_count + {p}_out_count"}


def _both(p: str) -> str:
    return f"{p}_in_count + {p}_out_count"


def _snapshot() -> str:
    aggs = {f"snap_{d}_count": count(d_(d)) for d in DIRS} | {f"snap_bg_{d}_count": count(f"dir = '{d}' AND {BG}") for d in DIRS}
    out = _sums("snap") | {"snap_out_over_in_plus1": ratio("snap_out_count", "snap_in_count"), "snap_in_over_out_plus1": ratio("snap_in_count", "snap_out_count")} | _sums("snap_bg")
    out |= {f"snap_bg_{d}_ratio": ratio(f"snap_bg_{d}_count", f"snap_{d}_count") for d in DIRS} | {"snap_bg_total_ratio": ratio(_both("snap_bg"), _both("snap")), "snapshot_day": "s.window_end", "snapshot_age": "greatest(s.window_end - s.first_active, 0)"}
    return per_node(ORDERS, aggs, out, source="sadj", more=SNAP, joins=" JOIN snap s ON s.node_id = f.node_id")


def _snapshot_recent() -> str:
    aggs, out = {f"snap_{d}_count": count(d_(d)) for d in DIRS}, {}
    for w in (14, 60):
        late = f"day > window_end - {w}"
        aggs |= {f"recent_{w}_{d}_count": count(f"dir = '{d}' AND {late}") for d in DIRS} | {f"recent_{w}_bg_{d}_count": count(f"dir = '{d}' AND {late} AND {BG}") for d in DIRS}
        p, b = f"recent_{w}", f"recent_{w}_bg"
        out |= _sums(p) | _sums(b) | {f"{p}_total_over_snapshot": ratio(_both(p), _both("snap")), f"{b}_total_over_snapshot": ratio(_both(b), _both("snap"))}
    return per_node(ORDERS, aggs, out, source="sadj", more=SNAP)


def _early() -> str:
    aggs, out = {}, {}
    for w in (7, 30):
        aggs |= {f"start_{w}_{d}_count": count(f"dir = '{d}' AND age < {w}") for d in DIRS} | {f"start_{w}_bg_{d}_count": count(f"dir = '{d}' AND age < {w} AND {BG}") for d in DIRS}
        out |= _sums(f"start_{w}") | _sums(f"start_{w}_bg")
    types = {f"start_30_{d}_type_{t}_count": count(f"dir = '{d}' AND age < 30 AND edge_type = {t}") for t in range(1, 7) for d in DIRS}
    return per_node(ORDERS, aggs | types, out | {n: n for n in types}, source="young", more=BORN)


def _windows() -> str:
    cut = "(SELECT {}_day FROM win WHERE window_idx = {})"
    aggs = {f"window_{i}_{d}_count": count(f"dir = '{d}' AND day BETWEEN {cut.format('start', i)} AND {cut.format('end', i)}") for i in range(1, 5) for d in DIRS}
    both = {i: f"(window_{i}_in_count + window_{i}_out_count)" for i in range(1, 5)}
    out = {n: e for i in both for n, e in ((f"window_{i}_in_count", f"window_{i}_in_count"), (f"window_{i}_out_count", f"window_{i}_out_count"), (f"window_{i}_total_count", both[i]))}
    return per_node(ORDERS, aggs, out | {"early_late_total_ratio": f"({both[1]} + {both[2]} + 1.0) / ({both[3]} + {both[4]} + 1.0)"})


def _concentration() -> str:
    parts, columns = [], []
    for w in (7, 30, 90):
        for d in ALL:
            parts.append(f"""p_{d}_{w} AS (SELECT center, max(c) / (sum(c) + 1.0) AS s, CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END AS h
  FROM (SELECT center, c, c / sum(c) OVER (PARTITION BY center) AS p FROM (SELECT center, neighbor, count(*)::DOUBLE AS c FROM adj, md WHERE day > md - {w} AND {d_(d)} GROUP BY ALL)) GROUP BY center)""")
        columns += [r6(f"coalesce(p_{d}_{w}.s, 0)", f"tcc_{d}_top_share_{w}") for d in ALL] + [r6(f"coalesce(p_{d}_{w}.h, 0)", f"tcc_{d}_entropy_{w}") for d in ALL]
    joins = " ".join(f"LEFT JOIN p_{d}_{w} ON p_{d}_{w}.center = n.node_id" for w in (7, 30, 90) for d in ALL)
    return f"WITH {EVENTS}, {', '.join(parts)} SELECT n.node_id, {', '.join(columns)} FROM nodes n {joins}"


def _bursts(windows: Sequence[int]) -> str:
    return (
        ",\nbyday AS (SELECT center, day, count(*) FILTER (WHERE dir = 'out') AS bo, count(*) FILTER (WHERE dir = 'in') AS bi, count(*) AS bt FROM adj GROUP BY ALL),\nburst AS (SELECT center, "
        + ", ".join(f"max(CASE WHEN day > md - {w} THEN b{d[0]} ELSE 0 END)::DOUBLE AS {d}_b{w}" for w in windows for d in ALL)
        + " FROM byday, md GROUP BY center)"
    )


def _burst() -> str:
    return f"WITH {EVENTS}{_bursts((7,))} SELECT n.node_id, {', '.join(r6(f'coalesce({d}_b7, 0)', f'burst_{d}_7') for d in ALL)} FROM nodes n LEFT JOIN burst ON center = n.node_id"


def _motif() -> str:
    more = (
        _bursts((7,))
        + """,
rec AS (SELECT src, dst FROM edges, md WHERE day > md - 14), dp AS (SELECT DISTINCT src, dst FROM rec),
mutual AS (SELECT a.src AS v, count(*)::DOUBLE AS n FROM dp a JOIN dp b ON a.src = b.dst AND a.dst = b.src GROUP BY 1),
deg AS (SELECT center, count(*)::DOUBLE AS g FROM adj GROUP BY 1),
o AS (SELECT src AS v, count(*)::DOUBLE AS n, count(DISTINCT dst)::DOUBLE AS u, sum(g) AS gs, sum(ln(1 + g)) AS gl FROM rec JOIN deg ON center = dst GROUP BY 1),
i AS (SELECT dst AS v, count(*)::DOUBLE AS n, count(DISTINCT src)::DOUBLE AS u, sum(g) AS gs, sum(ln(1 + g)) AS gl FROM rec JOIN deg ON center = src GROUP BY 1)"""
    )
    c = lambda x: f"coalesce({x}, 0)"
    out = {"tm14_recip_out_unique": c("mutual.n"), "tm14_recip_in_unique": c("mutual.n")}
    for d, t in (("out", "o"), ("in", "i")):
        out |= {f"tm14_recip_{d}_ratio": ratio(c("mutual.n"), c(f"{t}.u")), f"tm14_repeat_{d}_ratio": f"1.0 - {ratio(c(f'{t}.u'), c(f'{t}.n'))}"}
        out |= {f"tm14_neighbor_totaldeg_{d}_mean": f"{c(f'{t}.gs')} / greatest({c(f'{t}.n')}, 1.0)", f"tm14_neighbor_totaldeg_{d}_logsum": c(f"{t}.gl"), f"tm7_{d}_burst_maxday": c(f"{d}_b7")}
    joins = "LEFT JOIN mutual ON mutual.v = n.node_id LEFT JOIN o ON o.v = n.node_id LEFT JOIN i ON i.v = n.node_id LEFT JOIN burst ON burst.center = n.node_id"
    return f"WITH {EVENTS}{more} SELECT n.node_id, {', '.join(r6(e, n) for n, e in out.items())} FROM nodes n {joins}"


def _cosine() -> str:
    return f"""WITH v AS (SELECT vec_id AS node_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
s AS (SELECT a.node_id AS src, b.node_id AS dst, list_dot_product(a.v, b.v) / greatest(sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)), 1e-6) AS s FROM v a JOIN v b ON b.node_id = a.node_id + 1)
SELECT node_id, {", ".join(r6(f"coalesce({t}.s, 0)", f"{d}_cosine_{k}") for k in ("sum", "mean", "max") for d, t in (("out", "o"), ("in", "i")))}
FROM v LEFT JOIN s o ON o.src = node_id LEFT JOIN s i ON i.dst = node_id"""


def _row_stats() -> str:
    seen = "list_filter([x0, x1, x2], lambda v: v <> -1)"
    part = lambda cond: f"len(list_filter(s, lambda v: v {cond} 0)) / n"
    out = {
        "utpm_missing_count": "3 - len(s)", "utpm_missing_ratio": "(3 - len(s)) / 3.0", "utpm_valid_count": "n", "utpm_valid_mean": "t / n",
        "utpm_valid_std": "sqrt(greatest(q / n - (t / n) * (t / n), 0))", "utpm_valid_min": "coalesce(list_min(s), 0)", "utpm_valid_max": "coalesce(list_max(s), 0)",
        "utpm_zero_ratio": part("="), "utpm_pos_ratio": part(">"), "utpm_neg_ratio": part("<"), "utpm_l1_norm": "b", "utpm_l2_norm": "sqrt(q)", "utpm_mean_abs": "b / n",
        "utpm_max_abs": "coalesce(list_max(list_transform(s, lambda v: abs(v))), 0)", "utpm_raw_x0": "x0", "utpm_raw_x1": "x1",
    }
    return f"""WITH {ORDERS}, s AS (SELECT *, {seen} AS s FROM nodes),
t AS (SELECT *, greatest(len(s), 1)::DOUBLE AS n, coalesce(list_sum(s), 0) AS t, coalesce(list_sum(list_transform(s, lambda v: v * v)), 0) AS q, coalesce(list_sum(list_transform(s, lambda v: abs(v))), 0) AS b FROM s)
SELECT node_id, {", ".join(r6(e, n) for n, e in out.items())} FROM t"""


def _relation_core() -> str:
    kinds = range(1, 7)
    aggs = {f"{d}{t}": count(f"dir = '{d}' AND edge_type = {t}") for d in DIRS for t in kinds}
    late = {f"l{d}{t}": count(f"dir = '{d}' AND edge_type = {t} AND day <= window_end AND day > window_end - 30") for d in DIRS for t in kinds}
    i, o = [f"in{t}" for t in kinds], [f"out{t}" for t in kinds]
    b = [f"({x} + {y})" for x, y in zip(i, o, strict=True)]
    li, lo = [f"lin{t}" for t in kinds], [f"lout{t}" for t in kinds]
    total = lambda x: f"({' + '.join(x)})"
    p = lambda c, x: f"({c} / greatest({total(x)}, 1.0))"
    entropy = lambda x: f"({' + '.join(f'-{p(c, x)} * ln(greatest({p(c, x)}, 1e-6))' for c in x)}) / ln(6.0)"
    top = lambda x, k: f"list_sum(list_reverse_sort([{', '.join(x)}])[1:{k}]) / greatest({total(x)}, 1.0)"
    cover = lambda x: f"({' + '.join(f'CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END' for c in x)}) / 6.0"
    values = [entropy(x) for x in (i, o, b)] + [top(x, k) for k in (1, 2) for x in (i, o, b)] + [cover(x) for x in (i, o, b)] + [entropy(x) for x in (li, lo)] + [top(x, 1) for x in (li, lo)]
    more = ",\neadj AS (SELECT a.*, s.window_end FROM adj a JOIN snap s ON s.node_id = a.center)"
    return per_node(ORDERS, aggs | late, {f"utpm_relation_core_{k}": v for k, v in enumerate(values)}, source="eadj", more=more)


def _trailing(windows: Sequence[int]) -> tuple[str, dict[str, str]]:
    aggs = {f"{d}_c{w}": count(f"dir = '{d}' AND day > (SELECT md FROM md) - {w}") for w in windows for d in ("out", "in")} | {f"{d}_degree": count(d_(d)) for d in ("out", "in")}
    names = [*(f"c{w}" for w in windows), "degree"]
    inner = f"""tc0 AS (SELECT center, {", ".join(f"{e} AS {n}" for n, e in aggs.items())} FROM adj GROUP BY center),
tc1 AS (SELECT n.node_id, {", ".join(f"coalesce({n}, 0) AS {n}" for n in aggs)} FROM nodes n LEFT JOIN tc0 ON center = n.node_id),
tc AS (SELECT t.*, {", ".join(f"out_{x} + in_{x} AS total_{x}" for x in names)}, c.cohort FROM tc1 t JOIN coh c ON c.node_id = t.node_id)"""
    return inner, aggs


def _log(c: str, w: int) -> str:
    return f"ln(1 + {c} / {float(w)})"


def _adaptive() -> str:
    windows = (3, 7, 14, 30, 60, 90)
    inner, _ = _trailing(windows)
    cols = {}
    for d in ALL:
        on = f"{d}_degree > 0"
        cols |= {f"c_{d}_{w}": z(f"{d}_c{w}") for w in windows} | {f"r_{d}_{w}": z(f"{d}_c{w} / ({d}_degree + 1.0)", on) for w in windows}
        cols[f"d_{d}"] = z(f"{_log(f'{d}_c7', 7)} - {_log(f'{d}_c60', 60)}", on)
    peak = lambda k, d: f"greatest({', '.join(f'{k}_{d}_{w}' for w in windows)})"
    where = lambda d: "CASE " + " ".join(f"WHEN c_{d}_{w} = {peak('c', d)} THEN {i / 5}" for i, w in enumerate(windows)) + " END"
    out = {f"taw_{d}_count_peak_z": peak("c", d) for d in ALL} | {f"taw_{d}_ratio_peak_z": peak("r", d) for d in ALL} | {f"taw_{d}_density_7_over_60_z": f"d_{d}" for d in ALL}
    # Ties at the peak differ by rounding errors between engines, so the window is compared on rounded scores.
    rounded = ", ".join(f"round({e}, 9) AS {n}" for n, e in cols.items())
    return f"WITH {ORDERS}, {inner}, zs AS (SELECT node_id, {rounded} FROM tc WINDOW c AS (PARTITION BY cohort)) SELECT node_id, {', '.join(r6(e, n) for n, e in out.items())}, {', '.join(r6(where(d), f'taw_{d}_peak_window') for d in ALL)} FROM zs"


def _dual() -> str:
    inner, _ = _trailing((3, 7, 14, 30, 60))
    cols = {}
    for s, l in ((3, 14), (7, 30), (14, 60)):  # noqa: E741
        for d in ALL:
            on, slow = f"{d}_degree > 0", _log(f"{d}_c{l}", l)
            cols |= {f"tdd_{d}_density_delta_{s}_{l}": z(f"{_log(f'{d}_c{s}', s)} - {slow}", on), f"tdd_{d}_ratio_{s}_{l}": z(f"{d}_c{s} / ({d}_c{l} + 1.0)", on), f"tdd_{d}_burst_contrast_{s}_{l}": z(f"ln(1 + coalesce({d}_b{s}, 0)) - {slow}", on)}
    return f"WITH {ORDERS}{_bursts((3, 7, 14))}, {inner} SELECT node_id, {', '.join(r6(e, n) for n, e in cols.items())} FROM tc LEFT JOIN burst ON center = node_id WINDOW c AS (PARTITION BY cohort)"


def _ages() -> dict[str, str]:
    return {f"days_since_{d}_{k}": f"(SELECT md FROM md) - {f}(CASE WHEN dir = '{d}' THEN day END)" for k, f in (("mean", "avg"), ("last", "max")) for d in ("out", "in")}


def _recent() -> str:
    aggs = {"o": count("dir = 'out'"), "i": count("dir = 'in'")} | {f"{d}_last{w}": count(f"dir = '{d}' AND day > (SELECT md FROM md) - {w}") for w in (3, 7, 14, 30) for d in ("out", "in")}
    out = {n: e for w in (3, 7, 14, 30) for n, e in [(f"{d}_last{w}", f"{d}_last{w}") for d in ("out", "in")] + [(f"{d}_last{w}_ratio_v2", ratio(f"{d}_last{w}", d[0])) for d in ("out", "in")]}
    return per_node(ORDERS, aggs, out)


def _aux() -> str:
    aggs, out = {"o": count("dir = 'out'"), "i": count("dir = 'in'")}, {}
    for y in (2, 3):
        p = f"aux_label_{y}"
        for d in ("out", "in"):
            aggs |= {f"{p}_{d}_count": count(f"dir = '{d}' AND far_y = {y}"), f"{p}_{d}_last14": count(f"dir = '{d}' AND far_y = {y} AND day > (SELECT md FROM md) - 14")}
        out |= {f"{p}_{d}_count": f"{p}_{d}_count" for d in ("out", "in")} | {f"{p}_total_count": f"{p}_out_count + {p}_in_count"}
        out |= {f"{p}_{d}_ratio": ratio(f"{p}_{d}_count", d[0]) for d in ("out", "in")} | {f"{p}_{d}_last14": f"{p}_{d}_last14" for d in ("out", "in")}
    return per_node(ORDERS, aggs, out, source="ladj")


def _detrend() -> str:
    aggs = _ages() | {"o": count("dir = 'out'"), "i": count("dir = 'in'")} | {f"{d}30": count(f"dir = '{d}' AND day > (SELECT md FROM md) - 30") for d in ("out", "in")}
    ages = {n: f"coalesce({n}, (SELECT md FROM md) + 1)" for n in _ages()}
    cols = {f"gtd_{n}_z": z(e) for n, e in ages.items()} | {f"gtd_{d}_last30_ratio_z": z(ratio(f"coalesce({d}30, 0)", f"coalesce({d[0]}, 0)")) for d in ("out", "in")}
    return f"WITH {ORDERS}, a AS (SELECT center, {', '.join(f'{e} AS {n}' for n, e in aggs.items())} FROM adj GROUP BY center) SELECT n.node_id, {', '.join(r6(e, n) for n, e in cols.items())} FROM nodes n JOIN coh ON coh.node_id = n.node_id LEFT JOIN a ON a.center = n.node_id WINDOW c AS (PARTITION BY cohort)"


def _missing_z() -> str:
    cols = {f"tb30_{c}_z": z(c, f"{c} <> -1") for c in RAW}
    m = lambda c: f"(CASE WHEN {c} = -1 THEN 1.0 ELSE 0.0 END)"
    p = lambda c: f"(avg({m(c)}) OVER c)"
    cols |= {f"tb30_{c}_missing_z": f"({m(c)} - {p(c)}) / greatest(sqrt({p(c)} * greatest(1.0 - {p(c)}, 0)), 1e-3)" for c in RAW}
    return f"WITH {ORDERS} SELECT n.node_id, {', '.join(r6(e, n) for n, e in cols.items())} FROM nodes n JOIN coh ON coh.node_id = n.node_id WINDOW c AS (PARTITION BY cohort)"


def _cohort_z(prefix: str = "") -> str:
    inner, _ = _trailing(())
    cols = {f"tb30_log_{n}_z": z(f"ln(1 + {d}_degree)") for n, d in (("indegree", "in"), ("outdegree", "out"), ("total_degree", "total"))}
    return f"WITH {ORDERS}, {inner} SELECT node_id, {', '.join(r6(e, n) for n, e in cols.items())} FROM tc WINDOW c AS (PARTITION BY cohort)"


GROUPS = """,
grp AS (SELECT node_id, CASE y WHEN 0 THEN 'train_normal' WHEN 1 THEN 'train_fraud' WHEN -100 THEN 'test_holdout' ELSE 'background_' || y END AS group_name FROM nodes)"""


def _stats(table: str, columns: Sequence[str]) -> str:
    parts = " UNION ALL ".join(f"SELECT group_name, '{c}' AS feature, t.{c}::DOUBLE AS v FROM {table} t JOIN grp g ON g.node_id = t.node_id" for c in columns)
    return f"SELECT group_name, feature, count(v)::BIGINT AS n, {r6('avg(v)', 'mean')}, {r6('quantile_cont(v, 0.5)', 'median')}, {r6('quantile_cont(v, 0.9)', 'p90')}, {r6('quantile_cont(v, 0.95)', 'p95')}, {r6('max(v)', '\"max\"')} FROM ({parts}) GROUP BY ALL"


_DEG = ",\ndg AS (SELECT n.node_id, count(center) FILTER (WHERE dir = 'in') AS indegree, count(center) FILTER (WHERE dir = 'out') AS outdegree, count(center) AS total_degree FROM nodes n LEFT JOIN adj ON center = n.node_id GROUP BY 1)"
_ACT = ",\nac AS (SELECT *, last_active - first_active AS active_span FROM act)"
_LONG = ",\nlong AS (" + " UNION ALL ".join(f"SELECT node_id, y, '{c}' AS feature, {c} AS value FROM nodes" for c in RAW) + ")"
_QUANTILES = ((0, "q00"), (0.01, "q01"), (0.05, "q05"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.95, "q95"), (0.99, "q99"), (1, "q100"))


def _overview() -> str:
    return f"""WITH {ORDERS}, o AS (
SELECT 'label' AS metric, y::VARCHAR AS name, count(*)::DOUBLE AS v FROM nodes GROUP BY y UNION ALL SELECT 'edge_type', edge_type::VARCHAR, count(*) FROM edges GROUP BY edge_type
UNION ALL SELECT 'nodes', 'all', count(*) FROM nodes UNION ALL SELECT 'fraud_rate', 'all', count(*) FILTER (WHERE y = 1) / greatest(count(*) FILTER (WHERE y IN (0, 1)), 1) FROM nodes
UNION ALL SELECT 'edges', 'all', count(*) FROM edges UNION ALL SELECT 'day', 'min', min(day) FROM edges UNION ALL SELECT 'day', 'max', max(day) FROM edges) SELECT metric, name, {r6("v", "value")} FROM o"""


def _psi() -> str:
    return f"""WITH {ORDERS}{_LONG}, mid AS (SELECT floor(median(first_active)) AS m FROM act),
side AS (SELECT l.feature, l.value, first_active < m AS ref FROM long l JOIN act a ON a.node_id = l.node_id, mid),
cuts AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]))) AS e, min(value) AS lo, max(value) AS hi FROM side WHERE ref GROUP BY feature),
edged AS (SELECT feature, CASE WHEN len(e) > 2 THEN list_concat(list_concat([e[1] - 1e-6], e[2:-2]), [e[-1] + 1e-6]) ELSE [lo - 1e-6, hi + 1e-6] END AS e FROM cuts),
bins AS (SELECT feature, unnest(range(1, len(e)))::INTEGER AS b, e FROM edged),
counts AS (SELECT b.feature, b.b, count(*) FILTER (WHERE ref) AS p, count(*) FILTER (WHERE NOT ref) AS q FROM bins b LEFT JOIN side s ON s.feature = b.feature AND s.value >= e[b] AND (s.value < e[b + 1] OR (b = len(e) - 1 AND s.value <= e[b + 1])) GROUP BY ALL),
shares AS (SELECT feature, greatest(p / greatest(sum(p) OVER f, 1), 1e-6) AS p, greatest(q / greatest(sum(q) OVER f, 1), 1e-6) AS q FROM counts WINDOW f AS (PARTITION BY feature))
SELECT feature, {r6("sum((p - q) * ln(p / q))", "psi")} FROM shares GROUP BY feature"""


def _time_split() -> str:
    cuts = (0.80, 0.75, 0.70, 0.65, 0.60, 0.55)
    return f"""WITH {ORDERS}, r AS (SELECT n.node_id, n.y, a.first_active FROM nodes n JOIN act a ON a.node_id = n.node_id), l AS (SELECT * FROM r WHERE y IN (0, 1)),
t AS (SELECT unnest(range(6)) AS i, unnest(quantile_cont(first_active, [{", ".join(map(str, cuts))}]))::DOUBLE AS q FROM l),
good AS (SELECT i, floor(q) AS d FROM t WHERE (SELECT count(*) FROM l WHERE y = 1 AND first_active >= floor(q)) > 0 AND (SELECT count(*) FROM l WHERE y = 0 AND first_active >= floor(q)) > 0 AND (SELECT count(*) FROM l WHERE first_active < floor(q)) > 0),
theta AS (SELECT arg_min(d, i) AS d FROM good)
SELECT node_id, CASE WHEN y IN (0, 1) AND first_active >= d THEN 'val' WHEN y IN (0, 1) THEN 'train' WHEN y = -100 THEN 'test_pool' ELSE 'external' END AS part FROM r, theta"""


SCORED = "sc AS (SELECT event_id AS id, (event_type = 'error')::INTEGER AS y, 1 / (1 + exp(-value / 100.0)) AS score FROM events)"


def _metrics() -> str:
    return f"""WITH {SCORED}, s AS (SELECT score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y = 0) AS n FROM sc GROUP BY score),
c AS (SELECT *, sum(p) OVER o AS tp, sum(n) OVER o AS fp FROM s WINDOW o AS (ORDER BY score DESC)),
r AS (SELECT *, tp / (tp + fp) AS prec, lag(tp / (tp + fp), 1, 1.0) OVER (ORDER BY score DESC) AS before FROM c)
SELECT sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives, {r6("sum(n * (tp - p / 2.0)) / (sum(p) * sum(n)::DOUBLE)", "roc_auc")}, {r6("sum(p * prec) / sum(p)", "average_precision")},
{r6("sum(p * (prec + before) / 2) / sum(p)", "pr_auc")}, {r6("(SELECT avg(-(y * ln(q) + (1 - y) * ln(1 - q))) FROM (SELECT y, least(greatest(score, 1e-7), 1 - 1e-7) AS q FROM sc))", "log_loss")} FROM r"""


def _time_windows_profile() -> str:
    return f"""WITH {ORDERS}{_LONG} SELECT window_idx, y, feature, count(*)::BIGINT AS n, {r6("avg(value)", "mean")} FROM long JOIN (SELECT a.node_id, min(window_idx) AS window_idx FROM act a JOIN win ON first_active BETWEEN start_day AND end_day GROUP BY 1) w ON w.node_id = long.node_id WHERE y IN (0, 1) GROUP BY ALL"""


_types = {f"{d}_type_{t}_count": count(f"dir = '{d}' AND edge_type = {t}") for t in range(1, 7) for d in DIRS}
_bg_types = {f"bg_{d}_type_{t}_count": count(f"dir = '{d}' AND {BG} AND edge_type = {t}") for t in range(1, 7) for d in DIRS}
_late_types = {f"recent_30_{d}_type_{t}_count": count(f"dir = '{d}' AND day > window_end - 30 AND edge_type = {t}") for t in range(1, 7) for d in DIRS}

FEATURE_ORACLES: dict[str, str] = {
    "minimum_slice": f"""WITH {ORDERS}, dg AS (SELECT n.node_id, count(center) FILTER (WHERE dir = 'in')::DOUBLE AS indegree, count(center) FILTER (WHERE dir = 'out')::DOUBLE AS outdegree FROM nodes n LEFT JOIN adj ON center = n.node_id GROUP BY 1)
SELECT dg.node_id, indegree, outdegree, first_active, last_active, cohort, {r6(z("ln(1 + outdegree)"), "log_outdegree_z")} FROM dg JOIN act ON act.node_id = dg.node_id JOIN coh ON coh.node_id = dg.node_id WINDOW c AS (PARTITION BY cohort)""",
    "graph_degree": _degree(),
    "graph_activity": f"WITH {ORDERS} SELECT node_id, first_active, last_active, last_active - first_active AS active_span FROM act",
    "edge_type_counts": per_node(ORDERS, _types, list(_types)),
    "background_touch": per_node(
        ORDERS,
        {"bi": count(f"dir = 'in' AND {BG}"), "bo": count(f"dir = 'out' AND {BG}"), "i": count("dir = 'in'"), "o": count("dir = 'out'")},
        {"bg_in_count": "bi", "bg_out_count": "bo", "bg_total_count": "bi + bo", "bg_in_ratio": ratio("bi", "i"), "bg_out_ratio": ratio("bo", "o"), "bg_total_ratio": ratio("bi + bo", "i + o"), "touch_background": "CASE WHEN bi + bo > 0 THEN 1 ELSE 0 END"},
        source="ladj",
    ),
    "background_by_type": per_node(ORDERS, _bg_types, list(_bg_types), source="ladj"),
    "edge_time_windows": f"WITH {ORDERS} SELECT * FROM win",
    "node_time_bucket": f"WITH {ORDERS} SELECT node_id, first_active, time_bucket, window_end FROM snap",
    "window_counts": _windows(),
    "unique_multi_edges": per_node(
        EVENTS,
        {"uo": "count(DISTINCT CASE WHEN dir = 'out' THEN neighbor END)::DOUBLE", "ui": "count(DISTINCT CASE WHEN dir = 'in' THEN neighbor END)::DOUBLE", "o": count("dir = 'out'"), "i": count("dir = 'in'")},
        {"unique_out": "uo", "unique_in": "ui", "multi_out": "greatest(o - uo, 0)", "multi_in": "greatest(i - ui, 0)", "unique_out_ratio_v2": ratio("uo", "o"), "unique_in_ratio_v2": ratio("ui", "i")},
    ),
    "edge_age": per_node(ORDERS, _ages(), list(_ages()), default="(SELECT md FROM md) + 1"),
    "recent_counts": _recent(),
    "aux_label_counts": _aux(),
    "snapshot_block": _snapshot(),
    "snapshot_recent": _snapshot_recent(),
    "snapshot_relation_recent": per_node(ORDERS, _late_types, list(_late_types), source="sadj", more=SNAP),
    "early_activity": _early(),
    "neighbor_profile": _profile("fadj", ""),
    "snapshot_neighbor_profile": _profile("fsnap", "snap_"),
    "partner_concentration": _concentration(),
    "daily_burst": _burst(),
    "motif_lite": _motif(),
    "edge_cosine": _cosine(),
    "raw_block": f"WITH {ORDERS} SELECT node_id, {', '.join(r6(c, c) for c in RAW)}, {', '.join(r6(f'CASE WHEN {c} = -1 THEN 1 ELSE 0 END', f'{c}_is_neg1') for c in RAW)}, {r6(' + '.join(f'CASE WHEN {c} = -1 THEN 1 ELSE 0 END' for c in RAW), 'missing_count')}, {r6('(x0 + x1) / 2', 'x0_x1_mean')}, {r6('abs(x0 - x1)', 'x0_x1_absdiff')} FROM nodes",
    "row_attr_stats": _row_stats(),
    "relation_core": _relation_core(),
    "cohort_zscore": _cohort_z(),
    "missing_zscore": _missing_z(),
    "time_detrend": _detrend(),
    "adaptive_window": _adaptive(),
    "dual_scale_delta": _dual(),
    "overview": _overview(),
    "feature_profile": f"WITH {ORDERS}{_LONG} SELECT feature, {r6('avg(value)', 'mean')}, {r6('stddev_pop(value)', 'std')}, {r6('avg(value) FILTER (WHERE y = 0)', 'normal_mean')}, {r6('avg(value) FILTER (WHERE y = 1)', 'fraud_mean')}, {r6('abs(avg(value) FILTER (WHERE y = 1) - avg(value) FILTER (WHERE y = 0))', 'mean_gap')}, {r6('avg(CASE WHEN value = -1 THEN 1.0 ELSE 0.0 END)', 'missing_ratio')}, {', '.join(r6(f'quantile_cont(value, {q})', n) for q, n in _QUANTILES)} FROM long GROUP BY feature",
    "missing_by_group": f"WITH {ORDERS}{_LONG}{GROUPS} SELECT group_name, feature, {r6('avg(CASE WHEN value = -1 THEN 1.0 ELSE 0.0 END)', 'missing_ratio')}, {r6('avg(value)', 'mean')}, {r6('quantile_cont(value, 0.5)', 'median')} FROM long l JOIN grp g ON g.node_id = l.node_id GROUP BY ALL",
    "feature_corr": f"WITH {ORDERS} " + " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r6(f'corr({a}, {b})', 'corr')} FROM nodes" for a in RAW for b in RAW),
    "degree_stats": f"WITH {ORDERS}{GROUPS}{_DEG} {_stats('dg', ('indegree', 'outdegree', 'total_degree'))}",
    "node_activity_stats": f"WITH {ORDERS}{GROUPS}{_ACT} {_stats('ac', ('first_active', 'last_active', 'active_span'))}",
    "label_pair_matrix": f"WITH {ORDERS}, lab AS (SELECT unnest([-100, 0, 1, 2, 3]) AS y), m AS (SELECT a.y AS src_label, b.y AS dst_label, count(*) AS n FROM edges JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst GROUP BY ALL) SELECT a.y AS src_label, b.y AS dst_label, coalesce(n, 0)::BIGINT AS edges, {r6('coalesce(n, 0) / greatest((SELECT count(*) FROM edges), 1)', 'ratio')} FROM lab a CROSS JOIN lab b LEFT JOIN m ON m.src_label = a.y AND m.dst_label = b.y",
    "background_bridge": f"WITH {ORDERS}, own AS (SELECT node_id, y FROM nodes WHERE y IN (0, 1)), t AS (SELECT o.y, count(*) AS e, count(DISTINCT center) AS n FROM ladj JOIN own o ON o.node_id = center WHERE {BG} GROUP BY 1) SELECT o.y, count(*)::BIGINT AS class_nodes, coalesce(any_value(e), 0)::BIGINT AS edges, coalesce(any_value(n), 0)::BIGINT AS nodes, {r6('coalesce(any_value(n), 0) / count(*)', 'touch_ratio')} FROM own o LEFT JOIN t ON t.y = o.y GROUP BY o.y",
    "edge_day_series": f"WITH {ORDERS} SELECT d.day::INTEGER AS day, count(edge_type)::BIGINT AS edges, {', '.join(f'(count(*) FILTER (WHERE edge_type = {t}))::BIGINT AS type_{t}' for t in range(1, 7))} FROM (SELECT unnest(range(1, (SELECT md FROM md) + 1)) AS day) d LEFT JOIN edges e ON e.day = d.day GROUP BY d.day",
    "time_window_profile": _time_windows_profile(),
    "psi_drift": _psi(),
    "time_split": _time_split(),
    "ranking_metrics": _metrics(),
    "reciprocal_pairs": f"WITH {EVENTS}, p AS (SELECT DISTINCT src, dst FROM edges) SELECT a.src, a.dst FROM p a JOIN p b ON a.src = b.dst AND a.dst = b.src",
    "value_windows": f"WITH {ORDERS}, q AS (SELECT list_sort(list_distinct(quantile_cont(x2, [0, .25, .5, .75, 1]))) AS e FROM nodes), b AS (SELECT x2, CASE WHEN len(e) = 1 THEN 1 ELSE least(len(list_filter(e, lambda v: v <= x2)), len(e) - 1) END AS w FROM nodes, q) SELECT w::INTEGER AS window_idx, {r6('min(x2)', 'start')}, {r6('max(x2)', '\"end\"')}, count(*)::BIGINT AS rows FROM b GROUP BY w",
    "cumulative_distribution": f"WITH {ORDERS} SELECT {r6('x2', 'value')}, {r6('max(c)', 'cdf')} FROM (SELECT x2, cume_dist() OVER (ORDER BY x2) AS c FROM nodes) GROUP BY x2",
}
