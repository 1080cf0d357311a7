"""Feature groups, composed profiles and the projection of raw columns: one wide row for each node.

A profile names groups; groups name the operators that make their columns. Each operator of a
profile runs once, however many groups take columns from it; its rows are written in the shared folder, and
all are joined by node_id.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.contract import GraphFrame
from ledgerloom.operators import gram, graph, impute, pairs, ranks, rows, snapshot, windows
from ledgerloom.sources.shared import large, stored, stored_graph

#: Operators by name; each gives a row for each node.
SOURCES: dict[str, Callable[[GraphFrame], DataFrame]] = {
    "raw": rows.raw_block,
    "attr_stats": rows.row_attr_stats,
    "relation_core": rows.relation_core,
    "degrees": graph.degrees,
    "types": graph.edge_type_counts,
    "background": graph.background_touch,
    "activity": graph.activity,
    "windows": windows.window_counts,
    "unique": graph.unique_multi_edges,
    "age": graph.edge_age,
    "recent": graph.recent_counts,
    "aux": graph.aux_label_counts,
    "detrend": windows.time_detrend,
    "motif": pairs.motif_lite,
    "partners": pairs.partner_concentration,
    "adaptive": windows.adaptive_window,
    "dual": windows.dual_scale_delta,
    "similarity": lambda g: pairs.edge_cosine(filled_vectors(g), g.edges.select("src", "dst")),
    "bucket_norm": windows.bucket_norm,
    "snapshot": snapshot.snapshot_block,
    "snapshot_recent": snapshot.snapshot_recent,
    "snapshot_types": snapshot.snapshot_relation_recent,
    "early": snapshot.early_activity,
    "neighbor": snapshot.neighbor_profile,
    "snapshot_neighbor": snapshot.snapshot_neighbor_profile,
}

# The columns of the padded blocks, in order.
GRAPH_CORE = (
    "indegree", "outdegree", "total_degree", "out_over_in_plus1", "in_over_out_plus1", "unique_out", "unique_in", "multi_out", "multi_in",
    "unique_out_ratio_v2", "unique_in_ratio_v2", "days_since_out_mean", "days_since_in_mean", "days_since_out_last", "days_since_in_last", "out_last30_ratio_v2",
)
TEMPORAL_CORE = (
    "first_active", "last_active", "active_span", "early_late_total_ratio", "snapshot_day", "snapshot_age", "snap_in_count", "snap_out_count", "snap_total_count", "snap_bg_total_ratio",
    "window_1_total_count", "window_2_total_count", "window_3_total_count", "window_4_total_count", "recent_14_in_count", "recent_14_out_count", "recent_14_total_count",
    "recent_60_in_count", "recent_60_out_count", "recent_60_total_count", "recent_14_total_over_snapshot", "recent_60_total_over_snapshot", "recent_14_bg_total_over_snapshot", "recent_60_bg_total_over_snapshot",
)
TEMPORAL_RISK = (
    "bg_in_count", "bg_out_count", "bg_total_count", "bg_in_ratio", "bg_out_ratio", "bg_total_ratio", "touch_background", "tcc_out_top_share_7", "tcc_in_top_share_7", "tcc_total_top_share_7",
    "tcc_out_entropy_30", "tcc_in_entropy_30", "tcc_total_entropy_30", "tm14_recip_out_ratio", "tm14_recip_in_ratio", "taw_total_count_peak_z",
)
TEMPORAL_SHIFT = (
    "tdd_out_density_delta_7_30", "tdd_in_density_delta_7_30", "tdd_total_density_delta_7_30", "tdd_out_burst_contrast_7_30", "tdd_in_burst_contrast_7_30", "tdd_total_burst_contrast_7_30",
    "tdd_total_density_delta_14_60", "tdd_total_ratio_14_60", "tdd_total_burst_contrast_14_60", "tccr_total_top_share_7", "tccr_total_top_share_30", "tccr_total_entropy_7", "tccr_total_entropy_30",
    "tcsf_total_top_share_7", "tcsf_total_top_share_30", "taw_total_density_7_over_60_z",
)

#: Groups that are padded blocks: the operators, the columns and the width.
PADDED = {
    "utpm_graph_core": (("degrees", "unique", "age", "recent"), GRAPH_CORE, 16),
    "utpm_temporal_core": (("activity", "windows", "snapshot", "snapshot_recent"), TEMPORAL_CORE, 24),
    "utpm_temporal_risk": (("background", "partners", "motif", "adaptive"), TEMPORAL_RISK, 16),
    "utpm_temporal_shift": (("dual", "partners", "adaptive"), TEMPORAL_SHIFT, 16),
}
#: Groups that are columns of operators under their own names; a pattern picks some of them.
PLAIN = {
    "raw_x": (("raw",), r"x\d+"),
    "missing_mask": (("raw",), r"x\d+_is_neg1"),
    "missing_summary": (("raw",), "missing_count"),
    "strong_combo": (("raw",), r"x\d+_x\d+_(mean|absdiff)"),
    "graph_direction": (("degrees",), ".*"),
    "edge_type": (("types",), ".*"),
    "background": (("background",), ".*"),
    "time": (("activity", "windows"), ".*"),
    "graph_stats": (("unique", "age", "recent", "aux"), ".*"),
    "graph_time_detrend": (("detrend",), ".*"),
    "temporal_motif_lite": (("motif",), ".*"),
    "temporal_counterparty_concentration": (("partners",), "tcc_.*"),
    "temporal_counterparty_concentration_recent": (("partners",), r"tccr_.*"),
    "temporal_counterparty_share_focus": (("partners",), r"tcsf_.*"),
    "temporal_dual_scale_delta": (("dual",), ".*"),
    "temporal_adaptive_window": (("adaptive",), ".*"),
    "neighbor_similarity": (("similarity",), ".*"),
    "temporal_bucket_norm": (("bucket_norm",), ".*"),
    "temporal_snapshot": (("snapshot",), ".*"),
    "temporal_recent": (("snapshot_recent",), ".*"),
    "temporal_relation_recent": (("snapshot_types",), ".*"),
    "temporal_neighbor": (("snapshot_neighbor",), ".*"),
    "activation_early": (("early",), ".*"),
    "neighbor": (("neighbor",), ".*"),
    "utpm_attr_stats": (("attr_stats",), ".*"),
    "utpm_relation_core": (("relation_core",), ".*"),
}

# The groups of each profile, in order.
UNIFIED = ("utpm_attr_proj", "utpm_attr_stats", "utpm_graph_core", "utpm_relation_core", "utpm_temporal_core", "utpm_temporal_risk", "utpm_aux_label")
COMPACT = (*UNIFIED, "utpm_temporal_shift")
ENHANCED = (*COMPACT, "graph_time_detrend", "temporal_motif_lite", "temporal_counterparty_concentration", "temporal_adaptive_window", "neighbor_similarity", "temporal_bucket_norm", "activation_early")
FUSED = (*ENHANCED, "temporal_counterparty_concentration_recent", "temporal_counterparty_share_focus", "temporal_dual_scale_delta")
TABULAR = ("raw_x", "missing_mask", "missing_summary")
HYBRID = (*TABULAR, "strong_combo", "graph_direction", "edge_type", "background", "time")
PROFILES = {
    "utpm_unified": UNIFIED,
    "utpm_shift_compact": COMPACT,
    "utpm_shift_enhanced": ENHANCED,
    "utpm_shift_fused": FUSED,
    "utpm_shift_history": (*ENHANCED, "temporal_snapshot", "temporal_recent", "temporal_relation_recent"),
    "utpm_shift_fused_rawmask": (*TABULAR, "strong_combo", "background", "time", "graph_stats", *FUSED),
    "m1_tabular": TABULAR,
    "m2_hybrid": HYBRID,
    "m3_neighbor": (*HYBRID, "neighbor"),
}
#: Windows of the shorter lists of partner shares; their columns are those of partner_concentration under other names.
SHORT_WINDOWS = (7, 30)


def filled_vectors(g: GraphFrame) -> DataFrame:
    """(node_id, v): the raw columns with 0 for what is missing."""
    return g.nodes.select("node_id", F.array(*[F.coalesce(impute.seen(c), F.lit(0.0)) for c in g.schema.raw_columns]).alias("v"))


def projection(g: GraphFrame, train: DataFrame, width: int = 32) -> DataFrame:
    """(node_id, utpm_attr_proj_0, ...): raw columns projected on the singular vectors of the training rows.

    Medians fill what is missing, then columns are standardised, both over the training rows (node_id).
    The singular vectors are eigenvectors of the columns' products, taken in one pass (`operators/gram.py`); the driver
    solves a system as large as there are columns. Of a vector's two signs that is taken whose largest component is positive.
    Columns beyond the components are 0; without training rows all are.
    """
    raw = g.schema.raw_columns
    known = g.nodes.join(train.select("node_id"), "node_id", "left_semi")
    middle = ranks.medians(known, {c: impute.seen(c) for c in raw})
    filled = lambda c: F.coalesce(impute.seen(c), F.lit(middle.get(c, 0.0)))
    found = gram.total(gram.moments(known, [filled(c) for c in raw]), len(raw))
    n = min(width, len(raw), max(int(found.n) - 1, 1)) if found.n else 0
    spread = np.where(found.deviations() >= 1e-6, found.deviations(), 1.0)
    scaled = {c: (filled(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip(raw, found.mean, spread, strict=True)}
    parts: list[Column] = []
    if n:
        _, vectors = np.linalg.eigh(found.products / np.outer(spread, spread))
        for v in vectors.T[::-1][:n]:
            v = v if v[np.argmax(np.abs(v))] > 0 else -v
            # One fold over two arrays, so that a wide table isn't a deep expression.
            values = F.array(*[scaled[c] * F.lit(float(w)) for c, w in zip(raw, v, strict=True)])
            parts.append(F.aggregate(values, F.lit(0.0), lambda a, x: a + x))
    parts += [F.lit(0.0)] * (width - len(parts))
    return g.nodes.select("node_id", *[p.alias(f"utpm_attr_proj_{i}") for i, p in enumerate(parts)])


def _source(g: GraphFrame, name: str) -> DataFrame:
    out = SOURCES[name](g)
    if name == "partners":
        same = {"tccr": [c for c in out.columns if c.endswith(tuple(f"_{w}" for w in SHORT_WINDOWS))]}
        same["tcsf"] = [c for c in same["tccr"] if "_top_share_" in c]
        out = out.select("*", *[F.col(c).alias(c.replace("tcc_", f"{p}_")) for p, columns in same.items() for c in columns])
    return out.withColumnRenamed("tb30_log_bg_total_z", "tb30_log_bg_total_count_z")


def resolve(profile: str, extra: Sequence[str] = ()) -> list[str]:
    """The groups of a profile, then extra ones that it doesn't have."""
    if profile not in PROFILES:
        raise ValueError(f"no profile {profile}; there are {', '.join(PROFILES)}")
    return list(dict.fromkeys([*PROFILES[profile], *extra]))


def features(g: GraphFrame, groups: Sequence[str], train: DataFrame | None = None) -> tuple[DataFrame, dict[str, list[str]]]:
    """(node_id and the groups' columns in order, {group: its columns}); a column of two groups comes once, with the first.

    train (node_id) is what the projection is fitted on; without it, the labelled nodes.
    """
    wanted: list[str] = []
    for name in groups:
        wanted += ["aux"] if name == "utpm_aux_label" else [] if name == "utpm_attr_proj" else (PADDED.get(name) or PLAIN[name])[0]
    g = stored_graph(g)
    made = {s: large(stored(_source(g, s), f"block-{s}")) for s in dict.fromkeys(wanted)}
    wide, held = g.nodes.select("node_id"), {"node_id"}
    for source in made.values():
        fresh = [c for c in source.columns if c not in held]
        wide, held = wide.join(source.select("node_id", *fresh), "node_id"), held | set(fresh)
    if "utpm_attr_proj" in groups:
        fitted = g.nodes.filter(F.col("y").isin(0, 1)) if train is None else train
        part = projection(g, fitted)
        wide, held = wide.join(part, "node_id"), held | set(part.columns)
    picked: dict[str, list[Column]] = {}
    names: dict[str, list[str]] = {}
    for name in groups:
        if name in PADDED:
            _, columns, width = PADDED[name]
            found = {f"{name}_{i}": F.col(columns[i]) if i < len(columns) and columns[i] in held else F.lit(0.0) for i in range(width)}
        elif name == "utpm_aux_label":
            have = sorted(c for c in held if c.startswith("aux_label_"))[:8]
            found = {f"{name}_{i}": F.col(have[i]) if i < len(have) else F.lit(0.0) for i in range(8)}
        elif name == "utpm_attr_proj":
            found = {c: F.col(c) for c in part.columns if c != "node_id"}
        else:
            sources, pattern = PLAIN[name]
            found = {c: F.col(c) for s in sources for c in made[s].columns if c != "node_id" and re.fullmatch(pattern, c)}
        taken = {c for seen in names.values() for c in seen}
        names[name] = [c for c in found if c not in taken]
        picked[name] = [found[c].cast("double").alias(c) for c in names[name]]
    return wide.select("node_id", *[c for columns in picked.values() for c in columns]), names
