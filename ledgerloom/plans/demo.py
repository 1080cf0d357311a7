"""A demonstration network: some nodes of a graph as invented people, their features, and the edges among them.

Everything about a person is a hash of the node's id and the field's number, so people are the same whatever the
partitions, the other rows, and the runs before.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.contract import GraphFrame
from ledgerloom.operators.sampling import draw, induced
from ledgerloom.plans.serving import sequence_edges

# Names, places, occupations, and the beginnings of ids and telephone numbers.
FAMILY_NAMES = ("李", "王", "张", "刘", "陈", "杨", "黄", "赵", "吴", "周", "徐", "孙", "朱", "胡")
GIVEN_NAMES = ("明轩", "雨桐", "子涵", "嘉宁", "思远", "若琳", "浩然", "佳怡", "俊杰", "诗涵", "晨阳", "欣悦")
REGIONS = ("上海市浦东新区", "北京市朝阳区", "杭州市西湖区", "深圳市南山区", "成都市锦江区", "南京市玄武区", "武汉市江汉区", "苏州市工业园区")
OCCUPATIONS = ("个体经营者", "公司职员", "网约车司机", "电商商户", "财务人员", "销售人员", "自由职业者", "物流从业者")
AREAS = ("110101", "310101", "330102", "440305", "510104", "320102")
PHONES = ("3", "5", "7", "8", "9")
#: The first and last number of each part of an id and a telephone number, and its digits.
NUMBERS: Mapping[str, tuple[int, int, int]] = {"year": (1970, 2004, 4), "month": (1, 12, 2), "day": (1, 28, 2), "sequence": (100, 999, 3), "check": (0, 9, 1), "phone": (100_000_000, 999_999_999, 9)}
LISTS: Mapping[str, Sequence[str]] = {"family": FAMILY_NAMES, "given": GIVEN_NAMES, "region": REGIONS, "occupation": OCCUPATIONS, "area": AREAS, "carrier": PHONES}
#: The number of each field in the draws.
SEEDS = {name: 100 + i for i, name in enumerate([*LISTS, *NUMBERS])}


def _upto(n: int, name: str, key: str) -> Column:
    """A whole number from 0 to n - 1."""
    return F.least(F.floor(draw(SEEDS[name], key) * n), F.lit(n - 1)).cast("long")


def person(key: str) -> dict[str, Column]:
    """The columns of an invented person."""
    pick = {name: F.element_at(F.array(*[F.lit(x) for x in values]), (_upto(len(values), name, key) + 1).cast("int")) for name, values in LISTS.items()}
    number = {name: F.lpad((_upto(b - a + 1, name, key) + a).cast("string"), digits, "0") for name, (a, b, digits) in NUMBERS.items()}
    return {
        "display_name": F.concat(pick["family"], pick["given"]),
        "id_number": F.concat(pick["area"], *[number[n] for n in ("year", "month", "day", "sequence", "check")]),
        "phone": F.concat(F.lit("1"), pick["carrier"], number["phone"]),
        "region": pick["region"],
        "occupation": pick["occupation"],
    }


def people(features: DataFrame, chosen: DataFrame, limit: int | None = None, shown: int = 12) -> DataFrame:
    """(node_id, the person's columns, features map) of the chosen nodes (node_id), the first `limit` in order; the first `shown` feature columns, null for NaN."""
    ids = chosen.select("node_id").distinct()
    ids = ids if limit is None else ids.orderBy("node_id").limit(max(1, limit))
    columns = [c for c in features.columns if c != "node_id"][:shown]
    value = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    shown_ = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(f"core_feature_{i:02d}"), value(c))]) if columns else F.create_map().cast("map<string,double>")
    return features.join(ids, "node_id", "left_semi").select("node_id", *[c.alias(n) for n, c in person("node_id").items()], shown_.alias("features"))


def relations(g: GraphFrame, shown: DataFrame, limit: int | None = None) -> DataFrame:
    """(source, target, edge_type, day) among the shown nodes, the first `limit` in order; without any, the nodes in order, each linked to the next."""
    among = induced(g.edges, shown).select(F.col("src").alias("source"), F.col("dst").alias("target"), F.concat(F.lit("rel_"), F.col("edge_type")).alias("edge_type"), "day")
    if among.isEmpty():
        one = shown.select("node_id", F.lit(0).alias("all"))
        rows = sequence_edges(one, "node_id", ["node_id"], "all")
        return rows.select("source", "target", F.lit("sequence").alias("edge_type"), F.lit(None).cast("int").alias("day"))
    return among if limit is None else among.orderBy("source", "day", "target", "edge_type").limit(limit)
