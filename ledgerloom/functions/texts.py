"""JSON and keys in free text, as expressions; what can't be read is null."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def toml_string(text: Column, key: str) -> Column:
    """The quoted value of a key at the start of a line; null without one."""
    found = F.regexp_extract(text, rf'(?m)^{re.escape(key)}\s*=\s*"([^"]+)"', 1)
    return F.nullif(found, F.lit(""))


def toml_block(text: Column, section: str) -> Column:
    """What stands below the line [section], up to the next line that begins with a bracket; null without that section."""
    found = rf"(?ms)^\[{re.escape(section)}\]\s*(.*?)(?=^\[|\z)"
    return F.when(text.rlike(found), F.regexp_extract(text, found, 1))


def balanced_object(text: Column) -> Column:
    """The first object in a text: from its first brace to the brace that closes it, those in strings aside; null if there is none.

    One fold over braces, quotes, backslashes and what stands between them; quotes and backslashes are those of JSON.
    """
    rest = F.substr(text, F.locate("{", text))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(s: Column, c: Column) -> Column:
        plain = ~s["quoted"]
        depth = s["depth"] + F.when(plain & (c == "{"), 1).when(plain & (c == "}"), -1).otherwise(0)
        after = F.struct(
            depth.alias("depth"),
            F.when((c == '"') & ~s["escaped"], plain).otherwise(s["quoted"]).alias("quoted"),
            (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"),
            (s["n"] + F.length(c)).alias("n"),
            (depth == 0).alias("done"),
        )
        return F.when(s["done"], s).otherwise(after)

    end = F.aggregate(F.regexp_extract_all(rest, F.lit(r'[{}"\\]|[^{}"\\]+'), 0), start, step)
    whole = F.transform(F.array(end), lambda e: F.when(e["done"], F.substr(rest, F.lit(1), e["n"])))[0]  # one fold for both of its uses
    return F.when(F.locate("{", text) > 0, whole)


def parsed(text: Column) -> Column:
    """The first object of a text as a VARIANT; null if there is none or it is malformed."""
    return F.try_parse_json(balanced_object(text))


def field(value: Column, path: str, kind: str) -> Column:
    """A field of a VARIANT by its path, null if it isn't there or of another kind; NaN is null too."""
    found = F.try_variant_get(value, path, kind)
    return F.when(~F.isnan(found), found) if kind in ("double", "float") else found


def with_defaults(values: Column, defaults: Mapping[str, Column]) -> Column:
    """A map of strings with defaults for the keys that it doesn't have; a null map has none."""
    held = F.coalesce(values, F.create_map().cast("map<string,string>"))
    more = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_concat(held, F.map_filter(more, lambda k, v: ~F.map_contains_key(held, k)))


def updated(values: Column, changes: Mapping[str, Column]) -> Column:
    """A map of strings with some values put in, whatever they were."""
    held = F.coalesce(values, F.create_map().cast("map<string,string>"))
    new = F.create_map(*[x for k, v in changes.items() for x in (F.lit(k), v.cast("string"))])
    return F.map_concat(F.map_filter(held, lambda k, v: ~k.isin(list(changes))), new)
