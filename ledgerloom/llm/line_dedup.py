"""Line dedup by site-relative frequency.

For each host: the pages that hold a line, divided by the host's pages. Lines in more than a
given share of them, and in two pages at least, are boilerplate of the site and dropped from
all its pages. A line counts once for a page, however often it stands there.

A host has less than (lines a page) / (share) such lines, whatever its number of pages, so
they fit an array: the pages join one row for each host and filter their lines against it.
Lines are told by their MD5, and only those are counted; counts are combined before they are shuffled, so a host
with a third of all pages, or a line that stands in all of them, is no hot spot.

Defined results: pages without a host are left as they are, as they belong to no site; a null
text stays null; lines that are blank, white space apart, are kept and not counted; lines are
compared without white space at their ends; repeated rows and copies of a text are pages of their
own, unless `distinct` counts a host's equal texts as one page (null texts too); texts and lines of
any length are taken whole; an empty table gives an empty result; other columns stay, but for one
named lines_dropped, which is replaced. A text whose lines are all dropped becomes empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._shared import durable, small

#: Elements that end a line of a page's text, and those whose content isn't text.
BLOCKS = "p|div|li|ul|ol|h[1-6]|br|nav|article|section|header|footer|table|tr|td|th|title|body|head|html"
HIDDEN = "script|style"


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case, without user and port; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", host)


def page_text(html: Column) -> Column:
    """The text of a page, a line for each block element; references to characters are left as they are."""
    text = F.regexp_replace(html, rf"(?is)<!--.*?-->|<({HIDDEN})\b[^>]*>.*?</({HIDDEN})\s*>", " ")
    text = F.regexp_replace(text, rf"(?i)</?({BLOCKS})\b[^>]*>", "\n")
    text = F.regexp_replace(text, "<[^>]*>", " ")
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\r]+", " "), r" ?\n[ \n]*", "\n")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    return F.md5(F.trim(line, F.lit(" \t\r")))


def boilerplate(pages: DataFrame, host: str = "host", text: str = "text", *, share: float = 0.2, pages_least: int = 2, distinct: bool = False) -> DataFrame:
    """(host, lines): the hashes of a host's boilerplate lines. distinct: equal texts of a host count as one page."""
    own = F.array_distinct(F.transform(F.filter(_lines(F.col(text)), lambda x: F.trim(x, F.lit(" \t\r")) != ""), _key))
    # A null stands for the page itself: its count is the host's total.
    marked = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(own, F.array().cast("array<string>")))
    kept = pages.filter(F.col(host).isNotNull()).select(F.col(host).alias("host"), F.md5(F.col(text)).alias("page"), marked.alias("lines"))
    if distinct:
        kept = kept.dropDuplicates(["host", "page"])
    held = kept.select("host", F.explode("lines").alias("line"))
    counted = held.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages"))
    totals = counted.filter(F.col("line").isNull()).select(F.col("host").alias("_host"), F.col("pages").alias("total"))
    common = counted.filter((F.col("line").isNotNull()) & (F.col("pages") >= pages_least))
    joined = common.join(totals, F.col("host") == F.col("_host")).filter(F.col("pages") > share * F.col("total"))
    return joined.groupBy("host").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(pages: DataFrame, host: str = "host", text: str = "text", *, share: float = 0.2, pages_least: int = 2, distinct: bool = False) -> DataFrame:
    """pages with the boilerplate lines of their site taken out of `text`, and `lines_dropped`, how many."""
    sites = boilerplate(pages, host, text, share=share, pages_least=pages_least, distinct=distinct).select(F.col("host").alias("_host"), F.col("lines").alias("_boilerplate"))
    sites = durable(sites)
    n_lines = sites.agg(F.sum(F.size("_boilerplate"))).first()[0] or 0
    # Few lines are broadcast; for more, the join has a bare exchange on either side, so that Spark can split a hot host.
    joined = pages.join(small(sites, n_lines), F.col(host) == F.col("_host"), "left")
    lines = _lines(F.col(text))
    left = F.filter(lines, lambda x: ~F.array_contains(F.col("_boilerplate"), _key(x)) | (F.trim(x, F.lit(" \t\r")) == ""))
    kept = F.when(F.col("_boilerplate").isNull() | F.col(text).isNull(), lines).otherwise(left)
    out = joined.withColumn("_left", kept)
    dropped = F.coalesce(F.size(lines) - F.size("_left"), F.lit(0))
    dropped = F.when(F.col(text).isNull(), F.lit(0)).otherwise(dropped)
    return out.withColumn("lines_dropped", dropped.cast("int")).withColumn(text, F.when(F.col("lines_dropped") == 0, F.col(text)).otherwise(F.array_join("_left", "\n"))).drop("_host", "_boilerplate", "_left")
