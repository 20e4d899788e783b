"""Boilerplate lines of web sites: lines that a large share of a site's pages hold are dropped from all of them.

Pages are grouped by host. For each line of a host, the pages that contain it are divided by the host's pages; lines over
the ratio go, unless one page alone has them, which no small host could otherwise have. A host has at most (lines a
page) / ratio such lines, so they travel to its pages as one short list. Where the lists are too many to broadcast, pages
are shuffled by host, and hosts of many pages, which are few, in several parts.

Defined results: null html has no lines. A page whose url has no host keeps its lines, with host null. Repeated rows count
as pages each. A line at exactly the ratio stays. A page is one cell whatever its length, and a line without an end is one
line. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import sized, staged

#: Share of a host's pages, and pages, that a line must pass or reach to go.
RATIO, LEAST_PAGES = 0.2, 2
_SILENT = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
#: Pages of a host that go to one part where pages are shuffled: about a gigabyte of them with all their lines.
PART_PAGES = 10_000


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#:]+)", 1), F.lit(""))


def lines_of(html: Column) -> Column:
    """Text lines of a page: tags and line feeds part them, white space is folded, empty ones go."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), _SILENT, "\n"), r"<[^>]*>", "\n")
    return F.filter(F.transform(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " "))), lambda x: x != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, host_pages, dropped (hashes of the lines over the ratio; null without any) of each host, from pages (host, lines)."""
    known = pages.where("host is not null")
    totals = staged(known.groupBy("host").agg(F.count("*").alias("host_pages")), "hosts")
    held = known.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line"))
    counts = held.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    over = counts.join(sized(totals), "host").where(F.col("n") > F.col("host_pages") * ratio)
    lists = over.groupBy("host").agg(F.collect_list("line").alias("dropped"))
    return staged(totals.join(lists, "host", "left"), "boilerplate")


def strip_boilerplate(pages: DataFrame, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """page_id, host, host_pages, n_lines, n_dropped, kept (the lines that stay, joined by line feeds)."""
    cut = pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    lists = boilerplate(cut, ratio, least_pages)
    near = sized(lists)
    if near is lists:
        parts = F.ceil(F.col("host_pages") / PART_PAGES).cast("int")
        large = sized(staged(lists.where(F.col("host_pages") > PART_PAGES).select("host", parts.alias("parts")), "large_hosts"))
        near = lists.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        dealt = cut.join(large, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id", F.size("lines")), F.coalesce("parts", F.lit(1))).cast("int"))
        joined = dealt.join(near, ["host", "part"], "left")
    else:
        joined = cut.join(near, "host", "left")
    gone = F.coalesce(F.col("dropped"), F.array().cast("array<bigint>"))
    kept = F.filter("lines", lambda x: ~F.array_contains(gone, F.xxhash64(x)))
    return joined.withColumn("stays", kept).select(
        "page_id", "host", F.coalesce("host_pages", F.lit(0)).alias("host_pages"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("stays")).cast("long").alias("n_dropped"), F.array_join("stays", "\n").alias("kept"),
    )
