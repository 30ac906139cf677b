"""Boilerplate lines of sites: lines that a large share of a host's pages have.

The share of a line on a host is the number of the host's pages with that line by the number of the host's pages. A
host has few lines above a share: pages have so many lines on average, so at most that number divided by the share.
Only these lines travel to the pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The share above which a line is dropped; pages that a host, and a line, must have before any line is judged.
RATIO, LEAST_PAGES, LEAST_SEEN = 0.2, 5, 3
#: Parts that all pages together are dealt to where they meet their host's lines; a host gets its share of them.
PARTS = 4_000


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; the empty text if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def lines_of_html(html: Column) -> Column:
    """The lines that tags and line ends part, trimmed, with single spaces, without empty ones."""
    broken = F.regexp_replace(F.coalesce(html, F.lit("")), "<[^<>]*>", "\n")
    return F.filter(F.transform(F.split(broken, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\x20\x09-\x0D]+", " "))), lambda x: x != "")


def drop_boilerplate(df: DataFrame, page_id: str, host: Column, lines: Column, ratio: float = RATIO, least_pages: int = LEAST_PAGES, least_seen: int = LEAST_SEEN) -> DataFrame:
    """Per row of ``df``: page_id, host, n_lines, n_dropped and text, the kept lines joined by line ends.

    A line of a page that has it more than once counts once, and every one of its places is dropped. Hosts with fewer
    than ``least_pages`` pages keep all lines, and so do lines on fewer than ``least_seen`` pages. Rows are pages, so
    repeated rows count as often as they come; a null host is the host ``""``.
    """
    pages = df.select(F.col(f"`{page_id}`").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), lines.alias("lines"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    seen = pages.select("host", F.explode(F.array_distinct("lines")).alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("seen")).where(F.col("seen") >= least_seen)
    often = seen.join(totals, "host").where((F.col("pages") >= least_pages) & (F.col("seen") > ratio * F.col("pages")))
    lists = often.groupBy("host").agg(F.collect_list("line").alias("boilerplate"))
    # Hosts with more than a quarter of a thousandth of the pages, so at most PARTS, are dealt to parts.
    every = totals.agg(F.sum("pages").alias("all"))
    large = totals.crossJoin(F.broadcast(every)).where(F.col("pages") * PARTS > F.col("all"))
    large = F.broadcast(large.select("host", F.ceil(F.col("pages") * PARTS / F.col("all")).cast("int").alias("parts")))
    own = F.coalesce("parts", F.lit(1))
    dealt = lists.join(large, "host", "left").select(F.col("host").alias("of_host"), "boilerplate", F.explode(F.sequence(F.lit(0), own - 1)).alias("of_part"))
    parted = pages.join(large, "host", "left").withColumn("part", F.pmod(F.xxhash64("page_id"), own).cast("int"))
    met = parted.join(dealt, (F.col("host") == F.col("of_host")) & (F.col("part") == F.col("of_part")), "left")
    kept = F.when(F.col("boilerplate").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains(F.col("boilerplate"), x)))
    return met.withColumn("kept", kept).select("page_id", "host", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
