"""Line dedup by site-relative frequency: lines on a large share of a host's pages are boilerplate.

A page's lines are its text between block elements.  Pages are counted by host, and for each host
the pages that hold a line are counted by the line's hash, combined on the map side; a host's lines
over the ratio form one short array (of lines of which a page has n, at most n / ratio can be over
it).  That array meets the pages of its host, and each page filters its own lines.  Line texts are
not gathered; up to BROADCAST_HOSTS hosts with boilerplate they are not shuffled either.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

# What the text of a page is (also used by the SQL twin).
HIDDEN = [rf"(?is)<{kind}\b.*?(?:</{kind}\s*>|\z)" for kind in ("script", "style", "noscript", "template")]
COMMENT = r"(?s)<!--.*?(?:-->|\z)"
BREAK = r"(?i)</?(p|div|li|ul|ol|dl|dt|dd|nav|h[1-6]|br|hr|title|article|section|aside|header|footer|main|table|tr|td|th|blockquote|pre|form|head|body|html)\b[^<>]*>"
TAG = r"</?[A-Za-z!?][^<>]*>"
SPACES = r"[ \t\r\f]+"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"

#: A line is dropped if more than RATIO of its host's pages hold it, and at least MIN_PAGES do.
RATIO, MIN_PAGES = 0.3, 3
#: Hosts with boilerplate whose arrays are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 20_000


def host(url: Column) -> Column:
    """The lower-case host of a URL, '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def lines(html: Column) -> Column:
    """The non-empty lines of a page in order, white space collapsed.

    A script or comment without its end hides the rest of the page.  No pattern reads on beyond where
    it fails, so a page takes time in proportion to its length.
    """
    text = F.coalesce(html, F.lit(""))
    for pattern in HIDDEN:
        text = F.regexp_replace(text, pattern, "\n")
    text = F.regexp_replace(text, COMMENT, "")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, BREAK, "\n"), TAG, ""), SPACES, " ")
    return F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.trim(x)), lambda x: x != "")


def drop_boilerplate(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """For every page: id, host, lines, dropped lines, and the kept lines.

    Null and invalid URLs share the host ''; null and empty pages have no lines.  Rows are pages,
    repeated rows too; a line that a page holds several times counts once, and all its places go.
    Columns other than the three named are not read; an empty table gives no rows.
    """
    scratch = Scratch(pages.sparkSession, "lines")
    own = pages.select(F.col(id_col).alias("id"), host(F.col(url_col).cast("string")).alias("host"), lines(F.col(html_col).cast("string")).alias("lines"))
    own = scratch.save(own, "own")  # pages are taken apart once; counts and filter read the lines
    totals = own.groupBy("host").agg(F.count("*").alias("pages"))
    held = own.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: F.xxhash64(x)))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("holding"))
    over = held.where(F.col("holding") >= min_pages).join(totals, "host").where(F.col("holding") > ratio * F.col("pages"))
    boilerplate = scratch.save(over.groupBy("host").agg(F.collect_set("line").alias("boilerplate")), "boilerplate")  # a few lines by host, see above
    if boilerplate.count() <= BROADCAST_HOSTS:
        boilerplate = F.broadcast(boilerplate)
    none = F.array().cast("array<bigint>")
    joined = own.join(boilerplate, "host", "left").withColumn("boilerplate", F.coalesce("boilerplate", none))
    return joined.withColumn("kept", F.filter("lines", lambda x: ~F.array_contains(F.col("boilerplate"), F.xxhash64(x)))).select(
        "id", "host", F.size("lines").cast("bigint").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("bigint").alias("n_dropped"), "kept"
    )
