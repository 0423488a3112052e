"""Stored web pages to notices and listing rows, by expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.core import norm_ws
from ..functions.text import safe_filename

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
UNSEEN = r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>|<!--.*?-->"
ANY_TAG = r"(?s)<[^>]*>"
LINK = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'
IMAGE = r'(?is)<img\s[^>]*?src="([^"]*)"'
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def visible_text(html: Column) -> Column:
    """Text without scripts, styles, comments and tags, white space collapsed."""
    return norm_ws(unescape(F.regexp_replace(F.regexp_replace(html, UNSEEN, " "), ANY_TAG, " ")))


def html_to_notice(pages: DataFrame, page_id: str, url: str, html: str, *,
                   attachment_mark: str = "Download") -> DataFrame:
    """One notice per page: title, body text, link targets, attachment names (links whose
    target holds the mark) and image sources without inline data."""
    body = F.col(html)
    links = F.arrays_zip(F.regexp_extract_all(body, F.lit(LINK), F.lit(1)).alias("href"),
                         F.regexp_extract_all(body, F.lit(LINK), F.lit(2)).alias("label"))
    parsed = pages.select(
        F.col(page_id).cast("string").alias("notice_id"), F.col(url).alias("url"),
        norm_ws(unescape(F.regexp_extract(body, TITLE, 1))).alias("title"),
        visible_text(body).alias("content"), links.alias("links"),
        F.filter(F.regexp_extract_all(body, F.lit(IMAGE), F.lit(1)),
                 lambda s: (s != "") & ~s.startswith("data:")).alias("images"))
    files = F.transform(
        F.filter("links", lambda l: l["href"].contains(attachment_mark)),
        lambda l: safe_filename(F.regexp_replace(l["label"], ANY_TAG, "")))
    return parsed.withColumns({
        "attachments": F.filter(files, lambda f: f != ""),
        "links": F.transform("links", lambda l: l["href"]),
    })


def listing_rows(pages: DataFrame, page_id: str, html: str, *, row: str, id_group: int = 1,
                 title_group: int = 2, date_group: int | None = None) -> DataFrame:
    """One row per listing entry: ``row`` is a pattern whose groups give the id, the title
    and optionally the date."""
    groups = {"item_id": id_group, "title": title_group}
    if date_group is not None:
        groups["date"] = date_group
    zipped = F.arrays_zip(*[F.regexp_extract_all(F.col(html), F.lit(row), F.lit(g)).alias(n)
                            for n, g in groups.items()])
    rows = pages.select(F.col(page_id).alias("page_id"), F.posexplode(zipped).alias("at", "r"))
    return rows.select(
        "page_id", (F.col("at") + 1).cast("bigint").alias("position"), F.col("r.item_id").alias("item_id"),
        norm_ws(unescape(F.regexp_replace(F.col("r.title"), ANY_TAG, " "))).alias("title"),
        *([F.col("r.date").alias("date")] if date_group is not None else []))
