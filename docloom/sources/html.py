"""Metadata and links of HTML pages, by patterns on the JVM; pages(page_id, url, html)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def metadata(pages: DataFrame) -> DataFrame:
    """(page_id, title, lang, h1); missing parts are empty."""
    x = lambda p: F.regexp_extract("html", p, 1)
    return pages.select("page_id", x("<title>([^<]*)</title>").alias("title"), x('<html[^>]* lang="([^"]*)"').alias("lang"), x("<h1[^>]*>([^<]*)</h1>").alias("h1"))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, href) of each link."""
    return pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


def link_kind(href: Column) -> Column:
    return F.when(href.rlike("^(https?:)?//"), "external").when(href.rlike("^[a-z]+:"), "other").when(href.startswith("#"), "anchor").when(href.startswith("/"), "rooted").otherwise("relative")
