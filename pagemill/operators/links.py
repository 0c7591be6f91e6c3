"""Link extraction from page HTML (three tiers) and sitemap discovery.

All per-row array expressions: a page's links are computed where the page is
read, so the plan is narrow (scan → project → generate), no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import WS, col_
from pagemill.functions.urls import resolve_against_origin

# Extraction patterns of the three tiers and the skip/keep rules.
A_HREF = "<a[^>]*href=[\"']([^\"']+)[\"'][^>]*>"
ANY_HREF = "(?i)href=[\"']([^\"']+)[\"']"
BARE_URL = "(?i)(https?://[^" + WS[1:-1] + "<>\"']+)"
SKIP_HREF = "\\A(?:#|javascript:|mailto:|tel:)"
NAMESPACE_HOSTS = ["www.w3.org", "www.sitemaps.org"]
SITEMAP_LINK = "(?i)<link[^>]*rel=[\"']sitemap[\"'][^>]*href=[\"']([^\"']+)[\"'][^>]*>"
ROBOTS_LINK = "(?i)<a[^>]*href=[\"']([^\"']*robots\\.txt)[\"'][^>]*>"
ROBOTS_SITEMAP = "(?i)Sitemap:" + WS + "*(https?://[^" + WS[1:-1] + "]+)"


def keep_link(u: Column) -> Column:
    """Content links only: no namespace hosts, data: URLs, fragments or non-http(s)."""
    cond = ~u.startswith("data:") & ~u.contains("#") & (u.startswith("http://") | u.startswith("https://"))
    for h in NAMESPACE_HOSTS:
        cond = cond & ~u.contains(h)
    return cond


def extract_links(html, page_url) -> Column:
    """ARRAY<STRING> of content links in document order. Tier 1 `<a href>`; if
    it yields nothing, any `href=`; if still nothing, bare http(s) URLs."""
    h = col_(html)
    t1 = F.filter(F.regexp_extract_all(h, F.lit(A_HREF), 1), lambda x: ~x.rlike(SKIP_HREF))
    t2 = F.filter(F.regexp_extract_all(h, F.lit(ANY_HREF), 1), lambda x: ~x.rlike(SKIP_HREF))
    t3 = F.regexp_extract_all(h, F.lit(BARE_URL), 1)
    chosen = (
        F.when(F.size(t1) > 0, F.transform(t1, lambda x: resolve_against_origin(x, page_url)))
        .when(F.size(t2) > 0, F.transform(t2, lambda x: resolve_against_origin(x, page_url)))
        .otherwise(t3)
    )
    return F.filter(chosen, keep_link)


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, pos, link): one row per content link, `pos` 0-based."""
    return pages.select("page_id", F.posexplode(extract_links("html", F.col("url"))).alias("pos", "link")).select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "link"
    )


def page_links_top(pages: DataFrame, k: int = 5) -> DataFrame:
    """The first `k` content links per page (the reference's log preview)."""
    return pages.select(
        "page_id", F.posexplode(F.slice(extract_links("html", F.col("url")), 1, k)).alias("pos", "link")
    ).select("page_id", F.col("pos").cast("bigint").alias("pos"), "link")


def sitemap_discovery(pages: DataFrame) -> DataFrame:
    """Sitemap hints in a page: `<link rel=sitemap href>` and, separately, an
    `<a href=…robots.txt>` (the reference returned the latter as if it were a sitemap)."""
    return pages.select(
        "page_id",
        "url",
        F.nullif(F.regexp_extract("html", SITEMAP_LINK, 1), F.lit("")).alias("sitemap_link"),
        F.nullif(F.regexp_extract("html", ROBOTS_LINK, 1), F.lit("")).alias("robots_link"),
    )


def robots_sitemaps(robots: DataFrame, text_col: str = "robots_txt") -> DataFrame:
    """Every `Sitemap:` line of each robots.txt, in order; `pos` 0 is the one the
    reference would follow (first match)."""
    return robots.select(
        "host", F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(ROBOTS_SITEMAP), 1)).alias("pos", "sitemap_url")
    ).select("host", F.col("pos").cast("bigint").alias("pos"), "sitemap_url")


def body_kind(body) -> Column:
    """'html' when the body starts like an HTML page, else 'xml'."""
    return F.when(F.lower(F.regexp_replace(col_(body), "\\A" + WS + "+", "")).rlike("\\A(?:<!doctype html|<html)"), "html").otherwise("xml")


def source_kind(source) -> Column:
    """Input dispatch: local .html/.htm → html; local .xml → sitemap; URL with
    `sitemap` in it or ending `.xml` → sitemap; other URL → page."""
    s = F.lower(col_(source))
    is_url = s.rlike("\\A[a-z][a-z0-9+.\\-]*://")
    return (
        F.when(~is_url & (s.endswith(".html") | s.endswith(".htm")), "html")
        .when(~is_url & s.endswith(".xml"), "sitemap")
        .when(~is_url, "file")
        .when(s.contains("sitemap") | s.endswith(".xml"), "sitemap")
        .otherwise("page")
    )
