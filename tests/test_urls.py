"""URL functions on awkward URLs, and against Python's `urljoin` for relative references."""

from __future__ import annotations

from urllib.parse import urljoin

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import urls as U

PAGES = [
    # url, host, path
    ("https://S.org/a b|c", "s.org", "/a%20b|c"),
    ("https://s.org/café/x", "s.org", "/caf%C3%A9/x"),
    ("https://s.org:443/a/./b/../c", "s.org", "/a/c"),
    ("http://user:pw@s.org:8080", "s.org", "/"),
    ("https://s.org/a/b/c/d/e/f/../../../../../../x", "s.org", "/x"),
    ("https://s.org/a/%2E%2e/b/%2e", "s.org", "/b/"),
    ("https://s.org/../../up/..", "s.org", "/"),
    ("https://s.org/a//b/?q=../x#f", "s.org", "/a//b/"),
    ("https://s.org/100%25/{x}", "s.org", "/100%25/%7Bx%7D"),
    ("no url", None, None),
]

HREFS = [
    # href, against the origin, against the page https://S.org/docs/guide/page.html?q=1
    ("../docs/a.html", "https://s.org/docs/a.html", "https://s.org/docs/docs/a.html"),
    ("./a.html", "https://s.org/a.html", "https://s.org/docs/guide/a.html"),
    ("/x/../y z?a b#f", "https://s.org/y%20z?a%20b#f", "https://s.org/y%20z?a%20b#f"),
    ("//T.org:443/p", "https://t.org/p", "https://t.org/p"),
    ("HTTP://T.org:80", "http://t.org/", "http://t.org/"),
    ("https://t.org:8443/a/../b", "https://t.org:8443/b", "https://t.org:8443/b"),
    ("ftp://t.org/x", "ftp://t.org/x", "ftp://t.org/x"),
    ("?p=2", "https://s.org/?p=2", "https://s.org/docs/guide/page.html?p=2"),
    (" café ", "https://s.org/caf%C3%A9", "https://s.org/docs/guide/caf%C3%A9"),
    ("a/b/../../../../c", "https://s.org/c", "https://s.org/c"),
]


def test_host_and_path(spark):
    df = spark.createDataFrame([(u,) for u, _, _ in PAGES], "u string")
    got = [(r.u, r.h, r.p) for r in df.select("u", U.host("u").alias("h"), U.path("u").alias("p")).collect()]
    assert got == PAGES


@pytest.mark.parametrize("base", ["origin", "page"])
def test_resolution(spark, base):
    df = spark.createDataFrame([(h,) for h, _, _ in HREFS], "h string")
    got = [r[0] for r in df.select(U.resolve_against_origin("h", F.lit("https://S.org/docs/guide/page.html?q=1"), base)).collect()]
    assert got == [x[1 if base == "origin" else 2] for x in HREFS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.from_regex(r"(\.\./|\./|[a-z]{1,3}/){0,12}[a-z]{1,4}(\?[a-z]=1)?", fullmatch=True), min_size=20, max_size=60))
def test_relative_references_like_urljoin(spark, hrefs):
    page = "https://s.org/d1/d2/d3/page.html"
    df = spark.createDataFrame([(h,) for h in hrefs], "h string")
    got = [r[0] for r in df.select(U.resolve_against_origin("h", F.lit(page), "page")).collect()]
    assert got == [urljoin(page, h) for h in hrefs]


def test_awkward_urls_keep_their_path_key(spark):
    df = spark.createDataFrame([("https://s.org/a b|c.html",), ("https://s.org/x/../y/",)], "u string")
    assert [r[0] for r in df.select(U.path_key("u")).collect()] == ["tmp/s.org/a%20b|c/a%20b|c.html", "tmp/s.org/y/y"]


def test_merged_and_mirrored_paths(spark):
    df = spark.createDataFrame([("https://s.org/maps/sitemap.xml",), ("local/site.map.xml",), ("sitemap",)], "s string")
    assert [r[0] for r in df.select(U.merged_path("s")).collect()] == [
        "output/merged/sitemap-merged.md", "output/merged/site.map-merged.md", "output/merged/sitemap-merged.md"]
    t, o = U.local_markdown_paths("s", "/work/site")
    df = spark.createDataFrame([("file:///work/site/a/b.html",), ("/work/site/c.htm",), ("file:///else/d.html",)], "s string")
    assert [(r[0], r[1]) for r in df.select(t, o).collect()] == [("tmp/a/b.md", "output/a/b.md"), ("tmp/c.md", "output/c.md"), ("tmp/else/d.md", "output/else/d.md")]
