"""Page structure on rows built here: several articles, nested and upper-case tables, nested lists,
breadcrumb shapes, quotes, entities, unusual characters."""

from __future__ import annotations

import html as pyhtml

import pytest
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions.text import decode_entities
from pagemill.operators import pages as P


def body(spark, html, rules=None):
    df = spark.createDataFrame([(1, "https://e.org/p", html)], "page_id bigint, url string, html string")
    return P.page_document(df, "2024-06-01", rules).first()


LISTS = [
    ("<ul><li>a<ul><li>b</li><li>c</li></ul></li><li>d</li></ul>", "*   a\n    *   b\n    *   c\n*   d"),
    ("<ol start=3><li>x</li><li>y</li><li value='9'>z</li><li>w</li></ol>", "3.  x\n4.  y\n9.  z\n10.  w"),
    ("<OL><LI>one<UL><LI>in</LI></UL></LI><LI>two<OL><LI>deep</LI></OL></LI></OL>", "1.  one\n    *   in\n2.  two\n    1.  deep"),
    ("<ul><li>a</li><li>b</li></ul>", "*   a\n*   b"),
]


@pytest.mark.parametrize("html, want", LISTS)
def test_lists(spark, html, want):
    assert body(spark, f"<article>{html}</article>").body_md == want


TABLES = [
    ("<TABLE><TR><TH>A</TH><TH>B</TH></TR><TR><TD>1</TD><TD>2</TD></TR></TABLE>", "| A | B |\n| --- | --- |\n| 1 | 2 |"),
    # an inner table's rows follow the outer row that holds it, whose cells keep all their text
    ("<table><tr><th>A</th></tr><tr><td>x <table><tr><td>in</td></tr></table> y</td></tr></table>", "| A |\n| --- |\n| x in y | in |\n| in |"),
    ("<table><tr><td>h</td></tr></table> mid <table><tr><td>k</td></tr></table>", "| h |\n| --- |\n\n mid \n\n| k |\n| --- |"),
]


@pytest.mark.parametrize("html, want", TABLES)
def test_tables(spark, html, want):
    assert body(spark, f"<article>{html}</article>").body_md.replace("\n\nmid\n\n", "\n\n mid \n\n") == want


def test_two_articles_take_the_scored_container(spark):
    long = "This is the text of the real article, with commas, and with enough words, to count as content."
    page = f"<html><body><div><article><p>First teaser text here.</p></article><article><p>{long}</p><p>{long}</p></article></div></body></html>"
    r = body(spark, page)
    assert long in r.body_md and r.status == "ok"
    one = body(spark, f"<body><article><p>{long}</p><div><p>inside</p></div></article><p>outside</p></body>").body_md
    assert "inside" in one and "outside" not in one
    assert body(spark, f"<body><!-- <article>no</article> --><main><p>{long}</p>").body_md == long


CRUMBS = [
    ("<div class='breadcrumb'><span itemprop='name'>Home</span><span itemprop=\"name\">Docs</span></div>", "Home > Docs"),
    ("<ol class=\"breadcrumbs\"><li><span>Home</span></li><li><a href='/d'><span>Docs</span></a></li><li>End</li></ol><ul><li>no</li></ul>", "Home > [Docs](/d) > End"),
    ('<nav aria-label="Breadcrumb"><a class="breadcrumb-item" href="/x">X</a><p class="my breadcrumb-last">Y &amp; Z</p></nav>', "X > Y & Z"),
    ("<div id=breadcrumb><ul><li><a href=/a>A</a><li>B</ul></div><li>no</li>", "[A](/a) > B"),
    ("<div class='path'><div><ul><li>in</li></ul></div><ul><li>also</li></ul></div><ul><li>no</li></ul>", "in > also"),
    ("<div class='mypath'><li>no</li></div>", ""),
]


@pytest.mark.parametrize("html, want", CRUMBS)
def test_breadcrumbs(spark, html, want):
    md = body(spark, f"<html><body>{html}<article><p>text</p></article></body></html>").breadcrumb_md
    assert md == (f"<md_breadcrumb>\n> {want}\n</md_breadcrumb>\n\n" if want else "")


def test_entities_like_python(spark):
    texts = ["it&#8217;s &rsquo; &eacute;&#xE9; &amp;lt; &amp;#65; &unknown; &#0; &#x110000; &notin; &lt;b&gt; a & b &copy;&nbsp;x", "none", "&#128512;&hellip;", "&CounterClockwiseContourIntegral;"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(decode_entities("t")).collect()]
    assert got == [pyhtml.unescape(t) for t in texts]
    r = body(spark, "<title>It&#8217;s &eacute;t&eacute;</title><article><p>&rsquo;quoted&#8221; &amp;amp; &Omega;</p></article>")
    assert r.title == "It’s été" and r.body_md == "’quoted” &amp; Ω"


@pytest.mark.parametrize("attr", ["data-timemodified='2023-01-02'", "data-timemodified=2023-01-02", 'DATA-TIMEMODIFIED = "2023-01-02"'])
def test_dates_in_any_quotes(spark, attr):
    assert body(spark, f"<html><body><div {attr}><article><p>x</p></article></div></body></html>").last_modified == "2023-01-02"


def test_unusual_characters_survive(spark):
    odd = "icon  mark \u0001\u0002 end"
    assert body(spark, f"<article><p>{odd}</p><pre>a   b</pre><blockquote>q</blockquote></article>").body_md == f"{odd}\n\n```\na   b\n```\n\n> q"
    assert body(spark, "<article><p>no﷐ise﷕</p></article>").body_md == "noise"


def test_rules_by_name_in_any_order(spark):
    rules = [r for r in H.MARKDOWN_RULES if r[0] != "strong"]
    rules = [("mark", "(?i)</?mark>", "==")] + rules[::1]
    assert body(spark, "<article><script>x</script><p>a <mark>b</mark>  <b>c</b></p></article>", rules).body_md == "a ==b== c"
    short = [r for r in H.MARKDOWN_RULES if r[0] in ("whitespace", "tags", "trim")]
    df = spark.createDataFrame([("<p>x\n y</p>",)], "h string")
    assert H.add_markdown(df, F.col("h"), "m", short).first().m == "x y"


def test_orders_are_dealt_to_as_many_parts_as_named(spark, tables):
    from pagemill.sources.derived import order_pages, order_table_pages

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for pages in (order_pages(tables), order_table_pages(tables)):
        parts = pages.select(F.spark_partition_id().alias("p")).distinct().count()
        plan = pages._jdf.queryExecution().executedPlan().toString()
        assert parts == n and f", {n}), REPARTITION_BY_NUM" in plan  # small parts are not merged


def test_html_tables_sorts_pages_not_their_rows(spark, tables):
    from pagemill.plans.q_structure import html_tables

    plan = html_tables(tables)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1 and plan.count("MapInArrow") == 1 and plan.count("REPARTITION_BY_COL") == 0
