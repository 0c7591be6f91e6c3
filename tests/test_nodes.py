"""Node table, selectors, reader mode and rules on rows built here."""

from __future__ import annotations

import html as pyhtml
import time

import pytest
from pyspark.sql import functions as F

from pagemill.functions.text import decode_entities
from pagemill.operators import nodes as N
from pagemill.operators import pages as P
from pagemill.operators.render import ElementRule
from pagemill.operators.selectors import matches
from pagemill.operators.selectors import test as selected


def pages(spark, *htmls):
    return spark.createDataFrame([(i, "https://e.org/p", h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")


def bodies(spark, *htmls, rules=None):
    return {r["page_id"]: r["body_md"] for r in P.page_document(pages(spark, *htmls), "2024-06-01", element_rules=rules).collect()}


CASES = [
    ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
    ("<h2 class='a>b'>T</h2>", "## T"),
    ("<img src='a.png' alt='A'>", "![A](a.png)"),
    ("<img src=a.png>", "![](a.png)"),
    ("<a href=u>x</a>", "[x](u)"),
    ('<img data-src="lazy.png" src="real.png">', "![](real.png)"),
    ('<a data-href="x" href="y">z</a>', "[z](y)"),
    ("<p>&#38;lt; &AMP;lt; &amp;lt; &copy 5 &#150; &notit;</p>", "&lt; &lt; &lt; © 5 – ¬it;"),
    ("<blockquote>a<blockquote>b</blockquote>c</blockquote>", "> a\n> \n> > b\n> \n> c"),
    ("<ul><li><p>one</p><p>two</p></li></ul>", "*   one\n\n    two"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "*   a\n*   b\n    *   c\n*   d"),
    ("<ol start=1234567><li>x<li>y</ol>", "1234567.  x\n1234568.  y"),
    ("<pre><code class='language-js'>x < 1;\n  y</code></pre>", "```js\nx < 1;\n  y\n```"),
    ('<a href="u" title="ti">x</a>', '[x](u "ti")'),
    ("<p><b>a <i>b</i></b> c</p>", "**a _b_** c"),
    ("<p><b>a<p>b</b> c</p>", "**a**\n\n**b** c"),
    ("<p>a<br>b<br></p>", "a  \nb"),
    ("<p>a <b> b </b> c</p>", "a **b** c"),
    ("<ul><li><blockquote>q<pre>x\ny</pre></blockquote></li></ul>", "*   > q\n    > \n    > ```\n    > x\n    > y\n    > ```"),
    ("<table><tr><th>a</th><td></td></tr><tr><td>1|2</td><td>x Example: y</td></tr></table>", "| a |  |\n| --- | --- |\n| 1\\|2 | x (Example: y) |"),
    ("<dl><dt>t<dd>d</dl>", "t\n\nd"),
    ("<p>x</i></div></p>y", "x\n\ny"),
    ("<p>a<!-- <p>no --> b<script>if (a<b) x('</p>')</script> c</p>", "a b c"),
    ("<hr><p>x</p>", "* * *\n\nx"),
    ("<p>end<a hre", "end"),
]


def test_markdown_of_markup_as_it_comes(spark):
    got = bodies(spark, *(f"<article>{h}</article>" if not h.endswith("<a hre") else f"<article>{h}" for h, _ in CASES))
    assert [got[i] for i in range(len(CASES))] == [want for _, want in CASES]


LONG = "This is the text of the real article, with commas, and with enough words, to count as content."


def test_reader_mode(spark):
    got = bodies(
        spark,
        f"<body><article class='card'><p>teaser one.</p></article><div><p>{LONG}</p><p>{LONG}</p></div></body>",
        f"<body><div><div><p>{LONG}{LONG}</p></div><div class='ad-box'><p>{LONG}</p></div><div><p>{LONG}{LONG}</p></div></div></body>",
        f"<body><nav><p>{LONG}</p></nav><main><p>short</p></main></body>",
        f"<body><div class='sidebar'><p>{LONG}</p></div></body>",
        "<body><nav>only nav</nav></body>",
        f"<article><p>{LONG}</p><aside>{LONG}</aside><footer>by me</footer></article>",
    )
    assert got == {0: f"{LONG}\n\n{LONG}", 1: f"{LONG}{LONG}\n\n{LONG}{LONG}", 2: "short", 3: LONG, 4: "", 5: LONG}


def test_element_rules(spark):
    rules = [ElementRule("mark", "mark", "==", "=="), ElementRule("kbd", "kbd, span[data-k]", "<", ">"), ElementRule("ads", ".promo", drop=True), ElementRule("hidden", "span.x", drop=True)]
    page = "<article><p><mark>a</mark> b <kbd>c</kbd><span data-k=1>d</span> e <span class='y x'>gone <b>too</b></span>f</p><div class='promo big'><p>buy</p></div><p>g</p></article>"
    assert bodies(spark, page, rules=rules)[0] == "==a== b <c><d> e f\n\ng"


SELECTORS = [
    ("div", [0, 1]), (".a", [0]), ("div.a", [0]), ("#n", [1]), ("[k]", [2]), ("[k=v]", [2]), ('span[k="v"]', [2]), ("[class~=b]", [0]), ("[class*='-x']", [3]),
    ("[class^=c]", [3]), ("[class$=x]", [3]), ("div, span", [0, 1, 2]), ("*", [0, 1, 2, 3]), (".a.b", [0]), (".a.c", []),
]


def test_selectors(spark):
    rows = [(0, "div", {"class": "a b"}), (1, "div", {"id": "n"}), (2, "span", {"k": "v"}), (3, "p", {"class": "c-x"})]
    d = spark.createDataFrame(rows, "i int, tag string, attrs map<string,string>")
    got = d.select("i", *(matches(s).alias(f"m{k}") for k, (s, _) in enumerate(SELECTORS))).collect()
    assert [[r["i"] for r in got if r[f"m{k}"]] for k in range(len(SELECTORS))] == [want for _, want in SELECTORS]
    for bad in ("div > p", "", "a:hover"):
        with pytest.raises(ValueError):
            matches(bad)


def test_rows_are_balanced_and_tokens_are_the_page(spark):
    junk = ["<div><p>a<div>b</p></div><b><i>c</b></i><table><td>x<tr><td>y</table><li>z", "</div></p>text<ul><li><ol><li>", "<<a><><!x><?y></ 3>t", ""]
    d = pages(spark, *junk)
    for r in d.select("html", N.page_tokens("html").alias("t")).collect():
        assert "".join(r["t"]) == r["html"]
    rows = N.html_nodes(d).select("page_id", "pos", "end", "parent", "kind", "tag").collect()
    for page in range(len(junk)):
        mine = sorted((r for r in rows if r["page_id"] == page), key=lambda r: r["pos"])
        opened, blocks = {r["pos"]: r for r in mine if r["kind"] == "open"}, []
        for r in mine:
            if r["kind"] == "close":
                o = opened[r["end"]]
                assert o["tag"] == r["tag"] and o["end"] == r["pos"] + 1
                blocks.append((o["pos"], r["pos"]))
        assert len({r["pos"] for r in mine}) == len(mine)
        assert not any(a < c < b < d_ for a, b in blocks for c, d_ in blocks)  # elements nest


BROKEN = {"tag": "<a " * 400000, "comment": "<!--" * 300000, "quote": '<p x="' * 200000, "open": "<div>x" * 100000, "lists": "<ul><li>x" * 50000, "bold": "<b>x" * 100000, "less": "< " * 300000,
          "tables": "<table><tr><td>" * 10000, "ends": "</div>" * 100000, "flat": "<ul>" + "<li>x" * 100000}


def test_broken_pages_of_a_megabyte_take_seconds(spark):
    N.html_nodes(pages(spark, "<p>warm")).count()
    for name, page in BROKEN.items():
        began = time.time()
        N.html_nodes(pages(spark, page)).count()
        assert time.time() - began < 40, name


def test_references_like_python(spark):
    texts = ["&copy2 &amp &ampx &lt;&lt &#150;&#x80; &#38;lt; &notit; &not; &#xZ; &; & &nbsp x &frac12 &sup2;", "&#128;", "&AMP;lt;", "&rsquo &rsquo;"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in d.orderBy("i").select(decode_entities("t")).collect()] == [pyhtml.unescape(t) for t in texts]


def test_dates_and_breadcrumbs_come_from_elements(spark):
    page = ('<title>A > B</title><div data-x=\'<i data-timemodified="1999-01-01">\'><p data-timemodified="2023-02-03">x</p></div><nav class="breadcrumbs"><ol><li><a href="/a?x=1&amp;y=2">A &gt; a</a>'
            '<li><span>B</span></ol></nav><article>y</article>')
    r = P.page_document(pages(spark, page), "2024-06-01").first()
    assert (r["title"], r["last_modified"]) == ("A > B", "2023-02-03")
    assert r["breadcrumb_md"] == "<md_breadcrumb>\n> [A > a](/a?x=1&y=2) > B\n</md_breadcrumb>\n\n"


def test_one_scan_and_one_exchange(spark, tables):
    plan = P.page_document(tables.pages, "2024-06-01")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1


def test_rows_without_lines_stay_behind(spark):
    table = "<p>x</p><table class=t>" + "<tr><td>1</td><td>2</td></tr>" * 200 + "</table>"
    d = pages(spark, table, "<div><div class=path></div></div><p>y", "")
    lean = {(r["page_id"], r["pos"]): r for r in N.html_nodes(d, whole=False).collect()}
    whole = {(r["page_id"], r["pos"]): r for r in N.html_nodes(d).collect()}
    assert sum(k[0] == 0 for k in lean) < 8 < 1000 < sum(k[0] == 0 for k in whole)
    assert all(whole[k] == r for k, r in lean.items()) and {k for k in whole if k[0]} == {k for k in lean if k[0]}
    # a page whose containers are all bare, an article in a cell, an unlikely element in a cell
    got = bodies(spark, "<div><div></div></div>", f"<table><tr><td><article>{LONG}</article></td></tr></table><p>{LONG}</p>", f"<p>{LONG}</p><table><tr><td class=sidebar><div>s</div></td></tr></table><p>{LONG}</p>")
    assert got == {0: "", 1: f"| {LONG} |\n| --- |\n\n{LONG}", 2: f"{LONG}\n\n| s |\n| --- |\n\n{LONG}"}


def test_lines_are_made_once(spark):
    plan = P.page_document(pages(spark, "<p>x"), "2024-06-01")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("\\A( ?)~~~") == 1  # one of the patterns that escape a text
    assert bodies(spark, "<article><p>- a_b</p><p>plain, text</p><p>1. x</p><p> # y</p></article>")[0] == "\\- a\\_b\n\nplain, text\n\n1\\. x\n\n\\# y"


def test_pages_dealt_by_id_are_not_dealt_again(spark, tables):
    from pagemill.sources.derived import order_pages

    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    source = order_pages(tables)
    converted = plan(P.page_document(source, "2024-06-01"))
    assert converted.count("Exchange hashpartitioning") == plan(source).count("Exchange hashpartitioning")
    assert converted.count("Window [") == 1 and converted.count("MapInArrow") == 1  # a page's rows never leave its converter


def test_rows_of_one_id_are_one_page(spark):
    """Their lines stand side by side, by text at one place, as they always did."""
    page = f"<title>T</title><article><h1>H</h1><p>{LONG}</p><ul><li>a_b</ul></article>"
    d = spark.createDataFrame([(1, "https://e.org/a", page), (1, "https://e.org/b", page), (None, "u", page), (2, None, None)], "page_id bigint, url string, html string")
    got = {r["page_id"]: (r["url"], r["title"], r["body_md"], r["status"]) for r in P.page_document(d, "2024-06-01").collect()}
    assert got == {1: ("https://e.org/b", "T", f"\n\n# H# H\n\n{LONG}\n\n{LONG}\n\n    a\\_b\n\n*   a\\_b", "ok"), 2: (None, "", "", "no_content")}


def test_python_selectors_match_as_sql():
    rows = [("div", {"class": "a b"}), ("div", {"id": "n"}), ("span", {"k": "v"}), ("p", {"class": "c-x"})]
    assert [[i for i, r in enumerate(rows) if selected(s)(*r)] for s, _ in SELECTORS] == [want for _, want in SELECTORS]
