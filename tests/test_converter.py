"""Converter: tagged document, date fallbacks, Markdown rules, tables, breadcrumbs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.operators import pages as P

SAMPLE = """<!DOCTYPE html>
<html><head><title>Sample Page</title><style>p{color:red}</style><script>var x = "</p>";</script></head>
<body>
<nav><a href="/home">Home</a></nav>
<article>
  <h1>Main Heading</h1>
  <p>Intro with <b>bold</b>, <em>stress</em> and <a href="https://example.org/x">a link</a>.</p>
  <h2>Pictures</h2>
  <img src="images/one.png" alt="First picture">
  <img alt="Second" src="images/two.png">
  <h2>Sounds</h2>
  <p><a href="media/clip.mp3">Clip one</a> and <a href="media/clip.wav">Clip two</a></p>
  <h2>Lists</h2>
  <ul><li>alpha</li><li>beta</li><li>gamma</li></ul>
  <ol><li>first</li><li>second</li></ol>
  <blockquote><p>Quoted words</p><p>second line</p></blockquote>
  <pre><code>x = 1
y = 2</code></pre>
  <p>Line one<br>Line two &amp; more&hellip;</p>
</article>
<footer>&copy; Sample</footer>
</body></html>"""


def _doc(spark, html, url="https://example.org/page.html", run_date="2024-06-01"):
    df = spark.createDataFrame([(1, url, html)], "page_id bigint, url string, html string")
    return P.page_document(df, run_date).first()


def test_three_tags_present(spark):
    md = _doc(spark, SAMPLE).markdown
    assert md.startswith("<md_html-source>\nhttps://example.org/page.html\n</md_html-source>\n\n")
    assert "<md_html-title>\nSample Page\n</md_html-title>\n\n" in md
    assert "<md_last-modified>\n2024-06-01\n</md_last-modified>\n\n" in md


def test_convert_twice_is_equal(spark):
    assert _doc(spark, SAMPLE).markdown == _doc(spark, SAMPLE).markdown


def test_date_from_timemodified(spark):
    html = '<html><body><div data-timemodified="2023-06-15"><article><p>x</p></article></div></body></html>'
    assert _doc(spark, html).last_modified == "2023-06-15"


def test_date_from_publicationdate(spark):
    html = '<html><body><div data-publicationdate="2023-07-20"><article><p>x</p></article></div></body></html>'
    assert _doc(spark, html).last_modified == "2023-07-20"


def test_date_falls_back_to_run_date(spark):
    html = "<html><body><article><p>x</p></article></body></html>"
    assert _doc(spark, html, run_date="2031-01-02").last_modified == "2031-01-02"


def test_empty_timemodified_counts_as_missing(spark):
    html = '<html><body><i data-timemodified=""></i><b data-publicationdate="2022-02-02">x</b><article>y</article></body></html>'
    assert _doc(spark, html).last_modified == "2022-02-02"


def test_markdown_rules(spark):
    body = _doc(spark, SAMPLE).body_md
    assert body.startswith("# Main Heading\n\n")
    assert "Intro with **bold**, _stress_ and [a link](https://example.org/x)." in body
    assert "## Pictures" in body
    assert "![First picture](images/one.png)" in body
    assert "![Second](images/two.png)" in body
    assert "[Clip one](media/clip.mp3) and [Clip two](media/clip.wav)" in body
    assert "*   alpha\n*   beta\n*   gamma\n\n" in body
    assert "1.  first\n2.  second" in body
    assert "> Quoted words\n> \n> second line\n\n" in body
    assert "```\nx = 1\ny = 2\n```" in body  # whitespace inside <pre> is kept
    assert "Line one  \nLine two & more…" in body
    assert "Home" not in body and "Sample</" not in body  # nav and footer are not main content
    assert "color:red" not in body and "var x" not in body


def test_title_falls_back_to_h1(spark):
    html = "<html><body><article><h1>Only &amp; heading</h1></article></body></html>"
    assert _doc(spark, html).title == "Only & heading"


def test_table_to_pipe_table(spark):
    html = (
        "<table><tr><th>Name</th><th>Note</th></tr>"
        "<tr><td>a|b</td><td>Key 1 Example: x</td></tr>"
        "<tr><th>ignored</th><td>c</td><td>Plain</td></tr></table>"
    )
    df = spark.createDataFrame([(html,)], "h string")
    md = df.select(H.html_table_markdown(F.col("h")).alias("m")).first().m
    assert md == "\n\n| Name | Note |\n| --- | --- |\n| a\\|b | Key 1 (Example: x) |\n| c | Plain |\n\n"
    empty = spark.createDataFrame([("<table></table>",)], "h string").select(H.html_table_markdown(F.col("h")).alias("m"))
    assert empty.first().m == ""


def test_breadcrumbs_priority_and_rendering(spark):
    html = (
        '<div class="path"><ul><li>wrong</li></ul></div>'
        '<ol class="crumbs breadcrumb"><li><a href="/">Home</a></li><li> Docs </li><li></li></ol>'
    )
    df = spark.createDataFrame([(html,)], "h string")
    row = df.select(H.breadcrumbs_markdown(H.breadcrumb_items(F.col("h"))).alias("m")).first()
    assert row.m == "<md_breadcrumb>\n> [Home](/) > Docs\n</md_breadcrumb>\n\n"
    none = spark.createDataFrame([("<p>no crumbs</p>",)], "h string")
    assert none.select(H.breadcrumbs_markdown(H.breadcrumb_items(F.col("h"))).alias("m")).first().m == ""


def test_page_stats(spark):
    df = spark.createDataFrame([(1, "https://e.org/", "<html><body><article><p>one two three</p></article></body></html>")],
                               "page_id bigint, url string, html string")
    st = P.page_stats(P.page_document(df, "2024-06-01"), "2024-06-01").first()
    doc = P.page_document(df, "2024-06-01").first().markdown
    assert st.char_count == len(doc)
    assert st.line_count == len(doc.split("\n"))
    assert st.word_count == len(doc.split())
    assert st.token_count == -(-len(doc) // 4)
    assert st.title == ""  # the title is the page title, not the first line (which is a tag)


def test_text_is_escaped_but_code_and_tables_are_not(spark):
    html = (
        "<article><h1>De%%% êeux*** ouier### x_y</h1><p>- item [a] `t` 1. one</p>"
        "<p><code>a_b*c</code></p><pre>keep *this* _as_ is</pre>"
        "<table><tr><th>k_1</th></tr><tr><td>v*2</td></tr></table></article>"
    )
    body = _doc(spark, html).body_md
    assert body.startswith("# De%%% êeux\\*\\*\\* ouier### x\\_y\n\n")
    assert "\\- item \\[a\\] \\`t\\` 1. one" in body
    assert "`a_b*c`" in body and "keep *this* _as_ is" in body
    assert "| k_1 |" in body and "| v*2 |" in body


def test_page_without_content_is_a_failed_row(spark):
    assert _doc(spark, "<html><body><nav>only nav</nav></body></html>").status == "no_content"
    assert _doc(spark, SAMPLE).status == "ok"
