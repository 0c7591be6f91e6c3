from __future__ import annotations

import html
import random
import re
import time

import pytest

from pagemill.llm import html_text
from pagemill.llm.queries import QUERIES


def text(x):
    return "\n".join(html_text.render(x))


def stripped_words(x):
    """All words of a page by plain stripping; right for pages without hidden elements beyond these."""
    x = re.sub(r"(?is)<!--.*?-->|<head\b.*?(</head>|(?=<body))|<(script|style)\b.*?</\2>", " ", x)
    return html.unescape(re.sub(r"<(/?)(b|i|a|span|em|strong)\b[^>]*>", "", re.sub(r"<(?!/?(?:b|i|a|span|em|strong)\b)[^>]*>", " ", x))).split()


def test_query_keeps_all_visible_words(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = QUERIES["op7_html"](spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        own = " ".join(re.sub(r"^(?:- |\d+\. )", "", x.lstrip()) for x in r["text"].split("\n")).split()
        assert own == stripped_words(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"]) and r["n_lines"] == (len(r["text"].split("\n")) if r["text"] else 0)


@pytest.mark.parametrize(
    "page, want",
    [
        ("", ""),
        ("plain &amp; simple &#8217;", "plain & simple ’"),
        ("<p>one<p>two<div>three</div>four", "one\n\ntwo\n\nthree\nfour"),
        ("<title>t</title><style>p{}</style><script>if (a<b) x()</script><p hidden>h</p><p style='color:red; Display : None'>n</p><template>t</template>seen", "seen"),
        ("<ul><li>a<li>b<ol><li>x<li value=7>y<li>z</ol><li>c</ul>after", "- a\n- b\n  1. x\n  7. y\n  8. z\n- c\n\nafter"),
        ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
        ("<pre>\n a\n\n  b </pre>c", " a\n\n  b\n\nc"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("a <b> b</b>c <i>d</i> e", "a bc d e"),
        ("<table><tr><th>name<th>n<tr><td>apple<td>1<tr><td>fig<td>200</table>", "name   n\napple  1\nfig    200"),
        ("<TABLE><TR><TD>a</TD><TD colspan=2>wide</TD></TR><TR><TD rowspan=2>r</TD><TD>x</TD><TD>y</TD></TR><TR><TD>u</TD><TD>v</TD></TR></TABLE>", "a  wide\nr  x  y\n   u  v"),
        ("<table><td>in<table><tr><td>a<td>b</table></td><td>out</table>", "in    out\na  b"),
        ("<table><tr><td><p>p1<p>p2<td>q</table>", "p1  q\np2"),
        ("<blockquote>q<p>r</blockquote>s", "> q\n\n> r\n\ns"),
        ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
        ("<details><summary>s</summary>no</details><details open><summary>s</summary>yes</details><dialog>no</dialog>", "s\ns\nyes"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("</p></div>x<td>y", "x\ny"),
        ("<p>a<!-- c --> b", "a b"),
        ('<div style="visibility:hidden">a<span style="visibility:visible">b</span><li>c</li></div>d', "b\nd"),
        ('<div style="visibility:hidden;display:none">a<span style="visibility:visible">b</span></div>d', "d"),
        ("<ol start=1234567><li>x<li value=-3>y<li>z</ol>", "1234567. x\n-3. y\n-2. z"),
        ("<table><tr><td>漢字<td>a<tr><td>xyz<td>b</table>", "漢字  a\nxyz   b"),
        ("1 < 2 <b title='a>b'>x</b> <3 &copy 4", "1 < 2 x <3 © 4"),
        ("<textarea>a &amp; <b></textarea><title>t</title>c<p", "a & <b>c"),
    ],
)
def test_rendering(page, want):
    assert text(page) == want


def test_made_up_pages():
    """Random blocks are written with optional end tags left out at random; the lines must come back."""
    rng = random.Random(1)
    for _ in range(300):
        page, want = [], []
        for _ in range(rng.randrange(1, 7)):
            word = lambda: rng.choice(["alpha", "b&c", "çé", "x<y", "42"])
            line = lambda: " ".join(word() for _ in range(rng.randrange(1, 5)))
            esc = lambda s: html.escape(s).replace(" ", rng.choice([" ", "\n  "]))
            end = lambda t: rng.choice([f"</{t}>", ""])
            kind = rng.choice(["p", "ul", "ol", "table", "hidden"])
            if kind == "hidden":
                page.append(rng.choice([f"<div hidden>{esc(line())}</div>", f"<script>{word()}</script>", f'<span style="display:none">{esc(line())}</span>']))
                continue
            if kind == "p":
                s = line()
                page.append(f"<p>{esc(s)}{end('p')}")
                out = [s]
            elif kind in ("ul", "ol"):
                items = [line() for _ in range(rng.randrange(1, 4))]
                page.append(f"<{kind}>" + "".join(f"<li>{esc(s)}{end('li')}" for s in items) + f"</{kind}>")
                out = [("- " if kind == "ul" else f"{i + 1}. ") + s for i, s in enumerate(items)]
            else:
                cells = [[word() for _ in range(3)] for _ in range(rng.randrange(1, 4))]
                page.append("<table>" + "".join("<tr>" + "".join(f"<td>{esc(c)}{end('td')}" for c in r) + end("tr") for r in cells) + "</table>")
                w = [max(len(r[k]) for r in cells) for k in range(3)]
                out = ["  ".join(c.ljust(n) for c, n in zip(r, w)).rstrip() for r in cells]
            want += ([""] if want else []) + out
        assert html_text.render("".join(page)) == want


@pytest.mark.parametrize("part, times", [("<a ", 400000), ("<!--", 300000), ('<p x="', 200000), ("<div>x", 100000), ("<ul><li>x", 50000), ("<p><button><div>", 30000), ("<table><td>x", 20000), ("<td>x", 50000), ("</p>x", 200000)])
def test_broken_pages_of_a_megabyte_take_seconds(part, times):
    began = time.process_time()
    html_text.render(part * times)
    assert time.process_time() - began < 20


def test_nulls_depth_and_length(spark):
    deep = "<div>" * 100000 + "x" + "<table><tr><td>" * 300 + "y"
    rows = [(1, None, "u"), (2, "", "u"), (3, deep, "u"), (4, "<p>w " * 50000, "u"), (4, "<p>w " * 50000, "u"), (None, "<li>a", None)]
    df = spark.createDataFrame(rows, "page_id bigint, html string, text string")
    out = html_text.extract(df)
    assert out.columns == ["page_id", "text", "n_chars", "n_lines"]
    got = {r["page_id"]: r for r in out.collect()}
    assert got[1]["text"] == got[2]["text"] == "" and got[2]["n_lines"] == 0
    assert got[3]["text"].split() == ["x", "y"] and got[None]["text"] == "- a" and got[4]["n_lines"] == 99999
    assert html_text.extract(df.limit(0)).collect() == []
