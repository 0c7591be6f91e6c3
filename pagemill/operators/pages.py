"""Page conversion: pages(page_id, url, html) → tagged Markdown documents.

One exchange, by page, which pages that are dealt by `page_id` already do without; then each page is converted by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions.text import WS, line_count, word_count
from pagemill.operators import tokens as T
from pagemill.operators.nodes import HINT, Row, Tree, page_tokens, parse
from pagemill.operators.reader import content
from pagemill.operators.render import ElementRule, dropped, escaped, joined, line_markdown
from pagemill.operators.selectors import let, quoted, test

def tag_block(tag: str, value) -> "F.Column":
    """`<tag>\\nvalue\\n</tag>\\n\\n`"""
    return F.concat(F.lit(f"<{tag}>\n"), value, F.lit(f"\n</{tag}>\n\n"))


def page_markdown(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Body Markdown of the main content (same main-content choice as the document)."""
    return page_document(pages.withColumnRenamed(html_col, "html") if html_col != "html" else pages, "").select(
        "page_id", "url", "body_md"
    )


def page_document(
    pages: DataFrame, run_date: str, rules: list[tuple[str, str, str]] | None = None, element_rules: list[ElementRule] | None = None
) -> DataFrame:
    """The converter: source tag, title tag, last-modified tag, breadcrumb line, body. `run_date` dates
    the pages that carry no date; `page_id` names a page.

    One scan and one exchange, by page: tokens are cut in Spark, `converted` makes a page's rows (`operators.nodes`), reader
    mode (`operators.reader`), fields and Markdown (`operators.render`) of them, Spark writes the Markdown escapes and the tags.
    `element_rules`: the caller's rules for elements. `rules`: a caller's list of patterns instead of the
    renderer; such pages are converted by `functions.html`.

    A page without main content gets an empty body and status `no_content`."""
    if rules is not None:
        return _assembled(_by_patterns(pages, run_date, rules))
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    # `copies`: rows of one id, which stand side by side. They are one page, as its rows say
    pages = pages.where(F.col("page_id").isNotNull()).select(
        "page_id", "url", "html", F.count(F.lit(1)).over(Window.partitionBy("page_id")).alias("copies"))
    hinted = F.coalesce(F.col("html").rlike(HINT), F.lit(False)).alias("hinted")
    schema = f"page_id {dict(pages.dtypes)['page_id']}, {CONVERTED}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    page = pages.select("page_id", "url", "copies", hinted, page_tokens("html").alias("tokens")).mapInArrow(
        lambda batches: _conversion(batches, arrow, element_rules or []), schema)
    return _assembled(page.select(
        "page_id", "url", F.expr(f"coalesce(nullif({_clean('_title')}, ''), {_clean('_h1')}, '')").alias("title"),
        F.coalesce(F.nullif("_changed", F.lit("")), F.nullif("_published", F.lit("")), F.lit(run_date)).alias("last_modified"),
        H.breadcrumbs_markdown(F.expr(crumb_items("_crumbs"))).alias("breadcrumb_md"),
        F.expr(escaped("_body")).alias("body_md"),
    ))


ITEM = 'li, span[itemprop="name"], [class*="breadcrumb-"]'

#: What a page's rows say: its fields, ARRAY<STRUCT<pos, end, text, link, item>> of the elements and texts in its breadcrumb
#: container, and the body, whose texts that may need escapes are marked.
CONVERTED = (
    "url string, _title string, _changed string, _published string, _h1 string, "
    "_crumbs array<struct<pos:int,`end`:int,text:string,link:struct<pos:int,href:string>,item:boolean>>, _body string"
)
#: Characters of Markdown that are sent at once.
SENT = 1 << 22


def _conversion(batches: Iterator[pa.RecordBatch], arrow: pa.Schema, rules: list[ElementRule]) -> Iterator[pa.RecordBatch]:
    """Batches of pages (page_id, url, copies, hinted, tokens), copies of one id side by side → batches of CONVERTED."""
    copies: list[tuple] = []  # of the page that is being read
    for batch in batches:
        tokens = batch.column("tokens")
        words = tokens.values.dictionary_encode()  # a token is parsed once for all its occurrences
        parsed = [*map(parse, words.dictionary.to_numpy(zero_copy_only=False).tolist())]
        cut, flat = tokens.offsets.to_numpy().tolist(), [*map(parsed.__getitem__, words.indices.to_numpy().tolist())]
        out, at, size = [], [], 0

        def made() -> pa.RecordBatch:
            fields = zip(*out)
            return pa.record_batch([batch.column("page_id").take(pa.array(at, pa.int32())), *(pa.array(v, f.type) for f, v in zip(list(arrow)[1:], fields))], schema=arrow)

        for i, (url, n, hinted) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("url", "copies", "hinted")))):
            copies.append((url, hinted, flat[cut[i] : cut[i + 1]]))
            if len(copies) == n:
                if (page := converted(copies, rules)) is not None:
                    out.append(page)
                    at.append(i)
                    size += len(page[-1])
                copies = []
                if size >= SENT:
                    yield made()
                    out, at, size = [], [], 0
        if out:
            yield made()


def converted(copies: list[tuple], rules: list[ElementRule]) -> tuple | None:
    """The columns of CONVERTED of a page, given as its (url, hinted, parsed tokens); several if rows share its id. None if a rule
    drops the page itself."""
    drops = any(r.drop for r in rules)
    rows: list[Row] = []
    for _, hinted, tokens in copies:
        tree = Tree(drops or hinted)
        tree.feed(tokens)
        own = tree.rows
        if hinted:
            for r in own:
                r.hinted = True
        rows = rows + own if rows else own
    rows.sort(key=attrgetter("pos"))
    if drops:
        rows = dropped(rows, rules)
        if not rows:
            return None
    title = changed = published = h1 = box = None
    texts: dict[int, str] = {}
    nothing: set[int] = set()
    for i, r in enumerate(rows):
        if r.runs is not None:
            texts[i] = md = line_markdown(r, rules)
            head = r.block == "h1" and [x for x in r.runs if x.kind == "text"]
            if head:
                h1 = _first(h1, r.pos, "".join([" " + x.text if x.space else x.text for x in head]))
            elif not md and not r.hinted:
                nothing.add(i)
        elif r.kind == "open":
            if r.attrs:
                changed = _first(changed, r.pos, r.attrs.get("data-timemodified"))
                published = _first(published, r.pos, r.attrs.get("data-publicationdate"))
                if r.hinted:
                    for rank, selector in enumerate(H.BREADCRUMB_SELECTORS):
                        if test(selector)(r.tag, r.attrs):
                            box = min(box or (rank, r.pos, r.end), (rank, r.pos, r.end))
                            break
        elif r.kind == "title" and r.text.strip(" \t\n\r\f"):
            title = _first(title, r.pos, r.text)
    crumbs = [c for r in rows if box[1] < r.pos < box[2] and r.hinted for c in _crumbs(r)] if box else []
    crumbs.sort(key=lambda c: (c["pos"], c["end"], c["text"] or ""))
    urls = [url for url, _, _ in copies if url is not None]
    said = [x and x[1] for x in (title, changed, published, h1)]
    return max(urls, default=None), *said, crumbs, joined(content(rows, texts, nothing))


def _first(found: tuple | None, pos: int, value: str | None) -> tuple | None:
    return found if value is None or found is not None and found <= (pos, value) else (pos, value)


def _crumbs(r: Row) -> list[dict]:
    """What a row brings to breadcrumbs: elements, which may be items or links, and texts under their link."""
    if r.kind == "open":
        link = {"pos": r.pos, "href": r.attrs.get("href")} if r.tag == "a" else None
        return [{"pos": r.pos, "end": r.end, "text": None, "link": link, "item": test(ITEM)(r.tag, r.attrs)}]
    out = []
    for x in r.runs or []:
        if x.kind in ("text", "open"):
            link = next(({"pos": m["pos"], "href": m["href"]} for m in x.marks if m["kind"] == "link"), None)
            text = None if x.kind == "open" else " " + x.text if x.space else x.text
            out.append({"pos": x.pos, "end": x.pos + 1 if x.end is None else x.end, "text": text, "link": link, "item": x.kind == "open" and test(ITEM)(x.tag, x.attrs)})
    return out


def _clean(text: str) -> str:
    """SQL: white space collapsed and trimmed."""
    return f"regexp_replace(regexp_replace({text}, {quoted(H.HTML_WS + '+')}, ' '), {quoted('\\A' + WS + '+|' + WS + '+\\z')}, '')"


def crumb_items(rows: str) -> str:
    """SQL: ARRAY<STRUCT<text, url>> of the items among a container's rows in order: text and href of the item's first link,
    else its text where it has any."""
    said = lambda own: _clean(f"array_join(transform({own}, r -> r.text), '')")
    link = "get(filter(transform(own, r -> r.link), x -> x.pos > i.pos), 0)"
    item = let(link, "x", f"named_struct('text', CASE WHEN x IS NOT NULL THEN {said('filter(own, r -> r.link.pos = x.pos)')} ELSE {said('own')} END, 'url', nullif(x.href, ''))")
    # rows in the item's interval follow it directly, and are no more than the interval is long
    own = f"filter(slice({rows}, at + 2, greatest(least(i.`end` - i.pos, size({rows})) - 1, 0)), r -> r.pos < i.`end`)"
    items = f"transform({rows}, (i, at) -> CASE WHEN i.item THEN {let(own, 'own', item)} END)"
    return f"filter({items}, b -> b.url IS NOT NULL OR b.text <> '')"


def _by_patterns(pages: DataFrame, run_date: str, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Conversion with a caller's patterns: the article or main shortcut, else the scored container of the token table."""
    crumbs = H.breadcrumb_items(F.col("html"))
    meta = [
        H.page_title("html").alias("title"),
        H.last_modified("html", run_date).alias("last_modified"),
        F.when(F.col("html").rlike("breadcrumb|Breadcrumb|navigation-path|class[^>]*path"), H.breadcrumbs_markdown(crumbs))
        .otherwise(F.lit(""))
        .alias("breadcrumb_md"),
    ]
    cleaned = F.col("html")
    for _name, pattern, repl in (r for r in H.MARKDOWN_RULES if r[0] in H.CLEAN_RULES):
        cleaned = F.regexp_replace(cleaned, pattern, repl)
    short = H.shortcut_html(cleaned)
    with_short = pages.select("page_id", "url", "html", *meta, short.alias("main_html")).filter(F.col("main_html") != "")
    rest = pages.filter(short == "").select("page_id", "url", "html", *meta)
    scored = T.scored_main_html(rest.select("page_id", "html"))
    rest = rest.join(scored, "page_id", "left").withColumn("main_html", F.coalesce("main_html", F.lit("")))
    base = with_short.unionByName(rest.select(*with_short.columns))
    return H.add_markdown(base, F.col("main_html"), "body_md", rules).drop("html", "main_html")


def _assembled(df: DataFrame) -> DataFrame:
    # A page without main content is a failed row, not a failed task.
    df = df.withColumn("status", F.when(F.col("body_md") == "", F.lit("no_content")).otherwise(F.lit("ok")))
    return df.withColumn(
        "markdown",
        F.concat(
            tag_block("md_html-source", F.col("url")),
            tag_block("md_html-title", F.col("title")),
            tag_block("md_last-modified", F.col("last_modified")),
            F.col("breadcrumb_md"),
            F.col("body_md"),
        ),
    )


def page_stats(docs: DataFrame, generated_at: str) -> DataFrame:
    """Per-page size statistics of the Markdown document. Title is the page
    title (the first line of the document is always the source tag)."""
    md = F.col("markdown")
    return docs.select(
        "page_id",
        "url",
        "title",
        word_count(md).alias("word_count"),
        F.length(md).cast("bigint").alias("char_count"),
        line_count(md).alias("line_count"),
        F.ceil(F.length(md) / 4).cast("bigint").alias("token_count"),
        F.lit(generated_at).alias("generated_at"),
    )
