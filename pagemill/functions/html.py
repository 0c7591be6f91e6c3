"""HTML → structured fields and Markdown, as Column expressions.

No DOM and no per-row Python: each function is a chain of regex / string
expressions that Spark evaluates inside whole-stage codegen. Patterns use the
Java/RE2 common subset (see `text.py`), so the DuckDB oracle runs the very
same rules.

Contract of the Markdown renderer (`MARKDOWN_RULES`, applied in order):
ATX headings, fenced code (whitespace inside <pre> kept), `**` for b/strong,
`_` for i/em, inline links and images, `*   ` bullets and `1.  ` items of
ordered lists, `> ` quotes, `  \\n` for <br>, `* * *` for <hr>, one blank line
between blocks, unknown tags dropped with their text kept, entities decoded
last (`&amp;` after the others). Nested items are indented by four spaces, ordered
ones numbered; a table within a table gives its rows to the outer one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import (
    ENTITIES,
    HTML_WS,
    col_,
    collapse_ws,
    decode_entities,
    inner_text,
    interleave,
    js_trim,
    let,
    strip_tags,
)

_OPEN = "(?:" + HTML_WS + "[^>]*)?>"  # rest of an opening tag: optional attributes, then '>'
_CLOSE = HTML_WS + "*>"

BLOCK_TAGS = (
    "p|div|ul|ol|nav|section|article|header|footer|main|aside|table|thead|tbody|tfoot|tr|"
    "form|figure|figcaption|dl|dt|dd|address|center|fieldset|details|summary|body|html|head"
)

# (name, Java-regex pattern, Java replacement). Order matters. Callers may
# extend the list (the converter's rule hook) and pass it to `html_to_markdown`.
MARKDOWN_RULES: list[tuple[str, str, str]] = [
    ("comments", "(?s)<!--.*?-->", ""),
    ("script", f"(?is)<script{_OPEN}.*?</script{_CLOSE}", ""),
    ("style", f"(?is)<style{_OPEN}.*?</style{_CLOSE}", ""),
    ("noscript", f"(?is)<noscript{_OPEN}.*?</noscript{_CLOSE}", ""),
    ("whitespace", f"{HTML_WS}+", " "),
    ("pre_code", f"(?is)<pre{_OPEN} ?<code{_OPEN}(.*?)</code{_CLOSE} ?</pre{_CLOSE}", "\n\n```\n$1\n```\n\n"),
    ("pre", f"(?is)<pre{_OPEN}(.*?)</pre{_CLOSE}", "\n\n```\n$1\n```\n\n"),
    ("code", f"(?is)<code{_OPEN}(.*?)</code{_CLOSE}", "`$1`"),
] + [
    (f"h{n}", f"(?is)<h{n}{_OPEN}(.*?)</h{n}{_CLOSE}", f"\n\n{'#' * n} $1\n\n") for n in range(1, 7)
] + [
    ("link_dq", f"(?is)<a{HTML_WS}[^>]*?href{HTML_WS}*={HTML_WS}*\"([^\"]*)\"[^>]*>(.*?)</a{_CLOSE}", "[$2]($1)"),
    ("link_sq", f"(?is)<a{HTML_WS}[^>]*?href{HTML_WS}*={HTML_WS}*'([^']*)'[^>]*>(.*?)</a{_CLOSE}", "[$2]($1)"),
    ("img_alt_src", f"(?is)<img{HTML_WS}[^>]*?alt=\"([^\"]*)\"[^>]*?src=\"([^\"]*)\"[^>]*>", "![$1]($2)"),
    ("img_src_alt", f"(?is)<img{HTML_WS}[^>]*?src=\"([^\"]*)\"[^>]*?alt=\"([^\"]*)\"[^>]*>", "![$2]($1)"),
    ("img_src", f"(?is)<img{HTML_WS}[^>]*?src=\"([^\"]*)\"[^>]*>", "![]($1)"),
    ("strong", f"(?i)</?(?:strong|b){_OPEN}", "**"),
    ("em", f"(?i)</?(?:em|i){_OPEN}", "_"),
    ("br", f"(?i)<br{HTML_WS}*/?>", "  \n"),
    ("hr", f"(?i)<hr{_OPEN}", "\n\n* * *\n\n"),
    ("li_open", f"(?i)<li{_OPEN}", "\n*   "),
    ("li_close", f"(?i)</li{_CLOSE}", ""),
    ("quote", f"(?i)<blockquote{_OPEN}", "\n\n\ufdd5"),
    ("quote_close", f"(?i)</blockquote{_CLOSE}", "\ufdd6\n\n"),
    ("blocks", f"(?i)</?(?:{BLOCK_TAGS}){_OPEN}", "\n\n"),
    ("tags", "<[^>]*>", ""),
] + [
    (f"entity_{ent.strip('&;#')}", ent, ch) for ent, ch in ENTITIES
] + [
    ("line_lead", "\n +", "\n"),
    ("blank_lines", "\n{3,}", "\n\n"),
    ("trail_before_blank", " +\n\n", "\n\n"),
    ("trim", "\\A[ \n]+|[ \n]+\\z", ""),
]


def _apply(out: Column, pattern: str, repl: str) -> Column:
    if any(ch in pattern for ch in "\\()[]{}?*+|^$.") or "$" in repl:
        return F.regexp_replace(out, pattern, repl)
    return F.replace(out, F.lit(pattern), F.lit(repl))  # plain literal: cheaper than a regex


#: Rules that run before anything else, and the one that collapses white space; by name, so a caller's
#: list may be longer, shorter or in another order. All other rules run after tables and lists.
CLEAN_RULES = ("comments", "script", "style", "noscript")
WHITESPACE_RULES = ("whitespace",)
PRE_CLEAN = 5  # the first rules (comments, script, style, noscript, whitespace) run before tables

# Marks are Unicode noncharacters, which no text may hold; a page that holds them loses them on entry.
TABLE_MARK = "\ufdd0"


def _pieces(html: Column, pattern: Column | str) -> Column:
    """STRUCT<found, parts>: the matches of a pattern and the text around them."""
    p = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.struct(F.regexp_extract_all(html, p, F.lit(0)).alias("found"), F.split(html, p).alias("parts"))


def balanced_inner(rest: Column, tag: Column) -> Column:
    """`rest` (what follows an opening `tag`) up to the end tag that closes it: the first at which the end
    tags of that name outnumber the opening ones; all of `rest` when there is none."""
    pattern = F.concat(F.lit("(?i)</?"), tag, F.lit("(?:[ \\t\\n\\r\\f][^>]*)?/?>"))

    def step(acc: Column, t: Column) -> Column:
        depth = acc["depth"] + F.when(t.startswith("</"), -1).otherwise(1)
        return F.struct(depth.alias("depth"), (acc["i"] + 1).alias("i"), F.when((acc["end"] < 0) & (depth == 0), acc["i"]).otherwise(acc["end"]).alias("end"))

    def cut(x: Column) -> Column:
        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("i"), F.lit(-1).alias("end"))
        end = F.aggregate(x["found"], start, step)["end"]
        return let(end, lambda n: F.when(n < 0, interleave(x["parts"], x["found"])).otherwise(
            interleave(F.slice(x["parts"], F.lit(1), n + 1), F.slice(x["found"], F.lit(1), n))))

    return let(_pieces(rest, pattern), cut)


def elements(html: Column, opening: str, tag: str | None = None) -> Column:
    """Inner HTML of every element whose opening tag matches `opening`, nested ones included, in document
    order."""
    def each(x: Column) -> Column:
        n = F.size(x["found"])

        def one(t: Column, i: Column) -> Column:
            rest = interleave(F.slice(x["parts"], i + 2, n - i), F.slice(x["found"], i + 2, n - i - 1))
            return balanced_inner(rest, F.lit(tag) if tag else F.regexp_extract(t, "<([a-zA-Z0-9-]+)", 1))

        return F.transform(x["found"], one)

    return let(_pieces(html, opening), each)


TABLE_IN_TABLE = f"(?is)<table{_OPEN}(?:(?!</table).)*?<table{_OPEN}"


def nested_tables(html: Column) -> Column:
    """A table within a table gives its rows to the outer one, whose cells keep its text: outer tables that
    hold others are rewritten as one flat table. Pages without such tables skip the work."""
    def step(acc: Column, t: Column) -> Column:
        close = t.startswith("</")
        # inner tables lose their tags; their rows are the outer table's
        keep = F.when(close, acc["depth"] == 1).otherwise(acc["depth"] == 0)
        depth = F.greatest(acc["depth"] + F.when(close, -1).otherwise(1), F.lit(0))
        return F.struct(depth.alias("depth"), F.concat(acc["out"], F.array(F.when(keep, t).otherwise(F.lit("")))).alias("out"))

    def rows(table: Column) -> Column:
        cell = lambda x: F.concat(F.lit("<td>"), strip_tags(x), F.lit("</td>"))
        row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(elements(r, f"(?i)<t[dh]{_OPEN}"), cell), ""), F.lit("</tr>"))
        return F.concat(F.lit("<table>"), F.array_join(F.transform(elements(table, f"(?i)<tr{_OPEN}", "tr"), row), ""), F.lit("</table>"))

    def flat(x: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("out"))
        outer = interleave(x["parts"], F.aggregate(x["found"], start, step)["out"])
        segs = F.split(F.regexp_replace(outer, f"(?is)(<table{_OPEN}.*?</table{_CLOSE})", f"{TABLE_MARK}$1{TABLE_MARK}"), TABLE_MARK)
        return F.array_join(F.transform(segs, lambda s, i: F.when(i % 2 == 1, rows(s)).otherwise(s)), "")

    return let(html, lambda h: F.when(h.rlike(TABLE_IN_TABLE), let(_pieces(h, f"(?i)</?table(?:{_OPEN}|>)"), flat)).otherwise(h))


def tables_to_markdown(html) -> Column:
    """Replace every `<table>…</table>` by its pipe table. Tables are cut out with
    a sentinel split (odd segments are tables), so nothing else is touched; pages
    without tables skip the array work entirely."""
    return let(nested_tables(col_(html)), _flat_tables)


def _flat_tables(h: Column) -> Column:
    marked = F.regexp_replace(h, f"(?is)(<table{_OPEN}.*?</table{_CLOSE})", f"{TABLE_MARK}$1{TABLE_MARK}")
    segs = F.split(marked, TABLE_MARK)
    conv = F.transform(segs, lambda s, i: F.when(i % 2 == 1, html_table_markdown(s)).otherwise(s))
    return F.when(h.rlike("(?i)<table"), F.array_join(conv, "")).otherwise(h)


# Whitespace inside <pre> is kept: before whitespace collapsing, the text of
# every <pre> block (tags stripped, as its textContent) has its spaces, newlines
# and tabs swapped for noncharacters, swapped back at the very end.
PRE_WS_FROM = " \n\t\r"
PRE_WS_TO = "\ufdd2\ufdd3\ufdd4"  # '\r' is dropped
PRE_BLOCK = f"(?is)(<pre{_OPEN})(.*?)(</pre{_CLOSE})"
OL_BLOCK = f"(?is)(<ol{_OPEN})(.*?)(</ol{_CLOSE})"
OL_ITEM = f"(?i)<li{_OPEN}"


def _inner_segments(out: Column, block: str, fn) -> Column:
    """Apply `fn` to the inner text of every `block` match (open tag, inner, close
    tag captured as groups 1-3): cut out with a sentinel split, odd segments are
    the inner parts."""
    marked = F.regexp_replace(out, block, f"$1{TABLE_MARK}$2{TABLE_MARK}$3")
    segs = F.split(marked, TABLE_MARK)
    return F.array_join(F.transform(segs, lambda s, i: F.when(i % 2 == 1, fn(s)).otherwise(s)), "")


def protect_pre(out: Column) -> Column:
    return F.when(out.rlike("(?i)<pre"), _inner_segments(
        out, PRE_BLOCK, lambda s: F.translate(strip_tags(s), PRE_WS_FROM, PRE_WS_TO)
    )).otherwise(out)


def restore_pre(out: Column) -> Column:
    return F.translate(out, PRE_WS_TO + INDENT_MARK, PRE_WS_FROM[:3] + " ")


INDENT_MARK = "\ufdd7"  # one space of a nested item's indent
LIST_TAG = f"(?i)</?(?:ul|ol|li)(?:{_OPEN}|>)"
NEEDS_LISTS = f"(?is)<ol{_OPEN}|<ul{_OPEN}(?:(?!</ul).)*?<ul{_OPEN}"


def list_items(out: Column) -> Column:
    """Items get their marker: `*   `, or the item's number in an ordered list (from `start`, on from a
    `value`), indented by four spaces per enclosing item. One pass over the page's list tags
    keeps the stack of open lists; flat bulleted lists are left to the `li` rule."""
    # stack: next numbers of the open lists (0: bullets), innermost first
    start = F.struct(F.array().cast("array<int>").alias("stack"), F.array().cast("array<string>").alias("out"))
    number = lambda t, attr: F.coalesce(F.nullif(F.regexp_extract(t, f"(?i){HTML_WS}{attr}{HTML_WS}*={HTML_WS}*[\"']?([0-9]{{1,9}})", 1), F.lit("")).cast("int"))

    def step(acc: Column, t: Column) -> Column:
        stack = acc["stack"]
        opens, ordered, item = t.rlike("(?i)^<[uo]l"), t.rlike("(?i)^<ol"), t.rlike("(?i)^<li")
        closes = t.rlike("(?i)^</[uo]l")
        top = F.coalesce(F.get(stack, 0), F.lit(0))
        mine = F.when(top > 0, F.coalesce(number(t, "value"), top)).otherwise(F.lit(0))
        indent = F.repeat(F.lit(INDENT_MARK), (F.greatest(F.size(stack), F.lit(1)) - 1) * 4)
        mark = F.when(mine > 0, F.concat(mine.cast("string"), F.lit(".  "))).otherwise(F.lit("*   "))
        rest = F.slice(stack, F.lit(2), F.greatest(F.size(stack) - 1, F.lit(0)))
        new = (
            F.when(opens, F.concat(F.array(F.when(ordered, F.coalesce(number(t, "start"), F.lit(1))).otherwise(F.lit(0))), stack))
            .when(closes, rest)
            .when(item & (F.size(stack) > 0) & (mine > 0), F.concat(F.array(mine + 1), rest))
            .otherwise(stack)
        )
        # a list inside an item does not begin a new block
        text = F.when(item, F.concat(F.lit("\n"), indent, mark)).when((opens | closes) & (F.size(F.when(opens, stack).otherwise(rest)) > 0), F.lit("")).when(opens | closes, t).otherwise(F.lit(""))
        return F.struct(new.alias("stack"), F.concat(acc["out"], F.array(text)).alias("out"))

    render = lambda x: interleave(x["parts"], F.aggregate(x["found"], start, step)["out"])
    return F.when(out.rlike(NEEDS_LISTS), let(_pieces(out, LIST_TAG), render)).otherwise(out)


QUOTE_OPEN, QUOTE_CLOSE = "\ufdd5", "\ufdd6"
QUOTE_BLOCK = f"{QUOTE_OPEN}([^{QUOTE_CLOSE}]*){QUOTE_CLOSE}"


def quote_lines(out: Column) -> Column:
    """Prefix every line of a quote with `> ` (quotes are marked by the quote
    rules and rendered last, when their content is final Markdown)."""
    marked = F.regexp_replace(out, QUOTE_BLOCK, f"{TABLE_MARK}$1{TABLE_MARK}")
    segs = F.split(marked, TABLE_MARK)
    conv = F.transform(
        segs,
        lambda s, i: F.when(
            i % 2 == 1, F.concat(F.lit("> "), F.regexp_replace(F.regexp_replace(s, "\\A[ \n]+|[ \n]+\\z", ""), "\n", "\n> "))
        ).otherwise(s),
    )
    done = F.when(out.contains(QUOTE_OPEN), F.array_join(conv, "")).otherwise(out)
    return F.regexp_replace(F.translate(done, QUOTE_OPEN + QUOTE_CLOSE, ""), "\\A[ \n]+|[ \n]+\\z", "")


# Markdown escapes applied to text nodes (the converter's
# defaults): backslash, `*`, `` ` ``, `[`, `]`, `_` everywhere; a leading `-`,
# `+ `, `=`, `#`…`###### `, `~~~`, `>` or `1. ` at the start of a text node.
# (A single leading space is allowed before the anchored ones: the text is
# whitespace-collapsed but, unlike a DOM, not trimmed at block starts.)
TEXT_ESCAPES = [
    (r"\\", r"\\\\"),
    (r"\*", r"\\*"),
    (r"\A( ?)-", r"$1\\-"),
    (r"\A( ?)\+ ", r"$1\\+ "),
    (r"\A( ?)(=+)", r"$1\\$2"),
    (r"\A( ?)(#{1,6}) ", r"$1\\$2 "),
    (r"`", r"\\`"),
    (r"\A( ?)~~~", r"$1\\~~~"),
    (r"\[", r"\\["),
    (r"\]", r"\\]"),
    (r"\A( ?)>", r"$1\\>"),
    (r"_", r"\\_"),
    (r"\A( ?)(\d+)\. ", r"$1$2\\. "),
]
# Regions whose text is not escaped: code (inline and blocks) and tables
# (cells are rendered from their raw text).
UNESCAPED_BLOCK = (
    f"(?is)(<table{_OPEN}.*?</table{_CLOSE}|<code{_OPEN}.*?</code{_CLOSE}|<pre{_OPEN}.*?</pre{_CLOSE})"
)
TAG_MARK = "\ufdd1"


def escape_text(t: Column) -> Column:
    for pattern, repl in TEXT_ESCAPES:
        t = F.regexp_replace(t, pattern, repl)
    return t


def escape_text_nodes(out: Column) -> Column:
    """Escape Markdown punctuation in the text between tags, outside code and
    tables: regions, then tags, are cut out with sentinel splits."""

    def region(s: Column) -> Column:
        parts = F.split(F.regexp_replace(s, "(<[^>]*>)", f"{TAG_MARK}$1{TAG_MARK}"), TAG_MARK)
        return F.array_join(F.transform(parts, lambda t, j: F.when(j % 2 == 0, escape_text(t)).otherwise(t)), "")

    segs = F.split(F.regexp_replace(out, UNESCAPED_BLOCK, f"{TABLE_MARK}$1{TABLE_MARK}"), TABLE_MARK)
    return F.array_join(F.transform(segs, lambda s, i: F.when(i % 2 == 0, region(s)).otherwise(s)), "")


#: Every mark used here, dropped from a page on entry.
ALL_MARKS = "".join(chr(c) for c in range(0xFDD0, 0xFDD8))


def _stages(rules: list[tuple[str, str, str]]) -> tuple[list, list, list, list]:
    clean = [r for r in rules if r[0] in CLEAN_RULES]
    space = [r for r in rules if r[0] in WHITESPACE_RULES]
    rest = [r for r in rules if r[0] not in CLEAN_RULES + WHITESPACE_RULES]
    k = next((i for i, r in enumerate(rest) if r[0].startswith("entity_")), len(rest))
    # references are decoded once, all in one pass, where the list names its first one
    return clean, space, rest[:k], [r for r in rest[k:] if not r[0].startswith("entity_")]


def _apply_all(e: Column, rules: list[tuple[str, str, str]]) -> Column:
    for _name, pattern, repl in rules:
        e = _apply(e, pattern, repl)
    return e


def add_markdown(df, html, out: str, rules: list[tuple[str, str, str]] | None = None):
    """DataFrame form of `html_to_markdown`: adds column `out`. The steps that
    look at their input more than once (guards around segment splits) get
    their own projection, so they read a column instead of re-deriving the rule
    chain (and the higher-order segment functions never pull the regex chain
    out of whole-stage codegen)."""
    clean, space, rest, last = _stages(rules or MARKDOWN_RULES)
    df = df.withColumn(out, _apply_all(F.translate(col_(html), ALL_MARKS, ""), clean)).withColumn(out, protect_pre(F.col(out)))
    df = df.withColumn(out, _apply_all(F.col(out), space)).withColumn(out, escape_text_nodes(F.col(out)))
    df = df.withColumn(out, tables_to_markdown(F.col(out))).withColumn(out, list_items(F.col(out)))
    df = df.withColumn(out, _apply_all(F.col(out), rest)).withColumn(out, decode_entities(F.col(out)))
    return df.withColumn(out, _apply_all(F.col(out), last)).withColumn(out, restore_pre(quote_lines(F.col(out))))


def html_to_markdown(html, rules: list[tuple[str, str, str]] | None = None) -> Column:
    """Column form (ad-hoc use); operators use `add_markdown`, which evaluates
    the same steps with one projection per guarded step."""
    clean, space, rest, last = _stages(rules or MARKDOWN_RULES)
    out = protect_pre(_apply_all(F.translate(col_(html), ALL_MARKS, ""), clean))
    out = list_items(tables_to_markdown(escape_text_nodes(_apply_all(out, space))))
    return restore_pre(quote_lines(_apply_all(decode_entities(_apply_all(out, rest)), last)))


# ---------------------------------------------------------------- fields


def page_title(html) -> Column:
    """Document title: `<title>` text, else the first `<h1>` text."""
    t = inner_text(F.regexp_extract(col_(html), "(?is)<title[^>]*>(.*?)</title", 1))
    h1 = inner_text(F.regexp_extract(col_(html), f"(?is)<h1{_OPEN}(.*?)</h1", 1))
    return F.when(t != "", t).otherwise(h1)


#: An attribute's value: in double quotes, in single quotes, or bare.
ATTR_VALUE = "(\"[^\"]*\"|'[^']*'|[^ \\t\\n\\r\\f\"'=<>`]+)"


def unquoted(value: Column) -> Column:
    return decode_entities(F.regexp_replace(value, "\\A[\"'](.*)[\"']\\z", "$1"))


def _attr_of_first(html, attr: str) -> Column:
    """Value of `attr` on the first element carrying it ('' when absent)."""
    return unquoted(F.regexp_extract(col_(html), f"(?is)<[a-z][^>]*?{HTML_WS}{attr}{HTML_WS}*={HTML_WS}*{ATTR_VALUE}", 1))


def last_modified(html, run_date) -> Column:
    """`data-timemodified` of the first element having it, else
    `data-publicationdate`, else the run date. An empty value counts as missing."""
    rd = run_date if isinstance(run_date, Column) else F.lit(run_date)
    return F.coalesce(
        F.nullif(_attr_of_first(html, "data-timemodified"), F.lit("")),
        F.nullif(_attr_of_first(html, "data-publicationdate"), F.lit("")),
        rd,
    )


SHORTCUT = "(?i)<(?:article|main)(?:[ \\t\\n\\r\\f/][^>]*)?>"


def shortcut_html(html) -> Column:
    """Reader-mode shortcut: inner HTML of the page's `<article>` or `<main>` when it has exactly one
    of them (up to its last end tag, or to the end of the page), else '' (then the
    scored container decides). Comments and scripts must be gone already."""
    h = col_(html)
    article = F.regexp_extract(h, f"(?is)<article{_OPEN}(.*)</article{_CLOSE}", 1)
    main = F.regexp_extract(h, f"(?is)<main{_OPEN}(.*)</main{_CLOSE}", 1)
    open_end = F.regexp_extract(h, "(?is)<(?:article|main)(?:[ \\t\\n\\r\\f/][^>]*)?>(.*)", 1)
    inner = F.when(article != "", article).when(main != "", main).otherwise(open_end)
    return F.when(F.size(F.regexp_extract_all(h, F.lit(SHORTCUT), F.lit(0))) == 1, inner).otherwise(F.lit(""))


# ----------------------------------------------------------- breadcrumbs

# Breadcrumb container selectors, in priority order.
BREADCRUMB_SELECTORS = [
    ".breadcrumb",
    ".breadcrumbs",
    '[aria-label="breadcrumb"]',
    'nav[aria-label="Breadcrumb"]',
    ".navigation-path",
    ".path",
    "#breadcrumb",
    "#breadcrumbs",
]

_ATTRS = "(?:[ \\t\\n\\r\\f]+[^ \\t\\n\\r\\f\"'>/=]+(?:[ \\t\\n\\r\\f]*=[ \\t\\n\\r\\f]*(?:\"[^\"]*\"|'[^']*'|[^ \\t\\n\\r\\f\"'>]+))?)*"


def _attr_is(name: str, value: str, word: bool = False, part: bool = False) -> str:
    """Pattern of an attribute with this value, with this word among others, or with this part; any quotes."""
    ws = HTML_WS
    if part:
        dq, sq, bare = f"\"[^\"]*{value}[^\"]*\"", f"'[^']*{value}[^']*'", f"[^ \\t\\n\"'>]*{value}[^ \\t\\n\"'>]*"
    elif word:
        dq, sq, bare = f"\"(?:[^\"]*{ws})?{value}(?:{ws}[^\"]*)?\"", f"'(?:[^']*{ws})?{value}(?:{ws}[^']*)?'", value
    else:
        dq, sq, bare = f"\"{value}\"", f"'{value}'", value
    return f"{ws}{name}{ws}*={ws}*(?:{dq}|{sq}|{bare}(?=[ \\t\\n\\r\\f>/]))"


def _selector_regex(sel: str) -> str:
    """Pattern of the opening tag that one selector matches, capturing its name and what follows it."""
    if sel.startswith("."):
        tag, attr = "[a-zA-Z][a-zA-Z0-9-]*", _attr_is("class", sel[1:], word=True)
    elif sel.startswith("#"):
        tag, attr = "[a-zA-Z][a-zA-Z0-9-]*", _attr_is("id", sel[1:])
    else:
        name, _, rest = sel.partition("[")
        k, _, v = rest.rstrip("]").partition("=")
        tag, attr = name or "[a-zA-Z][a-zA-Z0-9-]*", _attr_is(k, v.strip('"'))
    return f"(?s)<({tag})(?=[ \\t\\n\\r\\f]){_ATTRS}?{attr}{_ATTRS}{HTML_WS}*/?>(.*)"


BREADCRUMB_PATTERNS = [_selector_regex(s) for s in BREADCRUMB_SELECTORS]
#: Opening tags of the items inside a container.
BREADCRUMB_ITEM = (
    f"(?:<[lL][iI]{_OPEN}|<[sS][pP][aA][nN](?=[ \\t\\n\\r\\f]){_ATTRS}?{_attr_is('itemprop', 'name')}{_ATTRS}{HTML_WS}*>|"
    f"<[a-zA-Z][a-zA-Z0-9-]*(?=[ \\t\\n\\r\\f]){_ATTRS}?{_attr_is('class', 'breadcrumb-', part=True)}{_ATTRS}{HTML_WS}*/?>)"
)


def breadcrumb_container(html) -> Column:
    """Inner HTML of the first container found by selector priority (NULL if none), up to its own end tag."""
    h = col_(html)
    # the opening tag's pattern, chosen once; its element is cut out once
    pattern = F.lit(None).cast("string")
    for p in reversed(BREADCRUMB_PATTERNS):
        pattern = F.when(h.rlike(p), F.lit(p)).otherwise(pattern)
    group = lambda p, k: F.call_function("regexp_extract", h, p, F.lit(k))
    cut = lambda p: balanced_inner(group(p, 2), group(p, 1))
    return let(pattern, lambda p: F.when(p.isNotNull(), cut(p)))


def breadcrumb_items(html) -> Column:
    """ARRAY<STRUCT<text, url>> of the items of the breadcrumb container (`li`, `span` with itemprop
    name, any element with a class containing `breadcrumb-`), in document order: text and href of
    the item's first link, else its non-empty text."""
    cont = breadcrumb_container(html)
    # an item that is not closed ends where the next one begins
    found = elements(F.regexp_replace(cont, f"(?i)(<li{_OPEN}(?:(?!</?li).)*)(?=<li{_OPEN})", "$1</li>"), BREADCRUMB_ITEM)

    def one(s: Column) -> Column:
        return let(F.regexp_extract(s, f"(?is)<a(?:{HTML_WS}[^>]*)?>.*", 0), lambda link: item(s, link))

    def item(s: Column, link: Column) -> Column:
        text = inner_text(F.regexp_extract(link, "(?is)^<a[^>]*>(.*?)(?:</a|$)", 1))
        href = F.nullif(unquoted(F.regexp_extract(link, f"(?is)^<a{HTML_WS}[^>]*?href{HTML_WS}*={HTML_WS}*{ATTR_VALUE}", 1)), F.lit(""))
        linked = link != ""
        return F.struct(F.when(linked, text).otherwise(inner_text(s)).alias("text"), F.when(linked, href).alias("url"))

    return F.filter(F.transform(found, one), lambda b: b["url"].isNotNull() | (b["text"] != ""))


def breadcrumbs_markdown(items) -> Column:
    """`<md_breadcrumb>\\n> a > [b](u)\\n</md_breadcrumb>\\n\\n`, '' when empty."""
    parts = F.transform(
        col_(items),
        lambda b: F.when(b["url"].isNotNull(), F.concat(F.lit("["), b["text"], F.lit("]("), b["url"], F.lit(")"))).otherwise(
            b["text"]
        ),
    )
    return F.when(
        F.coalesce(F.size(col_(items)), F.lit(0)) > 0,
        F.concat(F.lit("<md_breadcrumb>\n> "), F.array_join(parts, " > "), F.lit("\n</md_breadcrumb>\n\n")),
    ).otherwise(F.lit(""))


# ---------------------------------------------------------------- tables


def table_cell_text(c) -> Column:
    """Cell text with `X Example: Y` rewritten to `X (Example: Y)`, pipes escaped."""
    t = inner_text(c)
    t = F.regexp_replace(t, "(?s)\\A(.*?)[ \\t\\n\\r\\f]*Example:[ \\t\\n\\r\\f]*(.+)\\z", "$1 (Example: $2)")
    return F.replace(t, F.lit("|"), F.lit("\\|"))


def html_table_markdown(table_html) -> Column:
    """One `<table>` → pipe table. First row (th or td) is the header; later
    rows contribute their `td` cells only. Empty table → ''."""
    found = F.regexp_extract_all(col_(table_html), F.lit(f"(?is)<tr{_OPEN}(.*?)</tr{_CLOSE}"), 1)
    names = lambda rows: F.transform(
        F.regexp_extract_all(F.get(rows, 0), F.lit(f"(?is)<t[hd]{_OPEN}(.*?)</t[hd]{_CLOSE}"), 1),
        lambda c: F.replace(inner_text(c), F.lit("|"), F.lit("\\|")),
    )

    def table(rows: Column, header: Column) -> Column:
        sep = F.array_join(F.transform(header, lambda _h: F.lit("---")), " | ")
        body = F.transform(
            F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))),
            lambda r: F.concat(
                F.lit("| "),
                F.array_join(
                    F.transform(F.regexp_extract_all(r, F.lit(f"(?is)<td{_OPEN}(.*?)</td{_CLOSE}"), 1), table_cell_text),
                    " | ",
                ),
                F.lit(" |"),
            ),
        )
        lines = F.concat(
            F.array(
                F.concat(F.lit("| "), F.array_join(header, " | "), F.lit(" |")),
                F.concat(F.lit("| "), sep, F.lit(" |")),
            ),
            body,
        )
        return F.when(F.size(rows) == 0, F.lit("")).otherwise(F.concat(F.lit("\n\n"), F.array_join(lines, "\n"), F.lit("\n\n")))

    # the rows and the header are looked for once
    return let(found, lambda rows: let(names(rows), lambda header: table(rows, header)))


__all__ = [
    "MARKDOWN_RULES",
    "html_to_markdown",
    "page_title",
    "last_modified",
    "breadcrumb_items",
    "breadcrumbs_markdown",
    "html_table_markdown",
    "table_cell_text",
    "strip_tags",
    "collapse_ws",
    "decode_entities",
    "js_trim",
]
