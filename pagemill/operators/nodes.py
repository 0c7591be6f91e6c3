"""HTML → node table: the lines of a page's tree and its elements, as rows.

`page_tokens` cuts a page with one linear pattern inside Spark (quote-aware tags, a bare `<` is text,
comments and raw-text elements whole). `html_nodes` gives each page's tokens to a small stack
that supplies what the markup left out (implied end tags, ends of unclosed elements, formatting that runs
on) and writes rows, numbered by `pos` in document order:

    open / close   an element: its end, container depth, attributes (close: its open row as `end`)
    line           a run of inline content between block boundaries: its texts, images and inline elements
                   as `runs`, each with the white space or breaks before it and the formatting in force
    table          an outermost table, one line too: its cells as `grid` beside the runs
    rule, title    a thematic break; the text of `title`

An element other than article and main in which no line, table or rule begins is `bare`.

with the line feeds wanted before a line, its block's kind, and the open quotes and list items with their markers.
All that follows (title, dates, breadcrumbs, reader scoring, Markdown) is made of a page's rows where they are
written, see `reader`, `render` and `pages`; `html_nodes` gives the rows themselves.

Rules taken from the public HTML standard: void and raw-text elements, which start tags end a paragraph,
list item, cell or row, formatting that stays in force past the block it began in, first of repeated
attributes, end of input inside a tag drops it. Limits: at most `MAX_DEPTH` open elements (deeper ones
are children of the last), one `html` and `body`; list items and quotes beyond `MAX_ITEMS` levels keep
the indent of that level; tables beyond `MAX_TABLES` levels give their rows to the last. No text is lost.
"""

from __future__ import annotations

import html as charrefs
import re
from collections.abc import Iterable, Iterator, Sequence
from operator import attrgetter, itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 512
MAX_ITEMS = 32
MAX_TABLES = 8

# Fixed values of the HTML standard.
RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "title")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CELLS = frozenset(("td", "th", "caption"))
TABLE_PARTS = frozenset(("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"))
SCOPE = frozenset(("table", "td", "th", "caption", "object", "button"))
#: Formatting that Markdown can show, by its mark.
FORMATTING = {"b": "strong", "strong": "strong", "i": "em", "em": "em", "code": "code", "a": "link"}
#: Elements that hold other blocks: reader scoring weighs these.
CONTAINERS = frozenset(
    "html body div article section main aside nav header footer form center fieldset details figure blockquote "
    "ul ol dl table td th tr tbody thead tfoot".split()
)
#: Line feeds around an element: 2 sets it apart by a blank line.
FEEDS = {t: 2 for t in (ENDS_PARAGRAPH | CONTAINERS | {"body", "html", "option", "caption"})} | {
    "li": 1, "tr": 1, "td": 1, "th": 1, "tbody": 1, "thead": 1, "tfoot": 1}

_TAG_REST = "(?:[^=>]++|=[ \\t\\n\\r\\f]*+(?:\"[^\"]*+\"?|'[^']*+'?)?+)*+>?"
#: One token. Every alternative consumes what it looks at, so a page is cut in one pass, however broken.
PLAIN_TOKEN = f"(?is)</?[a-z]{_TAG_REST}|<[!?/][^>]*+>?|(?:[^<]++|<(?![a-z!?/]))++"
TOKEN = (
    "(?is)<!--.*?(?:--!?>|\\z)"
    f"|<({'|'.join(RAW)})(?=[ \\t\\n\\r\\f/>]){_TAG_REST}.*?(?:</\\1(?=[ \\t\\n\\r\\f/>])[^>]*+>?|\\z)"
    f"|{PLAIN_TOKEN[5:]}"
)
_ATTR = re.compile(r"""([^\s"'<>/=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s>]*)))?""")
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_WHITE = re.compile("[ \t\n\r\f]+")
_TITLE = re.compile(r"""(?is)<title(?:[^=>]|=\s*(?:"[^"]*"?|'[^']*'?)?)*>(.*?)(?:</title[^>]*>?)?\Z""")
#: Noncharacters that other parts of the library use as marks: dropped from a page on entry.
MARKS = "".join(chr(c) for c in range(0xFDD0, 0xFDD8))

#: Pages without any of these hold no breadcrumb container (`hinted` is false).
HINT = "breadcrumb|Breadcrumb|navigation-path|path|&#"
_HINTED = re.compile(HINT.removesuffix("|&#"))
_ITEM = "array<struct<pos:int,mark:string>>"
_MARK = "array<struct<pos:int,kind:string,href:string,title:string>>"
#: kind: text, image (text: alt, href: src), open or close of an inline element; `end` as in the table. `space`: white space
#: since the last text or image, `lead`: since the last run of any kind.
_RUN = f"array<struct<pos:int,kind:string,text:string,space:boolean,lead:boolean,breaks:int,href:string,title:string,marks:{_MARK},tag:string,attrs:map<string,string>,`end`:int>>"
SCHEMA = (
    "url string, hinted boolean, pos int, `end` int, parent int, kind string, tag string, attrs map<string,string>, text string, "
    f"depth int, bare boolean, feeds int, block string, items {_ITEM}, runs {_RUN}, grid array<array<struct<head:boolean,text:string>>>"
)


#: Columns that a page's rows share.
PAGE = ("page_id", "url", "hinted")


def page_tokens(html) -> Column:
    """ARRAY<STRING> of a page's tokens, in order; together they are the page."""
    h = F.translate(F.col(html) if isinstance(html, str) else html, MARKS, "")
    return F.regexp_extract_all(F.coalesce(h, F.lit("")), F.lit(TOKEN), F.lit(0))


#: Start tags whose arrival may end an open element.
_ENDS = ENDS_PARAGRAPH | {"td", "th", "tr", "thead", "tbody", "tfoot", "option"}
#: Tags whose start or end does more than to begin or end a block.
_OWN_START = frozenset(("html", "head", "body", "br", "img", "hr", *FORMATTING))
_LISTS = frozenset(("ul", "ol", "menu"))
_OWN_BLOCK = frozenset(("table", "li", "blockquote", "tr", "pre")) | _LISTS | CELLS | HEADINGS
_OWN_END = frozenset(("html", "body", "head", "br", *FORMATTING))
_PARTS = TABLE_PARTS - {"table"}
_ITEM_SCOPE = SCOPE | _LISTS
_TABLE_SCOPE = frozenset(("table",))
#: Start tags that end one of their own kind.
_ITSELF = frozenset(("li", "td", "th", "tr", "dt", "dd", "thead", "tbody", "tfoot", "option"))

#: What a tag begins or ends, by its name: does it end a paragraph, may it end another element, line feeds, is it a container,
#: does it do more, is it a list. For start tags, those that no other rule speaks of.
_BLOCKS = {t: (t in ENDS_PARAGRAPH, t in _ENDS and (t in _ITSELF or t in HEADINGS), FEEDS[t], t in CONTAINERS, t in _OWN_BLOCK, t in _LISTS) for t in FEEDS}
_STARTS = {t: v for t, v in _BLOCKS.items() if t not in _OWN_START and t not in VOID and t != "table"}
_NO_BLOCK = (False, False, 0, False, False, False)

#: What a token is.
TEXT, SKIPPED, START, END, TITLE = range(5)


def parse(token: str) -> tuple:
    """What a token is, its tag and attributes, what a start tag begins (`_STARTS`) or whether an end tag ends the nearest element
    of its name; of a text the text, the same with white space collapsed and trimmed, and whether white space was before and after."""
    named = _NAME.match(token) if token[0] == "<" else None
    if not named:
        if token.startswith(("<!", "<?", "</")):
            return SKIPPED, "", None, None, None
        text = charrefs.unescape(token) if "&" in token else token
        core = text if "  " not in text and text.isprintable() else _WHITE.sub(" ", text)
        return TEXT, text, core.strip(" "), core[:1] == " ", core[-1:] == " "
    tag = named[1].lower()
    if token[1] == "/":
        return END, tag, None, tag not in _OWN_END and tag != "table", None
    if tag == "title":
        inner = _TITLE.match(token)
        return (TITLE, charrefs.unescape(inner[1]), None, None, None) if inner else (SKIPPED, tag, None, None, None)
    if tag in RAW or token[-1] != ">":  # a tag that the page's end cuts off is dropped
        return SKIPPED, tag, None, None, None
    return START, tag, attributes(token[:-1], named.end()) if len(token) > named.end() + 1 else {}, _STARTS.get(tag), None


def attributes(tag: str, name_end: int) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, dq, sq, bare in _ATTR.findall(tag, name_end):
        out.setdefault(name.lower(), charrefs.unescape(dq or sq or bare))
    return out


class Row:
    """A row of the node table (SCHEMA)."""

    inline = hinted = False
    lines = 0
    text = bare = feeds = block = items = runs = grid = None

    def __init__(self, kind: str, pos: int, parent: int, depth: int, tag: str | None, attrs: dict[str, str] | None) -> None:
        self.kind, self.pos, self.end, self.parent, self.depth, self.tag, self.attrs = kind, pos, pos + 1, parent, depth, tag, attrs


class Run:
    """A run of a line."""

    inline = True
    href = title = tag = attrs = end = row = None

    def __init__(self, kind: str, pos: int, marks: list[dict], text: str | None = None, space: bool = False, lead: bool = False, breaks: int = 0) -> None:
        self.kind, self.pos, self.marks, self.text, self.space, self.lead, self.breaks = kind, pos, marks, text, space, lead, breaks


class Tree:
    """The stack of one page and the rows it writes; all rows if `whole`, else at least those that `_tells` wants."""

    def __init__(self, whole: bool = True) -> None:
        self.whole = whole
        self.rows: list[Row] = []
        self.next = 0
        self.stack: list[Row | Run] = []  # open elements
        self.open_tags: dict[str, int] = {}
        self.formatting: list[dict] = []
        self.outside: list[list[dict]] = []  # formatting in force around the open cells
        self.depth = 0
        self.feeds = 2
        self.line: Row | None = None
        self.space, self.lead, self.breaks = False, False, 0
        self.pending: list[Run] = []  # inline elements opened in front of a line's first text
        self.items: list[dict] = []
        self.items_before: list[list[dict]] = []
        self.counters: list[int | None] = []  # next number of the open lists
        self.tables = self.tables_ignored = 0
        self.table_rows: list[list] = []  # open rows of the outermost table's grid
        self.cells: list[dict] = []  # open cells
        self.marks: list[dict] = []
        self.block = ""
        self.pre = False  # is the block preformatted?
        self.language = ""
        self.lines = 0  # lines, tables and rules so far

    def number(self) -> int:
        self.next += 1
        return self.next - 1

    def row(self, kind: str, pos: int | None = None, tag: str | None = None, attrs: dict | None = None) -> Row:
        if pos is None:
            pos = self.next
            self.next += 1
        r = Row(kind, pos, self.stack[-1].pos if self.stack else -1, self.depth, tag, attrs)
        self.rows.append(r)
        return r

    def boundary(self, feeds: int) -> None:
        if not self.tables:  # a table is one line
            if feeds > self.feeds:
                self.feeds = feeds
            self.line = None
            self.space = self.lead = False
            self.breaks = 0
            if self.pending:
                for opened in self.pending:  # they hold blocks: rows of their own
                    if opened.row is None:
                        opened.row = self.row("open", opened.pos, opened.tag, opened.attrs)
                self.pending = []

    def begin(self, kind: str = "line") -> None:
        if self.line is None:
            self.lines += 1
            self.line = r = Row(kind, self.next, self.stack[-1].pos, self.depth, None, None)
            self.next += 1
            self.rows.append(r)
            r.feeds, r.block, r.items, r.runs = self.feeds, self.block, self.items, []
            self.feeds = self.breaks = 0
            self.space = self.lead = False

    def run(self, kind: str, text: str | None = None) -> Run:
        if self.line is None:
            self.begin()
        if self.pending:
            self.line.runs += self.pending
            self.pending = []
        r = Run(kind, self.next, self.marks, text, self.space, self.lead, self.breaks)
        self.next += 1
        self.line.runs.append(r)
        self.lead = False
        if kind in ("text", "image"):
            self.space, self.breaks = False, 0
        return r

    def has(self, tag: str) -> bool:
        return self.open_tags.get(tag, 0) > 0

    def find(self, tags, stops=SCOPE) -> int:
        """Index of the nearest open element with one of these tags, -1 if something in `stops` comes first."""
        for t in tags:
            if self.open_tags.get(t):
                break
        else:
            return -1
        for i in range(len(self.stack) - 1, -1, -1):
            tag = self.stack[i].tag
            if tag in tags:
                return i
            if tag in stops:
                return -1
        return -1

    def set_block(self) -> None:
        self.block = ""
        if self.has("pre"):
            self.block = f"pre {self.language}".rstrip()
        elif any(self.has(h) for h in HEADINGS):
            self.block = next(e.tag for e in reversed(self.stack) if e.tag in HEADINGS)
        self.pre = self.block.startswith("pre")

    def boundary_of(self, tag: str) -> None:
        if not self.tables and (feeds := FEEDS.get(tag)):
            self.boundary(1 if feeds == 2 and tag in _LISTS and self.open_tags.get("li") else feeds)

    def pop(self, down_to: int) -> None:
        stack = self.stack
        while len(stack) > down_to:
            opened = stack.pop()
            tag = opened.tag
            self.open_tags[tag] -= 1
            _, _, feeds, holds, own, lists = _BLOCKS.get(tag, _NO_BLOCK)
            if feeds and not self.tables:
                self.boundary(1 if lists and self.open_tags.get("li") else feeds)
            if holds:
                self.depth -= 1
            if own:
                self.end_own(tag)
            if opened.inline:  # a run of its line
                if opened.row is not None:
                    opened.row.end = self.next
                if self.pending and self.pending[-1] is opened:
                    self.pending.pop()
                elif self.line is not None:
                    r = self.run("close")
                    r.tag, r.attrs, r.end = tag, opened.attrs, opened.pos
            else:
                opened.bare = bare = self.lines == opened.lines and len(stack) > 0 and tag != "article" and tag != "main"
                if self.whole or holds and not bare:
                    r = Row("close", self.next, stack[-1].pos if stack else -1, opened.depth, tag, opened.attrs)
                    r.end, r.bare = opened.pos, bare
                    self.rows.append(r)
                self.next += 1
            opened.end = self.next

    def end_own(self, tag: str) -> None:
        if tag in ("li", "blockquote"):
            self.items = self.items_before.pop()
        elif tag in _LISTS:
            self.counters.pop()
        elif tag == "table":
            self.tables -= 1
            if not self.tables:
                self.boundary(2)
        elif tag == "tr" and self.tables:
            self.table_rows.pop()
        elif tag == "pre":
            self.language = ""
        if tag in CELLS:
            outside = self.outside.pop()
            if outside is not self.formatting:
                self.formatting = outside
                self.set_marks()
            if tag != "caption":
                self.cells.pop()
        if tag in HEADINGS or tag == "pre":
            self.set_block()

    def set_marks(self) -> None:
        kinds: dict[str, dict] = {}
        for f in self.formatting:
            kinds.setdefault(f["mark"]["kind"], f["mark"])
        self.marks = list(kinds.values())

    def unformat(self, tag: str) -> None:
        for i in range(len(self.formatting) - 1, -1, -1):
            f = self.formatting[i]
            if f["tag"] == tag:
                if f["row"] is not None:
                    f["row"].end = self.next
                self.formatting = self.formatting[:i] + self.formatting[i + 1 :]
                self.set_marks()
                return

    def implied_ends(self, tag: str) -> None:
        if tag in ENDS_PARAGRAPH:
            self.end_paragraph()
        self.end_same(tag)

    def end_paragraph(self) -> None:
        if self.open_tags.get("p"):
            i = len(self.stack) - 1 if self.stack[-1].tag == "p" else self.find(("p",))
            if i >= 0:
                self.pop(i)

    def end_same(self, tag: str) -> None:
        """The end of an element that cannot hold another of its kind."""
        i = -1
        if tag == "li":
            i = self.find(("li",), _ITEM_SCOPE)
        elif tag in ("td", "th"):
            i = self.find(("td", "th"), ("table", "tr"))
        elif tag == "tr":
            i = self.find(("tr",), _TABLE_SCOPE)
        elif tag in ("dt", "dd"):
            i = self.find(("dt", "dd"), SCOPE | {"dl"})
        elif tag in HEADINGS and self.stack and self.stack[-1].tag in HEADINGS:
            i = len(self.stack) - 1
        elif tag in ("thead", "tbody", "tfoot"):
            i = self.find(("thead", "tbody", "tfoot"), _TABLE_SCOPE)
            i = i if i >= 0 else self.find(("tr",), _TABLE_SCOPE)
        elif tag == "option":
            i = self.find(("option",))
        if i >= 0:
            self.pop(i)

    def format(self, tag: str, attrs: dict[str, str]) -> None:
        if self.pre:
            self.speak(attrs)
            return
        if tag == "a":
            self.unformat("a")
        opened = self.row("open", None, tag, attrs) if tag == "a" or attrs else None
        mark = {"pos": opened.pos if opened else self.number(), "kind": FORMATTING[tag], "href": None, "title": None}
        if tag == "a":
            if "href" not in attrs:
                return
            mark |= {"href": attrs["href"], "title": attrs.get("title")}
        same = [f for f in self.formatting if f["tag"] == tag]
        if len(same) >= 3:  # the standard keeps three alike
            self.formatting = [f for f in self.formatting if f is not same[0]]
        self.formatting = [*self.formatting, {"tag": tag, "mark": mark, "row": opened}]
        self.set_marks()

    def open(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in _OWN_START:
            if tag in FORMATTING:
                self.format(tag, attrs)
                return
            if tag == "html" and self.has(tag):
                self.rows[0].attrs = attrs | self.rows[0].attrs
                return
            if tag == "head" or tag == "body" and self.has(tag):
                return
            if tag == "br":
                if self.pre:
                    self.text("\n", "", True, True)
                elif self.line is not None:
                    self.breaks += 1
                return
            if tag == "img":
                if attrs.get("src"):
                    r = self.run("image", attrs.get("alt", ""))
                    r.href, r.title = attrs["src"], attrs.get("title")
                return
        if tag in _ENDS:
            self.implied_ends(tag)
        if tag == "hr":
            self.boundary(2)
            self.begin("rule")
            self.boundary(2)
        elif tag in FEEDS or tag in VOID or len(self.stack) >= MAX_DEPTH:
            self.open_block(tag, attrs)
        else:
            self.begin_inline(tag, attrs)

    def begin_inline(self, tag: str, attrs: dict[str, str]) -> None:
        """Any other element is a run of its line."""
        if self.line is not None:
            opened = self.run("open")
        else:
            opened = Run("open", self.number(), self.marks)
            self.pending.append(opened)
        opened.tag, opened.attrs = tag, attrs
        self.push(opened)
        if any(k.startswith("data-") or k in ("class", "id", "aria-label") and _HINTED.search(v) for k, v in attrs.items()):
            opened.row = self.row("open", None, tag, attrs)  # a page's fields look at rows

    def push(self, opened: Row | Run) -> None:
        self.stack.append(opened)
        self.open_tags[opened.tag] = self.open_tags.get(opened.tag, 0) + 1

    def open_block(self, tag: str, attrs: dict[str, str]) -> None:
        self.boundary_of(tag)
        if tag in VOID or len(self.stack) >= MAX_DEPTH:
            self.row("open", None, tag, attrs)
            return
        if tag == "table":
            if self.tables >= MAX_TABLES:
                self.tables_ignored += 1
                return
            if not self.tables:
                self.boundary(2)
                self.begin("table")
                self.line.grid = []
            self.tables += 1
        if tag in CONTAINERS:
            self.depth += 1
        self.begin_block(tag, attrs, tag in CONTAINERS, tag in _OWN_BLOCK)

    def begin_block(self, tag: str, attrs: dict[str, str], holds: bool, own: bool) -> None:
        opened = Row("open", self.next, self.stack[-1].pos if self.stack else -1, self.depth, tag, attrs)
        self.next += 1
        opened.lines = self.lines
        if holds or attrs or self.whole:  # else the row says nothing
            self.rows.append(opened)
        self.stack.append(opened)
        self.open_tags[tag] = self.open_tags.get(tag, 0) + 1
        if own:
            self.start_own(tag, attrs, opened)

    def start_own(self, tag: str, attrs: dict[str, str], opened: Row) -> None:
        if tag in ("li", "blockquote"):
            mark = "> "
            if tag == "li":
                mark = "*   "
                if self.counters and self.counters[-1] is not None:
                    own = _integer(attrs.get("value"))
                    number = self.counters[-1] if own is None else own
                    self.counters[-1] = number + 1
                    mark = f"{number}.  "
            self.items_before.append(self.items)
            self.items = [*self.items[: MAX_ITEMS - 1], {"pos": opened.pos, "mark": mark, "onward": mark if mark == "> " else " " * len(mark)}]
        elif tag in _LISTS:
            start = _integer(attrs.get("start")) if attrs else None
            self.counters.append(None if tag != "ol" else 1 if start is None else start)
        elif tag == "tr" and self.tables:
            self.table_rows.append([])
            self.line.grid.append(self.table_rows[-1])
        elif tag in CELLS:
            self.outside.append(self.formatting)
            if tag != "caption":
                self.cells.append({"head": tag == "th", "text": ""})
                for r in self.table_rows:  # a cell of a table within a cell is a cell of both rows
                    r.append(self.cells[-1])
        elif tag in HEADINGS or tag == "pre":
            if tag == "pre":
                self.speak(attrs)
            self.set_block()

    def speak(self, attrs: dict[str, str]) -> None:
        """The language that a code block names in its class."""
        for word in attrs.get("class", "").split():
            if word.startswith(("language-", "lang-")):
                self.language = word.split("-", 1)[1]
                self.set_block()
                if self.line is not None and not self.line.runs:
                    self.line.block = self.block

    def close(self, tag: str) -> None:
        if tag in _OWN_END:
            if tag in FORMATTING:
                self.unformat(tag)
            elif tag == "br":
                self.open("br", {})
        elif tag == "table" and self.tables_ignored:
            self.tables_ignored -= 1
        elif tag in HEADINGS:
            if (i := self.find(HEADINGS)) >= 0:
                self.pop(i)
        elif self.open_tags.get(tag):
            stops = _TABLE_SCOPE if tag in _PARTS else () if tag == "table" else _ITEM_SCOPE if tag == "li" else SCOPE
            if (i := self.find((tag,), stops)) >= 0:
                self.pop(i)

    def text(self, text: str, bare: str, before: bool, after: bool) -> None:
        """A text, also trimmed, with white space before and after it."""
        if self.cells:
            for c in self.cells:
                c["text"] += text
        if self.pre:
            if self.line is None:
                text = text.removeprefix("\r").removeprefix("\n")
            if text:
                self.run("text", text)
            return
        if not bare:
            if before:
                self.space = self.lead = True
            return
        if self.line is None:
            self.begin()
        if self.pending:
            self.line.runs += self.pending
            self.pending = []
        self.line.runs.append(Run("text", self.next, self.marks, bare, self.space or before, self.lead or before, self.breaks))
        self.next += 1
        self.breaks = 0
        self.space = self.lead = after

    def feed(self, tokens: Iterable[tuple]) -> None:
        """A page's tokens, parsed."""
        self.open("html", {})  # one root holds all; the page's own tag adds its attributes
        stack, rows, open_tags, whole = self.stack, self.rows, self.open_tags, self.whole
        for what, tag, attrs, begins, after in tokens:
            if what == TEXT:
                self.text(tag, attrs, begins, after)
            elif what == START:
                if begins is None or len(stack) >= MAX_DEPTH:
                    self.open(tag, attrs)
                    continue
                # as `open` has it, for blocks of which nothing else is to say
                paragraph, same, feeds, holds, own, lists = begins
                if paragraph and open_tags.get("p"):
                    self.end_paragraph()
                if same:
                    self.end_same(tag)
                if not self.tables:
                    self.boundary(1 if lists and open_tags.get("li") else feeds)
                if holds:
                    self.depth += 1
                pos = self.next
                opened = Row("open", pos, stack[-1].pos, self.depth, tag, attrs)
                opened.lines = self.lines
                self.next = pos + 1
                if holds or attrs or whole:  # else the row says nothing
                    rows.append(opened)
                stack.append(opened)
                open_tags[tag] = open_tags.get(tag, 0) + 1
                if own:
                    self.start_own(tag, attrs, opened)
            elif what == END:
                if begins and stack[-1].tag == tag:
                    self.pop(len(stack) - 1)
                else:
                    self.close(tag)
            elif what == TITLE and not self.has("svg"):
                self.row("title").text = tag
        for f in self.formatting:
            if f["row"] is not None:
                f["row"].end = self.next
        self.pop(0)


def _integer(value: str | None) -> int | None:
    found = re.match(r"\s*([+-]?[0-9]{1,9})", value or "")
    return int(found[1]) if found else None


def _side_by_side(values: list, names: list[str]) -> list[tuple]:
    of = (itemgetter if values and isinstance(values[0], dict) else attrgetter)(*names)
    return list(zip(*map(of, values))) if values else [()] * len(names)


def _array(values: Sequence, kind: pa.DataType) -> pa.Array:
    """`values` as Arrow, by columns: what lists, maps and structs (dicts, rows or runs, none of them null) hold is laid side by side first."""
    if pa.types.is_struct(kind):
        fields = [kind.field(i) for i in range(kind.num_fields)]
        return pa.StructArray.from_arrays([_array(v, f.type) for v, f in zip(_side_by_side(values, [f.name for f in fields]), fields)], fields=fields)
    if not (pa.types.is_list(kind) or pa.types.is_map(kind)):
        return pa.array(values, kind)
    flat, at = [], []
    for v in values:
        at.append(None if v is None else len(flat))
        if v:
            flat += v.items() if pa.types.is_map(kind) else v
    at = pa.array([*at, len(flat)], pa.int32())
    if pa.types.is_map(kind):
        return pa.MapArray.from_arrays(at, _array([k for k, _ in flat], kind.key_type), _array([v for _, v in flat], kind.item_type), type=kind)
    return pa.ListArray.from_arrays(at, _array(flat, kind.value_type), type=kind)


def _batch(rows: list[Row], page: dict[str, list], arrow: pa.Schema) -> pa.RecordBatch:
    """Rows with the columns of their pages."""
    own = [f.name for f in arrow if f.name not in page]
    found = page | dict(zip(own, _side_by_side(rows, own)))
    return pa.record_batch([_array(found[f.name], f.type) for f in arrow], schema=arrow)


def _tells(r: Row) -> bool:
    """Does a row say something about its page, breadcrumbs left aside?"""
    return r.kind not in ("open", "close") or r.tag in CONTAINERS and not r.bare or r.kind == "open" and bool(r.attrs)


def page_rows(tokens: list[str], whole: bool = True) -> list[Row]:
    """The rows of a page; unless `whole`, without those that say nothing."""
    tree = Tree(whole)
    tree.feed(map(parse, tokens))
    return tree.rows if whole else [r for r in tree.rows if _tells(r)]


def html_nodes(pages: DataFrame, whole: bool = True) -> DataFrame:
    """The node table (page_id and SCHEMA) of pages(page_id, url, html): rows of a page in order of `pos`. A page without
    any token has its root alone. Unless `whole`, pages that aren't `hinted` go without the rows of bare elements and of
    those that hold no other blocks, where these have no attributes."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"page_id {dict(pages.dtypes)['page_id']}, {SCHEMA}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[Row] = []
            of: dict[str, list] = {c: [] for c in PAGE}
            for *page, tokens in zip(*(batch.column(c).to_pylist() for c in (*PAGE, "tokens"))):
                rows = page_rows(tokens, whole or page[2])
                held += rows
                for c, v in zip(PAGE, page):
                    of[c] += [v] * len(rows)
                if len(held) >= 1024:  # rows that the processor still has at hand
                    for lo in range(0, len(held), 1 << 15):
                        yield _batch(held[lo : lo + (1 << 15)], {c: v[lo : lo + (1 << 15)] for c, v in of.items()}, arrow)
                    held, of = [], {c: [] for c in PAGE}
            if held:
                yield _batch(held, of, arrow)

    hinted = F.coalesce(F.col("html").rlike(HINT), F.lit(False)).alias("hinted")
    return pages.select("page_id", "url", hinted, page_tokens("html").alias("tokens")).mapInArrow(run, schema)
