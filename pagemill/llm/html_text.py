"""HTML extraction (operator 7): layout-aware rendering of all visible text.

A page's tags build a tree with the end tags that HTML implies; the tree is walked once, and
what a browser would show is written to text: blocks on lines of their own, blank lines
around paragraphs and the like, list markers with nesting, preformatted text as it is, and
table cells in aligned columns. Hidden are head, script, style, template and similar elements, the
hidden attribute, inline `display: none`, and what a closed details or dialog holds, with all in
them; inline `visibility` is inherited, so that a visible element shows inside a hidden one. No element is
chosen over another: all visible text comes out. Columns are as wide as a terminal shows their text.

The tokenizer looks at every character once, however broken the markup is; at most `MAX_OPEN` elements are
open at a time (deeper ones are children of the last), as in browsers.

A page is the unit of work; pages are independent, so the plan is one narrow pass over the
table. Walks use explicit stacks.

Defined results: null or empty html gives an empty text; broken markup is read as far as it
goes (a tag that the end of the page cuts off is dropped); repeated rows are rendered alike; an empty table
gives an empty result. Other columns are carried through; input columns named text, n_chars or n_lines give
way to the result's.
"""

from __future__ import annotations

import html as charrefs
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("area audio base canvas datalist head iframe link meta noembed noframes noscript object param rp script source style template title track video".split())
SPACED = set("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu".split())
BLOCK = SPACED | set("address article aside body caption center dd details dialog div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary tbody td tfoot th thead tr".split())
CLOSES_P = BLOCK - set("body caption dd dt html li optgroup option tbody td tfoot th thead tr".split()) | {"li", "dd", "dt"}
#: An opening tag ends open elements of the second column, up to an element of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, set()),
}
SCOPE = set("table td th caption html body button object template".split())
GONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\b", re.I)
#: Elements whose content is text up to their end tag; in the second group references are decoded.
RAW = ("script", "style", "xmp", "iframe", "noembed", "noframes", "title", "textarea")
DECODED = ("title", "textarea")
MAX_OPEN = 512
_REST = r"""(?:[^=>]++|=[ \t\n\r\f]*+(?:"[^"]*+"?|'[^']*+'?)?+)*+>?"""
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW)})(?=[ \t\n\r\f/>])(?P<open>{_REST})(?P<text>.*?)(?:</(?P=raw)(?=[ \t\n\r\f/>])[^>]*+>?|\Z)"
    rf"|<(?P<end>/?)(?P<tag>[a-z][^ \t\n\r\f/>]*+)(?P<rest>{_REST})"
    r"|<[!?/][^>]*+>?"
    r"|(?P<data>(?:[^<]++|<(?![a-z!?/]))++)",
    re.I | re.S,
)
ATTRIBUTE = re.compile(r"""([^ \t\n\r\f"'<>/=][^ \t\n\r\f/>=]*)(?:[ \t\n\r\f]*=[ \t\n\r\f]*(?:"([^"]*)"?|'([^']*)'?|([^ \t\n\r\f>]*)))?""")
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


def attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, dq, sq, bare in ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), charrefs.unescape(dq or sq or bare))
    return out


class Tree:
    def __init__(self):
        self.root = Node("#root", {})
        self.open = [self.root]
        self.count: Counter[str] = Counter()  # of open elements, so that most searches need no walk

    def _close(self, k: int) -> None:
        """End the open elements from the k-th on."""
        self.count.subtract(n.tag for n in self.open[k:])
        del self.open[k:]

    def _end(self, tags: set[str], stop: set[str]) -> None:
        """End the innermost open element of `tags` and what it holds, unless one of `stop` is nearer."""
        if not any(self.count[t] for t in tags):
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                self._close(k)
                return
            if self.open[k].tag in stop:
                return

    def feed(self, page: str) -> None:
        for m in TOKEN.finditer(page):
            if m["data"] is not None:
                self.open[-1].kids.append(charrefs.unescape(m["data"]))
            elif m["raw"]:
                if m["open"].endswith(">"):
                    tag = m["raw"].lower()
                    self.start(tag, attributes(m["open"][:-1]))
                    if self.open[-1].tag == tag:
                        self.open[-1].kids.append(charrefs.unescape(m["text"]) if tag in DECODED else m["text"])
                        self._close(len(self.open) - 1)
            elif m["tag"] and m["rest"].endswith(">"):  # a tag that the end of the page cuts off is dropped
                if m["end"]:
                    self.end(m["tag"].lower())
                else:
                    self.start(m["tag"].lower(), attributes(m["rest"][:-1]))

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in CLOSES_P:
            self._end({"p"}, SCOPE)
        if tag in IMPLIED:
            ends, stop = IMPLIED[tag]
            before = None
            while before != len(self.open):  # tr ends td and then tr
                before = len(self.open)
                self._end(ends, stop | ({"table"} if "tr" in ends else set()))
        if tag in ("td", "th"):
            k = len(self.open) - 1
            while k and self.open[k].tag not in ("tr", "table"):
                k -= 1
            if self.open[k].tag == "table":
                self._push("tr", {})
        self._push(tag, attrs)
        if tag in VOID and self.open[-1].tag == tag:
            self._close(len(self.open) - 1)

    def _push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        self.open[-1].kids.append(node)
        if len(self.open) < MAX_OPEN or tag in VOID or tag in RAW:
            self.open.append(node)
            self.count[tag] += 1

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif tag not in VOID:
            self._end({tag}, SCOPE - {tag} if tag not in ("table", "html", "body") else set())


class Canvas:
    """Lines under construction; `gap` blank lines are due before the next one."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = False  # a collapsed space is due
        self.gap = 0
        self.indent: list[str] = []
        self.marker = ""

    def text(self, s: str) -> None:
        words = SPACE.sub(" ", s)
        if words.strip(" ") == "":
            self.space = self.space or bool(words)
            return
        if self.now and (self.space or words[0] == " "):
            self.now.append(" ")
        self.now.append(words.strip(" "))
        self.space = words[-1] == " "

    def raw(self, s: str) -> None:
        first, *rest = s.replace("\r\n", "\n").split("\n")
        self.now.append(first)
        for line in rest:
            self.end(True)
            self.now.append(line)

    def end(self, keep_empty: bool = False) -> None:
        line = "".join(self.now)
        self.now, self.space = [], False
        if not keep_empty:
            line = line.rstrip()
        if line or keep_empty:
            if self.lines:
                self.lines += [""] * self.gap
            self.gap = 0
            lead = "".join(self.indent)
            if self.marker:
                lead = lead[: len(lead) - len(self.marker)] + self.marker
                self.marker = ""
            self.lines.append((lead + line).rstrip())

    def block(self, blank: int) -> None:
        self.end()
        self.gap = max(self.gap, blank)

    def done(self) -> list[str]:
        self.end()
        return self.lines


def _hidden(n: Node, parent: Node | None) -> bool:
    if n.tag in HIDDEN or "hidden" in n.attrs or (n.tag == "input" and n.attrs.get("type", "").lower() == "hidden"):
        return True
    if n.tag == "dialog" and "open" not in n.attrs:
        return True
    if parent is not None and parent.tag == "details" and "open" not in parent.attrs and n.tag != "summary":
        return True
    return "style" in n.attrs and GONE.search(n.attrs["style"]) is not None


def _visible(n: Node, inherited: bool) -> bool:
    """Is the element's own text drawn? The last `visibility` of its style counts, else its parent's."""
    said = VISIBILITY.findall(n.attrs["style"]) if "style" in n.attrs else []
    return said[-1].lower() == "visible" if said else inherited


def _number(s: str, least: int, most: int) -> int:
    """An integer as HTML reads it, held within bounds; 1 where there is none."""
    m = re.match(r"\s*([+-]?)0*(\d{1,18})", s)
    return min(max(int(m[1] + m[2]), least), most) if m else 1


def _width(s: str) -> int:
    """Columns that a terminal gives a text."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of (lines, colspan, rowspan) cells as lines with columns of equal width."""
    grid: list[dict[int, list[str]]] = []
    taken: dict[int, int] = {}  # column -> rows that a cell above still covers
    width: dict[int, int] = {}
    for row in rows:
        col, line = 0, {}
        held = dict(taken)
        for lines, cols, down in row:
            while held.get(col, 0) > 0:
                col += 1
            line[col] = lines
            if cols == 1:
                width[col] = max(width.get(col, 0), max(map(_width, lines), default=0))
            for c in range(col, col + cols):
                taken[c] = max(taken.get(c, 0), down)
            col += cols
        taken = {c: k - 1 for c, k in taken.items() if k > 1}
        grid.append(line)
    starts, at = {}, 0
    for c in range(max((max(line, default=-1) for line in grid), default=-1) + 1):
        starts[c] = at
        at += width[c] + 2 if c in width else 0
    out = []
    for line in grid:
        used = sorted(line)
        for k in range(max((len(line[c]) for c in used), default=0)):
            text, wide = [], 0
            for c in used:
                cell = line[c][k] if k < len(line[c]) else ""
                if cell:
                    pad = starts[c] - wide if wide <= max(starts[c] - 2, 0) or not wide else 2
                    text.append(" " * pad + cell)
                    wide += pad + _width(cell)
            text = "".join(text)
            out.append(text.rstrip())
    return [x for x in out if x]


def render(html: str) -> list[str]:
    """The visible text's lines."""
    tree = Tree()
    tree.feed(html)
    canvas = Canvas()
    # canvases of the tables and cells being walked: (table's rows, canvas around it)
    tables: list[tuple[list, Canvas]] = []
    cells: list[Canvas] = []
    lists: list[list] = []  # [ordered, next number]
    pre = 0
    work: list[tuple[str, Node | str, Node | None, bool]] = [("in", tree.root, None, True)]
    while work:
        step, n, parent, shown = work.pop()
        if isinstance(n, str):
            if not shown:
                continue
            if parent is not None and parent.tag == "details" and "open" not in parent.attrs:
                continue
            if parent is not None and parent.tag in ("table", "tr", "tbody", "thead", "tfoot") and not n.strip():
                continue
            canvas.raw(n) if pre else canvas.text(n)
            continue
        tag = n.tag
        if step == "in":
            if _hidden(n, parent):
                continue
            shown = _visible(n, shown)
            if tag == "br":
                canvas.end(keep_empty=not canvas.now and not pre and bool(canvas.lines) and canvas.gap == 0)
                continue
            if tag == "hr":
                canvas.block(1)
                continue
            if tag == "wbr" or tag in VOID:
                continue
            inner = bool(lists) and tag in ("ul", "ol", "menu")
            if tag in BLOCK and tag not in ("td", "th", "tr"):
                canvas.block(0 if inner else int(tag in SPACED))
            if tag == "pre":
                pre += 1
                if n.kids and isinstance(n.kids[0], str) and n.kids[0].startswith("\n"):
                    n.kids[0] = n.kids[0][1:]
            elif tag in ("ul", "ol", "menu"):
                lists.append([tag == "ol", _number(n.attrs["start"], -(1 << 31), (1 << 31) - 1) if "start" in n.attrs else 1])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    if "value" in n.attrs:
                        lists[-1][1] = _number(n.attrs["value"], -(1 << 31), (1 << 31) - 1)
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                canvas.indent.append(" " * len(mark))
                canvas.marker = mark if shown else ""
            elif tag == "dd":
                canvas.indent.append("  ")
            elif tag == "blockquote":
                canvas.indent.append("> ")
            elif tag == "table":
                tables.append(([], canvas))
            elif tag == "tr" and tables:
                tables[-1][0].append([])
            elif tag in ("td", "th") and tables and tables[-1][0]:
                cells.append(canvas)
                canvas = Canvas()
            elif tag in ("td", "th"):
                canvas.block(0)
            work.append(("out", n, parent, shown))
            work.extend(("in", k, n, shown) for k in reversed(n.kids))
        else:
            if tag in ("td", "th") and tables and tables[-1][0] and cells:
                lines = canvas.done()
                canvas = cells.pop()
                tables[-1][0][-1].append((lines, _number(n.attrs.get("colspan", "1"), 1, 1000), _number(n.attrs.get("rowspan", "1"), 1, 65534)))
                continue
            if tag in BLOCK and tag != "tr":
                canvas.end()
            if tag == "table":
                rows, canvas = tables.pop()
                canvas.block(1)
                for line in _aligned(rows):
                    canvas.now.append(line)
                    canvas.end()
            elif tag == "pre":
                pre -= 1
            elif tag in ("ul", "ol", "menu"):
                lists.pop()
            elif tag == "li":
                canvas.indent.pop()
                canvas.marker = ""
            elif tag in ("dd", "blockquote"):
                canvas.indent.pop()
            if tag in BLOCK and tag not in ("tr", "td", "th"):
                canvas.block(0 if tag in ("ul", "ol", "menu") and lists else int(tag in SPACED))
    return canvas.done()


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """`pages` with `text`, `n_chars` and `n_lines` instead of the html column."""
    keep = [c for c in pages.columns if c not in (html, "text", "n_chars", "n_lines")]
    kinds = dict(pages.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["text string, n_chars bigint, n_lines bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                lines = [render(v.as_py() or "") for v in part.column(html)]
                texts = ["\n".join(x) for x in lines]
                yield pa.record_batch([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(x) for x in lines], pa.int64())],
                                      names=[*keep, "text", "n_chars", "n_lines"])

    return pages.select(*keep, html).mapInArrow(run, schema)
