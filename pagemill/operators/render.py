"""Markdown from the node table: a line at a time, joined in order, no pattern over a whole page.

A line's runs become pieces (text marked for escapes, with the marks that begin or end there), joined in order; a table's cells
become rows of a pipe table. A line gets the prefix of its open quotes and list items (the item's marker on its first
line, an indent of the same width on others); lines are joined by one line feed or a blank line, as the tree asked.
Texts that may need a Markdown escape stand between two marks (`ESCAPE`, which no page's text holds) until `escaped` writes
the escapes.

Callers' rules: `ElementRule(name, selector, before, after)` writes its strings around an inline element that
matches the selector; with `drop=True` the element, inline or block, is left out with all in it."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pagemill.functions.html import TEXT_ESCAPES
from pagemill.operators.nodes import Row, Run
from pagemill.operators.selectors import quoted, test

ESCAPE = "\ufdd1"
_WS = re.compile("[ \t\n\r\f]+")
_EXAMPLE = re.compile(r"(?s)\A(.*?) ?Example: ?(.+)\Z")
#: Texts without any of these have nothing to escape.
_SPECIAL = re.compile(r"[\\*`\[\]_]|\A ?[-+=#~>0-9]")
_SIGNS = {"strong": "**", "em": "_", "code": "`", "link": "["}


@dataclass(frozen=True)
class ElementRule:
    name: str
    selector: str
    before: str = ""
    after: str = ""
    drop: bool = False


def dropped(rows: list[Row], rules: list[ElementRule]) -> list[Row]:
    """A page's rows in order without the block elements that the rules drop."""
    drops = [test(r.selector) for r in rules if r.drop]
    if not drops:
        return rows
    out, inside = [], 0
    for r in rows:
        if r.kind in ("open", "close") and any(d(r.tag, r.attrs) for d in drops):
            inside += 1 if r.kind == "open" else -1
        elif inside == 0:
            out.append(r)
    return out


def _ruled(runs: list[Run], rules: list[ElementRule]) -> list[Run]:
    """A line's runs with the rules' strings as literal runs, without the inline elements that they drop; the first rule
    that matches an element counts. Marks of other elements go."""
    if not rules:
        return [r for r in runs if r.kind in ("text", "image")]
    tests = [(r, test(r.selector)) for r in rules]
    closes: dict[int, int] = {}
    for r in runs:
        if r.kind == "close":
            closes.setdefault(r.end, r.pos)
    kept, holes = [], []
    for r in runs:
        rule = None
        if r.kind not in ("text", "image"):
            rule = next((rule for rule, hits in tests if hits(r.tag, r.attrs)), None)
            if rule is not None and rule.drop and r.kind == "open":
                holes.append((r.space, r.pos, closes.get(r.pos, 2147483647)))
            if rule is None or rule.drop:
                continue
        kept.append((r, rule))
    out = []
    for r, rule in kept:
        if any(a <= r.pos < b for _, a, b in holes):
            continue
        x = Run(r.kind if rule is None else "literal", r.pos, r.marks)
        x.text, x.lead, x.breaks, x.href, x.title = r.text, r.lead, r.breaks, r.href, r.title
        if rule is not None:
            x.text = rule.before if r.kind == "open" else rule.after
        # what follows a hole directly also stands behind the white space in front of it
        x.space = r.space or any(s and r.pos == b + 1 for s, _, b in holes)
        out.append(x)
    return out


def _titled(title: str | None) -> str:
    return ' "' + title.replace('"', '\\"') + '"' if title else ""


def _begun(marks: list[dict]) -> str:
    return "".join([_SIGNS[m["kind"]] for m in marks])


def _ended(marks: list[dict]) -> str:
    return "".join([f"]({m['href']}{_titled(m['title'])})" if m["kind"] == "link" else _SIGNS[m["kind"]] for m in reversed(marks)])


def _shared(a: list[dict], b: list[dict], apart: bool) -> int:
    """How many outer marks two neighbouring runs have in common (there are at most four, one of a kind)."""
    n = 0
    for x, y in zip(a, b):
        if not (x["pos"] == y["pos"] or not apart and x["kind"] == y["kind"] and x["kind"] != "link"):
            break
        n += 1
    return n


def _line(runs: list[Run], breaks: str, rules: list[ElementRule]) -> str:
    """One line's runs as Markdown; `breaks`: the text of one break."""
    out, before, last = [], [], None
    for r in runs if len(runs) == 1 and runs[0].kind == "text" else _ruled(runs, rules):
        marks = r.marks
        if last is not None:
            if before or marks:
                k = 0 if r.breaks else _shared(before, marks, r.space)
                out.append(_ended(before[k:]))
                marks = marks[k:]
            if r.breaks:
                out.append(breaks * r.breaks)
            elif r.lead if last == "literal" else r.space:
                out.append(" ")
        if marks:
            out.append(_begun(marks))
        if r.kind == "image":
            out.append(f"![{r.text}]({r.href}{_titled(r.title)})")
        elif r.kind == "literal" or not _SPECIAL.search(r.text) or any(m["kind"] == "code" for m in r.marks):
            out.append(r.text)
        else:
            out.append(f"{ESCAPE}{r.text}{ESCAPE}")
        before, last = r.marks, r.kind
    if before:
        out.append(_ended(before))
    return "".join(out)


def _table(grid: list[list[dict]]) -> str:
    """A pipe table: the first row, of any cells, is the head; later rows show their `td` cells. `X Example: Y` is
    rewritten to `X (Example: Y)` below the head."""
    if not grid:
        return ""
    flat = lambda c: _WS.sub(" ", c["text"]).strip(" ")
    out = [f"| {' | '.join([flat(c).replace('|', '\\|') for c in grid[0]])} |", f"| {' | '.join(['---'] * len(grid[0]))} |"]
    for row in grid[1:]:
        cells = [flat(c) for c in row if not c["head"]]
        cells = [_EXAMPLE.sub(r"\1 (Example: \2)", c) if "Example:" in c else c for c in cells]
        out.append(f"| {' | '.join(cells).replace('|', '\\|') if len(cells) == 1 else ' | '.join([c.replace('|', '\\|') for c in cells])} |")
    return "\n".join(out)


def line_markdown(r: Row, rules: list[ElementRule]) -> str:
    """Markdown of a line, table or rule row, without its prefix; texts that may need escapes between marks."""
    if r.kind == "line" and len(r.runs) == 1 and not r.block and (x := r.runs[0]).kind == "text" and not x.marks:
        return f"{ESCAPE}{x.text}{ESCAPE}" if _SPECIAL.search(x.text) else x.text
    if r.kind == "rule":
        return "* * *"
    if r.kind == "table":
        return _table(r.grid)
    if r.block.startswith("pre"):
        code = "".join([x.text for x in r.runs if x.kind == "text"])
        if not code:
            return ""
        fence = "````" if "```" in code else "```"
        return f"{fence}{r.block[4:]}\n{code.replace('\r\n', '\n').replace('\r', '\n').rstrip('\n')}\n{fence}"
    if not r.block:
        return _line(r.runs, "  \n", rules)
    text = _line(r.runs, " ", rules)
    return f"{'#' * int(r.block[1])} {text}" if text else ""


def joined(lines: list[tuple[Row, str]]) -> str:
    """A page's body: its lines in content, in order, each under its prefix with what joins it to the line before."""
    pieces, above = [], None
    for r, text in lines:
        items = r.items
        if items:
            if above:
                known = [b["pos"] for b in above]
                begin = "".join([i["onward" if i["pos"] in known else "mark"] for i in items])
            else:
                known = ()
                begin = "".join([i["mark"] for i in items])
            if "\n" in text:
                text = text.replace("\n", "\n" + "".join([i["onward"] for i in items]))
            text = begin + text
        if above is not None:
            if r.feeds < 2:
                text = "\n" + text
            elif items and known and any(i["mark"] == "> " for i in items):
                shared = "".join([i["onward"] for i in items if i["pos"] in known])
                text = f"\n{shared if '>' in shared else ''}\n{text}"
            else:
                text = "\n\n" + text
        above = items
        pieces.append((r.pos, text))
    pieces.sort()  # by text where several pages of one id have a line at one place
    return "".join([p for _, p in pieces])


def escaped(body: str) -> str:
    """SQL: Markdown with the escapes of its marked texts."""
    text = "t"
    for pattern, repl in TEXT_ESCAPES:
        text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(repl)})"
    return f"if(contains({body}, '{ESCAPE}'), array_join(transform(split({body}, '{ESCAPE}'), (t, i) -> if(i % 2 = 1, {text}, t)), ''), {body})"
