"""Reader mode over the node table: which elements of a page hold its content.

Contract. A line (a run of inline content) of at least `MIN_CHARS` characters outside links scores
1 + its commas + min(floor(characters / 100), 3), credited to every container around it, halved with each
container level (levels beyond `MAX_LEVEL` count as that level). A container's score is its credit, times
`GOOD` for article, main or a telling class or id and `POOR` for a telling bad one, times 1 − its link
share. Lines inside unlikely elements (navigation, asides, footers, bad class words) don't count
in the first pass, and what it finds is kept without them. The best container is taken (ties: the inner, then the first); where none scores, the page's only
article or main that holds something; else the best of a second pass that counts all lines. Siblings of the
chosen container that score at least max(`MIN_SIBLING`, `SIBLING` × its score) are content too.

The credit of a container is a difference of running sums over the page's rows, scaled by its level,
so nothing is multiplied by depth: one pass over a page's rows."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

from pagemill.operators.nodes import CONTAINERS, Row

MIN_CHARS = 25
MAX_LEVEL = 40
GOOD, POOR = 1.25, 0.2
MIN_SIBLING, SIBLING = 5.0, 0.2

# Words in a class or id (between spaces, - and _) that speak for or against content.
GOOD_WORDS = frozenset(("article", "blog", "body", "content", "entry", "main", "page", "post", "story", "text"))
POOR_WORDS = frozenset((
    "ad", "ads", "advert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "cookie", "disqus", "footer", "header", "menu", "nav", "navbar",
    "pager", "pagination", "popup", "promo", "related", "share", "sidebar", "social", "sponsor", "toolbar", "widget",
))
POOR_TAGS = frozenset(("nav", "aside", "footer", "form", "menu"))

_BETWEEN = re.compile("[^a-z0-9]+")
_MILLIONTH = Decimal("0.000001")


@lru_cache(4096)
def _weighed(tag: str, cls: str | None, id_: str | None) -> tuple[bool, float]:
    """Is an element unlikely to hold content? Its weight."""
    words = _BETWEEN.split(" ".join(x for x in (cls, id_) if x is not None).lower()) if cls is not None or id_ is not None else []
    poor = tag in POOR_TAGS or tag not in ("html", "body", "article", "main") and not POOR_WORDS.isdisjoint(words)
    good = tag in ("article", "main") or not GOOD_WORDS.isdisjoint(words)
    return poor, GOOD if good else POOR if poor else 1.0


def _rounded(x: float) -> float:
    """To six places, a half away from zero, by the shortest decimal that names `x`."""
    return x if (x * 64).is_integer() else float(Decimal(repr(x)).quantize(_MILLIONTH, ROUND_HALF_UP)) if x < 1e15 else x


#: The same for elements without a class or id; what a level is worth.
_PLAIN = {tag: _weighed(tag, None, None) for tag in CONTAINERS}
_DOWN = [0.5 ** k for k in range(MAX_LEVEL + 1)]
_UP = [2.0 ** k for k in range(MAX_LEVEL + 1)]


def _line(r: Row) -> tuple[float, int, int, int]:
    """A line's credit at its level, its characters and those of them in links, whether it shows something."""
    if len(r.runs) == 1:
        x = r.runs[0]
        if x.kind == "text" and not x.marks:
            n = len(x.text)
            return (1 + x.text.count(",") + min(n // 100, 3)) * _DOWN[min(r.depth, MAX_LEVEL)] if n >= MIN_CHARS else 0.0, n, 0, 1
    chars = links = commas = 0
    shows = r.kind == "rule"
    for x in r.runs:
        if x.kind == "text":
            n = len(x.text)
            chars += n
            commas += x.text.count(",")
            if x.marks and any(m["kind"] == "link" for m in x.marks):
                links += n
            shows = True
        elif x.kind == "image":
            shows = True
    n = chars - links
    part = (1 + commas + min(n // 100, 3)) * _DOWN[min(r.depth, MAX_LEVEL)] if n >= MIN_CHARS else 0.0
    return part, chars, links, shows


def content(rows: list[Row], texts: dict[int, str], nothing: set[int]) -> list[tuple[Row, str]]:
    """The lines, among the rows of a page in order, in what reader mode keeps of it, with their Markdown. `texts`: Markdown
    of the lines by place in `rows`; those in `nothing` show nothing and count for nothing."""
    steps = links = chars = shown = lones = 0
    strictly = loosely = 0.0
    opened: dict[int, tuple] = {}
    closed: list[tuple] = []
    lines: list[tuple] = []
    strict = loose = lone = None
    for i, r in enumerate(rows):
        if r.runs is not None:
            lines.append((r, i, steps > 0))
            if i not in nothing:
                part, c, n, s = _line(r)
                if part:
                    if steps <= 0:
                        strictly += part
                    loosely += part
                chars += c
                links += n
                shown += s
        elif not r.bare and r.tag in _PLAIN:
            attrs = r.attrs
            poor, weight = _weighed(r.tag, attrs.get("class"), attrs.get("id")) if attrs else _PLAIN[r.tag]
            if r.kind == "open":
                steps += poor
                opened[r.pos] = strictly, loosely, chars, links, shown
                continue
            steps -= poor
            before = opened.get(r.end)
            opened[r.end] = strictly, loosely, chars, links, shown  # should a page's row come twice
            single = r.tag == "article" or r.tag == "main"
            lones += single
            if before is None:
                closed.append((None, r))
                continue
            if single and shown - before[4] > 0:
                lone = max(lone or (), (0.0, 0, 0, r.end, r.pos, r.parent))
            if loosely == before[1] and strictly == before[0]:
                closed.append((0.0, r))
                continue
            c = chars - before[2]
            scale = _UP[min(r.depth, MAX_LEVEL)] * weight * (1 - ((links - before[3]) / c if c else 0.0))
            score, score_all = _rounded((strictly - before[0]) * scale), _rounded((loosely - before[1]) * scale)
            closed.append((score, r))
            if score > 0:
                strict = max(strict or (), (score, r.depth, -r.end, r.end, r.pos, r.parent))
            if score_all > 0:
                loose = max(loose or (), (score_all, r.depth, -r.end, r.end, r.pos, r.parent))
    top = strict or (lone if lones == 1 else None) or loose
    if top is None:
        return []
    least = max(MIN_SIBLING, SIBLING * top[0])
    # siblings that score a fifth of the best are few: their parent would outscore it
    spans = [(r.end, r.pos) for score, r in closed if r.end == top[3] or strict and r.parent == top[5] and score is not None and score >= least]
    if len(spans) == 1:
        (a, b), = spans
        return [(r, texts[i]) for r, i, unlikely in lines if a < r.pos < b and not (strict and unlikely) and texts[i]]
    return [(r, texts[i]) for r, i, unlikely in lines if not (strict and unlikely) and texts[i] and any(a < r.pos < b for a, b in spans)]
