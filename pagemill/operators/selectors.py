"""CSS selectors over the node table, as SQL predicates on an element's tag and attributes and, where rows are made, in Python.

Supported: `*`, tag, `.class`, `#id`, `[attr]`, `[attr=v]`, `[attr~=v]`, `[attr*=v]`, `[attr^=v]`, `[attr$=v]`, joined
into one compound selector, and lists of those separated by commas.

The node-table operators write their expressions as SQL text: one parsed string instead of a call for each node of
an expression keeps plans quick to build."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_PART = re.compile(
    r"""\s*(?:(?P<tag>\*|[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|"""
    r"""\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~*^$]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[^\]\s]+))\s*)?\])"""
)


_WHITE = re.compile("[ \t\n\r\f]+")


def quoted(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def let(value: str, name: str, body: str) -> str:
    """`body`, in which `name` stands for `value`, evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _has_word(value: str, word: str) -> str:
    return f"array_contains(split({value}, '[ \\\\t\\\\n\\\\r\\\\f]+'), {quoted(word)})"


def _parsed(text: str) -> list[tuple[str, str, str | None, str | None]]:
    """(kind, name, operator, value) of each part of a compound selector; a tag, class or id has its name alone."""
    parts, at = [], 0
    while at < len(text):
        m = _PART.match(text, at)
        if m is None or m.end() == at or (at and m["tag"]):
            raise ValueError(f"selector not supported: {text!r}")
        at = m.end()
        if m["attr"]:
            parts.append(("attr", m["attr"].lower(), m["op"], next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), None)))
        else:
            kind = next(k for k in ("tag", "cls", "id") if m[k])
            parts.append((kind, m[kind].lower() if kind == "tag" else m[kind], None, None))
    if not text:
        raise ValueError("empty selector")
    return parts


def _compound(text: str, tag: str, attrs: str) -> str:
    parts = []
    for kind, name, op, want in _parsed(text):
        if kind == "tag":
            if name != "*":
                parts.append(f"{tag} = {quoted(name)}")
        elif kind == "cls":
            parts.append(_has_word(f"{attrs}['class']", name))
        elif kind == "id":
            parts.append(f"{attrs}['id'] = {quoted(name)}")
        else:
            value = f"{attrs}[{quoted(name)}]"
            if op is None:
                parts.append(f"{value} IS NOT NULL")
            elif op == "=":
                parts.append(f"{value} = {quoted(want)}")
            elif op == "~=":
                parts.append(_has_word(value, want))
            elif not want:
                parts.append("false")
            else:
                parts.append(f"{dict(zip('*^$', ('contains', 'startswith', 'endswith')))[op[0]]}({value}, {quoted(want)})")
    return " AND ".join(f"({p})" for p in parts) or "true"


def _selectors(selector: str) -> list[str]:
    return [s.strip() for s in re.split(r""",(?=(?:[^"']|"[^"]*"|'[^']*')*$)""", selector)]


_TESTS = {"=": str.__eq__, "~=": lambda value, want: want in _WHITE.split(value), "*=": lambda value, want: bool(want) and want in value,
          "^=": lambda value, want: bool(want) and value.startswith(want), "$=": lambda value, want: bool(want) and value.endswith(want)}


@lru_cache(256)
def test(selector: str) -> Callable[[str, dict[str, str]], bool]:
    """Does an element of this tag with these attributes match the selector?"""
    lists = []
    for s in _selectors(selector):
        lists.append([{"tag": (kind, name, op, want), "cls": ("attr", "class", "~=", name), "id": ("attr", "id", "=", name)}.get(kind, (kind, name, op, want)) for kind, name, op, want in _parsed(s)])

    def hit(part: tuple, tag: str, attrs: dict[str, str]) -> bool:
        kind, name, op, want = part
        if kind == "tag":
            return name in ("*", tag)
        value = attrs.get(name)
        return value is not None and (op is None or _TESTS[op](value, want))

    return lambda tag, attrs: any(all(hit(p, tag, attrs) for p in parts) for parts in lists)


def matching(selector: str, tag: str = "tag", attrs: str = "attrs") -> str:
    """SQL: does an element match the selector? Never null."""
    either = [_compound(s, tag, attrs) for s in _selectors(selector)]
    return "(" + " OR ".join(f"coalesce({e}, false)" for e in either) + ")"


def matches(selector: str, tag: str = "tag", attrs: str = "attrs") -> Column:
    return F.expr(matching(selector, tag, attrs))
