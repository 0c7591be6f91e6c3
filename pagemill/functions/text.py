"""Generic string helpers as Column expressions (all JVM-side, codegen-able).

Regex dialect note: every pattern here is written in the subset shared by
Java regex (Spark) and RE2 (the DuckDB oracle): no look-around, no
back-references, explicit whitespace classes, `\\A`/`\\z` anchors.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as JavaScript's `\s` sees it for the texts we handle (ASCII
# whitespace plus no-break space); Spark's and RE2's `\s` are ASCII-only.
WS = "[ \\t\\n\\r\\f\\x{0B}\\x{A0}]"
HTML_WS = "[ \\t\\n\\r\\f]"

# HTML entities decoded by the converter, in the order applied.
# `&amp;` comes last so that `&amp;lt;` stays `&lt;`.
ENTITIES = [
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
    ("&hellip;", "…"),
    ("&amp;", "&"),
]


@functools.cache
def _references() -> tuple[str, str, str]:
    """(pattern of a character reference, pattern of the old names, `name → text` as text for `str_to_map`), from Python's
    table of the HTML standard: names with their semicolon, the old ones also without it."""
    from html.entities import html5

    old = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
    names = "|".join(old)
    pattern = f"&(?:#[0-9]{{1,7}};?|#[xX][0-9a-fA-F]{{1,6}};?|[A-Za-z][A-Za-z0-9]*;|{names})"
    return pattern, f"&(?:{names})", "\x02".join(f"&{k}\x01{v}" for k, v in html5.items() if v not in "\x01\x02")


def _windows_1252() -> dict[int, int]:
    """The standard reads references to 128..159 as Windows-1252 where that has a character."""
    out = {}
    for n in range(0x80, 0xA0):
        try:
            out[n] = ord(bytes([n]).decode("cp1252"))
        except UnicodeDecodeError:
            pass
    return out


def let(value: Column, body) -> Column:
    """`body(value)` with `value` evaluated once, however often the body looks at it."""
    return F.get(F.transform(F.array(value), body), 0)


def _one_entity(e: Column) -> Column:
    """Text of one character reference; what is no reference stays as it is."""
    digits = F.regexp_extract(e, "#[xX]?([0-9a-fA-F]+)", 1)
    n = F.when(e.rlike("&#[xX]"), F.conv(digits, 16, 10)).when(e.startswith("&#"), digits).cast("bigint")
    moved = F.element_at(F.create_map(*(F.lit(x) for pair in _windows_1252().items() for x in pair)), n.cast("int"))
    n = F.coalesce(moved.cast("bigint"), n)
    ok = n.between(1, 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    named = F.str_to_map(F.lit(_references()[2]), F.lit("\x02"), F.lit("\x01"))
    # a name that is none may begin with an old one: `&notit;` is `¬it;`
    begin = F.regexp_extract(e, "\\A" + _references()[1], 0)
    known = F.coalesce(F.element_at(named, e), F.concat(F.element_at(named, F.nullif(begin, F.lit(""))), F.substr(e, F.length(begin) + 1)), e)
    return F.when(e.startswith("&#"), F.when(ok, char).otherwise(F.lit("\ufffd"))).otherwise(known)


def interleave(parts: Column, between: Column) -> Column:
    """parts[0] + between[0] + parts[1] + …"""
    z = F.arrays_zip(parts.alias("p"), between.alias("b"))
    return F.array_join(F.transform(z, lambda x: F.concat(F.coalesce(x["p"], F.lit("")), F.coalesce(x["b"], F.lit("")))), "")


def decode_entities(c) -> Column:
    """Decode every character reference once, in one pass. Texts without an ampersand skip the work."""
    pattern = _references()[0]

    def body(t: Column) -> Column:
        joined = interleave(F.split(t, pattern), F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), _one_entity))
        return F.when(t.contains("&"), joined).otherwise(t)

    return let(col_(c), body)


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(c) -> Column:
    """`String.prototype.trim` for the whitespace we meet (Spark `trim` strips spaces only)."""
    return F.regexp_replace(col_(c), f"\\A{WS}+|{WS}+\\z", "")


def collapse_ws(c) -> Column:
    """HTML whitespace collapsing: runs of ASCII whitespace → one space."""
    return F.regexp_replace(col_(c), f"{HTML_WS}+", " ")


def strip_tags(c) -> Column:
    return F.regexp_replace(col_(c), "<[^>]*>", "")


def inner_text(c) -> Column:
    """Text content of an HTML fragment: tags dropped, entities decoded, whitespace collapsed, trimmed."""
    return js_trim(decode_entities(collapse_ws(strip_tags(c))))


def word_count(c) -> Column:
    """`s.split(/\\s+/).filter(w => w.length > 0).length`, without a lambda so it
    stays inside whole-stage codegen."""
    t = js_trim(c)
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, f"{WS}+"))).cast("bigint")


def line_count(c) -> Column:
    """`s.split('\\n').length` (always ≥ 1)."""
    return (F.length(col_(c)) - F.length(F.replace(col_(c), F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def preview(c, n: int = 1000) -> Column:
    """First `n` characters (log / error previews of bodies)."""
    return F.substring(col_(c), 1, n)
