"""DuckDB SQL expression builders for the oracle side of the correctness gate.

Each builder mirrors one Column function of `pagemill.functions`, written in
DuckDB's dialect (RE2 regex, `\\1` back-references, `lambda x: …`). The regex
*patterns* are shared with the Spark side (they are the rule contract); the
surrounding expression logic is written independently here.
"""

from __future__ import annotations

import re

from pagemill.functions import html as H
from pagemill.functions.text import ENTITIES, HTML_WS, WS


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def repl(java_repl: str) -> str:
    """Java replacement (`$1`) → RE2 replacement (`\\1`)."""
    return re.sub(r"\$(\d)", r"\\\1", java_repl)


def rr(expr: str, pattern: str, java_repl: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl(java_repl))}, 'g')"


def apply_rule(expr: str, pattern: str, java_repl: str) -> str:
    if any(ch in pattern for ch in "\\()[]{}?*+|^$.") or "$" in java_repl:
        return rr(expr, pattern, java_repl)
    return f"replace({expr}, {q(pattern)}, {q(java_repl)})"


def decode_entities(expr: str) -> str:
    """For the supplied pages, whose references are few; `&amp` also stands without its semicolon."""
    for ent, ch in ENTITIES:
        if ent == "&amp;":
            return rr(expr, "&amp;?", "&")
        expr = f"replace({expr}, {q(ent)}, {q(ch)})"
    return expr


def js_trim(expr: str) -> str:
    return rr(expr, f"\\A{WS}+|{WS}+\\z", "")


def inner_text(expr: str) -> str:
    e = rr(expr, "<[^>]*>", "")
    e = rr(e, f"{HTML_WS}+", " ")
    return js_trim(decode_entities(e))


def word_count(expr: str) -> str:
    t = js_trim(expr)
    return f"(CASE WHEN {t} = '' THEN 0 ELSE len(string_split_regex({t}, {q(WS + '+')})) END)::BIGINT"


def line_count(expr: str) -> str:
    return f"(length({expr}) - length(replace({expr}, chr(10), '')) + 1)::BIGINT"


_OPEN = H._OPEN
_CLOSE = H._CLOSE


def table_cell_text(expr: str) -> str:
    t = inner_text(expr)
    t = rr(t, "(?s)\\A(.*?)[ \\t\\n\\r\\f]*Example:[ \\t\\n\\r\\f]*(.+)\\z", "$1 (Example: $2)")
    return f"replace({t}, '|', '\\|')"


def html_table_markdown(expr: str) -> str:
    rows = f"regexp_extract_all({expr}, {q(f'(?is)<tr{_OPEN}(.*?)</tr{_CLOSE}')}, 1)"
    cells0 = f"regexp_extract_all(coalesce({rows}[1], ''), {q(f'(?is)<t[hd]{_OPEN}(.*?)</t[hd]{_CLOSE}')}, 1)"
    header = f"list_transform({cells0}, lambda c: replace({inner_text('c')}, '|', '\\|'))"
    sep = f"array_to_string(list_transform({header}, lambda h: '---'), ' | ')"
    tds = f"regexp_extract_all(r, {q(f'(?is)<td{_OPEN}(.*?)</td{_CLOSE}')}, 1)"
    body = (
        f"list_transform(list_slice({rows}, 2, len({rows})), lambda r: "
        f"'| ' || array_to_string(list_transform({tds}, lambda d: {table_cell_text('d')}), ' | ') || ' |')"
    )
    lines = f"list_concat(['| ' || array_to_string({header}, ' | ') || ' |', '| ' || {sep} || ' |'], {body})"
    return f"(CASE WHEN len({rows}) = 0 THEN '' ELSE chr(10) || chr(10) || array_to_string({lines}, chr(10)) || chr(10) || chr(10) END)"


def tables_to_markdown(expr: str) -> str:
    marked = f"regexp_replace({expr}, {q(f'(?is)(<table{_OPEN}.*?</table{_CLOSE})')}, chr(1) || '\\1' || chr(1), 'g')"
    segs = f"string_split({marked}, chr(1))"
    conv = f"list_transform({segs}, lambda s, i: CASE WHEN i % 2 = 0 THEN {html_table_markdown('s')} ELSE s END)"
    return f"(CASE WHEN contains({expr}, '<table') THEN array_to_string({conv}, '') ELSE {expr} END)"


def _inner_segments(expr: str, block: str, fn) -> str:
    marked = f"regexp_replace({expr}, {q(block)}, '\\1' || chr(1) || '\\2' || chr(1) || '\\3', 'g')"
    return f"array_to_string(list_transform(string_split({marked}, chr(1)), lambda s, i: CASE WHEN i % 2 = 0 THEN {fn('s')} ELSE s END), '')"


def protect_pre(expr: str) -> str:
    inner = _inner_segments(expr, H.PRE_BLOCK, lambda s: f"translate(regexp_replace({s}, '<[^>]*>', '', 'g'), {q(H.PRE_WS_FROM)}, {q(H.PRE_WS_TO)})")
    return f"(CASE WHEN regexp_matches({expr}, '(?i)<pre') THEN {inner} ELSE {expr} END)"


def escape_text_nodes(expr: str) -> str:
    def esc(t: str) -> str:
        for pattern, r in H.TEXT_ESCAPES:
            t = rr(t, pattern, r)
        return t

    region = (
        f"array_to_string(list_transform(string_split(regexp_replace(s, '(<[^>]*>)', chr(2) || '\\1' || chr(2), 'g'), chr(2)), "
        f"lambda t, j: CASE WHEN j % 2 = 1 THEN {esc('t')} ELSE t END), '')"
    )
    segs = f"string_split(regexp_replace({expr}, {q(H.UNESCAPED_BLOCK)}, chr(1) || '\\1' || chr(1), 'g'), chr(1))"
    return f"array_to_string(list_transform({segs}, lambda s, i: CASE WHEN i % 2 = 1 THEN {region} ELSE s END), '')"


def html_to_markdown(expr: str) -> str:
    rules = H.MARKDOWN_RULES
    for _n, p, r in rules[: H.PRE_CLEAN - 1]:
        expr = apply_rule(expr, p, r)
    expr = protect_pre(expr)
    for _n, p, r in rules[H.PRE_CLEAN - 1 : H.PRE_CLEAN]:
        expr = apply_rule(expr, p, r)
    expr = tables_to_markdown(escape_text_nodes(expr))
    for _n, p, r in rules[H.PRE_CLEAN :]:
        expr = apply_rule(expr, p, r)
    marked = f"regexp_replace({expr}, {q(H.QUOTE_BLOCK)}, chr(1) || '\\1' || chr(1), 'g')"
    conv = (
        f"array_to_string(list_transform(string_split({marked}, chr(1)), lambda s, i: CASE WHEN i % 2 = 0 THEN "
        f"'> ' || replace(regexp_replace(s, '^[ \n]+|[ \n]+$', '', 'g'), chr(10), chr(10) || '> ') ELSE s END), '')"
    )
    quoted = f"translate(CASE WHEN contains({expr}, {q(H.QUOTE_OPEN)}) THEN {conv} ELSE {expr} END, {q(H.QUOTE_OPEN + H.QUOTE_CLOSE)}, '')"
    quoted = rr(quoted, "\\A[ \n]+|[ \n]+\\z", "")
    return f"translate({quoted}, {q(H.PRE_WS_TO)}, {q(H.PRE_WS_FROM[:3])})"


def page_title(expr: str) -> str:
    t = inner_text(f"regexp_extract({expr}, {q('(?is)<title[^>]*>(.*?)</title')}, 1)")
    h1 = inner_text(f"regexp_extract({expr}, {q(f'(?is)<h1{_OPEN}(.*?)</h1')}, 1)")
    return f"(CASE WHEN {t} <> '' THEN {t} ELSE {h1} END)"


def attr_of_first(expr: str, attr: str) -> str:
    p = f"(?is)<[a-z][^>]*?{HTML_WS}{attr}{HTML_WS}*={HTML_WS}*\"([^\"]*)\""
    return f"regexp_extract({expr}, {q(p)}, 1)"


def last_modified(expr: str, run_date: str) -> str:
    return (
        f"coalesce(nullif({attr_of_first(expr, 'data-timemodified')}, ''), "
        f"nullif({attr_of_first(expr, 'data-publicationdate')}, ''), {q(run_date)})"
    )


def shortcut_html(expr: str) -> str:
    for _n, p, r in [x for x in H.MARKDOWN_RULES if x[0] in H.CLEAN_RULES]:
        expr = apply_rule(expr, p, r)
    article = f"regexp_extract({expr}, {q(f'(?is)<article{_OPEN}(.*)</article{_CLOSE}')}, 1)"
    main = f"regexp_extract({expr}, {q(f'(?is)<main{_OPEN}(.*)</main{_CLOSE}')}, 1)"
    n = f"len(regexp_extract_all({expr}, {q('(?i)<(?:article|main)(?:[ \\t\\n\\r\\f/][^>]*)?>')}))"
    return f"(CASE WHEN {n} <> 1 THEN '' WHEN {article} <> '' THEN {article} ELSE {main} END)"


BREADCRUMB_HINT = "(?is)<(?:ul|ol|nav)[^>]*(?:class|id)=\"[^\"]*breadcrumbs?[^\"]*\"[^>]*>(.*?)</(?:ul|ol|nav)>"


def breadcrumb_container(expr: str) -> str:
    """For the supplied pages, whose breadcrumbs (if any) are flat lists."""
    return f"nullif(regexp_extract({expr}, {q(BREADCRUMB_HINT)}, 1), '')"


def breadcrumbs_markdown(expr: str) -> str:
    """Markdown breadcrumb line from the page HTML ('' when none)."""
    cont = breadcrumb_container(expr)
    segs = f"string_split_regex({cont}, {q(f'(?i)<li{_OPEN}')})"
    items = f"list_transform(list_slice({segs}, 2, len({segs})), lambda s: regexp_replace(s, {q(f'(?is)</li{_CLOSE}.*')}, ''))"
    link_text = inner_text(f"regexp_extract(s, {q(f'(?is)<a{_OPEN}(.*?)</a')}, 1)")
    href = f"nullif(regexp_extract(s, {q(f'(?is)<a{HTML_WS}[^>]*?href{HTML_WS}*={HTML_WS}*\"([^\"]*)\"')}, 1), '')"
    one = (
        f"CASE WHEN regexp_matches(s, {q('(?i)<a[ >\t\n]')}) THEN {{'text': {link_text}, 'url': {href}}} "
        f"ELSE {{'text': {inner_text('s')}, 'url': NULL::VARCHAR}} END"
    )
    structs = f"list_filter(list_transform({items}, lambda s: {one}), lambda b: b.url IS NOT NULL OR b.text <> '')"
    parts = f"list_transform({structs}, lambda b: CASE WHEN b.url IS NOT NULL THEN '[' || b.text || '](' || b.url || ')' ELSE b.text END)"
    return (
        f"(CASE WHEN coalesce(len({structs}), 0) > 0 THEN '<md_breadcrumb>' || chr(10) || '> ' || "
        f"array_to_string({parts}, ' > ') || chr(10) || '</md_breadcrumb>' || chr(10) || chr(10) ELSE '' END)"
    )


def tag_block(tag: str, expr: str) -> str:
    return f"('<{tag}>' || chr(10) || {expr} || chr(10) || '</{tag}>' || chr(10) || chr(10))"


# ------------------------------------------------------------------ URLs

from pagemill.functions import urls as U  # noqa: E402
from pagemill.operators import links as L  # noqa: E402


def host(expr: str) -> str:
    return f"nullif(lower(regexp_extract({expr}, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^@/?#]*@)?([^:/?#]*)', 1)), '')"


def fold_dot_segments(p: str) -> str:
    seg = "replace(lower(s), '%2e', '.')"
    segs = f"string_split({p}, '/')"
    fold = (
        f"list_reduce(list_slice({segs}, 2, len({segs})), lambda acc, s: CASE WHEN {seg} = '..' THEN regexp_replace(acc, '/[^/]*$', '') "
        f"WHEN {seg} = '.' THEN acc ELSE acc || '/' || s END, '')"
    )
    slash = f"CASE WHEN regexp_matches({p}, '(?i)/(?:\\.|%2e){{1,2}}$') THEN '/' ELSE '' END"
    return f"(CASE WHEN regexp_matches({p}, '(?i)/(?:\\.|%2e){{1,2}}(/|$)') THEN {fold} || {slash} ELSE {p} END)"


def path(expr: str) -> str:
    p = fold_dot_segments(percent_encode(f"regexp_extract({expr}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)", U.PATH_SAFE_CHAR))
    return f"(CASE WHEN {p} = '' THEN '/' ELSE {p} END)"


def sanitize_path(expr: str) -> str:
    return f"translate({expr}, {q(chr(60) + '>:\"|?*' + chr(92))}, '________')"


def percent_encode(expr: str, safe: str = U.URL_SAFE_CHAR) -> str:
    enc = (
        f"array_to_string(list_transform(string_split({expr}, ''), lambda ch: CASE WHEN regexp_matches(ch, {q('^' + safe + '$')}) "
        f"THEN ch ELSE regexp_replace(hex(encode(ch)), '(..)', '%\\1', 'g') END), '')"
    )
    return f"(CASE WHEN regexp_matches({expr}, {q('[^' + safe[1:])}) THEN {enc} ELSE {expr} END)"


def origin(expr: str) -> str:
    head = f"lower(regexp_extract({expr}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1))"
    return _no_default_port(f"regexp_replace({head}, '://[^@]*@', '://')")


def _no_default_port(head: str) -> str:
    return f"regexp_replace(regexp_replace({head}, '^(http://[^/?#]*):80$', '\\1'), '^(https://[^/?#]*):443$', '\\1')"


def _tail(rest: str) -> str:
    """Rooted path encoded and folded, then query and fragment encoded."""
    p = percent_encode(f"regexp_extract({rest}, '^[^?#]*', 0)", U.PATH_SAFE_CHAR)
    behind = f"regexp_extract({rest}, '^[^?#]*(.*)$', 1)"
    return f"({fold_dot_segments(p)} || {percent_encode(behind)})"


def normalize_absolute(expr: str) -> str:
    head = f"lower(regexp_extract({expr}, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1))"
    rest0 = f"regexp_extract({expr}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$', 1)"
    rest = f"(CASE WHEN starts_with({rest0}, '/') THEN {rest0} ELSE '/' || {rest0} END)"
    return f"(CASE WHEN {head} <> '' THEN {_no_default_port(head)} || {_tail(rest)} ELSE {expr} END)"


def resolve_against_origin(h: str, o: str) -> str:
    """`h` resolved against the origin column `o` (both plain column names)."""
    scheme = f"regexp_extract({o}, '^([a-z][a-z0-9+.-]*:)', 1)"
    rooted = f"(CASE WHEN starts_with({h}, '/') THEN {h} ELSE '/' || {h} END)"
    return (
        f"(CASE WHEN starts_with({h}, '//') THEN {normalize_absolute('(' + scheme + ' || ' + h + ')')} "
        f"WHEN regexp_matches({h}, {q(U.SCHEME_RE)}) THEN (CASE WHEN regexp_matches({h}, '(?i)^https?://') THEN {normalize_absolute(h)} ELSE {h} END) "
        f"ELSE {o} || {_tail(rooted)} END)"
    )


def path_key(url: str, base_dir: str = "tmp", filename: str | None = None) -> str:
    p0 = rr(path(url), "\\A/+|/+\\z", "")
    p = f"(CASE WHEN {p0} = '' THEN 'index' ELSE {p0} END)"
    base = f"regexp_extract({p}, '[^/]*$', 0)"
    d = f"regexp_extract({p}, '^(.*)/[^/]*$', 1)"
    ext = f"regexp_extract({base}, '^.+(\\.[^.]*)$', 1)"
    stem = f"left({base}, length({base}) - length({ext}))"
    fname = q(filename) if filename else base
    key = f"concat_ws('/', {q(base_dir)}, {host(url)}, nullif({d}, ''), {stem}, {fname})"
    return f"(CASE WHEN {host(url)} IS NOT NULL THEN regexp_replace({key}, '/+', '/', 'g') END)"


def keep_link(u: str) -> str:
    cond = f"NOT starts_with({u}, 'data:') AND NOT contains({u}, '#') AND (starts_with({u}, 'http://') OR starts_with({u}, 'https://'))"
    for h in L.NAMESPACE_HOSTS:
        cond += f" AND NOT contains({u}, {q(h)})"
    return cond


def links_cte(src: str, k: int | None = None) -> str:
    """SQL producing (page_id, pos, link) for the pages in `src`."""
    lim = f"WHERE pos < {k}" if k else ""
    return f"""WITH p AS (SELECT page_id, html, {origin('url')} AS o FROM {src}),
t AS (SELECT page_id, o,
        list_filter(regexp_extract_all(html, {q(L.A_HREF)}, 1), lambda x: NOT regexp_matches(x, {q(L.SKIP_HREF)})) AS t1,
        list_filter(regexp_extract_all(html, {q(L.ANY_HREF)}, 1), lambda x: NOT regexp_matches(x, {q(L.SKIP_HREF)})) AS t2,
        regexp_extract_all(html, {q(L.BARE_URL)}, 1) AS t3 FROM p),
c AS (SELECT page_id, o, CASE WHEN len(t1) > 0 THEN t1 WHEN len(t2) > 0 THEN t2 ELSE t3 END AS hrefs,
        (len(t1) > 0 OR len(t2) > 0) AS resolve FROM t),
u AS (SELECT page_id, o, resolve, unnest(hrefs) AS h, generate_subscripts(hrefs, 1) AS i FROM c),
r AS (SELECT page_id, i, CASE WHEN resolve THEN {resolve_against_origin('h', 'o')} ELSE h END AS link FROM u),
f AS (SELECT page_id, i, link FROM r WHERE {keep_link('link')}),
n AS (SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::BIGINT AS pos, link FROM f)
SELECT page_id, pos, link FROM n {lim}"""
