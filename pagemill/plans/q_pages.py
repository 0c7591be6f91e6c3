"""Page group: title, date, Markdown, document, statistics."""

from __future__ import annotations


from pagemill.functions import html as H
from pagemill.operators import pages as P
from pagemill.plans import duck as D
from pagemill.plans.catalog import register
from pagemill.sources.derived import RUN_DATE, date_pages

_F3 = f"""f3 AS (
  SELECT page_id, url, replace(html, '<body>', '<body>' ||
    CASE WHEN page_id % 15 = 0 THEN '<div data-timemodified=""></div><p data-publicationdate="2024-02-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || '">x</p>'
         WHEN page_id % 3 = 0 THEN '<div data-timemodified="2024-01-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || '">'
         WHEN page_id % 3 = 1 THEN '<div data-publicationdate="2024-03-' || lpad((page_id % 28 + 1)::VARCHAR, 2, '0') || '">'
         ELSE '' END) AS html
  FROM pages)"""


@register("page_title", f"SELECT page_id, {D.page_title('html')} AS title FROM pages", "HTM3")
def page_title(t):
    return t.pages.select("page_id", H.page_title("html").alias("title"))


@register(
    "last_modified",
    f"WITH {_F3} SELECT page_id, {D.last_modified('html', RUN_DATE)} AS last_modified FROM f3",
    "HTM2 WIN2",
)
def last_modified(t):
    return date_pages(t).select("page_id", H.last_modified("html", RUN_DATE).alias("last_modified"))


# ------------------------------------------------------------ token table

from pagemill.functions.html import MARKDOWN_RULES  # noqa: E402
from pagemill.functions.text import HTML_WS  # noqa: E402
from pagemill.operators import tokens as T  # noqa: E402


def _clean_sql(expr: str) -> str:
    for _n, p, r in MARKDOWN_RULES[:4]:
        expr = D.apply_rule(expr, p, r)
    return expr


TOKEN = "<[^>]+>|[^<]+"  # enough for the supplied pages

_NC = ", ".join(D.q(x) for x in T.NON_COUNTING)
_TOKS = f"""c AS (SELECT page_id, {_clean_sql('html')} AS h FROM {{tok_src}}),
t0 AS (SELECT page_id, unnest(regexp_extract_all(h, {D.q(TOKEN)})) AS tok,
              (generate_subscripts(regexp_extract_all(h, {D.q(TOKEN)}), 1) - 1)::BIGINT AS pos FROM c),
t1 AS (SELECT *, CASE WHEN starts_with(tok, '</') THEN 'close' WHEN starts_with(tok, '<!') OR starts_with(tok, '<?') THEN 'decl'
                      WHEN starts_with(tok, '<') THEN 'open' ELSE 'text' END AS kind,
              lower(regexp_extract(tok, '^</?([a-zA-Z][a-zA-Z0-9-]*)', 1)) AS tag0 FROM t0),
t2 AS (SELECT *, CASE WHEN kind = 'open' AND tag0 NOT IN ({_NC}) AND NOT regexp_matches(tok, '/>$') THEN 1
                      WHEN kind = 'close' AND tag0 NOT IN ({_NC}) THEN -1 ELSE 0 END AS delta,
              CASE WHEN kind = 'open' AND tag0 = 'a' THEN 1 WHEN kind = 'close' AND tag0 = 'a' THEN -1 ELSE 0 END AS ld FROM t1),
tok AS (SELECT page_id, pos, kind, CASE WHEN kind = 'text' THEN NULL ELSE tag0 END AS tag,
               (sum(delta) OVER w)::BIGINT AS depth, sum(ld) OVER w > 0 AS in_link,
               CASE WHEN kind = 'text' THEN {D.js_trim(D.decode_entities(D.rr('tok', HTML_WS + '+', ' ')))} END AS text,
               delta = 1 AS is_container, tok AS raw
        FROM t2 WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""

_SCORES = f"""{_TOKS},
cont AS (SELECT page_id, pos AS cid, tag, depth AS level FROM tok WHERE is_container),
look AS (SELECT page_id, pos, kind, in_link, text, CASE WHEN is_container THEN depth - 1 ELSE depth END AS lvl
         FROM tok WHERE is_container OR kind = 'text'),
par AS (SELECT look.*, cont.cid AS parent FROM look ASOF LEFT JOIN cont
        ON look.page_id = cont.page_id AND look.lvl = cont.level AND look.pos > cont.cid),
gp AS (SELECT page_id, pos AS parent, parent AS gparent FROM par WHERE kind <> 'text'),
txt AS (SELECT * FROM par WHERE kind = 'text' AND parent IS NOT NULL),
chars AS (SELECT page_id, parent AS cid, sum(length(text))::BIGINT AS text_chars,
                 sum(CASE WHEN in_link THEN length(text) ELSE 0 END)::BIGINT AS link_chars FROM txt GROUP BY page_id, parent),
blocks AS (SELECT txt.page_id, txt.parent, gp.gparent,
                  (1 + (length(text) - length(replace(text, ',', ''))) + least(floor(length(text) / 100), 3))::DOUBLE AS s
           FROM txt LEFT JOIN gp ON txt.page_id = gp.page_id AND txt.parent = gp.parent
           WHERE NOT in_link AND length(text) >= {T.MIN_BLOCK_CHARS}),
credits AS (SELECT page_id, cid, sum(c) AS raw_score FROM (
              SELECT page_id, parent AS cid, s AS c FROM blocks
              UNION ALL SELECT page_id, gparent, s / 2 FROM blocks WHERE gparent IS NOT NULL) GROUP BY page_id, cid),
sc0 AS (SELECT cont.*, coalesce(text_chars, 0) AS text_chars, coalesce(link_chars, 0) AS link_chars,
               coalesce(raw_score, 0.0) AS raw_score
        FROM cont LEFT JOIN chars USING (page_id, cid) LEFT JOIN credits USING (page_id, cid)),
sc AS (SELECT page_id, cid AS container_pos, tag, level, text_chars::BIGINT AS text_chars, link_chars::BIGINT AS link_chars,
              round(CASE WHEN text_chars > 0 THEN link_chars / text_chars ELSE 0.0 END, 6) AS link_density,
              round(raw_score * (1.0 - CASE WHEN text_chars > 0 THEN link_chars / text_chars ELSE 0.0 END), 6) AS score
       FROM sc0)"""


@register("html_tokens", f"WITH {_TOKS.replace('{tok_src}', 'pages')} SELECT page_id, pos, kind, tag, depth, in_link, text, is_container FROM tok", "HTM10")
def html_tokens(t):
    return T.html_tokens(t.pages)


@register("link_density", f"WITH {_SCORES.replace('{tok_src}', 'pages')} SELECT * FROM sc", "HTM4")
def link_density(t):
    return T.container_scores(T.html_tokens(t.pages))


@register(
    "main_content",
    f"""WITH {_SCORES.replace('{tok_src}', 'pages')},
short AS (SELECT page_id, count(*) AS n_short, min(container_pos) AS short_pos FROM sc
          WHERE tag IN ({', '.join(D.q(x) for x in T.SHORTCUT_TAGS)}) GROUP BY page_id),
best AS (SELECT page_id, arg_max(container_pos, (score, -container_pos)) AS best_pos FROM sc GROUP BY page_id),
ch AS (SELECT sc.page_id, sc.container_pos, sc.tag, sc.level, sc.score, sc.link_density
       FROM best LEFT JOIN short USING (page_id)
       JOIN sc ON sc.page_id = best.page_id AND sc.container_pos = CASE WHEN n_short = 1 THEN short_pos ELSE best_pos END),
en AS (SELECT tok.page_id, min(tok.pos) AS end_pos FROM tok JOIN ch USING (page_id)
       WHERE tok.pos > ch.container_pos AND tok.depth < ch.level GROUP BY tok.page_id),
ins AS (SELECT tok.page_id, string_agg(tok.text, ' ' ORDER BY tok.pos) AS text
        FROM tok JOIN ch USING (page_id) LEFT JOIN en USING (page_id)
        WHERE tok.pos > ch.container_pos AND (en.end_pos IS NULL OR tok.pos < en.end_pos) AND tok.kind = 'text' AND tok.text <> ''
        GROUP BY tok.page_id)
SELECT ch.page_id, container_pos, tag, score, link_density, coalesce(ins.text, '') AS text
FROM ch LEFT JOIN ins USING (page_id)""",
    "HTM4",
)
def main_content(t):
    return T.main_content(T.html_tokens(t.pages))


# ------------------------------------------------------- page documents

def _doc_sql() -> str:
    """The supplied pages hold one article: a heading, then paragraphs, from the first `<b>` on (it is never closed) in
    bold. The oracle reads them so; it shares no pattern with the converter but the Markdown escapes."""
    esc = "t"
    for pattern, r in H.TEXT_ESCAPES:
        esc = D.rr(esc, pattern, r)
    clean = lambda e: f"trim(regexp_replace(replace(replace(replace(replace({e}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), '[ \\t\\n\\r\\f]+', ' ', 'g'))"
    fix = lambda e: clean(f"regexp_replace(regexp_replace({e}, '<[^<>]*>', '', 'g'), '&amp([^;]|$)', '&amp;\\1', 'g')")
    return f"""WITH s AS (SELECT page_id, url, html, regexp_extract(html, '(?s)<article>(.*)', 1) AS rest FROM pages),
art AS (SELECT page_id, url, html, regexp_replace(rest, '(?s)</article>.*', '') AS art FROM s),
seg AS (SELECT page_id, unnest(string_split(regexp_replace(art, '(?s)^.*?</h1>', ''), '<p>')) AS raw,
               generate_subscripts(string_split(regexp_replace(art, '(?s)^.*?</h1>', ''), '<p>'), 1) AS i FROM art),
par AS (SELECT page_id, i, {fix('raw')} AS t, min(CASE WHEN contains(raw, '<b>') THEN i END) OVER (PARTITION BY page_id) AS bold FROM seg),
md AS (SELECT page_id, i, CASE WHEN i >= bold THEN '**' || {esc} || '**' ELSE {esc} END AS md FROM par WHERE t <> ''),
h AS (SELECT page_id, {fix("regexp_extract(art, '(?s)<h1>(.*?)</h1>', 1)")} AS t FROM art),
b AS (SELECT page_id, '# ' || {esc} || chr(10) || chr(10) || (SELECT string_agg(md, chr(10) || chr(10) ORDER BY i) FROM md WHERE md.page_id = h.page_id) AS body_md FROM h),
d AS (SELECT page_id, url, {fix("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS title, {D.last_modified('html', RUN_DATE)} AS last_modified, '' AS breadcrumb_md, body_md
      FROM art JOIN b USING (page_id))
SELECT page_id, url, title, last_modified, breadcrumb_md, body_md,
       CASE WHEN body_md = '' THEN 'no_content' ELSE 'ok' END AS status,
       {D.tag_block('md_html-source', 'url')} || {D.tag_block('md_html-title', 'title')} ||
       {D.tag_block('md_last-modified', 'last_modified')} || breadcrumb_md || body_md AS markdown
FROM d"""


_DOC_SQL = _doc_sql()


@register("page_document", _DOC_SQL, "HTM11 HTM3 HTM2 HTM4 HTM6 HTM7")
def page_document(t):
    return P.page_document(t.pages, RUN_DATE)


@register("page_markdown", f"SELECT page_id, url, body_md FROM ({_DOC_SQL})", "HTM7 HTM4")
def page_markdown(t):
    return P.page_markdown(t.pages)


@register(
    "page_stats",
    f"""WITH doc AS ({_DOC_SQL})
SELECT page_id, url, title, {D.word_count('markdown')} AS word_count, length(markdown)::BIGINT AS char_count,
       {D.line_count('markdown')} AS line_count, ceil(length(markdown) / 4)::BIGINT AS token_count,
       '{RUN_DATE}' AS generated_at
FROM doc""",
    "HTM12 X2",
)
def page_stats(t):
    return P.page_stats(P.page_document(t.pages, RUN_DATE), RUN_DATE)
