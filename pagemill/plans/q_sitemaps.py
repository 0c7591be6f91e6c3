"""Sitemap group (F4 documents rendered from pages)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.operators import incremental as I
from pagemill.operators import links as L
from pagemill.plans import duck as D
from pagemill.plans.catalog import register
from pagemill.plans.q_pages import _F3
from pagemill.sources import sitemaps as S
from pagemill.sources.derived import (
    INDEX_HOST,
    RUN_DATE,
    SITEMAP_CHUNK,
    date_pages,
    discovery_pages,
    robots_docs,
    sitemap_docs,
)

Q = D.q
F4 = f"""f4 AS (
  SELECT host, page_id, url,
         'https://' || host || '/sitemap' || CASE WHEN floor(page_id / {SITEMAP_CHUNK}) > 0
              THEN '-' || floor(page_id / {SITEMAP_CHUNK})::BIGINT::VARCHAR ELSE '' END || '.xml' AS sitemap,
         strftime(DATE '2024-01-01' + (page_id % 90)::INT, '%Y-%m-%d') AS lastmod
  FROM (SELECT *, {D.host('url')} AS host FROM pages)),
u AS (SELECT f4.*, (row_number() OVER (PARTITION BY sitemap ORDER BY page_id) - 1)::BIGINT AS pos FROM f4)"""


@register(
    "sitemap_urls",
    f"WITH {F4} SELECT sitemap, pos, url AS loc, lastmod, NULL::VARCHAR AS changefreq, NULL::VARCHAR AS priority FROM u",
    "SRC4 PRJ1 D2 D3 X14",
)
def sitemap_urls(t):
    return S.urlset_entries(sitemap_docs(t))


@register(
    "sitemap_expand",
    f"""WITH {F4},
sm AS (SELECT sitemap, min(page_id) AS first_page FROM f4 GROUP BY sitemap),
smr AS (SELECT *, (row_number() OVER (PARTITION BY floor(first_page / {SITEMAP_CHUNK}) ORDER BY first_page, sitemap) - 1) AS spos,
               (dense_rank() OVER (ORDER BY floor(first_page / {SITEMAP_CHUNK})) - 1) AS bpos FROM sm)
SELECT '{INDEX_HOST}/sitemap.xml' AS root, 2::INT AS depth, u.sitemap, u.pos, u.url AS loc, u.lastmod,
       lpad(bpos::VARCHAR, 10, '0') || '.' || lpad(spos::VARCHAR, 10, '0') || '.' || lpad(pos::VARCHAR, 10, '0') AS order_key
FROM u JOIN smr USING (sitemap)""",
    "SRC5 JN6 SET1",
)
def sitemap_expand(t):
    docs = sitemap_docs(t)
    roots = t.spark.createDataFrame([(f"{INDEX_HOST}/sitemap.xml",)], "root string")
    return S.expand(docs, roots)


@register(
    "changed_since",
    f"""WITH {F4}, {_F3},
prev AS (SELECT url AS prev_url, {D.last_modified('html', RUN_DATE)} AS last_modified FROM f3)
SELECT url AS loc, lastmod, last_modified, CASE WHEN prev_url IS NULL THEN 'new' ELSE 'changed' END AS reason
FROM u LEFT JOIN prev ON u.url = prev.prev_url
WHERE prev_url IS NULL OR try_cast(lastmod AS DATE) > try_cast(last_modified AS DATE)""",
    "INC2",
)
def changed_since(t):
    prev = date_pages(t).select("url", H.last_modified("html", RUN_DATE).alias("last_modified"))
    return I.changed_since(S.urlset_entries(sitemap_docs(t)), prev)


@register(
    "robots_sitemaps",
    f"""WITH {F4}
SELECT host, (row_number() OVER (PARTITION BY host ORDER BY sitemap) - 1)::BIGINT AS pos, sitemap AS sitemap_url
FROM (SELECT DISTINCT host, sitemap FROM f4)""",
    "SRC7",
)
def robots_sitemaps(t):
    return L.robots_sitemaps(robots_docs(t))


@register(
    "sitemap_discovery",
    f"""WITH d AS (
  SELECT page_id, url, CASE WHEN page_id % 4 = 0 THEN replace(html, '<head>',
           '<head><link rel="sitemap" type="application/xml" href="https://' || {D.host('url')} || '/sitemap.xml">')
         WHEN page_id % 4 = 1 THEN replace(html, '<footer>', '<footer><a href="/robots.txt">robots</a> ')
         ELSE html END AS html FROM pages)
SELECT page_id, url, nullif(regexp_extract(html, {Q(L.SITEMAP_LINK)}, 1), '') AS sitemap_link,
       nullif(regexp_extract(html, {Q(L.ROBOTS_LINK)}, 1), '') AS robots_link FROM d""",
    "SRC6 X16",
)
def sitemap_discovery(t):
    return L.sitemap_discovery(discovery_pages(t))


@register(
    "source_kind",
    f"""WITH {F4},
src AS (SELECT url AS source, html AS body FROM pages
        UNION ALL SELECT DISTINCT sitemap, '<?xml version="1.0" encoding="UTF-8"?><urlset' FROM f4
        UNION ALL SELECT DISTINCT '{INDEX_HOST}/sitemap-index-' || floor(first_page / {SITEMAP_CHUNK})::BIGINT::VARCHAR || '.xml',
                         '<?xml version="1.0" encoding="UTF-8"?><sitemapindex' FROM (SELECT min(page_id) AS first_page FROM f4 GROUP BY sitemap)
        UNION ALL SELECT '{INDEX_HOST}/sitemap.xml', '<?xml version="1.0" encoding="UTF-8"?><sitemapindex')
SELECT source,
       CASE WHEN NOT regexp_matches(lower(source), '^[a-z][a-z0-9+.-]*://') AND (ends_with(lower(source), '.html') OR ends_with(lower(source), '.htm')) THEN 'html'
            WHEN NOT regexp_matches(lower(source), '^[a-z][a-z0-9+.-]*://') AND ends_with(lower(source), '.xml') THEN 'sitemap'
            WHEN NOT regexp_matches(lower(source), '^[a-z][a-z0-9+.-]*://') THEN 'file'
            WHEN contains(lower(source), 'sitemap') OR ends_with(lower(source), '.xml') THEN 'sitemap' ELSE 'page' END AS source_kind,
       CASE WHEN regexp_matches(lower(regexp_replace(body, {Q(chr(92) + 'A' + D.WS + '+')}, '')), '^(?:<!doctype html|<html)') THEN 'html' ELSE 'xml' END AS body_kind
FROM src""",
    "SRC8 SRC9",
)
def source_kind(t):
    docs = sitemap_docs(t).select(F.col("loc").alias("source"), F.col("xml").alias("body"))
    src = t.pages.select(F.col("url").alias("source"), F.col("html").alias("body")).unionByName(docs)
    return src.select("source", L.source_kind("source").alias("source_kind"), L.body_kind("body").alias("body_kind"))
