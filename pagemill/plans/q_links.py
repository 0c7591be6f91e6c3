"""Links and URL group."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import urls as U
from pagemill.operators import links as L
from pagemill.plans import duck as D
from pagemill.plans.catalog import register


@register("page_links", D.links_cte("pages"), "HTM1 FLT2 FLT3 URL6")
def page_links(t):
    return L.page_links(t.pages)


@register("page_links_top5", D.links_cte("pages", 5), "LIM1")
def page_links_top5(t):
    return L.page_links_top(t.pages, 5)


@register(
    "url_parts",
    f"SELECT page_id, url, {D.host('url')} AS host, {D.path('url')} AS path, "
    f"{D.sanitize_path(D.path('url'))} AS safe_path FROM pages",
    "URL2 URL3 URL4",
)
def url_parts(t):
    return t.pages.select(
        "page_id", "url", U.host("url").alias("host"), U.path("url").alias("path"),
        U.sanitize_path(U.path("url")).alias("safe_path"),
    )


def _paths_sql() -> str:
    pk = D.path_key("url")
    return f"""WITH k AS (SELECT page_id, url, {pk} AS path_key FROM pages),
m AS (SELECT *, regexp_replace(path_key, '/[^/]+$', '') AS dir_key,
             regexp_replace(path_key, '\\.html$', '.md') AS md_tmp_path FROM k)
SELECT page_id, url, path_key, dir_key, md_tmp_path,
       concat_ws('/', 'output', 'pages', regexp_extract(md_tmp_path, '([^/]+)/[^/]+$', 1),
                 regexp_extract(md_tmp_path, '[^/]+$', 0)) AS md_out_path
FROM m"""


@register("url_path_key", _paths_sql(), "URL1 URL5 URL12 URL13")
def url_path_key(t):
    tmp_md, out_md = U.markdown_paths(F.col("url"))
    return t.pages.select(
        "page_id", "url", U.path_key("url").alias("path_key"), U.dir_key("url").alias("dir_key"),
        tmp_md.alias("md_tmp_path"), out_md.alias("md_out_path"),
    )
