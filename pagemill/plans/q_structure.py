"""Structure group: HTML tables (F1) and breadcrumbs (F2). Oracles build the
expected Markdown from the relational rows — no HTML parsing on that side."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.operators import pages as P
from pagemill.plans.catalog import register
from pagemill.sources.derived import RUN_DATE, breadcrumb_pages, order_pages, order_table_pages

NL = "chr(10)"


_ORDERED = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity"


@register(
    "html_tables",
    f"""WITH r AS (
  SELECT l_orderkey, string_agg('| ' || l_partkey::VARCHAR || ' | Key ' || l_suppkey::VARCHAR ||
           CASE WHEN l_suppkey % 2 = 0 THEN ' (Example: a\\|b)' ELSE '' END || ' |', {NL} {_ORDERED}) AS body
  FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS order_key,
       {NL} || {NL} || '| Part | Note |' || {NL} || '| --- | --- |' || {NL} || body || {NL} || {NL} AS table_md,
       'Lines of the order, priority ' || o_orderpriority || {NL} || {NL} || '| Part | Note |' || {NL} || '| --- | --- |' || {NL} || body AS page_md
FROM r JOIN orders ON l_orderkey = o_orderkey""",
    "HTM8 HTM9 UDF1",
)
def html_tables(t):
    p = order_table_pages(t)
    table = H.html_table_markdown(F.regexp_extract("html", "(?is)(<table.*</table>)", 1))
    pages = P.page_document(p.select(F.col("order_key").alias("page_id"), F.lit("https://shop.example/").alias("url"), "html"), RUN_DATE)
    return p.select("order_key", table.alias("table_md")).join(pages.select(F.col("page_id").alias("order_key"), F.col("body_md").alias("page_md")), "order_key")


@register(
    "structured_pages",
    f"""WITH r AS (
  SELECT l_orderkey, string_agg('*   Part ' || l_partkey::VARCHAR || {NL} || {NL} || '    Quantity ' || l_quantity::BIGINT::VARCHAR || {NL} || {NL} ||
           '    *   Supplier ' || l_suppkey::VARCHAR, {NL} || {NL} {_ORDERED}) AS items
  FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey AS page_id, 'Order ' || o_orderkey::VARCHAR || ' & co' AS title,
       '## Order ' || o_orderkey::VARCHAR || ': 1 < 2 © 3' || {NL} || {NL} ||
       'Priority ' || o_orderpriority || ', status ' || o_orderstatus || ', and a text that is long enough to count as content.' || {NL} || {NL} ||
       items || {NL} || {NL} || '> outer' || {NL} || '> ' || {NL} || '> > inner ' || o_orderkey::VARCHAR || {NL} || '> ' || {NL} || '> tail' || {NL} || {NL} ||
       '```js' || {NL} || 'a  ' || o_orderkey::VARCHAR || {NL} || '  b' || {NL} || '```' || {NL} || {NL} ||
       'See [**order**](/o/' || o_orderkey::VARCHAR || ' "ti") and ![pic](/i/' || o_orderkey::VARCHAR || '.png)' AS body_md
FROM r JOIN orders ON l_orderkey = o_orderkey""",
    "HTM4 HTM7 HTM10 HTM11",
)
def structured_pages(t):
    return P.page_document(order_pages(t), RUN_DATE).select("page_id", "title", "body_md")


@register(
    "breadcrumbs",
    f"""SELECT s_suppkey AS page_id,
       CASE WHEN s_suppkey % 11 = 0 THEN 0 ELSE 3 END::BIGINT AS n_items,
       CASE WHEN s_suppkey % 11 = 0 THEN ''
            ELSE '<md_breadcrumb>' || {NL} || '> [' || r_name || '](/region/' || r_regionkey::VARCHAR || ') > [' || n_name ||
                 '](/nation/' || n_nationkey::VARCHAR || ') > ' || s_name || {NL} || '</md_breadcrumb>' || {NL} || {NL} END AS breadcrumb_md
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "HTM5 HTM6 WIN2 D4",
)
def breadcrumbs(t):
    items = H.breadcrumb_items(F.col("html"))
    return breadcrumb_pages(t).select(
        "page_id", F.coalesce(F.size(items), F.lit(0)).cast("bigint").alias("n_items"),
        H.breadcrumbs_markdown(items).alias("breadcrumb_md"),
    )
