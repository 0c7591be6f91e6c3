"""Sitemap sources: urlset / index documents parsed with `from_xml`, and the
recursive expansion of index documents.

`sitemap_docs(loc, xml)` holds fetched documents (fetching stays outside).
Parsing is per row (narrow); the expansion goes over *documents only*
(edges index → child), a level at a time, then joins the URL entries once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import ensure_checkpoint_dir

URLSET_SCHEMA = "url array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>"
INDEX_SCHEMA = "sitemap array<struct<loc:string,lastmod:string>>"
ORDER_DIGITS = 10


def read_sitemap_files(spark, path: str) -> DataFrame:
    """Sitemap XML files on storage → sitemap_docs(loc, xml)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("loc"), F.col("value").alias("xml")
    )


def urlset_entries(docs: DataFrame) -> DataFrame:
    """(sitemap, pos, loc, lastmod, changefreq, priority) in document order;
    a one-entry urlset gives one row; non-XML gives none."""
    u = F.from_xml(F.col("xml"), URLSET_SCHEMA)["url"]
    return docs.where(F.col("xml").contains("<urlset")).select(F.col("loc").alias("sitemap"), F.posexplode(u).alias("pos", "e")).select(
        "sitemap", F.col("pos").cast("bigint").alias("pos"), "e.loc", "e.lastmod", "e.changefreq", "e.priority"
    )


def index_edges(docs: DataFrame) -> DataFrame:
    """(parent, pos, child): entries of sitemap index documents."""
    s = F.from_xml(F.col("xml"), INDEX_SCHEMA)["sitemap"]
    return docs.where(F.col("xml").contains("<sitemapindex")).select(F.col("loc").alias("parent"), F.posexplode(s).alias("pos", "e")).select(
        "parent", F.col("pos").cast("bigint").alias("pos"), F.col("e.loc").alias("child")
    )


def expand(docs: DataFrame, roots: DataFrame, max_depth: int = 64) -> DataFrame:
    """Every URL reachable from each root (`roots(root)`), child lists
    concatenated in index order without dedup. `order_key` orders the result
    the way the reference's depth-first concatenation does. Cycles are cut
    (a document already on the path is not entered again). Nesting beyond
    `max_depth` index levels raises: a partial list is never returned.

    One join a level over the index documents' edges alone (a URL set is never parsed for it); each level's
    documents are written to the shared checkpoint folder and are the next level's frontier."""
    ensure_checkpoint_dir(docs.sparkSession)
    edges = index_edges(docs).checkpoint()
    step = F.concat("order_key", F.lpad(F.col("pos").cast("string"), ORDER_DIGITS, "0"), F.lit("."))
    reach = frontier = roots.select("root", F.col("root").alias("doc"), F.lit(0).alias("depth"), F.lit("").alias("order_key"), F.array("root").alias("path"))
    for depth in range(1, max_depth + 2):
        found = frontier.join(edges, frontier["doc"] == edges["parent"]).where(~F.array_contains("path", F.col("child")))
        frontier = found.select("root", F.col("child").alias("doc"), F.lit(depth).alias("depth"), step.alias("order_key"), F.array_append("path", F.col("child")).alias("path")).checkpoint()
        if frontier.isEmpty():
            break
        if depth > max_depth:
            raise ValueError(f"sitemap indexes are nested deeper than {max_depth} levels")
        reach = reach.unionAll(frontier)
    entries = urlset_entries(docs)
    return reach.join(entries, reach["doc"] == entries["sitemap"]).select(
        "root",
        F.col("depth").cast("int").alias("depth"),
        "sitemap",
        "pos",
        "loc",
        "lastmod",
        F.concat("order_key", F.lpad(F.col("pos").cast("string"), ORDER_DIGITS, "0")).alias("order_key"),
    )
