"""A whole site run as one composed plan: sitemap → newest usable captures →
converted pages → media resolution and requests → enriched pages → failures,
summary and (optionally) the merged document.

Inputs are tables: sitemap documents, the capture log, the fetched media bytes,
the registry, the per-page cache and the price list (fetching and model calls stay
outside Spark). The URL list and the converted pages are written once below `workdir`
(a shared folder; one below the checkpoint dir by default) and read back, so that
nothing expands the sitemaps or converts a page again; the outputs are lazy
DataFrames over them, and the caller decides what to write.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators import crawl as C
from pagemill.operators import media as MO
from pagemill.operators import merge as G
from pagemill.operators import pages as P
from pagemill.session import shared_folder
from pagemill.sources import sitemaps as S


@dataclass
class SiteRun:
    urls: DataFrame
    pages: DataFrame
    requests: DataFrame
    processed: DataFrame
    failures: DataFrame
    summary: DataFrame
    merged: DataFrame | None


def run_urls(sitemap_docs: DataFrame, root: str) -> DataFrame:
    """(site, url, i, pos): the run's URL list in sitemap order; a URL listed twice stands twice. A URL's place
    is its place in its sitemap plus the URLs of all earlier sitemaps: only one row per
    sitemap document is ordered."""
    roots = sitemap_docs.sparkSession.createDataFrame([(root,)], "root string")
    urls = S.expand(sitemap_docs, roots).select(
        F.col("root").alias("site"), F.col("loc").alias("url"), F.regexp_replace("order_key", "[0-9]+\\z", "").alias("doc"), F.col("pos").alias("at"))
    counts = urls.groupBy("site", "doc").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("site").orderBy("doc").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("site", "doc", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return urls.join(starts, ["site", "doc"]).select("site", "url", (F.col("start") + F.col("at") + 1).alias("i"), (F.col("start") + F.col("at")).alias("pos"))


def site_run(sitemap_docs: DataFrame, root: str, captures: DataFrame, media_bytes: DataFrame, registry: DataFrame, cache: DataFrame,
             run_date: str, merge: bool = True, timeout_ms: int | None = None, workdir: str | None = None) -> SiteRun:
    spark = sitemap_docs.sparkSession
    workdir = workdir or shared_folder(spark)

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{workdir}/{name}")
        return spark.read.parquet(f"{workdir}/{name}")

    urls = written(run_urls(sitemap_docs, root), "urls")
    wanted = captures.join(urls.select("url").distinct(), "url", "left_semi")
    pages_in = C.latest_capture(wanted).select(F.md5("url").alias("page_id"), "url", "html")
    docs = written(P.page_document(pages_in, run_date), "markdown_pages")
    raw = docs.select("page_id", "url", "markdown")
    resolved = MO.resolve_contents(MO.resolve_refs(MO.media_refs(raw), media_bytes), cache, registry)
    enriched = MO.enrich_markdown(raw, media_bytes, cache, registry)
    # every URL of the list, captured or not; a page without content is a failed one
    place = urls.groupBy("site", "url").agg(F.min("pos").alias("pos"))
    status = C.crawl_status(wanted, place).drop("site").join(place, "url")
    status = status.join(docs.select("url", (F.col("status") == "ok").alias("_parsed")), "url", "left")
    unparsed = F.col("ok") & ~F.coalesce("_parsed", F.lit(True))
    status = status.withColumn("error", F.when(unparsed, F.lit("Failed to parse article")).otherwise(F.col("error"))).withColumn("ok", F.col("ok") & ~unparsed)
    failures = C.failure_report(status, timeout_ms, ["pos"], [F.floor(F.col("pos") / 1_000_000), F.floor(F.col("pos") / 1000)])
    merged = None
    if merge:
        good = enriched.join(docs.filter(F.col("status") == "ok").select("page_id"), "page_id", "left_semi")
        content = G.prefer_processed(urls.join(good, "url"))
        merged = G.merged_document(content, F.col("site"), f"{run_date}T00:00:00.000Z")
    return SiteRun(urls, docs, MO.enrichment_requests(resolved, media_bytes), enriched.select("page_id", "url", "processed"), failures, C.site_summary(status), merged)
