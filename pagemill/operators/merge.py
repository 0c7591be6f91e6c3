"""Site merge: pages of a site, in sitemap order, into one Markdown document.

A merged document is emitted as ordered *parts* of at most `part_pages`
pages (`part = pos div part_pages`), so no single row, task or group ever
holds a whole site: a site with a third of all pages is just many parts.
Writing the parts of a site in `part` order, joined by the page separator,
gives the reference's single file. Page numbers in the table of contents are
global: a part's first number comes from a prefix sum over per-part counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.media import IMAGE_TAG
from pagemill.functions.urls import markdown_paths

PART_PAGES = 100
SEPARATOR = "\n\n---\n\n"
SOURCE_LINE = "\\A\\[source: [^\\n\\r\\x{2028}\\x{2029}]+\\]\\n\\n"


def strip_source_line(md) -> Column:
    """Remove a leading `[source: …]` line and the blank line after it."""
    c = F.col(md) if isinstance(md, str) else md
    return F.regexp_replace(c, SOURCE_LINE, "")


def prefer_processed(raw: DataFrame, processed: DataFrame | None = None) -> DataFrame:
    """raw(page_id, site, pos, url, markdown[, processed]): the processed page (without its source
    line) where there is one, else the raw page. `processed(page_id, processed)` as a table of its
    own is joined; a column beside the raw text (as `enrich_markdown` leaves it) needs no join."""
    df = raw if processed is None else raw.join(processed.select("page_id", "processed"), "page_id", "left")
    return df.select(
        "page_id", "site", "pos", "url",
        F.coalesce(strip_source_line("processed"), F.col("markdown")).alias("content"),
        F.col("processed").isNotNull().alias("used_processed"),
    )


def section_name(url) -> Column:
    """`path.basename(markdownPath, '.md')` of the page's Markdown path."""
    tmp_md, _ = markdown_paths(url)
    return F.regexp_replace(tmp_md, "\\A.*/([^/]+?)(?:\\.md)?\\z", "$1")


def with_parts(df: DataFrame, part_pages: int = PART_PAGES) -> DataFrame:
    """Adds `part` = pos div part_pages and the global 1-based page number `i` within the site. `pos` is
    the page's place in the site (0-based; gaps are fine). Offsets come from (site, part) counts
    alone, so page texts are not read for them."""
    part = F.floor(F.col("pos") / part_pages).cast("bigint")
    d = df.withColumn("part", part)
    counts = df.select("site", part.alias("part")).groupBy("site", "part").agg(F.count(F.lit(1)).alias("cnt"))
    offsets = counts.withColumn(
        "offset",
        F.coalesce(F.sum("cnt").over(Window.partitionBy("site").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select("site", "part", "offset")
    w = Window.partitionBy("site", "part").orderBy("pos")
    return d.join(offsets, ["site", "part"]).withColumn("i", (F.col("offset") + F.row_number().over(w)).cast("bigint"))


def merge_header(site_source: Column, generated_on: str) -> Column:
    # The merged document's heading lines.
    return F.concat(
        F.lit("# Merged Documentation from Sitemap\n\nSource: "), site_source,
        F.lit(f"\n\nGenerated on: {generated_on}\n\n## Included Pages\n\n"),
    )


#: Between the page list and the first section.
RULE = "\n---\n\n"


def merge_toc(pages: DataFrame, sitemap_url: Column, generated_on: str, part_pages: int = PART_PAGES) -> DataFrame:
    """Per (site, part): the numbered list `i. url` lines, and the header."""
    d = with_parts(pages, part_pages)
    return d.groupBy("site", "part").agg(
        F.min("i").alias("first_i"),
        F.count(F.lit(1)).cast("bigint").alias("n_pages"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "i", "url"))),
                        lambda s: F.concat(s["i"].cast("string"), F.lit(". "), s["url"], F.lit("\n"))),
            "",
        ).alias("toc"),
    ).withColumn("header", merge_header(sitemap_url, generated_on))


def merge_site(content: DataFrame, part_pages: int = PART_PAGES) -> DataFrame:
    """Per (site, part): `## <name>\\n\\n<content>` sections in order, joined by
    the separator (the separator also goes between consecutive parts)."""
    d = with_parts(content, part_pages).withColumn(
        "section", F.concat(F.lit("## "), section_name(F.col("url")), F.lit("\n\n"), F.col("content"))
    )
    return d.groupBy("site", "part").agg(
        F.min("i").alias("first_i"),
        F.count(F.lit(1)).cast("bigint").alias("n_pages"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("pos", "section"))), lambda s: s["section"]), SEPARATOR
        ).alias("body"),
    )


def merged_document(content: DataFrame, sitemap_url: Column, generated_on: str, part_pages: int = PART_PAGES) -> DataFrame:
    """(site, block, part, text): the whole merged document of each site as pieces; concatenated in (block,
    part) order they are the file: 0 heading, 1 page list, 2 rule, 3 sections with the separator
    between them. No piece holds more than `part_pages` pages."""
    d = with_parts(content, part_pages)
    toc = F.concat(F.col("i").cast("string"), F.lit(". "), F.col("url"), F.lit("\n"))
    # the separator goes before every section but the site's first
    section = F.concat(F.when(F.col("i") > 1, F.lit(SEPARATOR)).otherwise(F.lit("")), F.lit("## "), section_name(F.col("url")), F.lit("\n\n"), F.col("content"))
    parts = d.withColumns({"_toc": toc, "_section": section}).groupBy("site", "part").agg(
        F.array_sort(F.collect_list(F.struct("pos", "_toc", "_section"))).alias("p"),  # at most part_pages pages
        (F.min("i") == 1).alias("_first"))
    pieces = parts.withColumn("x", F.explode(F.filter(F.array(
        F.when(F.col("_first"), F.struct(F.lit(0).alias("block"), merge_header(sitemap_url, generated_on).alias("text"))),
        F.struct(F.lit(1).alias("block"), F.array_join(F.transform("p", lambda s: s["_toc"]), "").alias("text")),
        F.when(F.col("_first"), F.struct(F.lit(2).alias("block"), F.lit(RULE).alias("text"))),
        F.struct(F.lit(3).alias("block"), F.array_join(F.transform("p", lambda s: s["_section"]), "").alias("text")),
    ), lambda s: s.isNotNull())))
    return pieces.select("site", "x.block", "part", "x.text")


def tag_counts(processed: DataFrame, text_col: str = "processed") -> DataFrame:
    """Description tags per page (counting tags that carry attributes) and in total."""
    t = F.col(text_col)
    per = processed.select(
        "page_id",
        t.contains(f"<{IMAGE_TAG}").alias("has_description"),
        F.size(F.regexp_extract_all(t, F.lit(f"<{IMAGE_TAG}[ >]"), 0)).cast("bigint").alias("n_descriptions"),
    )
    return per.rollup("page_id").agg(
        F.max(F.col("has_description").cast("int")).cast("boolean").alias("has_description"),
        F.sum("n_descriptions").cast("bigint").alias("n_descriptions"),
    )
