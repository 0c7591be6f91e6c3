"""Re-run support: what changed since the last run (by sitemap `lastmod`)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_since(sitemap_urls: DataFrame, previous: DataFrame) -> DataFrame:
    """URLs to (re)process: not converted before, or `lastmod` newer than the
    stored last-modified date. previous(url, last_modified)."""
    prev = previous.select(F.col("url").alias("prev_url"), "last_modified")
    j = sitemap_urls.join(prev, sitemap_urls["loc"] == prev["prev_url"], "left")
    newer = F.try_to_date("lastmod") > F.try_to_date("last_modified")
    return j.filter(F.col("prev_url").isNull() | newer).select(
        "loc", "lastmod", "last_modified",
        F.when(F.col("prev_url").isNull(), F.lit("new")).otherwise(F.lit("changed")).alias("reason"),
    )
