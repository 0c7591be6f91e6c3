"""Sinks: partitioned parquet / JSON / text outputs and the versioned registry.

Every writer is a DataFrame write (distributed, one task per partition); no
output passes through the driver.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.urls import host
from pagemill.operators.ordering import running_total


#: Files that one domain may be split into.
DOMAIN_FILES = 16


def by_domain(df: DataFrame, files: int = DOMAIN_FILES) -> DataFrame:
    """Rows dealt by (domain, one of `files` hash buckets of the URL): a domain's rows end up in at most
    that many files, however many tasks wrote them, and a hot domain is still split."""
    return df.withColumn("domain", host("url")).repartition("domain", F.pmod(F.xxhash64("url"), F.lit(files)))


def write_markdown_pages(docs: DataFrame, path: str, mode: str = "overwrite", files: int = DOMAIN_FILES) -> None:
    """markdown_pages partitioned by domain (the documented output layout)."""
    by_domain(docs, files).write.mode(mode).partitionBy("domain").parquet(path)


def write_page_stats(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Page metadata as JSON lines (one record per page)."""
    stats.write.mode(mode).json(path)


def write_merged(pieces: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Merged documents as text: `pieces(site, block, part, text)` as `merge.merged_document` gives them.
    Each site's folder holds its pieces in order: reading the files of a site by name and
    concatenating them gives the document (heading, page list, rule, sections and the
    separators between them)."""
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    order = ["site", "block", "part"]
    rows = pieces.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # no line separator: a piece ends exactly where its text ends
    rows.select("site", F.col("text").alias("value")).write.mode(mode).option("lineSep", LINE_SEP).partitionBy("site").text(path)


#: Ends a piece in the text files of a merged document; a character that no text may hold.
LINE_SEP = "\ufdd8"


def write_merged_parts(pieces: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Merged documents as parts with a manifest: `parts` holds each piece with the byte offset at which its site's one
    document has it, partitioned by site and in order; `manifest` the offsets, lengths and checksums. Offsets are a
    prefix sum over range runs, so a site of any size is written by many tasks. `merged_faults` checks a folder."""
    sized = pieces.select("site", "block", "part", F.encode("text", "UTF-8").alias("data")).withColumn("length", F.octet_length("data").cast("bigint"))
    placed = running_total(sized, ["block", "part"], "length", "_end", group=["site"]).withColumn("offset", F.col("_end") - F.col("length"))
    n = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    rows = placed.select("site", "offset", "length", F.sha2("data", 256).alias("sha256"), "data").repartitionByRange(n, "site", "offset").sortWithinPartitions("site", "offset")
    rows.write.mode(mode).partitionBy("site").parquet(f"{path}/parts")
    # read back, so that the manifest tells what was written
    back = pieces.sparkSession.read.parquet(f"{path}/parts")
    back.select("site", "offset", "length", "sha256", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file")).write.mode(mode).parquet(f"{path}/manifest")


def merged_faults(spark, path: str) -> DataFrame:
    """(site, offset, fault) of parts that are missing, altered or do not join the part before; no row if a reader that
    concatenates a site's parts by offset gets its document."""
    w = Window.partitionBy("site").orderBy("offset", "length")
    m = spark.read.parquet(f"{path}/manifest").withColumn("due", F.coalesce(F.lag(F.col("offset") + F.col("length")).over(w), F.lit(0)))
    p = spark.read.parquet(f"{path}/parts").select("site", "offset", F.octet_length("data").cast("bigint").alias("_n"), F.sha2("data", 256).alias("_sha"))
    both = m.join(p, ["site", "offset"], "left")
    fault = F.when(F.col("_n").isNull(), "missing").when((F.col("_n") != F.col("length")) | (F.col("_sha") != F.col("sha256")), "altered").when(F.col("offset") != F.col("due"), "gap")
    return both.select("site", "offset", fault.alias("fault")).where("fault IS NOT NULL")


def append_captures(captures: DataFrame, path: str, files: int = DOMAIN_FILES) -> None:
    by_domain(captures, files).write.mode("append").partitionBy("domain").parquet(path)


def append_content_cache(cache: DataFrame, path: str) -> None:
    cache.write.mode("append").parquet(path)


def is_missing(error: Exception) -> bool:
    return isinstance(error, AnalysisException) and error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def registry_versions(spark, base: str) -> list[int]:
    """Committed registry versions: those with a marker, which is written after their data. Only a missing
    folder means "none"; any other read error is raised."""
    try:
        rows = spark.read.schema("value string, v int").text(f"{base}/_committed").select("v").distinct().collect()  # one row per version
    except AnalysisException as e:
        if is_missing(e):
            return []
        raise
    return sorted(r["v"] for r in rows)


def latest_registry_version(spark, base: str) -> int:
    """Current registry version (0 when none)."""
    return max(registry_versions(spark, base), default=0)


def commit_registry_version(spark, base: str, v: int) -> None:
    """The last step of a save; a marker is a folder of its own, so no pointer is ever rewritten."""
    spark.createDataFrame([(str(v),)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/_committed/v={v}")


def read_registry(spark, base: str, v: int | None = None) -> tuple[DataFrame, DataFrame] | None:
    """(media_contents, occurrences) of the latest or a given committed version."""
    v = latest_registry_version(spark, base) if v is None else v
    return (spark.read.parquet(f"{base}/v={v}/media_contents"), spark.read.parquet(f"{base}/v={v}/occurrences")) if v else None


def save_registry_version(contents: DataFrame, occurrences: DataFrame, base: str, delta: DataFrame | None = None, version: int | None = None) -> int:
    """Versioned registry save: write `v=N+1` next to the kept `v=N` (the backup), then commit it.
    Nothing is written when the delta of this run is empty. A committed version is never
    overwritten; what a failed save left uncommitted is. Returns the version in force."""
    spark = contents.sparkSession
    known = registry_versions(spark, base)
    v = max(known, default=0)
    if delta is not None and delta.isEmpty():
        return v
    nxt = v + 1 if version is None else version
    if nxt in known:
        return v
    contents.write.mode("overwrite").parquet(f"{base}/v={nxt}/media_contents")
    occurrences.write.mode("overwrite").parquet(f"{base}/v={nxt}/occurrences")
    commit_registry_version(spark, base, nxt)
    return nxt


def export_registry_json(contents: DataFrame, occurrences: DataFrame, path: str) -> None:
    """JSON export as two line-delimited datasets keyed by hash: entries and
    their occurrences (an occurrence list of a hot item is never one record)."""
    contents.select("hash", F.to_json(F.struct("*")).alias("value")).select("value").write.mode("overwrite").text(f"{path}/entries")
    occurrences.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/occurrences")
