"""File sources: local HTML pages, media bytes, registry and cache JSON.

All are plain DataFrame readers with explicit schemas; a file that cannot be
parsed yields NULL fields (PERMISSIVE), never a failed task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.schemas import REGISTRY_ENTRY

CACHE_RECORD = "description STRING, transcription STRING, model STRING, timestamp BIGINT"


def read_local_html(spark: SparkSession, path: str) -> DataFrame:
    """Local `.html`/`.htm` files as pages: url = `file://` + absolute path."""
    df = spark.read.option("pathGlobFilter", "*.[hH][tT][mM]*").text(path, wholetext=True)
    fp = F.col("_metadata.file_path")
    df = df.filter(F.lower(fp).rlike("\\.html?\\z"))
    url = F.when(fp.startswith("file:"), F.regexp_replace(fp, "\\Afile:/*", "file:///")).otherwise(F.concat(F.lit("file://"), fp))
    return df.select(F.md5(url).alias("page_id"), url.alias("url"), F.col("value").alias("html"))


def read_media_files(spark: SparkSession, path: str) -> DataFrame:
    """Media bytes via the `binaryFile` source, with a content type from the
    extension and the SHA-256 content hash (the registry key)."""
    df = spark.read.format("binaryFile").load(path)
    ext = F.lower(F.regexp_extract("path", "\\.([^./]+)\\z", 1))
    ctype = (
        F.when(ext.isin("jpg", "jpeg"), "image/jpeg").when(ext == "png", "image/png").when(ext == "gif", "image/gif")
        .when(ext == "webp", "image/webp").when(ext == "svg", "image/svg+xml").when(ext == "avif", "image/avif")
        .when(ext == "mp3", "audio/mpeg").when(ext == "wav", "audio/wav").when(ext == "ogg", "audio/ogg")
        .when(ext == "m4a", "audio/mp4").when(ext == "aac", "audio/aac").otherwise("application/octet-stream")
    )
    return df.select(
        "path", "length", "content", ctype.alias("content_type"), F.col("path").alias("original_url"),
        F.sha2("content", 256).alias("hash"),
    )


def media_bytes_of(files: DataFrame, fetched: DataFrame) -> DataFrame:
    """media_bytes(url, content, content_type) for `operators.media`: files on storage joined to the list of
    what was fetched, fetched(url, path)."""
    return fetched.select("url", "path").join(files.select("path", "content", "content_type"), "path").select("url", "content", "content_type")


def read_registry_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A registry JSON file (`{entries: {hash: entry}, stats}`) → (media_contents,
    occurrences). A missing file gives two empty tables (start empty)."""
    schema = f"entries MAP<STRING, {REGISTRY_ENTRY}>, stats STRING"
    try:
        raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
        e = raw.select(F.explode("entries").alias("hash", "e"))
    except Exception as exc:  # path does not exist yet
        if "PATH_NOT_FOUND" not in str(exc) and "does not exist" not in str(exc):
            raise
        e = spark.createDataFrame([], f"hash STRING, e {REGISTRY_ENTRY}")
    contents = e.select(
        "hash", "e.type", "e.content",
        F.to_timestamp("e.firstProcessed").alias("first_processed"), F.to_timestamp("e.lastUsed").alias("last_used"),
        F.size("e.occurrences").cast("bigint").alias("n_occurrences"), F.col("e.apiCost").alias("api_cost"),
        F.col("e.metadata").alias("metadata"),
    )
    occ = e.select("hash", F.posexplode("e.occurrences").alias("pos", "o")).select(
        "hash", F.col("o.pagePath").alias("page_path"), F.col("o.originalUrl").alias("original_url"),
        F.to_timestamp("o.timestamp").alias("ts"),
    )
    return contents, occ


def read_cache_json(spark: SparkSession, path: str, root: str, base_dir: str = "tmp") -> DataFrame:
    """Per-item cache files (`<root>/<host>/…/<key>.json`) → content_cache rows. `page_dir` is relative to
    `root` under `base_dir`, the form in which references carry it, so that the rows join
    (`media.resolve_contents`). Unreadable JSON gives NULL content (a miss).
    The legacy format has one file per item; a file is read by one task."""
    df = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    rec = F.from_json("value", CACHE_RECORD, {"mode": "PERMISSIVE"})
    fp = F.col("_metadata.file_path")
    folder = F.regexp_replace(F.regexp_extract(fp, "\\A(.*)/[^/]+\\z", 1), "\\A[a-z0-9]+:/*", "/")
    top = "/" + root.split(":", 1)[-1].strip("/") if "://" in root or root.startswith("file:") else "/" + root.strip("/")
    page_dir = F.concat(F.lit(base_dir), F.substr(folder, F.lit(len(top) + 1)))
    return df.select(
        page_dir.alias("page_dir"),
        F.regexp_extract(fp, "[^/]+\\z", 0).alias("cache_key"),
        F.when(rec["transcription"].isNotNull(), "audio").otherwise("image").alias("media_type"),
        F.coalesce(rec["description"], rec["transcription"]).alias("content"),
        rec["model"].alias("model"),
        F.timestamp_millis(rec["timestamp"]).alias("ts"),
    )
