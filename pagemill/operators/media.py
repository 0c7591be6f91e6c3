"""Media enrichment as joins: references → resolution (cache, registry) →
request table for unknown content → annotated Markdown.

Plan shape at scale:
* refs are generated per page (narrow); an item is identified by the SHA-256 of its
  bytes, joined to the reference by URL (hashes only);
* cache lookup = shuffle join on (page_dir, cache_key); registry lookup =
  shuffle join on hash (AQE splits a hot hash such as a site logo);
* the request table groups by hash with partial aggregation (pay once per
  distinct content);
* annotation brings one small map of contents a page and kind back to the page text
  (one shuffle of text), so page texts are never exploded into segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions import media as M
from pagemill.functions.urls import dir_key

# Model request settings from the configuration.
IMAGE_PROMPT = (
    "Describe this image concisely. For icons and UI elements, provide a brief functional description "
    "(e.g., 'Plus icon for adding items'). For screenshots, describe key UI elements. For diagrams, use "
    "ASCII/markdown to explain what it represents. Keep descriptions under 2 sentences unless it's a complex "
    "diagram. Alt text: {altText}"
)
IMAGE_MAX_TOKENS = 500
AUDIO_LANGUAGE = "en"
AUDIO_FORMAT = "text"


KINDS = ("image", "audio")


def media_refs(pages: DataFrame, md_col: str = "markdown", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(page_id, url, kind, pos, alt, raw_url, ref): image refs and audio links,
    left to right; `pos` counts within the kind's scan. One pass over the text:
    the scans become one array that is exploded once."""
    md = F.col(md_col)

    def scan(pattern: str, kind: str) -> Column:
        z = F.arrays_zip(
            F.regexp_extract_all(md, F.lit(pattern), 0).alias("ref"),
            F.regexp_extract_all(md, F.lit(pattern), 1).alias("alt"),
            F.regexp_extract_all(md, F.lit(pattern), 2).alias("raw_url"),
        )
        return F.transform(z, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.cast("bigint").alias("pos"),
                                                    x["alt"].alias("alt"), x["raw_url"].alias("raw_url"), x["ref"].alias("ref")))

    by_kind = {"image": scan(M.IMAGE_REF, "image"), "audio": F.filter(scan(M.LINK_REF, "audio"), lambda x: M.is_audio(x["raw_url"]))}
    refs = F.concat(*(by_kind[k] for k in kinds))
    return pages.select("page_id", "url", F.explode(refs).alias("r")).select("page_id", "url", "r.*")


def content_hashes(media_bytes: DataFrame) -> DataFrame:
    """media_bytes(url, content, content_type) → (source_url, hash, content_type), one row per URL. An item
    is its bytes: equal names with different bytes are different items, and the same bytes under
    two names are one."""
    h = media_bytes.filter(F.col("content").isNotNull()).select("url", F.struct(F.sha2("content", 256).alias("hash"), "content_type").alias("b"))
    return h.groupBy(F.col("url").alias("source_url")).agg(F.min("b").alias("b")).select("source_url", "b.*")


def resolve_refs(refs: DataFrame, media_bytes: DataFrame) -> DataFrame:
    """Adds resolved / unwrapped URL, content hash (NULL where no bytes were fetched), cache key, stored
    name, page dir. Only hashes travel through the join, never bytes."""
    resolved = M.resolve_media(F.col("raw_url"), F.col("url"))
    df = refs.withColumn("resolved_url", resolved).withColumn(
        "source_url",
        F.when(F.col("kind") == "image", M.unwrap_next_image(F.col("resolved_url"), F.col("url"))).otherwise(
            F.col("resolved_url")
        ),
    )
    uid = F.regexp_extract(F.col("source_url"), M.UUID_RE, 0)
    key = F.lower(F.when(uid != "", uid).otherwise(M.basename_no_query(F.col("source_url"))))
    df = df.withColumn("media_key", key).join(content_hashes(media_bytes), "source_url", "left")
    df = df.withColumn("stored_name", M.stored_name(F.col("kind"), F.col("source_url"), F.col("raw_url"), F.col("hash")))
    cache_key = F.when(F.col("kind") == "image", M.image_cache_key(F.col("source_url"))).otherwise(
        F.concat(F.col("stored_name"), F.lit(".json"))
    )
    return df.withColumn("cache_key", cache_key).withColumn("page_dir", dir_key(F.col("url")))


def model_for(kind: Column) -> Column:
    return F.when(kind == "image", F.lit(M.IMAGE_MODEL)).otherwise(F.lit(M.AUDIO_MODEL))


def resolve_contents(refs: DataFrame, cache: DataFrame, registry: DataFrame) -> DataFrame:
    """Per reference: content from the per-page cache (same model only), else
    from the registry by content hash, else none: `new` (a model request) where
    there are bytes, `failed` where there are none."""
    c = cache.select("page_dir", "cache_key", "model", F.col("content").alias("cache_content"))
    r = registry.select("hash", F.col("content").alias("registry_content"))
    df = refs.withColumn("model", model_for(F.col("kind")))
    df = df.join(c, ["page_dir", "cache_key", "model"], "left").join(r, "hash", "left")
    src = (
        F.when(F.col("cache_content").isNotNull(), F.lit("cache"))
        .when(F.col("registry_content").isNotNull(), F.lit("registry"))
        .when(F.col("hash").isNull(), F.lit("failed"))
        .otherwise(F.lit("new"))
    )
    return df.withColumn("content_source", src).withColumn("content", F.coalesce("cache_content", "registry_content"))


def _content_type(kind: Column, url: Column) -> Column:
    ext = F.lower(M.extname(url))
    return (
        F.when(kind == "audio", F.when(ext == ".wav", "audio/wav").when(ext == ".ogg", "audio/ogg").otherwise("audio/mpeg"))
        .when(ext.isin(".jpg", ".jpeg"), "image/jpeg").when(ext == ".gif", "image/gif").when(ext == ".webp", "image/webp")
        .when(ext == ".svg", "image/svg+xml").otherwise("image/png")
    )


def enrichment_requests(
    resolved: DataFrame,
    media_bytes: DataFrame,
    prompt: str = IMAGE_PROMPT,
    max_tokens: int = IMAGE_MAX_TOKENS,
    image_model: str = M.IMAGE_MODEL,
    audio_model: str = M.AUDIO_MODEL,
    language: str = AUDIO_LANGUAGE,
    response_format: str = AUDIO_FORMAT,
) -> DataFrame:
    """One model request per distinct unknown content hash (each item is paid for
    once). `prompt` is a template whose `{altText}` takes the alt text of the
    item's first reference. The data URL holds the item's bytes, which are joined
    by URL after the references are grouped."""
    new = resolved.filter(F.col("content_source") == "new")
    first = new.groupBy("hash").agg(
        F.min_by(F.struct("kind", "alt", "source_url", "page_id"), F.struct("page_id", "kind", "pos")).alias("f"),
        F.count(F.lit(1)).cast("bigint").alias("n_refs"),
    )
    data = media_bytes.filter(F.col("content").isNotNull()).select(
        F.col("url").alias("_url"), F.sha2("content", 256).alias("_hash"), "content", "content_type"
    )
    first = first.join(data, (F.col("f.source_url") == F.col("_url")) & (F.col("hash") == F.col("_hash"))).dropDuplicates(["hash"])
    pre, _, post = prompt.partition("{altText}")
    kind = F.col("f.kind")
    b64 = F.replace(F.replace(F.base64("content"), F.lit("\r"), F.lit("")), F.lit("\n"), F.lit(""))
    ctype = F.coalesce("content_type", _content_type(kind, F.col("f.source_url")))
    return first.select(
        "hash",
        kind.alias("media_type"),
        F.when(kind == "image", F.lit(image_model)).otherwise(F.lit(audio_model)).alias("model"),
        F.when(kind == "image", F.concat(F.lit(pre), F.col("f.alt"), F.lit(post))).alias("prompt"),
        F.when(kind == "image", F.lit(max_tokens)).cast("int").alias("max_tokens"),
        F.when(kind == "audio", F.lit(language)).alias("language"),
        F.when(kind == "audio", F.lit(response_format)).alias("response_format"),
        F.concat(F.lit("data:"), ctype, F.lit(";base64,"), b64).alias("data_url"),
        F.col("f.page_id").alias("first_page_id"),
        F.col("f.source_url").alias("source_url"),
        "n_refs",
    )


def _annotate(text: Column, pattern: str, kind: str, contents: Column) -> Column:
    """Append the tag after every reference (matched by `pattern`) whose raw URL
    has a content in the map `contents` (raw_url → struct(resolved, content)).
    References are cut out with a split at a Unicode noncharacter (which no text may
    hold, and which is dropped from one that does): odd segments are references;
    content is appended with concat, so `$` and `\\` stay literal."""
    mark = "\ufdd0"
    marked = F.regexp_replace(F.translate(text, mark, ""), f"({pattern})", f"{mark}$1{mark}")
    segs = F.split(marked, mark)

    def one(s, i):
        hit = F.element_at(contents, F.regexp_extract(s, pattern, 2))
        keep_kind = M.is_audio(F.regexp_extract(s, pattern, 2)) if kind == "audio" else F.lit(True)
        tagged = F.concat(s, M.enrichment_tag(F.lit(kind), hit["resolved_url"], hit["content"]))
        return F.when((i % 2 == 1) & keep_kind & hit.isNotNull() & hit["content"].isNotNull(), tagged).otherwise(s)

    return F.when(F.size(F.coalesce(F.map_keys(contents), F.array())) == 0, text).otherwise(
        F.array_join(F.transform(segs, one), "")
    )


def annotate(pages: DataFrame, resolved: DataFrame, kind: str, md_col: str = "markdown", out: str = "processed") -> DataFrame:
    """`pages` with `out`: the text with the content of each reference of `kind` behind it. A reference
    without content keeps the original text (failure isolation)."""
    r = resolved.filter(F.col("content").isNotNull() & (F.col("kind") == kind))
    per_url = r.groupBy("page_id", "raw_url").agg(F.min_by(F.struct("resolved_url", "content"), F.col("pos")).alias("v"))
    contents = per_url.groupBy("page_id").agg(F.map_from_entries(F.collect_list(F.struct("raw_url", "v"))).alias("_contents"))
    pattern = M.IMAGE_REF if kind == "image" else M.LINK_REF
    p = pages.join(contents, "page_id", "left")
    return p.withColumn(out, _annotate(F.col(md_col), pattern, kind, F.col("_contents"))).drop("_contents")


def description_links(resolved: DataFrame) -> DataFrame:
    """The audio links inside the descriptions of `resolved` images, as rows of `media_refs`; they are
    relative to the page."""
    tag = M.enrichment_tag(F.lit("image"), F.col("resolved_url"), F.col("content"))
    held = resolved.filter((F.col("kind") == "image") & F.col("content").isNotNull() & tag.contains("]("))
    return media_refs(held.select("page_id", "url", tag.alias("_tag")), "_tag", ("audio",))


def enrich_markdown(pages: DataFrame, media_bytes: DataFrame, cache: DataFrame, registry: DataFrame, md_col: str = "markdown") -> DataFrame:
    """(page_id, url, <md_col>, processed): images first, then the audio links of the image-enriched
    text, so that a link inside a description is transcribed as well. The raw text stays beside the
    processed one, so consumers need not read the pages again.

    A description stands on lines of its own and a reference never crosses a line, so the references of the
    enriched text are those of the raw text and those inside descriptions. Both are resolved
    as rows (the images' lookups stand twice in the plan), and the text itself travels once, to meet
    all contents of its page."""
    outer = resolve_contents(resolve_refs(media_refs(pages, md_col), media_bytes), cache, registry)
    inner = resolve_contents(resolve_refs(description_links(outer), media_bytes), cache, registry)
    found = ("page_id", "kind", "raw_url", "pos", "resolved_url", "content")
    known = outer.select(*found).unionByName(inner.select(*found)).filter(F.col("content").isNotNull())
    # one exchange: the references of a page are few enough for a task, as its text is
    per_url = known.repartition("page_id").groupBy("page_id", "kind", "raw_url").agg(F.min(F.struct("pos", "resolved_url", "content")).alias("v"))
    entry = F.struct("raw_url", F.struct("v.resolved_url", "v.content").alias("v"))
    maps = {k: F.map_from_entries(F.collect_list(F.when(F.col("kind") == k, entry))).alias(f"_{k}s") for k in KINDS}
    p = pages.join(per_url.groupBy("page_id").agg(*maps.values()), "page_id", "left")
    p = p.withColumn("_img", _annotate(F.col(md_col), M.IMAGE_REF, "image", F.col("_images")))
    return p.withColumn("processed", _annotate(F.col("_img"), M.LINK_REF, "audio", F.col("_audios"))).drop("_img", "_images", "_audios")


def sidecar_notes(resolved: DataFrame) -> DataFrame:
    """The Markdown note written next to each described item."""
    # The notes' headings.
    img = F.concat(F.lit("# Image Description\n\n## Original Alt Text\n"), F.col("alt"),
                   F.lit("\n\n## Generated Description\n"), F.col("content"), F.lit("\n"))
    aud = F.concat(F.lit("# Audio Transcription\n\n## Original Link Text\n"), F.col("alt"),
                   F.lit("\n\n## Generated Transcription\n"), F.col("content"), F.lit("\n"))
    return resolved.filter(F.col("content").isNotNull()).select(
        "page_id", "kind", "pos",
        F.concat(F.col("page_dir"), F.lit("/"), F.regexp_replace("stored_name", "\\.[^.]+\\z", ".md")).alias("sidecar_path"),
        F.when(F.col("kind") == "image", img).otherwise(aud).alias("sidecar_md"),
    )
