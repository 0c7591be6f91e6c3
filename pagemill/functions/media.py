"""Media reference functions over Markdown (Column → Column).

`.` in the reference's patterns is JavaScript's dot (no line terminators); it
is spelled out as `[^\\n\\r\\x{2028}\\x{2029}]` so Java and RE2 agree with it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.text import col_
from pagemill.functions.urls import fold_dot_segments

DOT = "[^\\n\\r\\x{2028}\\x{2029}]"
# Reference patterns (image refs, links) and media extensions.
IMAGE_REF = f"!\\[({DOT}*?)\\]\\(({DOT}*?)\\)"
LINK_REF = f"\\[({DOT}*?)\\]\\(({DOT}*?)\\)"
AUDIO_EXT = "(?i)\\.(mp3|wav|ogg|m4a|aac)\\z"
IMAGE_EXT = "(?i)\\.(jpg|jpeg|png|gif|webp|svg|avif)\\z"
UUID_RE = "(?i)uuid-[a-f0-9-]+"
NEXT_IMAGE = "/_next/image?url="
IMAGE_TAG = "md_image-description"
AUDIO_TAG = "md_audio-transcript"
IMAGE_MODEL = "gpt-4o-mini"
AUDIO_MODEL = "whisper-1"


def is_audio(url) -> Column:
    return col_(url).rlike(AUDIO_EXT)


def is_image(url) -> Column:
    return col_(url).rlike(IMAGE_EXT)


def page_base_dir(page_url) -> Column:
    """Page URL without query/fragment, up to and including the last '/'."""
    u = F.regexp_replace(col_(page_url), "[?#].*\\z", "")
    return F.regexp_extract(u, "\\A(.*/)", 1)


def resolve_media(url, page_url) -> Column:
    """Resolve a media URL against the page only when it starts with `/`, `./`
    or `../`; anything else is left as written (bare relatives stay relative)."""
    u = col_(url)
    origin = F.lower(F.regexp_extract(col_(page_url), "\\A([a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*)", 1))
    base_path = F.regexp_extract(page_base_dir(page_url), "\\A[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*(/.*)\\z", 1)
    rel = F.concat(F.when(base_path == "", F.lit("/")).otherwise(base_path), u)
    return (
        F.when(u.startswith("//"), F.concat(F.regexp_extract(origin, "\\A([a-z][a-z0-9+.\\-]*:)", 1), u))
        .when(u.startswith("/"), F.concat(origin, fold_dot_segments(u)))
        .when(u.startswith("./") | u.startswith("../"), F.concat(origin, fold_dot_segments(rel)))
        .otherwise(u)
    )


def unwrap_next_image(resolved, page_url) -> Column:
    """`/_next/image?url=<encoded>` → the decoded original (decoded once),
    resolved against the page when it is itself relative."""
    r = col_(resolved)
    raw = F.regexp_extract(r, "[?&]url=([^&#]*)", 1)
    dec = F.try_url_decode(raw)
    return F.when(r.contains(NEXT_IMAGE) & (raw != ""), resolve_media(dec, page_url)).otherwise(r)


def _path_parts(url) -> Column:
    p = F.regexp_extract(col_(url), "\\A[a-zA-Z][a-zA-Z0-9+.\\-]*://[^/?#]*([^?#]*)", 1)
    return F.split(p, "/")


def uuid_part(url) -> Column:
    """First path segment containing `uuid-` (NULL if none)."""
    return F.get(F.filter(_path_parts(url), lambda s: s.contains("uuid-")), 0)


def basename_no_query(url) -> Column:
    return F.regexp_extract(F.regexp_replace(col_(url), "\\?.*\\z", ""), "([^/]*)/*\\z", 1)


def image_cache_key(unwrapped) -> Column:
    """Per-page cache file name of an image: uuid segment or basename, + `.json`."""
    return F.concat(F.coalesce(uuid_part(unwrapped), basename_no_query(unwrapped)), F.lit(".json"))


def extname(url) -> Column:
    base = F.regexp_extract(F.regexp_replace(col_(url), "[?#].*\\z", ""), "[^/]*\\z", 0)
    return F.regexp_extract(base, "\\A.+(\\.[^.]*)\\z", 1)


def stored_name(kind, resolved, raw_url, content_hash) -> Column:
    """Stored file name: `uuid-…` match + `.png` (image) or the link's extension
    (audio); without a uuid, `image-`/`audio-` + 12 hex of the content hash
    (deterministic, where the reference used the clock)."""
    uid = F.regexp_extract(col_(resolved), UUID_RE, 0)
    ext = F.when(col_(kind) == "image", F.lit(".png")).otherwise(extname(raw_url))
    fallback = F.concat(col_(kind), F.lit("-"), F.substring(col_(content_hash), 1, 12))
    return F.concat(F.when(uid != "", uid).otherwise(fallback), ext)


def enrichment_tag(kind, resolved, content) -> Column:
    """`\\n\\n<tag src="url">content</tag>\\n\\n` appended after a reference."""
    tag = F.when(col_(kind) == "image", F.lit(IMAGE_TAG)).otherwise(F.lit(AUDIO_TAG))
    return F.concat(F.lit("\n\n<"), tag, F.lit(' src="'), col_(resolved), F.lit('">'), col_(content),
                    F.lit("</"), tag, F.lit(">\n\n"))


def transcript_text(text, payload) -> Column:
    """A transcription answer as text: the string when the model returned one,
    else the JSON of the structured answer."""
    return F.coalesce(col_(text), F.to_json(col_(payload)))
