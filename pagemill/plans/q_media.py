"""Media group (F5 Markdown pages with media, from documents)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import media as M
from pagemill.operators import media as MO
from pagemill.plans import duck as D
from pagemill.plans.catalog import register
from pagemill.sources.derived import content_cache, known_contents, media_bytes, media_pages

Q = D.q
NL2 = "chr(10) || chr(10)"


def _hx(col: str, m: int) -> str:
    return f"lpad(lower(hex({col} % {m})), 2, '0')"


F5 = f"""f5 AS (
  SELECT doc_id AS page_id, 'https://docs.example.com/' || lang || '/doc-' || doc_id::VARCHAR AS url, lang AS site,
         text || {NL2} || img || CASE WHEN doc_id % 5 = 0 THEN img ELSE '' END ||
         CASE WHEN doc_id % 4 = 0 THEN '[listen to clip](./audio/clip' || (doc_id % 13)::VARCHAR || '.MP3)' || {NL2} ELSE '' END ||
         CASE WHEN doc_id % 9 = 0 THEN '![wrapped](/_next/image?url=https%3A%2F%2Fcdn.example.com%2Fassets%2Fuuid-' ||
              {_hx('doc_id', 89)} || '%2Fphoto.png&w=640)' || {NL2} ELSE '' END AS markdown
  FROM (SELECT *, '![figure ' || doc_id::VARCHAR || '](/img/uuid-' || {_hx('doc_id', 97)} || '.png)' || {NL2} AS img FROM documents))"""

CLIP = "'media:clip' || n::VARCHAR || CASE WHEN n % 2 = 0 THEN '-' || lang ELSE '' END"

MEDIA_BYTES = f"""mb AS (
  SELECT 'https://docs.example.com/img/uuid-' || {_hx('k', 97)} || '.png' AS url, 'media:img' || (k % 60)::VARCHAR AS bytes, 'image/png' AS content_type
  FROM (SELECT DISTINCT doc_id % 97 AS k FROM documents)
  UNION ALL
  SELECT 'https://docs.example.com/' || lang || '/audio/clip' || n::VARCHAR || '.MP3', {CLIP}, 'audio/mpeg'
  FROM (SELECT DISTINCT doc_id % 13 AS n, lang FROM documents)
  UNION ALL
  SELECT 'https://cdn.example.com/assets/uuid-' || {_hx('w', 89)} || '/photo.png', 'media:photo' || w::VARCHAR, 'image/png'
  FROM (SELECT DISTINCT doc_id % 89 AS w FROM documents) WHERE w % 11 <> 0)"""

KNOWN = f"""known AS (
  SELECT sha256('media:img' || j::VARCHAR) AS hash, 'image' AS type,
         'A figure labelled img' || j::VARCHAR || CASE WHEN j % 2 = 0 THEN ' (costs $1, path C:\\tmp)' ELSE '' END ||
         CASE WHEN j % 10 = 1 THEN ' [hear it](./audio/clip1.MP3)' ELSE '' END AS content
  FROM (SELECT DISTINCT doc_id % 97 % 60 AS j FROM documents) WHERE j % 3 <> 0
  UNION ALL
  SELECT DISTINCT sha256({CLIP}), 'audio', 'Transcript of ' || substr({CLIP}, 7)
  FROM (SELECT DISTINCT doc_id % 13 AS n, lang FROM documents) WHERE n % 3 <> 0)"""


_fold = D.fold_dot_segments


def _resolve(u: str, origin: str, base_path: str) -> str:
    rel = f"(CASE WHEN {base_path} = '' THEN '/' ELSE {base_path} END || {u})"
    return (
        f"(CASE WHEN starts_with({u}, '//') THEN regexp_extract({origin}, '^([a-z][a-z0-9+.-]*:)', 1) || {u} "
        f"WHEN starts_with({u}, '/') THEN {origin} || {_fold(u)} "
        f"WHEN starts_with({u}, './') OR starts_with({u}, '../') THEN {origin} || {_fold(rel)} ELSE {u} END)"
    )


def _unnest(kind: str, pat: str, src: str = "f5", md: str = "markdown") -> str:
    arr = f"regexp_extract_all({md}, {Q(pat)}, 0)"
    return (
        f"SELECT page_id, url, '{kind}' AS kind, (generate_subscripts({arr}, 1) - 1)::BIGINT AS pos, "
        f"unnest(regexp_extract_all({md}, {Q(pat)}, 1)) AS alt, unnest(regexp_extract_all({md}, {Q(pat)}, 2)) AS raw_url, "
        f"unnest({arr}) AS ref FROM {src}"
    )


BASENAME = "regexp_extract(regexp_replace({u}, '\\?.*$', ''), '([^/]*)/*$', 1)"
PATH_OF = "regexp_extract({u}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def _audio(src: str, md: str = "markdown") -> str:
    return f"SELECT * FROM ({_unnest('audio', M.LINK_REF, src, md)}) WHERE regexp_matches(raw_url, {Q(M.AUDIO_EXT)})"


def _refs_ctes(raw: str, x: str) -> str:
    """CTEs from references (`raw`) to `refs<x>`: resolved URLs, content hashes, keys."""
    return f"""raw{x} AS ({raw}),
rs{x} AS (SELECT *, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)) AS origin,
              regexp_extract(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^(.*/)', 1),
                             '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(/.*)$', 1) AS base_path FROM raw{x}),
rv{x} AS (SELECT *, {_resolve('raw_url', 'origin', 'base_path')} AS resolved_url FROM rs{x}),
rw{x} AS (SELECT *, CASE WHEN kind = 'image' AND contains(resolved_url, '/_next/image?url=')
                       AND regexp_extract(resolved_url, '[?&]url=([^&#]*)', 1) <> ''
                      THEN url_decode(replace(regexp_extract(resolved_url, '[?&]url=([^&#]*)', 1), '+', '%20')) END AS decoded
       FROM rv{x}),
ru{x} AS (SELECT * EXCLUDE (decoded), CASE WHEN decoded IS NOT NULL THEN {_resolve('decoded', 'origin', 'base_path')}
                                         ELSE resolved_url END AS source_url FROM rw{x}),
rh{x} AS (SELECT ru{x}.*, lower(CASE WHEN regexp_extract(source_url, {Q(M.UUID_RE)}, 0) <> '' THEN regexp_extract(source_url, {Q(M.UUID_RE)}, 0)
                            ELSE {BASENAME.replace('{u}', 'source_url')} END) AS media_key, sha256(mb.bytes) AS hash
       FROM ru{x} LEFT JOIN mb ON mb.url = source_url),
rn{x} AS (SELECT *, CASE WHEN regexp_extract(source_url, {Q(M.UUID_RE)}, 0) <> '' THEN regexp_extract(source_url, {Q(M.UUID_RE)}, 0)
                      ELSE kind || '-' || substr(hash, 1, 12) END ||
                 CASE WHEN kind = 'image' THEN '.png'
                      ELSE regexp_extract(regexp_extract(regexp_replace(raw_url, '[?#].*$', ''), '[^/]*$', 0), '^.+(\\.[^.]*)$', 1) END
                 AS stored_name FROM rh{x}),
refs{x} AS (SELECT *, CASE WHEN kind = 'image'
                        THEN coalesce(list_filter(string_split({PATH_OF.replace('{u}', 'source_url')}, '/'), lambda s: contains(s, 'uuid-'))[1],
                                      {BASENAME.replace('{u}', 'source_url')}) || '.json'
                        ELSE stored_name || '.json' END AS cache_key,
                   regexp_replace({D.path_key('url')}, '/[^/]+$', '') AS page_dir,
                   CASE WHEN kind = 'image' THEN '{M.IMAGE_MODEL}' ELSE '{M.AUDIO_MODEL}' END AS model
         FROM rn{x})"""


def _resolved_cte(x: str) -> str:
    return f"""res{x} AS (SELECT refs{x}.*, cache.content AS cache_content, known.content AS registry_content,
               CASE WHEN cache.content IS NOT NULL THEN 'cache' WHEN known.content IS NOT NULL THEN 'registry'
                    WHEN refs{x}.hash IS NULL THEN 'failed' ELSE 'new' END AS content_source,
               coalesce(cache.content, known.content) AS content
        FROM refs{x} LEFT JOIN cache USING (page_dir, cache_key, model) LEFT JOIN known USING (hash))"""


REFS = f"{F5}, {MEDIA_BYTES}, " + _refs_ctes(f"{_unnest('image', M.IMAGE_REF)} UNION ALL {_audio('f5')}", "")

CACHE = f"""cd AS (SELECT doc_id, lang, regexp_replace({D.path_key("'https://docs.example.com/' || lang || '/doc-' || doc_id::VARCHAR")}, '/[^/]+$', '') AS pd
       FROM documents WHERE doc_id % 7 = 0),
cache AS (
  SELECT page_dir, cache_key, media_type, 'Cached ' || media_type || ' for doc ' || doc_id::VARCHAR AS content,
         CASE WHEN doc_id % 14 <> 0 THEN 'older-model' WHEN media_type = 'image' THEN '{M.IMAGE_MODEL}' ELSE '{M.AUDIO_MODEL}' END AS model
  FROM (
    SELECT doc_id, pd AS page_dir, 'uuid-' || {_hx('doc_id', 97)} || '.png.json' AS cache_key, 'image' AS media_type FROM cd
    UNION ALL SELECT doc_id, pd, 'uuid-' || {_hx('doc_id', 89)} || '.json', 'image' FROM cd WHERE doc_id % 9 = 0
    UNION ALL SELECT doc_id, pd, 'audio-' || substr(sha256('media:clip' || (doc_id % 13)::VARCHAR || CASE WHEN doc_id % 13 % 2 = 0 THEN '-' || lang ELSE '' END), 1, 12) || '.MP3.json', 'audio'
      FROM cd WHERE doc_id % 4 = 0))"""

RESOLVED = f"{REFS}, {KNOWN}, {CACHE}, " + _resolved_cte("")


def _refs(t):
    return MO.resolve_refs(MO.media_refs(media_pages(t)), media_bytes(t))


def _resolved(t):
    return MO.resolve_contents(_refs(t), content_cache(t), known_contents(t))


@register("media_refs", f"WITH {REFS} SELECT page_id, kind, pos, alt, raw_url, ref FROM refs", "MED1 MED2 SRT2")
def media_refs(t):
    return MO.media_refs(media_pages(t)).select("page_id", "kind", "pos", "alt", "raw_url", "ref")


@register(
    "media_refs_count",
    f"WITH {REFS} SELECT page_id, kind, count(*)::BIGINT AS n_refs FROM refs GROUP BY page_id, kind",
    "AGG9",
)
def media_refs_count(t):
    return MO.media_refs(media_pages(t)).groupBy("page_id", "kind").agg(F.count(F.lit(1)).cast("bigint").alias("n_refs"))


@register(
    "media_kind",
    f"""WITH {REFS} SELECT page_id, kind, pos, raw_url, regexp_matches(raw_url, {Q(M.AUDIO_EXT)}) AS is_audio,
       regexp_matches(raw_url, {Q(M.IMAGE_EXT)}) AS is_image FROM refs""",
    "FLT4 FLT5",
)
def media_kind(t):
    return MO.media_refs(media_pages(t)).select(
        "page_id", "kind", "pos", "raw_url", M.is_audio("raw_url").alias("is_audio"), M.is_image("raw_url").alias("is_image")
    )


@register(
    "media_resolve",
    f"WITH {REFS} SELECT page_id, kind, pos, raw_url, resolved_url, source_url FROM refs",
    "URL7 URL8 X20 X23 X24",
)
def media_resolve(t):
    return _refs(t).select("page_id", "kind", "pos", "raw_url", "resolved_url", "source_url")


@register(
    "media_cache_key",
    f"WITH {REFS} SELECT page_id, kind, pos, media_key, cache_key, stored_name, page_dir FROM refs",
    "URL9 URL10 URL11 X25",
)
def media_cache_key(t):
    return _refs(t).select("page_id", "kind", "pos", "media_key", "cache_key", "stored_name", "page_dir")


# Built from the rows, with no reference parsing: which bytes each reference stands for.
HASH_ROWS = f"""WITH b AS (
  SELECT doc_id AS page_id, 'image' AS kind, 0 AS pos, 'media:img' || (doc_id % 97 % 60)::VARCHAR AS bytes FROM documents
  UNION ALL SELECT doc_id, 'image', 1, 'media:img' || (doc_id % 97 % 60)::VARCHAR FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 'image', CASE WHEN doc_id % 5 = 0 THEN 2 ELSE 1 END,
                   CASE WHEN doc_id % 89 % 11 <> 0 THEN 'media:photo' || (doc_id % 89)::VARCHAR END FROM documents WHERE doc_id % 9 = 0
  UNION ALL SELECT page_id, 'audio', CASE WHEN page_id % 5 = 0 THEN 2 ELSE 1 END, {CLIP} FROM (SELECT doc_id AS page_id, doc_id % 13 AS n, lang FROM documents WHERE doc_id % 4 = 0))
SELECT page_id, kind, pos::BIGINT AS pos, sha256(bytes) AS hash, bytes IS NULL AS failed FROM b"""


@register("media_hash", HASH_ROWS, "MED3 SRC10")
def media_hash(t):
    return _refs(t).select("page_id", "kind", "pos", "hash", F.col("hash").isNull().alias("failed"))


@register(
    "cache_lookup",
    f"""WITH {REFS}, {CACHE}
SELECT page_id, kind, pos, cache_key, model, cache.content AS cache_content
FROM refs LEFT JOIN cache USING (page_dir, cache_key, model)""",
    "JN2 FLT6",
)
def cache_lookup(t):
    refs = _refs(t)
    c = content_cache(t).select("page_dir", "cache_key", "model", F.col("content").alias("cache_content"))
    df = refs.withColumn("model", MO.model_for(F.col("kind")))
    return df.join(c, ["page_dir", "cache_key", "model"], "left").select("page_id", "kind", "pos", "cache_key", "model", "cache_content")


@register(
    "content_resolution",
    f"WITH {RESOLVED} SELECT page_id, kind, pos, hash, content_source, content FROM res",
    "MED5 JN1 JN2",
)
def content_resolution(t):
    return _resolved(t).select("page_id", "kind", "pos", "hash", "content_source", "content")


_PRE, _POST = MO.IMAGE_PROMPT.split("{altText}", 1)


@register(
    "enrichment_requests",
    f"""WITH {RESOLVED},
r AS MATERIALIZED (SELECT hash, kind, alt, source_url, page_id, row_number() OVER (PARTITION BY hash ORDER BY page_id, kind, pos) AS rn,
             count(*) OVER (PARTITION BY hash)::BIGINT AS n_refs FROM res WHERE content_source = 'new'),
f AS MATERIALIZED (SELECT hash, kind, alt, source_url, page_id AS first_page_id, n_refs FROM r WHERE rn = 1),
x AS (SELECT f.*, mb.bytes, mb.content_type FROM f JOIN mb ON mb.url = source_url)
SELECT hash, kind AS media_type, CASE WHEN kind = 'image' THEN '{M.IMAGE_MODEL}' ELSE '{M.AUDIO_MODEL}' END AS model,
       CASE WHEN kind = 'image' THEN {Q(_PRE)} || alt || {Q(_POST)} END AS prompt,
       CASE WHEN kind = 'image' THEN {MO.IMAGE_MAX_TOKENS} END::INT AS max_tokens,
       CASE WHEN kind = 'audio' THEN '{MO.AUDIO_LANGUAGE}' END AS language,
       CASE WHEN kind = 'audio' THEN '{MO.AUDIO_FORMAT}' END AS response_format,
       'data:' || content_type || ';base64,' || to_base64(encode(bytes)) AS data_url,
       first_page_id, source_url, n_refs
FROM x""",
    "MED7 AGG3 UDF2 SCF15",
)
def enrichment_requests(t):
    return MO.enrichment_requests(_resolved(t), media_bytes(t))


def _enrich_sql() -> str:
    """Oracle: split on the same sentinel, explode segments, join contents by
    (page, raw url), re-aggregate in order — relational, not positional maps."""
    img, link = Q(M.IMAGE_REF), Q(M.LINK_REF)

    def tag(kind: str, tagname: str) -> str:
        return (
            f"{NL2} || '<{tagname} src=\"' || v.resolved_url || '\">' || v.content || '</{tagname}>' || {NL2}"
        )

    return f"""{RESOLVED},
iv AS (SELECT page_id, raw_url, arg_min(resolved_url, pos) AS resolved_url, arg_min(content, pos) AS content
       FROM res WHERE kind = 'image' AND content IS NOT NULL GROUP BY page_id, raw_url),
s1 AS (SELECT page_id, url, string_split(regexp_replace(markdown, '(' || {img} || ')', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS segs FROM f5),
e1 AS (SELECT page_id, url, unnest(segs) AS seg, generate_subscripts(segs, 1) AS i FROM s1),
j1 AS (SELECT e1.page_id, e1.url, e1.i,
              CASE WHEN e1.i % 2 = 0 AND v.content IS NOT NULL THEN e1.seg || {tag('image', M.IMAGE_TAG)} ELSE e1.seg END AS seg
       FROM e1 LEFT JOIN iv v ON v.page_id = e1.page_id AND e1.i % 2 = 0 AND v.raw_url = regexp_extract(e1.seg, {img}, 2)),
p1 AS (SELECT page_id, url, string_agg(seg, '' ORDER BY i) AS md FROM j1 GROUP BY page_id, url),
{_refs_ctes(_audio('p1', 'md'), '2')}, {_resolved_cte('2')},
av AS (SELECT page_id, raw_url, arg_min(resolved_url, pos) AS resolved_url, arg_min(content, pos) AS content
       FROM res2 WHERE content IS NOT NULL GROUP BY page_id, raw_url),
s2 AS (SELECT page_id, url, string_split(regexp_replace(md, '(' || {link} || ')', chr(1) || '\\1' || chr(1), 'g'), chr(1)) AS segs FROM p1),
e2 AS (SELECT page_id, url, unnest(segs) AS seg, generate_subscripts(segs, 1) AS i FROM s2),
j2 AS (SELECT e2.page_id, e2.url, e2.i,
              CASE WHEN e2.i % 2 = 0 AND v.content IS NOT NULL AND regexp_matches(regexp_extract(e2.seg, {link}, 2), {Q(M.AUDIO_EXT)})
                   THEN e2.seg || {tag('audio', M.AUDIO_TAG)} ELSE e2.seg END AS seg
       FROM e2 LEFT JOIN av v ON v.page_id = e2.page_id AND e2.i % 2 = 0 AND v.raw_url = regexp_extract(e2.seg, {link}, 2)),
enr AS (SELECT page_id, url, string_agg(seg, '' ORDER BY i) AS processed FROM j2 GROUP BY page_id, url)"""


ENRICHED = _enrich_sql()


def enriched(t):
    return MO.enrich_markdown(media_pages(t), media_bytes(t), content_cache(t), known_contents(t))


@register("enrich_markdown", f"WITH {ENRICHED} SELECT page_id, url, processed FROM enr", "MED4 MED6 MED8 X9")
def enrich_markdown(t):
    return enriched(t).select("page_id", "url", "processed")


@register(
    "media_sidecar",
    f"""WITH {RESOLVED}
SELECT page_id, kind, pos, page_dir || '/' || regexp_replace(stored_name, '\\.[^.]+$', '.md') AS sidecar_path,
       CASE WHEN kind = 'image'
            THEN '# Image Description' || {NL2} || '## Original Alt Text' || chr(10) || alt || {NL2} || '## Generated Description' || chr(10) || content || chr(10)
            ELSE '# Audio Transcription' || {NL2} || '## Original Link Text' || chr(10) || alt || {NL2} || '## Generated Transcription' || chr(10) || content || chr(10)
       END AS sidecar_md
FROM res WHERE content IS NOT NULL""",
    "SNK6",
)
def media_sidecar(t):
    return MO.sidecar_notes(_resolved(t))
