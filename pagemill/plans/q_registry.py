"""Registry group (F6 occurrences from lineitem)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import registry as R
from pagemill.plans.catalog import register
from pagemill.sources.derived import media_occurrences

F6 = """f6 AS (
  SELECT sha256(l_partkey::VARCHAR) AS hash,
         CASE WHEN l_partkey % 5 = 0 THEN 'audio' ELSE 'image' END AS type,
         'orders/' || l_orderkey::VARCHAR AS page_path,
         'https://media.example.com/' || CASE WHEN l_partkey % 5 = 0 THEN 'audio' ELSE 'image' END || '/' ||
           l_partkey::VARCHAR || CASE WHEN l_partkey % 5 = 0 THEN '.mp3' ELSE '.png' END AS original_url,
         l_shipdate AS ts, l_linenumber::BIGINT AS tie1, l_suppkey AS tie2, l_orderkey AS tie3,
         CASE WHEN l_partkey % 5 = 0 THEN 'audio' ELSE 'image' END || ' of part ' || l_partkey::VARCHAR AS content,
         (CASE WHEN l_partkey % 5 = 0 THEN round(l_quantity * 6 * 100000)::BIGINT
               ELSE round(l_quantity * 100)::BIGINT * 150 + (l_linenumber * 50)::BIGINT * 600 END)::DOUBLE / 1e9::DOUBLE AS api_cost,
         l_orderkey AS page_id,
         CASE WHEN l_partkey % 5 = 0 THEN 'whisper-1' ELSE 'gpt-4o-mini' END AS model,
         CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE round(l_quantity * 100)::BIGINT END AS prompt_tokens,
         CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE (l_linenumber * 50)::BIGINT END AS completion_tokens,
         CASE WHEN l_partkey % 5 = 0 THEN l_quantity * 6 ELSE 0.0 END AS seconds
  FROM lineitem {where})"""


def f6(where: str = "") -> str:
    return F6.replace("{where}", where)


DISTINCT = """d AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY hash, page_path ORDER BY ts, tie1, tie2, tie3) AS rn,
           max(ts) OVER (PARTITION BY hash, page_path) AS last_ts
    FROM {src}) WHERE rn = 1)"""

CONTENTS = """c AS (
  SELECT hash, type, content, first_processed, last_used, n_occurrences, api_cost FROM (
    SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ts, tie1, tie2, tie3) AS rn2,
           min(ts) OVER (PARTITION BY hash) AS first_processed,
           max(last_ts) OVER (PARTITION BY hash) AS last_used,
           count(*) OVER (PARTITION BY hash) AS n_occurrences
    FROM d) WHERE rn2 = 1)"""


@register(
    "registry_build",
    f"WITH {f6()}, {DISTINCT.replace('{src}', 'f6')}, {CONTENTS} SELECT * FROM c",
    "AGG2 WIN3 D12 D13",
)
def registry_build(t):
    return R.registry_build(media_occurrences(t))


@register(
    "registry_stats",
    f"""WITH {f6()}, {DISTINCT.replace('{src}', 'f6')}, {CONTENTS}
SELECT type, sum(n_occurrences)::BIGINT AS total_files, count(*)::BIGINT AS unique_files,
       sum(greatest(n_occurrences - 1, 0))::BIGINT AS duplicate_count, round(sum(coalesce(api_cost, 0.0)), 9) AS total_api_cost
FROM c GROUP BY type
UNION ALL
SELECT 'all', sum(n_occurrences)::BIGINT, count(*)::BIGINT, sum(greatest(n_occurrences - 1, 0))::BIGINT,
       round(sum(coalesce(api_cost, 0.0)), 9) FROM c""",
    "AGG1 D15",
)
def registry_stats(t):
    return R.registry_stats(R.registry_build(media_occurrences(t)))


@register(
    "media_duplicates",
    f"""WITH {f6()}, {DISTINCT.replace('{src}', 'f6')},
n AS (SELECT hash, count(*) AS n_occurrences FROM d GROUP BY hash HAVING count(*) > 1)
SELECT d.hash, page_path, original_url, ts AS first_ts, n_occurrences FROM d JOIN n USING (hash)""",
    "JN7",
)
def media_duplicates(t):
    return R.media_duplicates(media_occurrences(t))


@register(
    "registry_lookup",
    f"""WITH {f6("WHERE l_shipdate < TIMESTAMP '1998-06-01'")}, {DISTINCT.replace('{src}', 'f6')}, {CONTENTS},
f6b AS (SELECT DISTINCT sha256(l_partkey::VARCHAR) AS hash, 'orders/' || l_orderkey::VARCHAR AS page_path
        FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01')
SELECT f6b.hash, page_path, c.content AS registry_content, c.content IS NOT NULL AS hit
FROM f6b LEFT JOIN c USING (hash)""",
    "JN1",
)
def registry_lookup(t):
    occ = media_occurrences(t)
    known = R.registry_build(occ.filter(F.col("ts") < F.lit("1998-06-01").cast("timestamp_ntz")))
    refs = occ.filter(F.col("ts") >= F.lit("1998-06-01").cast("timestamp_ntz")).select("hash", "page_path").distinct()
    return R.registry_lookup(refs, known).select("hash", "page_path", "registry_content", "hit")
