"""Cost group (F7 usage from the F6 occurrences)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.operators import costs as C
from pagemill.operators.ordering import position_within
from pagemill.plans.catalog import register
from pagemill.plans.q_registry import f6
from pagemill.sources.derived import api_usage, media_occurrences


def _prices_values() -> str:
    def lit(v):
        return "NULL::DOUBLE" if v is None else f"{v!r}::DOUBLE"

    rows = ", ".join(f"('{m}', {lit(a)}, {lit(b)}, {lit(c)})" for m, a, b, c in C.PRICES)
    return f"prices_cfg AS (SELECT * FROM (VALUES {rows}) t(model, input_per_1k, output_per_1k, per_minute))"


PRICED = f"""{f6()},
u AS (SELECT page_id, hash AS media_hash, model, prompt_tokens, completion_tokens, seconds, ts FROM (
        SELECT *, row_number() OVER (PARTITION BY hash ORDER BY ts, tie1, tie2, tie3) AS rn FROM f6) WHERE rn = 1),
{_prices_values()},
pp AS (SELECT model, coalesce(input_per_1k, 0.0)::DECIMAL(20,12) * 1000000 AS in_nano,
              coalesce(output_per_1k, 0.0)::DECIMAL(20,12) * 1000000 AS out_nano,
              round(coalesce(per_minute, 0.0) * 1e9::DOUBLE / 60, 9)::DECIMAL(28,9) AS sec_nano FROM prices_cfg),
pr AS (SELECT u.*, CASE WHEN seconds > 0 THEN 'audio' ELSE 'image' END AS media_type, in_nano IS NULL AS unpriced,
              (prompt_tokens * in_nano + completion_tokens * out_nano + seconds::DECIMAL(12,4) * sec_nano::DECIMAL(18,4))::DECIMAL(28,6) AS cost_nano
       FROM u LEFT JOIN pp USING (model))"""


def usd4(n: str) -> str:
    c4 = f"floor(({n} + 50000) / 100000)::BIGINT"
    return f"(floor({c4} / 10000)::BIGINT::VARCHAR || '.' || lpad(({c4} % 10000)::VARCHAR, 4, '0'))"


def usd(n: str) -> str:
    return f"({n})::DOUBLE / 1e9::DOUBLE"


def _priced(t):
    return C.priced_usage(api_usage(t), C.prices_df(t.spark))


@register(
    "api_cost_by_page",
    f"""WITH {PRICED}
SELECT page_id, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
       sum(seconds) AS audio_seconds,
       {usd("sum(CASE WHEN media_type = 'image' THEN cost_nano ELSE 0 END)")} AS image_cost,
       {usd("sum(CASE WHEN media_type <> 'image' THEN cost_nano ELSE 0 END)")} AS audio_cost,
       {usd("sum(cost_nano)")} AS total_cost, count(*) FILTER (WHERE unpriced)::BIGINT AS unpriced_calls
FROM pr GROUP BY page_id""",
    "AGG4 AGG5 JN5 SRC13",
)
def api_cost_by_page(t):
    return C.cost_by_page(_priced(t))


def _js_number(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN floor({x})::BIGINT::VARCHAR ELSE {x}::VARCHAR END)"


@register(
    "cost_rollup",
    f"""WITH {PRICED},
r AS (SELECT page_id, media_type, GROUPING(page_id, media_type)::INT AS level,
             sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens,
             sum(seconds) AS audio_seconds,
             sum(CASE WHEN media_type = 'image' THEN cost_nano ELSE 0 END) AS img_nano,
             sum(CASE WHEN media_type = 'audio' THEN cost_nano ELSE 0 END) AS aud_nano,
             sum(cost_nano) AS cost_nano
      FROM pr GROUP BY ROLLUP (page_id, media_type))
SELECT page_id, media_type, level, prompt_tokens, completion_tokens, audio_seconds,
       {usd('cost_nano')} AS cost, {usd4('cost_nano')} AS cost_text,
       chr(10) || 'OpenAI API Usage Summary:' || chr(10) || '------------------------' || chr(10) ||
       CASE WHEN prompt_tokens + completion_tokens > 0 THEN
         chr(10) || 'Image Processing:' || chr(10) || '  Prompt Tokens: ' || prompt_tokens::VARCHAR ||
         chr(10) || '  Completion Tokens: ' || completion_tokens::VARCHAR ||
         chr(10) || '  Total Tokens: ' || (prompt_tokens + completion_tokens)::VARCHAR ||
         chr(10) || '  Cost: $' || {usd4('img_nano')} || chr(10) ELSE '' END ||
       CASE WHEN audio_seconds > 0 THEN
         chr(10) || 'Audio Processing:' || chr(10) || '  Duration: ' || {_js_number('audio_seconds')} || ' seconds' ||
         chr(10) || '  Cost: $' || {usd4('aud_nano')} || chr(10) ELSE '' END ||
       chr(10) || 'Total Cost: $' || {usd4('cost_nano')} || chr(10) AS summary
FROM r""",
    "AGG6 RPT2 X3 X4 X5",
)
def cost_rollup(t):
    return C.cost_rollup(_priced(t))


@register(
    "run_cost_report",
    f"""WITH {PRICED},
r AS (SELECT page_id, sum(prompt_tokens) AS pt, sum(completion_tokens) AS ct, sum(seconds) AS audio_seconds,
             sum(CASE WHEN media_type = 'image' THEN cost_nano ELSE 0 END) AS img_nano,
             sum(CASE WHEN media_type = 'audio' THEN cost_nano ELSE 0 END) AS aud_nano, sum(cost_nano) AS cost_nano FROM pr GROUP BY page_id),
o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders)
SELECT 'orders' AS site, i::BIGINT AS i, 'https://orders.example.com/' || o_orderkey::VARCHAR AS url,
       chr(10) || '=== URL ' || i::VARCHAR || ': https://orders.example.com/' || o_orderkey::VARCHAR || ' ===' || chr(10) ||
       chr(10) || 'OpenAI API Usage Summary:' || chr(10) || '------------------------' || chr(10) ||
       CASE WHEN pt + ct > 0 THEN chr(10) || 'Image Processing:' || chr(10) || '  Prompt Tokens: ' || pt::BIGINT::VARCHAR ||
         chr(10) || '  Completion Tokens: ' || ct::BIGINT::VARCHAR || chr(10) || '  Total Tokens: ' || (pt + ct)::BIGINT::VARCHAR ||
         chr(10) || '  Cost: $' || {usd4('img_nano')} || chr(10) ELSE '' END ||
       CASE WHEN audio_seconds > 0 THEN chr(10) || 'Audio Processing:' || chr(10) || '  Duration: ' || {_js_number('audio_seconds')} ||
         ' seconds' || chr(10) || '  Cost: $' || {usd4('aud_nano')} || chr(10) ELSE '' END ||
       chr(10) || 'Total Cost: $' || {usd4('cost_nano')} || chr(10) || chr(10) AS text
FROM r JOIN o ON o_orderkey = page_id""",
    "RPT2",
)
def run_cost_report(t):
    run = t.orders.select(F.lit("orders").alias("site"), F.col("o_orderkey").alias("page_id"),
                          F.concat(F.lit("https://orders.example.com/"), F.col("o_orderkey").cast("string")).alias("url"))
    k = F.col("page_id")
    run = position_within(run, ["site"], ["page_id"], levels=[F.floor(k / 1_000_000), F.floor(k / 10_000), F.floor(k / 100)])
    return C.run_report(run, _priced(t))


@register(
    "cost_guard",
    f"""WITH {PRICED},
c AS (SELECT *, sum(cost_nano) OVER (ORDER BY ts, media_hash ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM pr)
SELECT ts, media_hash, page_id, model, {usd('cost_nano')} AS cost, {usd('cum')} AS cumulative_cost,
       CASE WHEN cum >= {int(C.STOP_USD * 1e9)} THEN 'stop' WHEN cum >= {int(C.WARN_USD * 1e9)} THEN 'warn' ELSE 'ok' END AS guard_level
FROM c""",
    "AGG10 WIN5",
)
def cost_guard(t):
    return C.cost_guard(_priced(t))


@register(
    "requests_admitted",
    f"""WITH {PRICED},
n AS (SELECT hash AS media_hash, count(DISTINCT page_path)::BIGINT AS n_pages FROM f6 GROUP BY hash),
c AS (SELECT media_hash, n_pages, cost_nano, sum(coalesce(cost_nano, 0)) OVER (ORDER BY n_pages DESC, media_hash ROWS UNBOUNDED PRECEDING) AS cum
      FROM pr JOIN n USING (media_hash))
SELECT media_hash, n_pages, {usd('cost_nano')} AS cost, {usd('cum')} AS cumulative_cost,
       CASE WHEN cost_nano IS NULL THEN 'unpriced' WHEN cum <= {int(C.STOP_USD * 1e9)} THEN 'admit' ELSE 'hold' END AS decision
FROM c""",
    "AGG10 MED7",
)
def requests_admitted(t):
    waiting = media_occurrences(t).groupBy("hash").agg(F.count_distinct("page_path").cast("bigint").alias("n_pages"))
    priced = _priced(t).select("media_hash", "cost_nano")
    return C.admitted_requests(priced.join(waiting, priced["media_hash"] == waiting["hash"]).select("media_hash", "n_pages", "cost_nano"))


@register(
    "audio_cost_estimate",
    f"""SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes,
       octet_length(encode(text)) / 1048576.0::DOUBLE * 60.0::DOUBLE AS est_seconds,
       {usd("round(octet_length(encode(text)) / 1048576.0::DOUBLE * 60.0::DOUBLE * 100000)::BIGINT")} AS est_cost
FROM documents""",
    "MED10 AGG5",
)
def audio_cost_estimate(t):
    # Every document's bytes stand in for a clip of that size (whole table).
    docs = t.documents.select("doc_id", F.octet_length("text").cast("bigint").alias("bytes"))
    est = C.audio_duration_estimate(docs, "bytes")
    return est.select(
        "doc_id", "bytes", "est_seconds",
        C.usd(F.round(F.col("est_seconds") * 100000).cast("bigint")).alias("est_cost"),
    )
