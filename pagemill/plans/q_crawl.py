"""Crawl group (F8 capture attempts from events)."""

from __future__ import annotations


from pagemill.functions.urls import host
from pagemill.operators import crawl as C
from pagemill.plans import duck as D
from pagemill.plans.catalog import register
from pagemill.sources.derived import CHALLENGE_LITERALS, captures

F8 = """f8 AS (
  SELECT 'https://site' || (user_id % 12)::VARCHAR || '.example.com/user/' || user_id::VARCHAR || '/p' || (event_id % 16)::VARCHAR AS url,
         ts AS fetched_at, event_id AS attempt,
         CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 200 WHEN 'signup' THEN 404
                         WHEN 'purchase' THEN 429 WHEN 'error' THEN 503 END::INT AS status,
         CASE WHEN user_id % 2 = 0 THEN 'cloudflare' ELSE 'nginx' END AS server,
         CASE WHEN event_type = 'view' AND event_id % 10 = 0
                THEN '<html><head><title>Just a moment...</title></head><body><div id="challenge-platform"></div></body></html>'
              WHEN event_type IN ('view', 'click')
                THEN '<!DOCTYPE html><html><head><title>User ' || user_id::VARCHAR || '</title></head><body><article><h1>Event ' ||
                     event_id::VARCHAR || '</h1><p>' || props || '</p></article></body></html>'
              ELSE '<html><body>Error ' || (CASE event_type WHEN 'signup' THEN 404 WHEN 'purchase' THEN 429 ELSE 503 END)::VARCHAR || '</body></html>'
         END AS html
  FROM events)"""

CHALLENGE = " OR ".join(f"contains(html, {D.q(x)})" for x in CHALLENGE_LITERALS)
OUTCOME = """CASE WHEN {ch} THEN 'challenge' WHEN status BETWEEN 200 AND 299 THEN 'ok'
     WHEN status = 403 AND lower(server) = 'cloudflare' THEN 'blocked' WHEN status = 429 THEN 'rate_limited'
     WHEN status >= 500 THEN 'server_error' WHEN status >= 400 THEN 'client_error' WHEN status >= 300 THEN 'redirect' ELSE 'informational' END"""

LATEST = f"""latest AS (
  SELECT url, arg_max(fetched_at, (fetched_at, attempt)) AS fetched_at,
         arg_max(attempt, (fetched_at, attempt)) AS attempt, arg_max(status, (fetched_at, attempt)) AS status,
         arg_max(length(html), (fetched_at, attempt))::BIGINT AS html_chars, arg_max(html, (fetched_at, attempt)) AS html
  FROM f8 WHERE status BETWEEN 200 AND 299 AND NOT ({CHALLENGE}) GROUP BY url)"""

STATUS = f"""{LATEST},
last AS (SELECT url, arg_max(status, (fetched_at, attempt)) AS status, arg_max(server, (fetched_at, attempt)) AS server,
                arg_max({CHALLENGE}, (fetched_at, attempt)) AS challenge FROM f8 GROUP BY url),
st AS (
  SELECT url, true AS ok, NULL::VARCHAR AS error FROM latest
  UNION ALL
  SELECT url, false, CASE WHEN {OUTCOME.replace('{ch}', 'challenge')} = 'challenge' THEN 'Challenge page detected'
                          WHEN {OUTCOME.replace('{ch}', 'challenge')} = 'blocked' THEN 'Error 403: Access blocked'
                          WHEN {OUTCOME.replace('{ch}', 'challenge')} = 'rate_limited' THEN 'Error 429: Rate limited'
                          ELSE 'Error ' || status::VARCHAR END
  FROM last WHERE url NOT IN (SELECT url FROM latest)),
sts AS (SELECT *, {D.host('url')} AS site FROM st)"""


@register(
    "challenge_flag",
    f"WITH {F8} SELECT url, attempt, ({CHALLENGE}) AS is_challenge FROM f8",
    "FLT1",
)
def challenge_flag(t):
    c = captures(t)
    return c.select("url", "attempt", C.is_challenge("html").alias("is_challenge"))


@register(
    "fetch_outcome",
    f"""WITH {F8}, o AS (SELECT *, {OUTCOME.replace('{ch}', '(' + CHALLENGE + ')')} AS outcome,
                               ({CHALLENGE}) AS ch FROM f8)
SELECT url, attempt, status, outcome, status < 500 AS accepted_by_status, (ch OR status = 403) AS browser_fallback,
       (CASE WHEN outcome = 'ok' THEN 0 WHEN outcome = 'rate_limited' THEN {2 * C.WAIT_MS} ELSE {C.WAIT_MS} END)::BIGINT AS retry_after_ms
FROM o""",
    "FLT7 X13",
)
def fetch_outcome(t):
    return C.fetch_outcome(captures(t))


@register(
    "latest_capture",
    f"WITH {F8}, {LATEST} SELECT url, fetched_at, attempt, status, html_chars, html FROM latest",
    "SRC1 WIN4",
)
def latest_capture(t):
    return C.latest_capture(captures(t))


@register(
    "crawl_hits",
    f"WITH {F8}, {LATEST} SELECT DISTINCT url FROM f8 WHERE url IN (SELECT url FROM latest)",
    "SRC2 JN4",
)
def crawl_hits(t):
    c = captures(t)
    hits, _todo = C.crawl_split(c.select("url").distinct(), C.usable_captures(c).select("url"))
    return hits


@register(
    "crawl_todo",
    f"WITH {F8}, {LATEST} SELECT DISTINCT url FROM f8 WHERE url NOT IN (SELECT url FROM latest)",
    "SRC2 JN4 SET3 INC1",
)
def crawl_todo(t):
    c = captures(t)
    _hits, todo = C.crawl_split(c.select("url").distinct(), C.usable_captures(c).select("url"))
    return todo


@register(
    "crawl_progress",
    f"""WITH {F8}, u AS (SELECT DISTINCT {D.host('url')} AS site, url FROM f8),
r AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY url)::BIGINT AS i,
             count(*) OVER (PARTITION BY site)::BIGINT AS n FROM u),
p AS (SELECT *, floor((i * 2000 + n) / (n * 2))::BIGINT AS p10 FROM r)
SELECT site, url, i, n, i::VARCHAR || '/' || n::VARCHAR || ' (' || floor(p10 / 10)::BIGINT::VARCHAR || '.' ||
       (p10 % 10)::VARCHAR || '%)' AS progress FROM p""",
    "WIN1",
)
def crawl_progress(t):
    u = captures(t).select(host("url").alias("site"), "url").distinct()
    return C.crawl_progress(u)


@register(
    "site_summary",
    f"""WITH {F8}, {STATUS}
SELECT site, count(*) FILTER (WHERE ok)::BIGINT AS succeeded, count(*) FILTER (WHERE NOT ok)::BIGINT AS failed,
       count(*)::BIGINT AS total FROM sts GROUP BY site""",
    "AGG7 SET2 RPT3",
)
def site_summary(t):
    return C.site_summary(C.crawl_status(captures(t)))


@register(
    "failure_report",
    f"""WITH {F8}, {STATUS}
SELECT site, row_number() OVER (PARTITION BY site ORDER BY url)::BIGINT AS n, url, error,
       {2 * C.TIMEOUT_MS}::BIGINT AS retry_timeout_ms, 'retry "' || url || '" --timeout={2 * C.TIMEOUT_MS}' AS retry_command
FROM sts WHERE NOT ok""",
    "RPT1 X26",
)
def failure_report(t):
    return C.failure_report(C.crawl_status(captures(t)))
