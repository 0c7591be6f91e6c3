"""Crawl bookkeeping over a capture log: challenge detection, attempt outcome,
newest usable capture per URL, cache hits / to-do lists, progress and reports.

`captures(url, fetched_at, attempt, status, server, html)` is the table form of
the fetcher's cache; fetching itself stays outside Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.urls import host
from pagemill.operators.ordering import position_within
from pagemill.sources.derived import CHALLENGE_LITERALS

# Fixed values (ms): challenge wait and page timeout from the configuration.
WAIT_MS = 15000
TIMEOUT_MS = 60000


def is_challenge(html) -> Column:
    h = F.col(html) if isinstance(html, str) else html
    cond = F.lit(False)
    for lit in CHALLENGE_LITERALS:
        cond = cond | h.contains(lit)
    return cond


# Fixed value: the `server` header value that marks a blocking proxy on a 403.
BLOCKING_SERVER = "cloudflare"


def outcome(status: Column, server: Column, challenge: Column) -> Column:
    return (
        F.when(challenge, "challenge")
        .when(status.between(200, 299), "ok")
        .when((status == 403) & (F.lower(server) == BLOCKING_SERVER), "blocked")
        .when(status == 429, "rate_limited")
        .when(status >= 500, "server_error")
        .when(status >= 400, "client_error")
        .when(status >= 300, "redirect")
        .otherwise("informational")
    )


def fetch_outcome(captures: DataFrame, wait_ms: int = WAIT_MS) -> DataFrame:
    ch = is_challenge("html")
    oc = outcome(F.col("status"), F.col("server"), ch)
    return captures.select(
        "url", "attempt", "status",
        oc.alias("outcome"),
        (F.col("status") < 500).alias("accepted_by_status"),
        (ch | (F.col("status") == 403)).alias("browser_fallback"),
        F.when(oc == "ok", F.lit(0)).when(oc == "rate_limited", F.lit(2 * wait_ms)).otherwise(F.lit(wait_ms))
        .cast("bigint").alias("retry_after_ms"),
    )


def usable_captures(captures: DataFrame) -> DataFrame:
    return captures.filter(F.col("status").between(200, 299) & ~is_challenge("html"))


def latest_capture(captures: DataFrame) -> DataFrame:
    """Newest usable (2xx, not a challenge) capture per URL, with its HTML. The winner
    is picked from its time and attempt number alone (a partially aggregated
    group-by, so a URL with very many attempts is combined in every map task);
    only the winners' HTML is fetched afterwards. `attempt` is unique per URL."""
    usable = usable_captures(captures)
    best = usable.groupBy("url").agg(F.max(F.struct("fetched_at", "attempt")).alias("b")).select("url", "b.*")
    return usable.join(best, ["url", "fetched_at", "attempt"]).select(
        "url", "fetched_at", "attempt", "status", F.length("html").cast("bigint").alias("html_chars"), "html"
    )


def crawl_split(requested: DataFrame, cached: DataFrame, key: str = "url"):
    """(hits, todo): semi- and anti-join of the requested URLs with the cache."""
    c = cached.select(key).distinct()
    return requested.join(c, key, "left_semi"), requested.join(c, key, "left_anti")


def crawl_status(captures: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """One row per URL: site, ok flag and, for failures, the error of the last
    attempt. One aggregation per URL yields both whether any attempt is usable and
    the last attempt. With `requested(url)` there is a row for every requested
    URL, also for those that were never captured."""
    ch = is_challenge("html")
    usable = F.col("status").between(200, 299) & ~ch
    per_url = captures.groupBy("url").agg(
        F.bool_or(F.coalesce(usable, F.lit(False))).alias("ok"),
        F.max(F.struct("fetched_at", "attempt", "status", "server", ch.alias("challenge"))).alias("last"),
    )
    if requested is not None:
        per_url = requested.select("url").distinct().join(per_url, "url", "left")
    oc = outcome(F.col("last.status"), F.col("last.server"), F.col("last.challenge"))
    err = (
        F.when(F.col("last").isNull(), F.lit("Not captured"))
        .when(oc == "challenge", F.lit("Challenge page detected"))
        .when(oc == "blocked", F.lit("Error 403: Access blocked"))
        .when(oc == "rate_limited", F.lit("Error 429: Rate limited"))
        .otherwise(F.concat(F.lit("Error "), F.col("last.status").cast("string")))
    )
    ok = F.coalesce("ok", F.lit(False))
    return per_url.select("url", ok.alias("ok"), F.when(~ok, err).alias("error"), host("url").alias("site"))


def site_summary(status: DataFrame) -> DataFrame:
    return status.groupBy("site").agg(
        F.count_if(F.col("ok")).cast("bigint").alias("succeeded"),
        F.count_if(~F.col("ok")).cast("bigint").alias("failed"),
        F.count(F.lit(1)).cast("bigint").alias("total"),
    )


def failure_report(status: DataFrame, timeout_ms: int | None = None, order: list[str] = ("url",), levels: list[Column] | None = None) -> DataFrame:
    """Failed URLs numbered per site in `order` (by URL, or by the position that the run gave
    them), with the retry suggestion: twice the timeout in force (the configured
    page timeout when none was given)."""
    retry = 2 * (timeout_ms if timeout_ms is not None else TIMEOUT_MS)
    f = position_within(status.filter(~F.col("ok")), ["site"], list(order), out="n", levels=levels)
    return f.select(
        "site", "n", "url", "error",
        F.lit(retry).cast("bigint").alias("retry_timeout_ms"),
        F.concat(F.lit("retry \""), F.col("url"), F.lit(f"\" --timeout={retry}")).alias("retry_command"),
    )


def crawl_progress(urls: DataFrame, site_col: str = "site", order_col: str = "url") -> DataFrame:
    """`i/n (p%)` per URL within its site (skew-safe numbering, see `ordering`)."""
    df = position_within(urls.select(site_col, order_col), [site_col], [order_col], out="i", total="n")
    p10 = F.floor((F.col("i") * 2000 + F.col("n")) / (F.col("n") * 2)).cast("bigint")
    pct = F.concat(F.floor(p10 / 10).cast("bigint").cast("string"), F.lit("."), (p10 % 10).cast("string"))
    return df.select(site_col, order_col, "i", "n").withColumn(
        "progress", F.concat(F.col("i").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" ("), pct, F.lit("%)"))
    )
