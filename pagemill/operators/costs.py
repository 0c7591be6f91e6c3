"""Model cost accounting: usage × price list, roll-ups, spend guard.

Money is summed as exact decimal nano-USD and turned into USD only at the end,
so the totals do not depend on the order in which partitions are summed. A call
whose model is not in the price list has no cost: its `cost_nano` is NULL and its
`price_status` is `unknown_model`, and reports count such calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.operators.ordering import running_total

# Price list (USD) of the configured models.
PRICES = [
    # model, input per 1K tokens, output per 1K tokens, per audio minute
    ("gpt-4o", 0.005, 0.015, None),
    ("gpt-4o-mini", 0.00015, 0.0006, None),
    ("whisper-1", None, None, 0.006),
]
PRICES_DDL = "model STRING, input_per_1k DOUBLE, output_per_1k DOUBLE, per_minute DOUBLE"

# Spend guard thresholds (USD).
WARN_USD = 10.0
STOP_USD = 50.0


def prices_df(spark: SparkSession, prices=PRICES) -> DataFrame:
    return spark.createDataFrame(prices, PRICES_DDL)


#: Nano-USD with six more digits.
NANO = "decimal(28,6)"


def usd(nano: Column) -> Column:
    return nano.cast("double") / F.lit(1e9)


def usd4_text(nano: Column) -> Column:
    """`cost.toFixed(4)` computed exactly (half-up) from integer or decimal nano-USD, no float formatting."""
    c4 = F.floor((nano + F.lit(50000)) / F.lit(100000)).cast("bigint")
    return F.concat(
        F.floor(c4 / 10000).cast("bigint").cast("string"), F.lit("."), F.lpad((c4 % 10000).cast("string"), 4, "0")
    )


#: Price lists are configuration: one row per model. More rows than this are an error, not a broadcast.
MAX_MODELS = 10_000


def priced_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage ⋈ prices on model; cost_nano per call (DECIMAL), NULL for a model
    without a price. The price list is checked to be config-sized before it is
    broadcast."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    exact = lambda c, factor: F.coalesce(F.col(c), F.lit(0.0)).cast("decimal(20,12)") * F.lit(factor).cast("decimal(12,0)")
    p = prices.select(
        "model",
        exact("input_per_1k", 10**6).cast("decimal(28,9)").alias("in_nano"),
        exact("output_per_1k", 10**6).cast("decimal(28,9)").alias("out_nano"),
        (exact("per_minute", 10**9) / F.lit(60).cast("decimal(2,0)")).cast("decimal(28,9)").alias("sec_nano"),
        F.assert_true(n <= MAX_MODELS, F.lit("the price list is not config-sized")).alias("_checked"),
    )
    p = p.filter(F.col("_checked").isNull()).drop("_checked")
    u = usage.join(F.broadcast(p), "model", "left")
    tokens = F.col("prompt_tokens").cast("decimal(19,0)") * F.col("in_nano") + F.col("completion_tokens").cast("decimal(19,0)") * F.col("out_nano")
    audio = F.col("seconds").cast("decimal(18,6)") * F.col("sec_nano")
    return u.withColumns({
        "media_type": F.when(F.col("seconds") > 0, F.lit("audio")).otherwise(F.lit("image")),
        "price_status": F.when(F.col("in_nano").isNull(), F.lit("unknown_model")).otherwise(F.lit("priced")),
        "cost_nano": (tokens + audio).cast(NANO),
    })


def cost_by_page(priced: DataFrame) -> DataFrame:
    is_img = F.col("media_type") == "image"
    return priced.groupBy("page_id").agg(
        F.sum("prompt_tokens").cast("bigint").alias("prompt_tokens"),
        F.sum("completion_tokens").cast("bigint").alias("completion_tokens"),
        F.sum("seconds").alias("audio_seconds"),
        usd(F.coalesce(F.sum(F.when(is_img, F.col("cost_nano"))), F.lit(0))).alias("image_cost"),
        usd(F.coalesce(F.sum(F.when(~is_img, F.col("cost_nano"))), F.lit(0))).alias("audio_cost"),
        usd(F.coalesce(F.sum("cost_nano"), F.lit(0))).alias("total_cost"),
        F.count_if(F.col("price_status") == "unknown_model").cast("bigint").alias("unpriced_calls"),
    )


def _js_number(x: Column) -> Column:
    return F.when(x == F.floor(x), F.floor(x).cast("bigint").cast("string")).otherwise(x.cast("string"))


def cost_rollup(priced: DataFrame) -> DataFrame:
    """ROLLUP(page_id, media_type) with the reference's summary text per row."""
    # Fixed values below: the lines of the usage summary.
    r = priced.rollup("page_id", "media_type").agg(
        F.sum("prompt_tokens").cast("bigint").alias("prompt_tokens"),
        F.sum("completion_tokens").cast("bigint").alias("completion_tokens"),
        F.sum("seconds").alias("audio_seconds"),
        F.coalesce(F.sum(F.when(F.col("media_type") == "image", F.col("cost_nano"))), F.lit(0)).alias("img_nano"),
        F.coalesce(F.sum(F.when(F.col("media_type") == "audio", F.col("cost_nano"))), F.lit(0)).alias("aud_nano"),
        F.coalesce(F.sum("cost_nano"), F.lit(0)).alias("cost_nano"),
        F.grouping_id().alias("level"),
    )
    tokens = F.col("prompt_tokens") + F.col("completion_tokens")
    image_block = F.when(
        tokens > 0,
        F.concat(
            F.lit("\nImage Processing:\n  Prompt Tokens: "), F.col("prompt_tokens").cast("string"),
            F.lit("\n  Completion Tokens: "), F.col("completion_tokens").cast("string"),
            F.lit("\n  Total Tokens: "), tokens.cast("string"),
            F.lit("\n  Cost: $"), usd4_text(F.col("img_nano")), F.lit("\n"),
        ),
    ).otherwise(F.lit(""))
    audio_block = F.when(
        F.col("audio_seconds") > 0,
        F.concat(
            F.lit("\nAudio Processing:\n  Duration: "), _js_number(F.col("audio_seconds")),
            F.lit(" seconds\n  Cost: $"), usd4_text(F.col("aud_nano")), F.lit("\n"),
        ),
    ).otherwise(F.lit(""))
    summary = F.concat(
        F.lit("\nOpenAI API Usage Summary:\n------------------------\n"), image_block, audio_block,
        F.lit("\nTotal Cost: $"), usd4_text(F.col("cost_nano")), F.lit("\n"),
    )
    return r.select(
        "page_id", "media_type", F.col("level").cast("int").alias("level"), "prompt_tokens", "completion_tokens",
        "audio_seconds", usd(F.col("cost_nano")).alias("cost"), usd4_text(F.col("cost_nano")).alias("cost_text"),
        summary.alias("summary"),
    )


def run_report(run: DataFrame, priced: DataFrame) -> DataFrame:
    """The run's usage text in run order: run(site, i, url, page_id) → (site, i, url, text), one
    `=== URL i: url ===` block for every page that used a model."""
    per_page = cost_rollup(priced).filter((F.col("level") == 1) & F.col("page_id").isNotNull()).select("page_id", "summary")
    # The block's lines.
    text = F.concat(F.lit("\n=== URL "), F.col("i").cast("string"), F.lit(": "), F.col("url"), F.lit(" ===\n"), F.col("summary"), F.lit("\n"))
    return run.join(per_page, "page_id").select("site", "i", "url", text.alias("text"))


def cost_guard(priced: DataFrame, order: list[str] = ("ts", "media_hash"), warn_usd=WARN_USD, stop_usd=STOP_USD) -> DataFrame:
    """Running spend over the calls in `order`, with the guard level reached.
    A distributed prefix sum (`ordering.running_total`): days, then times, then
    two characters of the hash; a task orders the calls of one such slice. A call
    without a price adds nothing and keeps its NULL cost."""
    order = list(order)
    spent = priced.withColumn("_spent", F.coalesce("cost_nano", F.lit(0).cast(NANO)))
    ts, key = order
    levels = [F.to_date(ts), F.col(ts), F.struct(F.col(ts).alias("t"), F.substring(key, 1, 2).alias("k"))]
    running = running_total(spent, order, "_spent", "cum_nano", levels)
    cum = F.col("cum_nano")
    return running.select(
        *order, "page_id", "model", usd(F.col("cost_nano")).alias("cost"), usd(cum).alias("cumulative_cost"),
        F.when(cum >= F.lit(int(round(stop_usd * 1e9))), "stop")
        .when(cum >= F.lit(int(round(warn_usd * 1e9))), "warn").otherwise("ok").alias("guard_level"),
    )


def admitted_requests(requests: DataFrame, budget_usd: float = STOP_USD) -> DataFrame:
    """Which of the pending model requests (media_hash, n_pages, cost_nano) may be issued under a budget: those most pages
    wait for first (ties by hash), as long as their running cost stays within it. A request without a price adds
    nothing and is not issued. The running cost is a prefix sum over range runs, so no task orders them all."""
    d = requests.withColumns({"_last": -F.col("n_pages"), "_cost": F.coalesce("cost_nano", F.lit(0).cast(NANO))})
    d = running_total(d, ["_last", "media_hash"], "_cost", "_cum")
    within = F.col("_cum") <= F.lit(int(round(budget_usd * 1e9)))
    return d.select(
        "media_hash", "n_pages", usd(F.col("cost_nano")).alias("cost"), usd(F.col("_cum")).alias("cumulative_cost"),
        F.when(F.col("cost_nano").isNull(), "unpriced").when(within, "admit").otherwise("hold").alias("decision"),
    )


def audio_duration_estimate(media: DataFrame, bytes_col: str = "length") -> DataFrame:
    """Duration estimate of 1 MB per minute: seconds = bytes / 1048576 × 60."""
    return media.withColumn("est_seconds", F.col(bytes_col) / F.lit(1048576.0) * F.lit(60.0))
