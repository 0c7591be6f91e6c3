"""Media registry: content-hash deduplication as grouped aggregates.

The registry is a *normalised* pair of tables instead of one JSON map:
  occurrences(hash, page_path, original_url, ts, …)   fact table, one row per use
  media_contents(hash PK, type, content, first_processed, last_used, n, api_cost)
Occurrence lists are never collected into one row (a site logo may be a third
of all rows); consumers read the occurrence table, keyed and ordered by ts.

Skew: every aggregate below is an aggregate with a partial (map-side) phase, so
a hot hash is pre-combined in every task before the shuffle; the only
per-group ordering is a `min`, which also combines partially. `media_duplicates` deals the hashes that aren't hot
to tasks whole, in one shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["ts", "tie1", "tie2", "tie3"]


def _order_key(df: DataFrame, order: list[str]):
    return F.struct(*[c for c in order if c in df.columns])


#: A hash with more rows is hot: its rows are not brought to one task.
HOT_ROWS = 100_000

PAYLOAD = ["type", "original_url", "content", "api_cost"]


def distinct_occurrences(occ: DataFrame, order: list[str] = ORDER, payload: list[str] = PAYLOAD) -> DataFrame:
    """One occurrence per (hash, page_path): the first by `order`; `last_ts` keeps
    the latest use of that pair (registering again bumps `lastUsed`). Only the
    registry's own columns travel through the aggregation."""
    # one struct that is ordered by its first fields: `min_by` would send these twice. Rows alike in them go by the payload
    first = [c for c in order if c in occ.columns] + [c for c in payload if c in occ.columns]
    return occ.groupBy("hash", "page_path").agg(
        F.min(F.struct(*first)).alias("first"),
        F.max("ts").alias("last_ts"),
    ).select("hash", "page_path", "first.*", "last_ts")


def registry_build(occ: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """media_contents: per hash, the first registration's type/content/cost,
    first/last use and the number of distinct pages using it."""
    return contents_of(distinct_occurrences(occ, order, ["type", "content", "api_cost"]), order)


def contents_of(d: DataFrame, order: list[str] = ORDER) -> DataFrame:
    """media_contents of distinct occurrences."""
    return d.groupBy("hash").agg(
        F.min_by(F.struct("type", "content", "api_cost"), _order_key(d, order)).alias("e"),
        F.min("ts").alias("first_processed"),
        F.max("last_ts").alias("last_used"),
        F.count(F.lit(1)).alias("n_occurrences"),
    ).select(
        "hash",
        F.col("e.type").alias("type"),
        F.col("e.content").alias("content"),
        "first_processed",
        "last_used",
        "n_occurrences",
        F.col("e.api_cost").alias("api_cost"),
    )


def registry_stats(contents: DataFrame) -> DataFrame:
    """Per type and overall ('all'): files, unique files, duplicates = Σ max(0, n−1),
    total API cost. One grouping-sets aggregate over the (small) per-hash table."""
    out = contents.rollup("type").agg(
        F.sum("n_occurrences").cast("bigint").alias("total_files"),
        F.count(F.lit(1)).cast("bigint").alias("unique_files"),
        F.sum(F.greatest(F.col("n_occurrences") - 1, F.lit(0))).cast("bigint").alias("duplicate_count"),
        F.round(F.sum(F.coalesce("api_cost", F.lit(0.0))), 9).alias("total_api_cost"),
        F.grouping("type").alias("g"),
    )
    out = out.select(
        F.when(F.col("g") == 1, F.lit("all")).otherwise(F.col("type")).alias("type"),
        "total_files", "unique_files", "duplicate_count", "total_api_cost",
    )
    # An empty registry still reports its zero totals (the roll-up of no rows
    # has no grand-total row); the roll-up has at most three rows, so this
    # final union + group is tiny.
    zero = contents.sparkSession.createDataFrame([("all", 0, 0, 0, 0.0)], out.schema)
    return out.unionByName(zero).groupBy("type").agg(
        F.sum("total_files").cast("bigint").alias("total_files"),
        F.sum("unique_files").cast("bigint").alias("unique_files"),
        F.sum("duplicate_count").cast("bigint").alias("duplicate_count"),
        F.round(F.sum("total_api_cost"), 9).alias("total_api_cost"),
    )


def media_duplicates(occ: DataFrame, order: list[str] = ORDER, hot_rows: int = HOT_ROWS) -> DataFrame:
    """`findDuplicates` for every content at once: the distinct occurrences of each
    hash used on more than one page, with the group size. Rows, not pairs and
    not lists: the consumer orders by (hash, ts).

    One shuffle by hash brings together all that a hash's rows and its size need. Hot hashes are counted beforehand
    and go another way: by hash and page, with a map-side phase, and then to their sizes, of which there are few."""
    occ = occ.select("hash", "page_path", *(c for c in order if c in occ.columns), "original_url").where(F.col("hash").isNotNull())
    hot = F.broadcast(occ.groupBy("hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows).select("hash"))  # at most a row per `hot_rows`
    size = F.count(F.lit(1)), F.max("ts")

    w = Window.partitionBy("hash")
    few = distinct_occurrences(occ.join(hot, "hash", "left_anti").repartition("hash"), order, ["original_url"])
    few = few.select("*", size[0].over(w).alias("n_occurrences"), size[1].over(w).alias("_t"))
    many = distinct_occurrences(occ.join(hot, "hash", "left_semi"), order, ["original_url"])
    many = many.join(F.broadcast(many.groupBy("hash").agg(size[0].alias("n_occurrences"), size[1].alias("_t"))), "hash")
    found = few.unionByName(many).where((F.col("n_occurrences") > 1) & F.col("_t").isNotNull())
    return found.select("hash", "page_path", "original_url", F.col("ts").alias("first_ts"), "n_occurrences")


def registry_lookup(refs: DataFrame, contents: DataFrame) -> DataFrame:
    """Content lookup by hash: hit → the stored content is reused."""
    c = contents.select("hash", F.col("content").alias("registry_content"))
    return refs.join(c, "hash", "left").withColumn("hit", F.col("registry_content").isNotNull())
