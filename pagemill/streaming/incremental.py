"""Structured Streaming forms of the re-run behaviour.

* `start_page_stream` (INC1): captures arriving as files → newest usable capture per URL in each micro-batch →
  converted pages, kept as runs (`streaming.runs`); merging keeps the newest capture of each URL, however late it
  came, so `current_pages` reads a bounded number of versions of a URL.
* `start_registry_stream` (INC3): media occurrences arriving as files → a batch's distinct (item, page) pairs, kept as
  runs: a batch writes rows in proportion to itself, not to the registry. Merging is the aggregate that made
  them. The state is the table itself, not stream state, so nothing expires and batch ≡ stream.

A batch that is run again changes nothing. Checkpoints go to the caller's folder, which on a cluster must be the shared
checkpoint location (see `pagemill.session.checkpoint_dir`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators import crawl as C
from pagemill.operators import pages as P
from pagemill.operators import registry as R
from pagemill.schemas import CAPTURES
from pagemill.streaming import runs


def start_page_stream(spark: SparkSession, captures_dir: str, out: str, checkpoint: str, run_date: str,
                      available_now: bool = True, fanout: int = runs.FANOUT):
    src = spark.readStream.schema(CAPTURES).parquet(captures_dir)

    def convert(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # the batch's files are read once
        try:
            latest = C.latest_capture(batch).select(F.md5("url").alias("page_id"), "url", "fetched_at", "html")
            docs = P.page_document(latest, run_date).join(latest.select("url", "fetched_at"), "url")
            runs.add(docs.withColumn("batch_id", F.lit(batch_id).cast("bigint")), out, batch_id + 1, newest_pages, fanout)
        finally:
            batch.unpersist()

    w = src.writeStream.foreachBatch(convert).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def newest_pages(versions: DataFrame) -> DataFrame:
    """The newest version of every URL: picked from its time and batch alone, then its row is fetched, so old versions'
    texts are not shuffled."""
    best = versions.groupBy("url").agg(F.max(F.struct("fetched_at", "batch_id")).alias("b")).select("url", "b.*")
    return versions.join(best, ["url", "fetched_at", "batch_id"])


def current_pages(spark: SparkSession, out: str) -> DataFrame | None:
    """Newest converted version of every URL across all batches."""
    return runs.read(spark, out, newest_pages)


def merged_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct occurrences of several batches as one: of a pair the earlier use stays and the last use moves on."""
    # order columns and payload are kept with the pairs, so that merging is the same aggregate again
    order = [c for c in R.ORDER if c in pairs.columns]
    fields = [c for c in pairs.columns if c not in ("hash", "page_path", "last_ts")]
    both = pairs.groupBy("hash", "page_path").agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("f"), F.max("last_ts").alias("last_ts"))
    return both.select("hash", "page_path", "f.*", "last_ts")


def start_registry_stream(spark: SparkSession, occ_dir: str, schema: str, base: str, checkpoint: str, available_now: bool = True, fanout: int = runs.FANOUT):
    """Keep the registry's pairs under `base` as runs, one for every micro-batch (`streamed_registry` reads them)."""
    src = spark.readStream.schema(schema).parquet(occ_dir)

    def merge(batch: DataFrame, batch_id: int) -> None:
        runs.add(R.distinct_occurrences(batch), base, batch_id + 1, merged_pairs, fanout)

    w = src.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def streamed_registry(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame] | None:
    """(media_contents, distinct occurrences) of what the stream has brought so far; `writers.save_registry_version`
    keeps a copy of it as a version."""
    pairs = runs.read(spark, base, merged_pairs)
    return None if pairs is None else (R.contents_of(pairs), pairs)
