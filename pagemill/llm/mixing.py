"""Mixing sources to target weights (operator 6): Efraimidis-Spirakis sampling.

Every document draws an exponential key `-ln(u) / weight`, where `u` is a hash of its
id and `weight` its quality weight. Within a source, documents in ascending key order
are prefix-summed against the source's token budget; full epochs over the whole source
come first, the fractional remainder takes the documents whose prefix sum stays within
it (the last one is taken if that comes nearer to the budget than leaving it).

Nothing is sorted globally: keys fall into `buckets` equal slices of their range, the
per-(source, bucket) sums give the one bucket in which a source's remainder ends, and
only documents of that bucket are ordered. All other rows are decided where they are
read. Keys depend on the id alone, so reruns and recomputed tasks agree.

Defined results: null text counts 0 words; null source is a source of its own, last in
order; null or non-positive weights count as the smallest positive double; rows with the
same id are separate rows (ties go by size); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import guarded

#: Relative weights dealt to the sources in code-point order, repeating.
SOURCE_WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3.0
BUCKETS = 4096
#: Buckets of a run; a task that searches a source's sums sees at most BUCKETS / COARSE or COARSE of them.
COARSE = 64


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` runs; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = SOURCE_WEIGHTS, share: float = 1.0, cap: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> target: `share` of all sizes split by weight, no target above
    `cap` times its source. The level that resharing converges to is found by sorting the
    sources by the level at which they fill up; one row per source."""
    everything = Window.partitionBy()
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % n + 1).cast("int")))
    s = s.withColumn("_cap", F.col("source_size") * cap).withColumn("_full", F.col("_cap") / F.col("_w"))
    order = Window.orderBy("_full", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_left", F.sum("source_size").over(everything) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_wleft", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_at", F.row_number().over(order)).withColumn("_level", F.col("_left") / F.col("_wleft"))
    s = s.withColumn("_level", F.min_by("_level", F.when(F.col("_level") <= F.col("_full"), F.col("_at"))).over(everything))
    return s.select("source", "source_size", F.coalesce(F.least("_cap", F.col("_level") * F.col("_w")), F.col("_cap")).alias("target"))


def _crossing(sums: DataFrame, slot: str, base: Column) -> DataFrame:
    """Per source the slot in which the prefix sums of `_sum` (on top of `base`) reach `_rest`, with the sum `_before` it."""
    before = Window.partitionBy("_skey").orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    s = sums.withColumn("_before", base + F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    s = s.where((F.col("_before") < F.col("_rest")) & (F.col("_rest") <= F.col("_before") + F.col("_sum")))
    return s.groupBy("_skey").agg(F.min(slot).alias(slot), F.min_by("_before", slot).alias("_before"))


def mix(docs: DataFrame, size: str = "size", source: str = "source", doc_id: str = "doc_id", weight: str | None = None,
        seed: int = 42, weights: tuple[float, ...] = SOURCE_WEIGHTS, cap: float = MAX_EPOCHS, buckets: int = BUCKETS) -> DataFrame:
    """`docs` with `_source_size`, `_target` and `_copies` (how often the mix takes the row). Columns of these names are
    kept beside them."""
    known = (size, source, doc_id, *([weight] if weight else []))
    return guarded(docs, known, lambda d: _mix(d, size, source, doc_id, weight, seed, weights, cap, buckets))


def _mix(docs: DataFrame, size: str, source: str, doc_id: str, weight: str | None, seed: int, weights: tuple[float, ...], cap: float, buckets: int) -> DataFrame:
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(1.0)), F.lit(1e-300)) if weight else F.lit(1.0)
    d = docs.withColumn("_key", -F.log(u) / w)
    d = d.withColumn("_bucket", F.least(F.floor((1 - F.exp(-F.col("_key"))) * buckets), F.lit(buckets - 1)).cast("int"))
    d = d.withColumn("_skey", _source_key(F.col(source)))

    sums = d.groupBy("_skey", F.col(source).alias("source"), "_bucket").agg(F.sum(size).alias("_sum"))
    totals = sums.groupBy("_skey", "source").agg(F.sum("_sum").alias("source_size"))
    goal = targets(totals.select("source", "source_size"), weights, cap=cap)
    goal = goal.withColumn("_skey", _source_key(F.col("source"))).withColumn(
        "_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(1)).cast("int"))
    goal = goal.withColumn("_rest", F.when(F.col("source_size") > 0, F.col("target") - F.col("_epochs") * F.col("source_size")).otherwise(F.lit(0.0)))
    # the bucket in which a source's remainder ends: first among runs of COARSE buckets, then within one run
    fine = sums.join(goal.select("_skey", "_rest"), "_skey").withColumn("_run", F.floor(F.col("_bucket") / COARSE).cast("int"))
    runs = fine.groupBy("_skey", "_rest", "_run").agg(F.sum("_sum").alias("_sum"))
    run = _crossing(runs, "_run", F.lit(0)).select("_skey", "_run", F.col("_before").alias("_base"))
    cut = _crossing(fine.join(run, ["_skey", "_run"]), "_bucket", F.col("_base")).select("_skey", F.col("_bucket").alias("_cut"), "_before")
    plan = goal.join(cut, "_skey", "left").select(
        "_skey", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "_epochs", "_rest",
        F.coalesce("_cut", F.lit(-1)).alias("_cut"), F.coalesce("_before", F.lit(0)).alias("_before"))

    d = d.join(plan, "_skey")
    sure = d.where(F.col("_bucket") != F.col("_cut")).withColumn("_copies", F.col("_epochs") + (F.col("_bucket") < F.col("_cut")).cast("int"))
    run = Window.partitionBy("_skey").orderBy("_key", doc_id, size).rowsBetween(Window.unboundedPreceding, -1)
    edge = d.where(F.col("_bucket") == F.col("_cut"))
    edge = edge.withColumn("_copies", F.col("_epochs") + (
        F.col("_before") + F.coalesce(F.sum(size).over(run), F.lit(0)) + F.col(size) / 2 < F.col("_rest")).cast("int"))
    keep = [*docs.columns, "_source_size", "_target", "_copies"]
    return sure.select(*keep).unionByName(edge.select(*keep))
