"""Order-dependent numbering without putting a whole group into one task.

A plain `row_number()` / running `sum()` window moves every row of a group (or,
without PARTITION BY, of the whole table) into a single task. Here the rows are cut into
slices that follow the order, counted per slice with a map-side phase, offset by prefix
sums over those counts, and only the rows of one slice are ordered in one task.

Slices are either `levels` named by the caller (columns, coarse to fine, that are
monotone in the order: a date and then the timestamp), functions of the key alone, so that
the plan is lazy; or runs: range partitions of the rows, written once, which hold about as many
rows each whatever the keys look like.
The result equals the global window (tests/test_skew.py).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.session import ensure_checkpoint_dir


def _offsets(df: DataFrame, group: list[str], names: list[str], value: Column, out: str) -> DataFrame:
    """(group, levels) → `out`: sum of `value` over all earlier slices of the group."""
    table = df.groupBy(*group, *names).agg(F.sum(value).alias("_sum"))
    total = None
    for k in range(len(names), 0, -1):
        keys = group + names[:k]
        at = table if k == len(names) else table.groupBy(*keys).agg(F.sum("_sum").alias("_sum"))
        w = Window.partitionBy(*group, *names[: k - 1]).orderBy(names[k - 1]).rowsBetween(Window.unboundedPreceding, -1)
        at = at.select(*keys, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias(f"_before{k}"))
        total = at if total is None else _join(total, at, keys)
    return total.select(*group, *names, sum(F.col(f"_before{k}") for k in range(1, len(names) + 1)).alias(out))


def _join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on `keys` that also matches nulls."""
    r = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
    cond = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(r, cond).drop(*(f"_r_{k}" for k in keys))


def _sliced(df: DataFrame, levels: list[Column]) -> tuple[DataFrame, list[str]]:
    names = [f"_l{k}" for k in range(len(levels))]
    return df.withColumns(dict(zip(names, levels))), names


def position_within(df: DataFrame, group: list[str], order: list[str], out: str = "i", total: str | None = None,
                    levels: list[Column] | None = None) -> DataFrame:
    """Adds `out` = 1-based position of the row within `group` by `order` (and the group size as `total` when asked).

    Without `levels` the rows are cut into runs: range partitions by group and order, written to the shared checkpoint
    folder so that all uses see the same runs. A run's rows are ordered in one task, whatever prefixes the keys share;
    positions are offset by the counts of the group's earlier runs, of which there are at most as many as partitions."""
    d, names = _sliced(df, levels) if levels is not None else _runs(df, group + order)
    d = _join(d, _offsets(d, group, names, F.lit(1), "_off"), group + names)
    w = Window.partitionBy(*group, *names).orderBy(*order)
    d = d.withColumn(out, (F.col("_off") + F.row_number().over(w)).cast("bigint"))
    if total:
        d = _join(d, d.groupBy(*group).agg(F.count(F.lit(1)).alias(total)), group)
    return d.drop("_off", *names)


def _runs(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Rows cut into range partitions by `keys`, written once."""
    ensure_checkpoint_dir(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return df.repartitionByRange(parts, *keys).withColumn("_run", F.spark_partition_id()).checkpoint(), ["_run"]


def running_total(df: DataFrame, order: list[str], value: str, out: str, levels: list[Column] | None = None, group: list[str] | None = None) -> DataFrame:
    """Adds `out` = running sum of `value` within `group` (the whole table without one) in `order`; slices as in
    `position_within`."""
    group = group or []
    d, names = _sliced(df, levels) if levels is not None else _runs(df, group + order)
    d = _join(d, _offsets(d, group, names, F.col(value), "_off"), group + names)
    w = Window.partitionBy(*group, *names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn(out, F.col("_off") + F.sum(value).over(w)).drop("_off", *names)
