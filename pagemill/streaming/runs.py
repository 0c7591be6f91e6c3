"""A table kept as runs: what each batch brought, merged in levels.

Batch v writes run (v, v): rows in proportion to the batch, whatever the table holds. Whenever `fanout` runs of a
level are full they are merged into one run of the next level, so a row is rewritten once a level (a logarithm of
the number of batches) and a reader merges at most `fanout` runs a level. A run is a folder of its own, committed by a
marker written after it; nothing is changed in place. A batch that is run again finds its run committed; a merge
that died is made again by the next batch. Runs that a wider one covers are no longer read and may be
deleted (`obsolete`)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from pagemill.sources.writers import is_missing

FANOUT = 8
Run = tuple[int, int]
Merge = Callable[[DataFrame], DataFrame]


def committed(spark: SparkSession, base: str) -> list[Run]:
    """Committed runs (first and last batch); one small row a run. Only a missing folder means "none"."""
    try:
        rows = spark.read.schema("value string").text(f"{base}/_runs/*").collect()
    except AnalysisException as e:
        if is_missing(e):
            return []
        raise
    return sorted({(int(lo), int(hi)) for lo, hi in (r["value"].split("-") for r in rows)})


def cover(runs: list[Run]) -> list[Run]:
    """The widest runs that hold every batch once."""
    out: list[Run] = []
    for lo, hi in sorted(runs, key=lambda r: (r[0], -r[1])):
        if not out or lo > out[-1][1]:
            out.append((lo, hi))
    return out


def obsolete(spark: SparkSession, base: str) -> list[str]:
    runs = committed(spark, base)
    return [f"{base}/runs/{lo}-{hi}" for lo, hi in runs if (lo, hi) not in cover(runs)]


def _write(df: DataFrame, base: str, run: Run) -> None:
    name = f"{run[0]}-{run[1]}"
    df.write.mode("overwrite").parquet(f"{base}/runs/{name}")
    df.sparkSession.createDataFrame([(name,)], "value string").coalesce(1).write.mode("overwrite").text(f"{base}/_runs/{name}")


def _read(spark: SparkSession, base: str, runs: list[Run]) -> DataFrame:
    return spark.read.parquet(*(f"{base}/runs/{lo}-{hi}" for lo, hi in runs))


def add(df: DataFrame, base: str, version: int, merge: Merge, fanout: int = FANOUT) -> None:
    """Write batch `version` (from 1) and make the merges that it completes."""
    spark = df.sparkSession
    runs = committed(spark, base)
    if not any(lo <= version <= hi for lo, hi in runs):
        _write(df, base, (version, version))
        runs.append((version, version))
    size = fanout
    while version % size == 0:
        whole = (version - size + 1, version)
        parts = cover([r for r in runs if whole[0] <= r[0] and r[1] <= version])
        if whole not in runs and len(parts) > 1:
            _write(merge(_read(spark, base, parts)), base, whole)
            runs.append(whole)
        size *= fanout


def read(spark: SparkSession, base: str, merge: Merge) -> DataFrame | None:
    """The table as of the last committed batch, None before the first."""
    runs = cover(committed(spark, base))
    return merge(_read(spark, base, runs)) if runs else None
