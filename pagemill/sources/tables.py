"""Scans of the supplied parquet tables, always with an explicit schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.schemas import SUPPLIED


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """`spark.read.parquet` with the declared schema: no inference, and
    Catalyst prunes columns / pushes filters into the scan."""
    return spark.read.schema(SUPPLIED[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Tables:
    """Lazy accessor: `Tables(spark, sf_dir).pages` → DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in SUPPLIED:
            return read_table(self.spark, self.sf_dir, name)
        raise AttributeError(name)
