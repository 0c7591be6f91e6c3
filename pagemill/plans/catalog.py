"""Query catalog: name → (Spark builder, DuckDB oracle SQL).

Every Spark builder takes `(spark, sf_dir)` and returns a DataFrame over the
supplied tables (or inputs Spark derives from them); nothing is collected.
Oracles are written against the pre-registered DuckDB views of the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from pagemill.session import apply_defaults
from pagemill.sources.tables import Tables


@dataclass
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None
    survey_ids: str = ""


CATALOG: dict[str, Query] = {}


def register(name: str, oracle: str | None, survey_ids: str = ""):
    def deco(fn: Callable[[Tables], DataFrame]):
        CATALOG[name] = Query(name, fn, oracle, survey_ids)
        return fn

    return deco


def runner(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_defaults(spark)
        return load_all()[name].build(Tables(spark, sf_dir))

    run.__name__ = f"q_{name}"
    return run


def load_all() -> dict[str, Query]:
    # Importing the modules registers their queries.
    from pagemill.plans import (  # noqa: F401
        q_crawl,
        q_costs,
        q_links,
        q_media,
        q_merge,
        q_pages,
        q_registry,
        q_sitemaps,
        q_structure,
    )

    return CATALOG
