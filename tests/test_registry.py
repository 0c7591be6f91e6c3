"""Registry cases: empty, add, duplicates by content, order of duplicates,
both types, cost sum, versioned save with backup."""

from __future__ import annotations

import datetime as dt

import pytest

from pagemill.operators import registry as R
from pagemill.sources import writers as W

SCHEMA = (
    "hash string, type string, page_path string, original_url string, ts timestamp_ntz, tie1 bigint, "
    "tie2 bigint, tie3 bigint, content string, api_cost double"
)


def occ(spark, rows):
    base = dt.datetime(2024, 1, 1)
    full = [
        (h, t, p, f"https://m/{p}", base + dt.timedelta(minutes=i), i, 0, 0, c, cost)
        for i, (h, t, p, c, cost) in enumerate(rows)
    ]
    return spark.createDataFrame(full, SCHEMA)


def stats(df):
    return {r.type: r for r in R.registry_stats(R.registry_build(df)).collect()}


def test_empty_registry(spark):
    s = stats(occ(spark, []))
    assert s["all"].total_files == 0 and s["all"].unique_files == 0 and s["all"].total_api_cost == 0.0


def test_add_entry(spark):
    c = R.registry_build(occ(spark, [("h1", "image", "a/img.png", "desc", 0.01)])).collect()
    assert len(c) == 1 and c[0].n_occurrences == 1 and c[0].content == "desc"


def test_duplicate_by_content(spark):
    df = occ(spark, [("h1", "image", "a/one.png", "desc", 0.01), ("h1", "image", "b/two.png", "desc", 0.0)])
    s = stats(df)
    assert s["all"].total_files == 2
    assert s["image"].unique_files == 1
    assert s["image"].duplicate_count == 1


def test_same_page_twice_is_one_occurrence(spark):
    df = occ(spark, [("h1", "image", "a/one.png", "desc", 0.01), ("h1", "image", "a/one.png", "desc", 0.0)])
    row = R.registry_build(df).first()
    assert row.n_occurrences == 1
    assert row.last_used > row.first_processed  # re-registration bumps lastUsed


def test_find_duplicates_in_order(spark):
    df = occ(spark, [("h1", "image", "p3", "d", 0.0), ("h1", "image", "p1", "d", 0.0), ("h1", "image", "p2", "d", 0.0),
                     ("h2", "image", "only", "e", 0.0)])
    dups = R.media_duplicates(df).orderBy("hash", "first_ts").collect()
    assert [r.page_path for r in dups] == ["p3", "p1", "p2"]
    assert all(r.n_occurrences == 3 for r in dups)


def test_both_types(spark):
    df = occ(spark, [("h1", "image", "p1", "d", 0.0), ("h2", "audio", "p1", "t", 0.0), ("h2", "audio", "p2", "t", 0.0)])
    s = stats(df)
    assert s["image"].unique_files == 1 and s["audio"].unique_files == 1
    assert s["audio"].duplicate_count == 1 and s["image"].duplicate_count == 0


def test_cost_sum(spark):
    df = occ(spark, [("h1", "image", "p1", "d", 0.02), ("h2", "audio", "p1", "t", 0.03)])
    assert stats(df)["all"].total_api_cost == pytest.approx(0.05)


def test_first_registration_wins(spark):
    df = occ(spark, [("h1", "image", "p1", "first", 0.01), ("h1", "image", "p2", "second", 0.5)])
    row = R.registry_build(df).first()
    assert row.content == "first" and row.api_cost == 0.01  # per-item cost, not cumulative


def test_versioned_save_keeps_backup(spark, tmp_path):
    base = str(tmp_path / "registry")
    df = occ(spark, [("h1", "image", "p1", "d", 0.01)])
    c = R.registry_build(df)
    assert W.save_registry_version(c, df, base) == 1
    assert W.save_registry_version(c, df, base) == 2
    assert spark.read.parquet(f"{base}/v=1/media_contents").count() == 1  # former version kept
    empty = df.limit(0)
    assert W.save_registry_version(c, df, base, delta=empty) == 2  # clean: nothing written


def test_hot_hashes_are_the_same_as_others(spark):
    rows = [("h1", "image", f"p{i % 7}", "d", 0.0) for i in range(30)] + [("h2", "image", "only", "e", 0.0)] * 2 + [("h3", "audio", f"q{i}", "f", 0.0) for i in range(3)] + [(None, "image", f"r{i}", "g", 0.0) for i in range(3)]
    df = occ(spark, rows)
    want = sorted(map(tuple, R.media_duplicates(df).collect()))
    assert len(want) == 10 and want == sorted(map(tuple, R.media_duplicates(df, hot_rows=5).collect())) == sorted(map(tuple, R.media_duplicates(df, hot_rows=0).collect()))


def test_duplicates_take_one_shuffle_of_the_rows(spark):
    plan = R.media_duplicates(occ(spark, [("h1", "image", "p", "d", 0.0)]))._jdf.queryExecution().executedPlan().toString()
    cold = plan[plan.index("Window") : plan.index("LeftAnti")]
    assert cold.count("Exchange hashpartitioning(hash") == 1 and "min_by" not in plan
