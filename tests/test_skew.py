"""Hot keys: one group holding a large share of all rows must be split across
tasks (ordered numbering, running totals) or combined before the shuffle
(aggregates), and results must stay whole."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pagemill.operators import ordering as O
from pagemill.operators import registry as R


def _hot(spark, n=6000):
    # One site holds two thirds of the rows.
    return spark.range(n).select(
        F.when(F.col("id") % 3 != 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("site"),
        F.format_string("u%07d", F.col("id")).alias("url"),
        F.col("id").alias("v"),
    )


def test_position_within_splits_a_hot_group(spark):
    """Production settings; the hot site's URLs share 200 characters."""
    df = _hot(spark).withColumn("url", F.concat(F.lit("https://hot.example/" + "a" * 180), "url"))
    got = O.position_within(df, ["site"], ["url"], out="i", total="n")
    want = df.withColumn("i", F.row_number().over(Window.partitionBy("site").orderBy("url")).cast("bigint"))
    a = sorted((r.site, r.url, r.i) for r in got.collect())
    b = sorted((r.site, r.url, r.i) for r in want.collect())
    assert a == b
    assert got.filter("site = 'hot'").select("n").distinct().first().n == 4000
    runs = df.repartitionByRange(8, "site", "url").withColumn("p", F.spark_partition_id()).filter("site = 'hot'").groupBy("p").count().collect()
    assert len(runs) > 4 and max(r["count"] for r in runs) < 1500  # the hot site is ordered in many tasks


def test_position_within_levels_is_lazy(spark):
    df = _hot(spark)
    levels = [F.substring("url", 1, n) for n in (4, 6)]
    got = O.position_within(df, ["site"], ["url"], levels=levels)
    assert "Range (0, 6000" in got._jdf.queryExecution().executedPlan().toString()  # still reads its input
    want = df.withColumn("i", F.row_number().over(Window.partitionBy("site").orderBy("url")).cast("bigint"))
    assert sorted((r.site, r.url, r.i) for r in got.collect()) == sorted((r.site, r.url, r.i) for r in want.collect())


def test_position_within_null_group_and_ties(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "b", 2), ("x", "a", 3), ("x", None, 4)], "site string, url string, v int")
    got = {(r.site, r.url): r.i for r in O.position_within(df, ["site"], ["url"]).collect()}
    assert got == {(None, "a"): 1, (None, "b"): 2, ("x", None): 1, ("x", "a"): 2}


def test_running_total_equals_global_window(spark):
    df = _hot(spark)
    got = O.running_total(df, ["v"], "v", "cum", [F.floor(F.col("v") / 1000), F.floor(F.col("v") / 50)])
    want = df.withColumn("cum", F.sum("v").over(Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    assert sorted((r.v, r.cum) for r in got.collect()) == sorted((r.v, r.cum) for r in want.collect())


def test_registry_hot_hash_is_combined_before_the_shuffle(spark):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    rows = [("logo" if i % 3 else f"h{i}", "image", f"p{i % 500}", "u", base + dt.timedelta(seconds=i), i, 0, 0, "c", 0.0)
            for i in range(3000)]
    occ = spark.createDataFrame(rows, "hash string, type string, page_path string, original_url string, ts timestamp_ntz, "
                                      "tie1 bigint, tie2 bigint, tie3 bigint, content string, api_cost double")
    built = R.registry_build(occ)
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "partial_" in plan  # map-side partial aggregation precedes each exchange
    logo = built.filter("hash = 'logo'").first()
    assert logo.n_occurrences == 500  # whole result: every distinct page of the hot item
