from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from pagemill.llm import mixing
from pagemill.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes: dict) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


def check(rows, docs):
    sizes, by = {}, {}
    for d, text, source in docs:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    goal = brute_targets(sizes)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(goal[r["source"]], rel=1e-9)
        assert r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        by.setdefault(r["source"], []).append(r)
    for s, mine in by.items():
        taken = sum(r["taken"] for r in mine)
        assert abs(taken - goal[s]) <= max(r["size"] for r in mine) / 2 + 1e-6
        whole = {r["taken"] // r["size"] for r in mine if r["size"]}
        assert len(whole) <= 2 and (not whole or max(whole) - min(whole) <= 1)  # full epochs first


def test_query_against_brute_force(spark, sf, documents):
    rows = QUERIES["op6_mix"](spark, sf).collect()
    assert len(rows) == len(documents)
    check(rows, documents[["doc_id", "text", "source"]].itertuples(index=False, name=None))
    assert {(r["doc_id"], r["taken"]) for r in rows} == {(r["doc_id"], r["taken"]) for r in QUERIES["op6_mix"](spark, sf).collect()}


def test_edges(spark, make_docs):
    rows = [(1, None, "b"), (2, "", None), (3, "x " * 500, "b"), (3, "x " * 500, "b"), (None, "a b", "c"), (5, "a", None), (6, "q " * 10, "zé")]
    rows += [(10 + i, "w " * (i % 7), "a") for i in range(200)]
    docs = make_docs(rows).withColumn("size", mixing.word_count(F.col("text")))
    out = [r.asDict() | {"source_size": r["_source_size"], "target": r["_target"], "taken": r["size"] * r["_copies"]} for r in mixing.mix(docs).collect()]
    assert len(out) == len(rows)
    check(out, rows)
    assert mixing.mix(docs.limit(0)).collect() == []


def test_heavier_documents_come_first(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "'s' source", "1L size", "if(id % 2 = 0, 4.0, 0.25) w")
    docs = docs.unionByName(spark.range(4000, 6000).selectExpr("id doc_id", "'t' source", "1L size", "1.0 w"))
    got = mixing.mix(docs, weight="w").where("source = 's'").groupBy("w").agg(F.avg("_copies").alias("c")).collect()
    c = {float(r["w"]): r["c"] for r in got}
    assert c[4.0] >= c[0.25]


def test_clashing_columns_are_kept(spark):
    docs = spark.range(300).selectExpr("id doc_id", "if(id % 3 = 0, 's', 't') source", "id % 5 size")
    plain = sorted(tuple(r) for r in mixing.mix(docs).collect())
    names = ["_key", "_bucket", "_skey", "_sum", "_target", "_source_size", "_copies", "_epochs", "_rest", "_cut", "_before", "_run", "_base", "target", "source_size"]
    wide = docs.select("*", *(F.lit(n).alias(n) for n in names))
    got = mixing.mix(wide)
    assert got.columns == [*wide.columns, "_source_size", "_target", "_copies"]
    rows = [tuple(r) for r in got.collect()]
    assert all(list(r[3:-3]) == names for r in rows) and sorted(r[:3] + r[-3:] for r in rows) == plain
