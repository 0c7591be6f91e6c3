from __future__ import annotations

import zlib

import numpy as np

from pagemill.llm import toxicity
from pagemill.llm.queries import QUERIES


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op5_toxicity"](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    test = [(r["predicted"], labels[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    pos = sum(y for _, y, _ in test)
    hit = sum(p and y for p, y, _ in test)
    assert hit / max(1, sum(p for p, _, _ in test)) > 0.9 and hit / pos > 0.75
    s, y = np.array([t[2] for t in test]), np.array([t[1] for t in test])
    rank = s.argsort().argsort()
    auc = (rank[y == 1].sum() - pos * (pos - 1) / 2) / (pos * (len(y) - pos))
    assert auc > 0.95


def test_same_text_same_score_and_edges(spark, make_docs):
    rows = [(1, None, None), (2, "", "b"), (5, "vile awful words", "a"), (5, "vile awful words", "z"), (None, "vile awful words", "a"), (7, "nice " * 90000, "a"), (8, "vile thing", "a")]
    rows += [(100 + i, "vile thing here" if i % 2 else "kind thing here", "a") for i in range(200)]
    docs = make_docs(rows).withColumnRenamed("lang", "_score2")
    labels = spark.createDataFrame([(100 + i, 1, i % 2) for i in range(200)] + [(1, 0, None), (None, 0, 1), (100, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = toxicity.train(docs, labels)
    got = {(r["doc_id"], r["source"]): r["_score"] for r in toxicity.score(docs, model).collect()}
    assert got[1, None] == got[2, "b"] and got[5, "a"] == got[5, "z"] == got[None, "a"]
    assert got[8, "a"] > 0.5 > got[100, "a"]
    assert toxicity.score(docs.limit(0), model).collect() == []
    empty = toxicity.train(docs, labels.limit(0))
    assert {r["_score"] for r in toxicity.score(docs, empty).collect()} == {0.5}


def test_features_do_not_cross_rows():
    def feats(*texts):
        buf = np.frombuffer("".join(texts).encode(), np.uint8)
        off = np.cumsum([0] + [len(t.encode()) for t in texts])
        row, bucket = toxicity.features(buf, off)
        return [set(bucket[row == i].tolist()) for i in range(len(texts))]

    a, b = feats("one two Three", "four five")
    assert feats("ONE two three")[0] == a and feats("four five")[0] == b and len(a) == 6 and len(b) == 3


def test_clashing_columns_are_kept(spark, make_docs):
    docs = make_docs([(1, "vile thing", "a"), (2, "kind thing", None)]).withColumnRenamed("lang", "_score").withColumnRenamed("source", "m")
    model = (np.array([1 << toxicity.BITS]), np.array([1.0]))
    got = toxicity.score(docs, model)
    assert got.columns == [*docs.columns, "_score"]
    assert sorted(r[:-1] for r in got.collect()) == sorted(tuple(r) for r in docs.collect())
    assert {round(r[-1], 6) for r in got.collect()} == {0.731059}
