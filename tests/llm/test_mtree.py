from __future__ import annotations

import math

import numpy as np

from pagemill.llm import mtree
from pagemill.llm.queries import QUERIES

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, k=20, step=20, single=lambda x: float(np.float32(x))):
    good = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good[i, tuple(math.floor(64 * single(x)) for x in v)] = None
    out = set()
    for q, x in good:
        if q % step == 0:
            s = sorted((-min(max(sum(a * b for a, b in zip(x, y)), -(2**63)), 2**63 - 1), i) for i, y in good if i != q and len(x) == len(y))[:k]
            out |= {(q, r + 1, i, -d) for r, (d, i) in enumerate(s)}
    return out


def test_query_against_brute_force(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = [tuple(r) for r in QUERIES["op9_topk"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-2, 3, 3).astype(float).tolist(), 1) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0, 3.0], None) for i in range(300)] + [(1020, [1.0, 2.0, 3.0], 1)]
    rows += [(2000, None, 1), (2020, [1.0, None, 2.0], 1), (2040, [1.0, float("nan"), 2.0], 1), (2060, [float("inf"), 1.0, 1.0], 1), (None, [1.0, 1.0, 1.0], 1), (2080, [0.0, 0.0, 0.0], 1), (2100, [1.0, 1.0], 1), (2101, [0.5, 1.0], 1)]
    df = spark.createDataFrame(rows, VECTORS).withColumnRenamed("label", "tree")
    v = mtree.quantized(df)
    got = [tuple(r) for r in mtree.top_k(v, v.where("vec_id % 20 = 0")).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    empty = v.limit(0)
    assert mtree.top_k(empty, empty).collect() == [] and mtree.top_k(v, empty).collect() == []


def test_tree_is_exact_and_prunes():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 50
    x = np.rint(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)))
    tree = mtree.MTree(x)
    seen = 0
    for q in x[::300]:
        before = np.sort(x @ q)[::-1][19]
        at, s = tree.search(q, 20, -np.inf)
        assert sorted(s.tolist(), reverse=True)[19] == before and set(np.flatnonzero(x @ q >= before)) == set(at.tolist())
        seen += 1
    assert seen == 20


def test_one_id_under_several_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-3, 4, 3).astype(float).tolist(), 1) for i in range(1, 120)]
    rows += [(20, [5.0, 5.0, float(j)], 1) for j in range(6)] + [(40, [-4.0, 5.0, 1.0], 1)]
    v = mtree.quantized(spark.createDataFrame(rows, VECTORS))
    got = [tuple(r) for r in mtree.top_k(v, v.where("vec_id % 20 = 0")).collect()]
    want = brute(rows)
    assert set(got) == want and len({r for r in want if r[0] == 20}) > 100
    ranks = [r for r in got if r[0] == 20]
    assert len(ranks) == 20 * 7


def test_most_trees_are_never_asked(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.2).astype(np.float32).tolist(), 1) for i in range(2400)]
    rows += [(5000 + i, rows[0][1], 1) for i in range(900)]  # one vector in over a quarter of the rows
    v = mtree.quantized(spark.createDataFrame(rows, VECTORS))
    asked = []
    real = mtree.search_trees

    def counted(data, sent):
        asked.append((sent.select("q", "tree").distinct().count(), data.select("tree").distinct().count(), sent.select("q").distinct().count()))
        assert sent.groupBy("tree", "block").count().agg({"count": "max"}).first()[0] <= 60
        return real(data, sent)

    monkeypatch.setattr(mtree, "search_trees", counted)
    got = [tuple(r) for r in mtree.top_k(v, v.where("vec_id % 20 = 0"), tree_rows=100, query_rows=30).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    (one, trees, queries), (rest, _, _) = asked
    assert one == queries and trees >= 12 and rest < 0.4 * queries * (trees - 1)


def test_components_of_any_size(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-2, 16)).tolist(), 1) for i in range(300)]
    rows += [(1000 + i, [(-1.0) ** i * 1e80, 1.0, -1e80, float(i)], 1) for i in range(60)] + [(2000, [1e99, 0.0, 0.0, 1.0], 1), (2020, [-1e99, 1e30, 0.0, 1.0], 1)]
    rows += [(4000 + i, (rng.normal(size=3) * 1e7).tolist(), 1) for i in range(60)]  # scores beyond 2^53 that fit a long
    df = spark.createDataFrame(rows + [(3000, [1e300, 1.0, 1.0, 1.0], 1)], "vec_id bigint, embedding array<double>, label int")
    v = mtree.quantized(df)
    got = [tuple(r) for r in mtree.top_k(v, v.where("vec_id % 20 = 0"), tree_rows=50).collect()]
    want = brute(rows, single=lambda x: x)
    assert len(got) == len(set(got)) and set(got) == want
    assert {s for _, _, _, s in want} >= {2**63 - 1} and any(2**53 < s < 2**62 for _, _, _, s in want)
