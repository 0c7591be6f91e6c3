from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest

from pagemill.llm import near_vectors
from pagemill.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id bigint, embedding array<float>, label int"


def brute(rows, cosine=0.98):
    ok = [(n, i, np.array(v, float), lab) for n, (i, v, lab) in enumerate(rows)
          if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    links = [0] * len(rows)
    for p, (a, _, x, la) in enumerate(ok):
        for b, _, y, lb in ok[p + 1 :]:
            if la == lb and len(x) == len(y) and (x @ y) / math.sqrt((x @ x) * (y @ y)) >= cosine:
                links[a] += 1
                links[b] += 1
                parent[find(b)] = find(a)
    least = {}
    for n, (i, *_) in enumerate(rows):
        r = find(n)
        least[r] = i if least.get(r) is None else min(x for x in (least[r], i) if x is not None)
    return sorted(((i, links[n], least[find(n)], i == least[find(n)]) for n, (i, *_) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert got(QUERIES["op10_near_vectors"](spark, sf)) == brute(rows)


@pytest.mark.parametrize("how", [{}, {"chunk": 40, "cell_rows": 10}, {"blocks": 3, "cell_rows": 3}])
def test_clusters_copies_and_bad_vectors(spark, how):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(12):
        centre = rng.normal(size=6)
        for _ in range(25):
            rows.append((len(rows), (centre * rng.uniform(0.1, 9) + rng.normal(size=6) * 0.12 * rng.uniform(0, 2)).astype(np.float32).tolist(), c % 3))
    rows += [(1000 + i, rows[7][1], rows[7][2]) for i in range(60)]  # copies
    rows += [(1100, rows[7][1], rows[7][2] + 1), (1101, rows[7][1], None), (1102, None, 1), (1103, [0.0] * 6, 1), (1104, [1.0, None] * 3, 1), (1105, [float("nan")] + [1.0] * 5, 1)]
    rows += [(1106, [1.0, 2.0], 1), (1107, [2.0, 4.0], 1), (1108, [-0.0, 1.0], 1), (1109, [0.0, 1.0], 1), (1110, [1e-30] * 6, 1), (1111, [1e30] * 6, 1), (None, rows[3][1], rows[3][2])]
    df = spark.createDataFrame(rows, VECTORS)
    assert got(near_vectors.near_duplicates(df, **how)) == brute(rows)
    assert near_vectors.near_duplicates(df.limit(0), **how).collect() == []


def test_repeated_row(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [2.0, 1.0], 1)], VECTORS)
    assert got(near_vectors.near_duplicates(df)) == [(1, 1, 1, True), (1, 1, 1, True), (2, 0, 2, True)]


def test_repeated_rows_as_in_sql(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i % 40, (rng.integers(1, 4, 3) * 1.0).tolist(), int(i % 2)) for i in range(120)]
    rows += [(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [2.0, 1.0], 1), (3, None, 1), (4, [1.0, 2.0], None)]
    df = spark.createDataFrame(rows, VECTORS)
    df.write.parquet(f"{tmp_path}/e")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    sql = sorted(con.sql(ORACLES["op10_near_vectors"]).fetchall(), key=str)
    assert sql == got(near_vectors.near_duplicates(df)) == brute(rows)
