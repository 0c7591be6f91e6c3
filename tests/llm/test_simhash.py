from __future__ import annotations

import random
import re

import numpy as np
import xxhash

from pagemill.llm import simhash
from pagemill.llm.components import components
from pagemill.llm.queries import QUERIES


def brute_fp(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows, bits=3):
    """rows: (doc_id, fp) -> smallest doc_id reachable per row."""
    fps = sorted({f for _, f in rows})
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= bits):
            parent[find(fps[j])] = find(f)
    least = {}
    for d, f in rows:
        r = find(f)
        least[r] = min(x for x in (least.get(r), d) if x is not None) if d is not None or least.get(r) is not None else None
    return {(d, f): least[find(f)] for d, f in rows}


def test_query_against_brute_force(spark, sf, documents):
    got = QUERIES["op4_simhash"](spark, sf).collect()
    rows = [(d, brute_fp(t)) for d, t in zip(documents.doc_id.tolist(), documents.text.tolist())]
    want = brute_components(rows)
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == sorted((d, f"{f:016x}", want[d, f]) for d, f in rows)


def test_edges(spark, make_docs):
    rows = [(3, None), (2, ""), (9, " \t\n"), (4, "one"), (5, "One two"), (None, "alone here now"), (7, "w" * 200000), (8, "a b c " * 30000), (8, "a b c " * 30000), (6, "Été A B x y")]
    docs = make_docs(rows).withColumnRenamed("lang", "fp").withColumnRenamed("source", "_one").withColumnRenamed("n_chars", "component_id")
    got = simhash.near_duplicates(docs).collect()
    want = brute_components([(d, brute_fp(t)) for d, t in rows])
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got), key=key) == sorted(((d, f, c) for (d, f), c in want.items() for _ in range(sum(x[0] == d for x in rows))), key=key)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == sorted((d is None, d or 0) for d in {c for c in want.values()})
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


def test_links_of_hot_blocks(spark):
    """One block value holds most fingerprints; chunks smaller than the group lose no link."""
    rng = random.Random(5)
    base = rng.getrandbits(64)
    fps = {base}
    while len(fps) < 400:
        f = rng.choice(sorted(fps)) if rng.random() < 0.9 else rng.getrandbits(64)
        for _ in range(rng.randrange(1, 6)):
            f ^= 1 << rng.randrange(64)
        fps.add(f)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp bigint")
    want = brute_components([(f, f % 2**64) for f in signed])
    for chunk in (4096, 25):
        label = {r["node"]: r["label"] for r in components(simhash.links(nodes, chunk=chunk)).collect()}
        assert {(f, f % 2**64): label.get(f, f) for f in signed} == want


def test_long_chain(spark):
    edges = spark.range(300).selectExpr("id u", "id + 1 v").unionByName(spark.range(1000, 1100).selectExpr("1000L u", "id v"))
    label = {r["node"]: r["label"] for r in components(edges).collect()}
    assert label == {i: 0 for i in range(1, 301)} | {i: 1000 for i in range(1001, 1100)}


def test_keep_one_keeps_one_row_of_each_component(spark, make_docs):
    """Several documents without an id, several texts under one id, and a component whose smallest id stands
    under an unlike text too."""
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(60))
    a, b, c, d, e, f = (text() for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, c.upper()), (7, c), (4, d), (4, e), (4, e), (9, d.upper()), (5, f), (None, f), (None, None), (None, " ")]
    docs = make_docs(rows).repartition(5)
    labels = {}
    for i, t in rows:
        labels.setdefault(brute_fp(t), []).append((i is None, i or 0, t or ""))
    fps = sorted(labels)
    assert all((x ^ y).bit_count() > 3 for x in fps for y in fps if x < y) and len(fps) == 7
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_one(docs).collect()]
    assert sorted(brute_fp(t) for _, t in got) == fps
    for i, t in got:
        assert (i is None, i or 0) == min(labels[brute_fp(t)])[:2] and (i, t) in rows
    assert simhash.keep_one(docs).exceptAll(docs).count() == 0
