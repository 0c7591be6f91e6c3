from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pytest

from pagemill.llm import spelling as S
from pagemill.llm.queries import QUERIES

SCHEMA = "doc_id bigint, text string, w string, n int"


def brute(docs):
    n = collections.Counter()
    for i, text in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                n[w] += 1
    n = {w: c for w, c in n.items() if c >= 3}
    letters = sorted({c for w in n for c in w})
    form, out = {}, {}
    for w, c in n.items():
        edits = {w[:i] + w[i + 1 :] for i in range(len(w))}
        edits |= {w[:i] + a + w[i + k :] for i in range(len(w) + 1) for a in letters for k in (0, 1)}
        near = [e for e in edits if e in n and e != w]
        best = min(near, key=lambda e: (-n[e], e), default=None)
        form[w] = best if best and n[best] >= 2 * c else None
        out[w] = (form[w], c, len(near), n[form[w]] if form[w] else None)
    for w in out:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (out[w][0], root, *out[w][1:])
    return out


def result(df):
    rows = df.collect()
    got = {r[0]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(got) == len(rows)
    return got


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert result(QUERIES["op13_spelling"](spark, sf)) == brute(docs)


@pytest.mark.parametrize("limit", [8, 64, 1 << 20])
def test_waves_of_any_size_give_the_same(spark, limit):
    r = random.Random(3)
    words = ["".join(r.choice("abcé") for _ in range(r.choice((4, 5, 5, 6, 7)))) for _ in range(300)]
    docs = [(i, " ".join(r.choices(words, k=40)) + "÷×ÀÿQ") for i in range(120)] + [(None, "Abcab abcab! abcab"), (None, None), (5, "")]
    table = spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA)
    got = result(S.variants(table, limit).select("w", "form", "root", "n", "n_near", "form_n"))
    assert got == brute(docs) and any(g[0] for g in got.values())


def test_long_chains_repeats_and_long_words(spark):
    chain = [("a" * (5 + k) + "b") for k in range(7)]
    docs = [(i, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 3**k))) for i in range(2)]
    docs += [(9, ("q" * 3000 + " ") * 3 + ("q" * 2999 + "r ") * 9 + ("q" * 3001 + " ") * 30)] * 2 + [(10, "z" * 200000)] * 3
    got = result(S.variants(spark.createDataFrame([(*d, "x", 1) for d in docs], SCHEMA), 1 << 20))
    assert {w: g for w, g in got.items() if len(w) < 100} == brute(docs[:2])
    assert got["q" * 2999 + "r"][0] == "q" * 3000 or got["q" * 3000][4] is not None
    assert got["z" * 200000][:2] == (None, "z" * 200000)
    assert S.variants(spark.createDataFrame([], SCHEMA)).collect() == []


def test_crc32_of_runs():
    r = random.Random(1)
    raw = [bytes(r.randrange(256) for _ in range(r.choice((1, 3, 63, 64, 65, 200)))) for _ in range(200)]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    off = np.cumsum([0] + [len(x) for x in raw])
    before = [zlib.crc32(b"%d:" % i) for i in range(len(raw))]
    got = S.crc32(buf, off[:-1], off[1:], np.array(before, np.uint32))
    assert got.tolist() == [zlib.crc32(x, b) for x, b in zip(raw, before)]


def test_filters_know_all_their_words_and_few_others():
    counts = {7: 5000}
    blocks, waves = S.plan_waves(counts, 1 << 20)
    m = np.random.default_rng(0).integers(97, 123, (10000, 7)).astype(np.uint8)
    place, mask = S._place(S._hash(m), 7, blocks[7])
    shard = np.zeros(blocks[7], np.uint64)
    np.bitwise_or.at(shard, place[:5000], mask[:5000])
    hit = shard[place] & mask == mask
    assert hit[:5000].all() and hit[5000:].mean() < 0.02
    assert S.plan_waves({5: 1000, 6: 10}, 64) == ({5: 251, 6: 3}, S.plan_waves({5: 1000, 6: 10}, 64)[1])
    for limit in (8, 64, 4096):
        covered = [(size, b) for wave in S.plan_waves({5: 100, 6: 50}, limit)[1] for size, lo, hi in wave for b in range(lo, hi)]
        assert sorted(covered) == [(5, b) for b in range(26)] + [(6, b) for b in range(13)]
        assert all(8 * sum(hi - lo for _, lo, hi in wave) <= limit for wave in S.plan_waves({5: 100, 6: 50}, limit)[1])
