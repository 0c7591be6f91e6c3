from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pagemill.llm import packing
from pagemill.llm.queries import QUERIES, vocabulary


def check(rows, texts, capacity=1024):
    """texts: list of (doc_id, text), with repeats."""
    tok = Tokenizer.from_file(vocabulary())
    want = []
    for d, text in texts:
        ids = tok.encode(text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want.append((d, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    key = lambda x: tuple((v is not None, v) for v in x)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    seqs = {}
    for r in rows:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(w[3] for w in want)
    return len(seqs), -(-total // capacity)


def test_query(spark, sf, documents):
    used, least = check(QUERIES["op2_pack"](spark, sf).collect(), list(zip(documents.doc_id.tolist(), documents.text.tolist())))
    assert used <= 1.03 * least + 1


def test_edges(spark, make_docs):
    rows = [(1, None), (2, ""), (None, "a"), (4, "x<|endoftext|>y"), (5, "z " * 9000), (6, "same text"), (6, "same text"), (7, "中文 буквы \U0001f600"),
            (8, "  \n\n\t  it's  1234 été   x"), (9, "a" * 5000)]
    docs = make_docs(rows).withColumnRenamed("lang", "sequence").withColumnRenamed("source", "_rank")
    check(packing.pack(packing.pieces(docs, vocabulary())).collect(), rows)
    assert packing.pack(packing.pieces(docs.limit(0), vocabulary())).collect() == []


def test_both_encoders_agree(documents):
    enc = packing.Encoder(vocabulary())
    random.seed(7)
    odd = "".join(chr(c) for c in range(1, 0x250))
    texts = documents.text.tolist() + ["".join(random.choices(odd, k=60)) for _ in range(2000)] + [" " * n + "a" + "\n" * n for n in range(9)]
    for t in texts:
        assert enc.ids(t) == enc.slow.encode(t, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=25))
def test_plan_uses_every_piece_once(counts):
    used = {}
    for pattern, n in packing.plan(counts, 40):
        assert sum(pattern) <= 40 and n > 0
        for x in pattern:
            used[x] = used.get(x, 0) + n
    assert used == counts


def test_plan_finds_exact_triples():
    assert sum(n for _, n in packing.plan({512: 2, 500: 3, 300: 3, 224: 3}, 1024)) == 4
    assert packing.plan({1: 1024 * 5}, 1024) == [((1,) * 1024, 5)]


def test_plan_beats_or_meets_best_fit():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 1025, 20000)
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    assert sum(n for _, n in packing.plan(counts)) <= 1.005 * -(-int(lengths.sum()) // 1024)


@pytest.mark.parametrize("salts", [1, 5])
def test_salts_only_renumber(spark, salts):
    cut = spark.range(5000).selectExpr("id doc_id", "0 piece", "0L start", "if(id % 3 = 0, 1024, 1 + id % 700) length", "id ids_crc32")
    rows = packing.pack(cut, salts=salts).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == 5000
    assert len({r["sequence_id"] for r in rows}) <= 1.01 * sum(r["length"] for r in rows) / 1024 + 1


def test_clashing_columns_are_kept(spark):
    names = ["_salt", "_rank", "_shift", "sequence_id", "offset", "count", "n"]
    cut = spark.range(200).selectExpr("id doc_id", "0 piece", "0L start", "1 + id * 37 % 1024 length", "id ids_crc32")
    plain = sorted(tuple(r) for r in packing.pack(cut).collect())
    wide = cut.select("*", *(F.lit(n).alias(n) for n in names))
    got = packing.pack(wide)
    assert got.columns == [*wide.columns, "sequence_id", "offset"]
    rows = [tuple(r) for r in got.collect()]
    assert all(list(r[5:-2]) == names for r in rows) and sorted(r[:5] + r[-2:] for r in rows) == plain
