from __future__ import annotations

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.llm import suffix_dedup
from pagemill.llm.gsaca import suffix_array
from pagemill.llm.queries import QUERIES


def brute(rows, width=100):
    """rows: (doc_id, text) -> list of (doc_id, n_bytes, n_removed, n_spans, sha) in the order of rows."""
    first = {}
    raws = [((1, 0) if d is None else (0, d), (t or "").encode()) for d, t in rows]
    for d, b in raws:
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            first[w] = min(first.get(w, (d, i)), (d, i))
    out = []
    for (d, b), (doc_id, _) in zip(raws, rows):
        gone = bytearray(len(b) + 1)
        for i in range(len(b) - width + 1):
            if (d, i) > first[b[i : i + width]]:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not h for g, h in zip(gone, b"\0" + gone))
        out.append((doc_id, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, *r[1:])


def result(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in df.collect()), key=key)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_array(s):
    s = [*s, 0]
    assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab \n", max_size=40), min_size=1, max_size=6), st.integers(2, 9))
def test_equal_windows(texts, width):
    bodies = [t.encode() for t in texts]
    got = {}
    for s, o, c in zip(*(x.tolist() for x in suffix_dedup.equal_windows(bodies, width))):
        got.setdefault(c, set()).add(bodies[s][o : o + width])
    assert all(len(x) == 1 for x in got.values()) and len({next(iter(x)) for x in got.values()}) == len(got)
    assert sum(max(0, len(b) - width + 1) for b in bodies) == len(suffix_dedup.equal_windows(bodies, width)[0])


def test_query_against_brute_force(spark, sf, documents):
    got = QUERIES["op1_suffix_dedup"](spark, sf).collect()
    want = brute(list(zip(documents.doc_id.tolist(), documents.text.tolist())))
    assert sum(w[2] for w in want) > 0
    assert sorted(tuple(r) for r in got) == sorted(want)


@pytest.mark.parametrize("hot", [4096, 3])
def test_made_up_repeats(spark, make_docs, hot):
    rng = random.Random(hot)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    passages = [prose(60) for _ in range(4)] + ["x" * 300, "ab" * 200, "".join(rng.choices("01", k=400))]
    rows = []
    for i in range(120):
        cut = [p[rng.randrange(0, 60) : len(p) - rng.randrange(0, 60)] for p in rng.sample(passages, rng.randrange(0, 3))]
        rows.append((i * 3 % 121, prose(rng.randrange(0, 30)).join(["", *cut, "", prose(10)])))
    rows += [(200 + i, rows[5][1]) for i in range(30)] + [(300, None), (301, ""), (302, "short"), (None, rows[5][1] + "!"), (303, "a" * 5000), (304, "a" * 5000 + "b")]
    rows += [(400, rows[7][1] + prose(40))] * 2 + [(401, rows[8][1]), (401, rows[9][1] + rows[8][1])]
    docs = make_docs(rows).withColumnRenamed("lang", "block").withColumnRenamed("source", "doc")
    assert result(suffix_dedup.dedup(docs, hot=hot, blocks=5)) == sorted(brute(rows), key=key)


def test_small_width_and_empty(spark, make_docs):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choices("ab ", k=rng.randrange(0, 40)))) for i in range(40)]
    docs = make_docs(rows)
    assert result(suffix_dedup.dedup(docs, width=12, gram=4, blocks=3)) == sorted(brute(rows, 12), key=key)
    assert suffix_dedup.dedup(docs.limit(0)).collect() == []
