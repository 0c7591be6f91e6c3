from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagemill.llm import ctw
from pagemill.llm.queries import QUERIES


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def held(d):
    return d is None or zlib.crc32(str(d).encode()) % 7 == 2


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)


class Tree:
    """Context-tree weighting with plain dictionaries: log weighted probability of the counted bits."""

    def __init__(self, depth):
        self.depth, self.n = depth, defaultdict(lambda: [0, 0])

    def add(self, data):
        for i in range(self.depth, len(data)):
            for k in range(8):
                node, bit = (1 << k) | (data[i] >> (8 - k)), data[i] >> (7 - k) & 1
                for d in range(self.depth + 1):
                    self.n[node, data[i - d : i]][bit] += 1

    def finish(self):
        kids = defaultdict(list)
        for node, c in self.n:
            if c:
                kids[node, c[1:]].append((node, c))
        self.w = {}
        for d in range(self.depth, -1, -1):
            for key in [x for x in self.n if len(x[1]) == d]:
                own = kt(*self.n[key])
                self.w[key] = own if d == self.depth else np.logaddexp(own, sum(self.w[k] for k in kids[key])) - math.log(2)

    def p(self, node, bit, context, d=0):
        key = (node, context[len(context) - d :])
        a = self.n.get(key, [0, 0])
        est = (a[bit] + 0.5) / (sum(a) + 1)
        if d == self.depth:
            return est
        share = math.exp(kt(*a) - math.log(2) - self.w.get(key, 0.0))
        return share * est + (1 - share) * self.p(node, bit, context, d + 1)

    def score(self, data):
        return sum(math.log10(self.p((1 << k) | (data[i] >> (8 - k)), data[i] >> (7 - k) & 1, data[i - self.depth : i])) for i in range(self.depth, len(data)) for k in range(8))


def stream(text, depth):
    return b"\n" * depth + " ".join(tokens(text)).encode() + b"\n"


def base(rows):
    c, docs = Counter(), [(d, tokens(t)) for d, t in rows]
    for d, ws in docs:
        if not held(d):
            c.update(ws)
            c["\n"] += 1
    n, v = sum(c.values()), len(c)
    out = []
    for d, ws in docs:
        ts = [*ws, "\n"]
        out.append((d, held(d), len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts)))
    return out


def key(r):
    return (r[0] is None, r[0] or 0, r[2], r[3])


def compare(rows, want):
    got = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows), key=key)
    want = sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-9, abs=1e-9)


def test_query_base_against_brute_force(spark, sf, documents):
    rows = QUERIES["op8_lm"](spark, sf).collect()
    compare(rows, base(list(zip(documents.doc_id.tolist(), documents.text.tolist()))))
    ok = [r for r in rows if r["held_out"] and r["n_tokens"] > 50]
    assert np.mean([r["bits_per_byte"] for r in ok]) < 4


def test_model_against_brute_force(spark, make_docs):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcé", k=rng.randrange(1, 5))) for _ in range(12)]
    rows = [(i, rng.choice([" ", "\n ", "\t"]).join(rng.choices(words, k=rng.randrange(0, 12)))) for i in range(40)]
    rows += [(100, None), (101, " \n"), (None, "never Learned words"), (102, "Zz unknown " + words[0]), (103, "A " * 3000), (5, rows[5][1]), (5, rows[5][1])]
    docs = make_docs(rows).withColumnRenamed("lang", "block").withColumnRenamed("source", "held")
    for depth in (3, 5):
        got = ctw.score(docs, depth=depth, blocks=3).collect()
        compare(got, base(rows))
        tree = Tree(depth)
        for d, t in rows:
            if not held(d):
                tree.add(stream(t, depth))
        tree.finish()
        want = defaultdict(list)
        for d, t in rows:
            want[d].append(tree.score(stream(t, depth)))
        seen = defaultdict(list)
        for r in got:
            seen[r["doc_id"]].append(r["score"])
        for d in want:
            assert sorted(seen[d]) == pytest.approx(sorted(want[d]), rel=1e-5)


def test_edges(spark, make_docs):
    docs = make_docs([(1, "a b")])
    assert ctw.score(docs.limit(0)).collect() == []
    (r,) = ctw.score(make_docs([(None, "ab")]), blocks=2).collect()
    assert r["score"] == pytest.approx(-24 * math.log10(2)) and r["base_score"] == 0 and r["train_tokens"] == 0


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.5, 100.5, 1e7])
    assert ctw._log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-10, abs=1e-10)


def test_default_depth_and_pieces(spark, make_docs):
    """The query learns contexts of 5 bytes, also where a task's contexts are built a few at a time."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefg", k=rng.randrange(4, 9))) for _ in range(10)]
    rows = [(i, " ".join(rng.choices(words, k=20))) for i in range(30)]
    tree = Tree(5)
    for d, t in rows:
        if not held(d):
            tree.add(stream(t, 5))
    tree.finish()
    want = [tree.score(stream(t, 5)) for _, t in rows]
    for piece in (ctw.PIECE, 50):
        got = {r["doc_id"]: r["score"] for r in ctw.score(make_docs(rows), piece=piece).collect()}
        assert [got[d] for d, _ in rows] == pytest.approx(want, rel=1e-5)
    grams = np.unique(np.random.default_rng(3).integers(0, 1 << 48, 500).astype(np.uint64) & np.uint64(0x030303030303))
    n = np.arange(len(grams)) % 3
    whole, _ = ctw._subtrees(grams, n, 5)
    near = (grams >> np.uint64(8)) & np.uint64(0xFFFF)
    for c in np.unique(near):
        assert ctw._subtrees(grams[near == c], n[near == c], 5)[0] == pytest.approx(whole[near == c], rel=1e-6)


def test_a_blocks_questions_are_packed_in_little_memory():
    import tracemalloc

    g = np.unique(np.random.default_rng(1).integers(0, 1 << 48, 1 << 21).astype(np.uint64))
    tracemalloc.start()
    ctw._packed(g, 256, 0, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4.2 * g.nbytes
    t = ctw._packed(g, 256, 0, 1, (g & np.uint64(1023)).astype(float))
    got = {s: (np.frombuffer(a, np.uint64), np.frombuffer(b, np.float32)) for s, a, b in zip(t["share"].to_pylist(), t["grams"].to_pylist(), t["values"].to_pylist())}
    assert sum(len(a) for a, _ in got.values()) == len(g) and np.array_equal(np.sort(np.concatenate([a for a, _ in got.values()])), g)
    for s, (a, b) in got.items():
        assert (np.diff(a.astype(np.int64)) > 0).all() and np.array_equal(b, (a & np.uint64(1023)).astype(np.float32))
        assert ((ctw.mixed(a) >> np.uint64(32)) % np.uint64(256) == s).all()


def test_distinct_grams_are_brought_together_as_they_come(monkeypatch):
    monkeypatch.setattr(ctw, "FLUSH", 100)
    rng = np.random.default_rng(2)
    some = [rng.integers(0, 300, 80).astype(np.uint64) for _ in range(20)]
    u = ctw._Distinct()
    for a in some:
        u.add(a)
        assert u.held <= max(100, 2 * 300) + 80
    assert np.array_equal(u.all(), np.unique(np.concatenate(some))) and len(ctw._Distinct().all()) == 0


def test_questions_are_answered_once(spark, make_docs):
    """One pass over the questions gives the answers and the totals, and one row holds what a block asks of a share."""
    plan = ctw.score(make_docs([(1, "a b")]), blocks=2)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow answer(") == 1 and "Join" not in plan and "Aggregate" not in plan


def test_blocks_without_documents_and_long_words(spark, make_docs):
    long = ["x" * 300, "x" * 299 + "y", "y" + "x" * 299, "é" * 200]
    rows = [(i, " ".join((long[i % 4], long[(i + 1) % 4], "ab", f"w{i % 3}"))) for i in range(9)]
    for blocks in (1, 40):
        compare(ctw.score(make_docs(rows), depth=2, blocks=blocks).collect(), base(rows))


def test_a_blocks_words_are_packed_by_share():
    import pyarrow as pa

    words = [b"\n", b"a", b"ab", b"abcdefgh", b"abcdefghi", b"x" * 256, b"x" * 257, b"x" * 256 + b"y", *(b"w%d" % i for i in range(500))]
    n = np.arange(len(words))
    h = ctw._hashes(pa.array(words, pa.binary()))
    assert len(set(h.tolist())) == len(words) and (ctw._hashes(pa.array(words[::-1], pa.binary()))[::-1] == h).all()
    assert (ctw._hashes(pa.array([b"", *words], pa.binary()).slice(1)) == h).all()
    gram = np.arange(5, dtype=np.uint64)
    t = ctw._asked(gram, pa.array(words, pa.binary()), n, 64, 3)
    assert t.num_rows <= 64 and len(set(t["share"].to_pylist())) == t.num_rows and set(t["block"].to_pylist()) == {3}
    got, grams = {}, []
    for share, g, spelled, sizes, counts in zip(*(t[c].to_pylist() for c in ("share", "grams", "words", "sizes", "values"))):
        grams += np.frombuffer(g or b"", np.uint64).tolist()
        at = 0
        for size, count in zip(np.frombuffer(sizes or b"", np.int32).tolist(), np.frombuffer(counts or b"", np.int64).tolist()):
            word, at = spelled[at : at + size], at + size
            got[word] = count
            assert ctw._shares(h[[words.index(word)]], 64)[1].tolist() == [share]
    assert got == dict(zip(words, n.tolist())) and sorted(grams) == gram.tolist()


def test_counts_of_grams_are_summed():
    rng = np.random.default_rng(5)
    keys, counts = [rng.integers(0, 50, 40).astype(np.uint64) for _ in range(5)], [rng.integers(0, 9, 40) for _ in range(5)]
    want = Counter()
    for k, c in zip(keys, counts):
        for x, y in zip(k.tolist(), c.tolist()):
            want[x] += y
    key, n = ctw._summed(keys, counts)
    assert dict(zip(key.tolist(), n.tolist())) == want and (np.diff(key.astype(np.int64)) > 0).all()
    (b,) = ctw._context_rows(key << np.uint64(8), n, 16)
    assert sorted(ctw._values(b.column("grams"), np.uint64).tolist()) == (key << np.uint64(8)).tolist() and ctw._values(b.column("counts"), np.int64).sum() == n.sum()
