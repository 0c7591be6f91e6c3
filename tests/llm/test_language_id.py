from __future__ import annotations

import math
import zlib

import numpy as np

from pagemill.llm import language_id as L
from pagemill.llm.queries import QUERIES


def arrays(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw])


def plain_set(text):
    """n-gram bucket set from the definition, one n-gram at a time."""
    s, out = bytearray(b" "), set()
    for b in "".join(c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in text).encode():
        c = b if 97 <= b <= 122 or b >= 128 else 32
        if c != 32 or s[-1] != 32:
            s.append(c)
    if s[-1] != 32 or len(s) == 1:
        s.append(32)
    for n in range(1, 5):
        for i in range(len(s) - n + 1):
            v = int.from_bytes(s[i : i + n], "little")
            out.add(((v * int(L._FACTORS[n - 1])) & 0xFFFFFFFF) >> 16)
    return out


def test_presence_is_the_definitions():
    texts = ["", "a", "Zwei Wörter!", "ÉTÉ, été × 12", "x" * 5000, "  \n", "漢字 ab", "tail."]
    flags = L.presence(*arrays(texts))
    assert [set(np.flatnonzero(f)) for f in flags] == [plain_set(t) for t in texts]


def test_kernel_and_regression_by_plain_arithmetic():
    texts = [w * k for k in (1, 2, 3) for w in ("der und die ", "the and of ", "el los que ")]
    flags = L.presence(*arrays(texts)).astype(np.uint8)
    sets = [plain_set(t) for t in texts]
    k = [[len(a & b) / math.sqrt(len(a) * len(b)) for b in sets] for a in sets]
    assert np.allclose(L._kernel(flags, flags), k)
    # with every row a landmark, Nyström features are exact: the same fit as weighted kernel ridge regression
    y = np.array([0, 1, 2] * 3)
    k = np.array(k) + 0.0
    coef = L.solve(flags[:3], y[:3], np.ones(3), 3, np.arange(3), ridge=0.1)
    kk = k[:3, :3]
    dual = np.linalg.solve(kk + 0.1 * np.eye(3), np.where(y[:3, None] == np.arange(3), 1.0, -1.0))
    assert np.allclose(kk @ coef, kk @ dual)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    true = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op12_language"](spark, sf).collect()
    assert len(rows) == len(true)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    test = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in test) / len(test) > 0.98


def test_edges(spark):
    schema = "doc_id bigint, text string, lang string, score string, `has letter` int"
    rows = [(i, ("der die und " if i % 2 else "the of and ") * (1 + i % 5), "de" if i % 2 else "en", "z", 1) for i in range(100)]
    rows += [(200, None, "en", None, None), (201, "", "en", "", 0), (202, "12 ... !", "de", "", 0), (None, "der und", None, None, 0), (203, "the of " * 60000, None, "", 0), (203, "the of " * 60000, None, "", 0), (204, "漢字", None, "", 1)]
    docs = spark.createDataFrame(rows, schema)
    model = L.train(docs)
    assert model[0] == ["de", "en"]
    out = L.predict(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "has letter", "lang_pred", "score"]
    got = [(r[0], r[5], r[6]) for r in out.collect()]
    assert len(got) == len(rows)
    assert {g[1:] for g in got if g[0] in (200, 201, 202)} == {("und", 0.0)}
    assert [g[1] for g in got if g[0] is None] == ["de"] and [g[1] for g in got if g[0] == 203] == ["en", "en"]
    assert {g[1] for g in got if g[0] == 204} <= {"de", "en"}
    assert all(g[1] == ("de" if g[0] % 2 else "en") for g in got if g[0] is not None and g[0] < 100)
    assert L.predict(docs.limit(0), model).collect() == []
    nothing = L.train(docs.limit(0))
    assert {(r[5], r[6]) for r in L.predict(docs, nothing).collect()} == {("und", 0.0)}


def test_training_rows_are_bounded_and_repeatable(spark):
    rows = [(i, f"wort{i} und der" if i % 3 else f"word{i} the of", "de" if i % 3 else "en") for i in range(300)]
    docs = spark.createDataFrame(rows * 2, "doc_id bigint, text string, lang string")
    a, b = L.train(docs, max_rows=20, landmarks=8), L.train(docs.repartition(7), max_rows=20, landmarks=8)
    assert len(a[1]) == 8 and a[0] == b[0] and (a[1] == b[1]).all() and np.allclose(a[2], b[2])
