from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pagemill.llm import simhash
from tests.llm.test_mixing import brute_targets
from tests.llm.test_packing import check as check_packing
from tests.llm.test_simhash import brute_components, brute_fp

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGE = dict(corpus_pipeline.STAGES)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_order_and_columns(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "suffix_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).dtypes == docs.dtypes, name


def test_toxicity_rejects_marked_and_leaves_the_rest(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r["doc_id"] for r in STAGE["toxicity"](spark, docs, sf).select("doc_id").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    clean = [d for d, t in labels.items() if t == 0]
    toxic = [d for d, t in labels.items() if t == 1]
    assert sum(d in kept for d in clean) > 0.99 * len(clean)
    assert sum(d not in kept for d in toxic) > 0.8 * len(toxic)


def test_simhash_keeps_one_of_each_group(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    fps = [(d, brute_fp(t)) for d, t in zip(documents.doc_id.tolist(), documents.text.tolist())]
    want = set(brute_components(fps).values())
    got = rows(STAGE["simhash"](spark, docs, sf))
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    texts = dict(zip(documents.doc_id.tolist(), documents.text.tolist()))
    assert all(r["text"] == texts[r["doc_id"]] for r in got)


def test_suffix_stage_cuts_texts(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in rows(STAGE["suffix_dedup"](spark, docs, sf))}
    seen: set[bytes] = set()
    for r in documents.sort_values("doc_id").itertuples():
        b = r.text.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 99):
            w = b[i : i + 100]
            if w in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        if b and not kept:
            assert r.doc_id not in got
        else:
            assert got[r.doc_id]["text"] == kept and got[r.doc_id]["n_chars"] == len(kept) or kept == r.text


def test_mixing_stage_repeats_documents(spark, sf, documents):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    size = {r.doc_id: len(WORD.findall(r.text)) for r in documents.itertuples()}
    source = dict(zip(documents.doc_id, documents.source))
    totals: dict = {}
    for d, n in size.items():
        totals[source[d]] = totals.get(source[d], 0) + n
    goal = brute_targets(totals)
    got = [r["doc_id"] for r in rows(STAGE["mixing"](spark, docs, sf))]
    assert max(got.count(d) for d in set(got)) <= 3
    for s in totals:
        taken = sum(size[d] for d in got if source[d] == s)
        assert abs(taken - goal[s]) <= max(n for d, n in size.items() if source[d] == s) / 2 + 1


def test_run_packs_what_the_stages_leave(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.count() > 0
    texts = [(r["doc_id"], r["text"]) for r in rows(docs)]
    out = corpus_pipeline.run(spark, sf).collect()
    used, least = check_packing(out, texts)
    assert used <= 1.03 * least + 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, sf, name):
    """Nulls in any column, empty and long texts, repeated rows, clashing column names, an empty table."""
    made = [(1, None, "en", "a", 0, "x"), (None, "some words here", None, None, None, None), (3, "", "fr", "b", 0, "y"), (4, "long " * 60000, "de", "a", 1, "z"), (5, "same text twice", "en", "a", 2, "q"), (5, "same text twice", "en", "a", 2, "q")]
    docs = spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint, `_score` string")
    docs = docs.withColumns({c: F.col("lang") for c in ("_copies", "block", "doc", "fp", "kept", "_size", "size", "h", "sequence_id2", "_id", "component_id", "n_removed", "carried0", "_weight")})
    out = STAGE[name](spark, docs, sf)
    n = out.count()
    if name == "packing":
        assert n == 5 + -(-60001 // 1024)
    else:
        assert out.columns == docs.columns
        assert n <= {"toxicity": 6, "simhash": 5, "suffix_dedup": 6, "mixing": 18}[name]
    empty = STAGE[name](spark, docs.limit(0), sf)
    assert empty.count() == 0


def test_shingles_of_the_contract():
    assert (simhash.SHINGLE, simhash.MAX_BITS) == (3, 3)
