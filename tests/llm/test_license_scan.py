from __future__ import annotations

import re

from pagemill.llm import license_scan
from pagemill.llm.queries import QUERIES

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for p, label in PHRASES.items():
        q = p.split()
        for i in range(len(words) - len(q) + 1):
            if words[i : i + len(q)] == q:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def check(rows, texts):
    want = sorted(((d is None, d or 0, *brute(t)) for d, t in texts), key=str)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows), key=str) == want
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(",")) - {""}))


def test_query_against_brute_force(spark, sf, documents):
    rows = QUERIES["op3_license"](spark, sf).collect()
    check(rows, list(zip(documents.doc_id.tolist(), documents.text.tolist())))
    assert any(r["n_base"] for r in rows)


def test_templates_and_edges(spark, make_docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
    changed = mit.replace("hereby", "herewith").replace("associated", "related")
    no_key = mit.replace("free of charge", "at some cost")
    texts = [(1, None), (2, ""), (3, "The MIT License. " * 40000), (4, mit), (5, changed), (6, no_key), (7, "cc by-nc 4.0 CC BY-SA CC BY"), (7, "cc by-nc 4.0 CC BY-SA CC BY"),
             (None, "GNU Lesser General Public License and GNU general  public\nLICENSE"), (9, "apache license apache license"), (10, "xgnu general public license cc"), (11, "by GNU général public license ccby é cc by"),
             (12, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"), (13, "gnu general public"), (14, "license")]
    texts += [(100 + i, "some other words and the in for to a of this copy use all rights") for i in range(50)]
    docs = make_docs(texts).withColumnRenamed("lang", "number").withColumnRenamed("source", "w")
    rows = license_scan.scan(docs).collect()
    check(rows, texts)
    got = {r["doc_id"]: r for r in rows}
    assert got[4]["labels"] == "mit" and got[4]["score"] == 1.0
    assert got[5]["labels"] == "mit" and got[5]["score"] < 1.0
    assert got[6]["labels"] == ""
    assert got[7]["labels"] == "cc-by,cc-by-nc,cc-by-sa" and got[7]["n_base"] == 3
    assert got[None]["labels"] == "gpl,lgpl"
    assert got[12]["labels"] == "bsd"
    assert license_scan.scan(docs.limit(0)).collect() == []


def test_notices_need_all_their_phrases_and_nothing_rarer(spark, make_docs):
    bsd = next(t for t in license_scan.TEMPLATES if t.label == "bsd" and len(t.words) > 30)
    full = " ".join(bsd.words)
    fixed = set(bsd.fixed)
    # every word outside the phrases altered but as many as the threshold wants
    loose = [i for i in range(len(bsd.words)) if i not in fixed]
    altered = " ".join(w if i not in loose[:6] else "zzz" for i, w in enumerate(bsd.words))
    broken = full.replace("must reproduce", "may reproduce")
    docs = make_docs([(1, full), (2, altered), (3, broken)] + [(10 + i, "other words of the text and conditions") for i in range(30)]).withColumnRenamed("lang", "n_words").withColumnRenamed("source", "score")
    out = license_scan.scan(docs)
    got = {r[0]: r[out.columns.index("labels")] for r in out.collect()}  # columns of the same names stand in front
    assert (got[1], got[2], got[3], got[10]) == ("bsd", "bsd", "", "")


def test_index_loses_nothing(spark, sf, documents):
    """Every template at every place, checked word by word."""
    import re

    import numpy as np

    df, n = license_scan.document_frequencies(spark.read.parquet(f"{sf}/documents.parquet"), license_scan.TEMPLATES)
    words, _, _ = license_scan._vocabulary(license_scan.TEMPLATES)
    idf = dict(zip(words, np.log((n + 1) / (df + 0.5))))
    rows = {r["doc_id"]: r["labels"] for r in QUERIES["op3_license"](spark, sf).collect()}
    for d, text in zip(documents.doc_id.tolist(), documents.text.tolist()):
        own = re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        want = set()
        for t in license_scan.TEMPLATES:
            places = [i for i, w in enumerate(own) if w == t.words[t.fixed[0]]]
            for i in places:
                at = i - t.fixed[0]
                if at >= 0 and at + len(t.words) <= len(own) and all(own[at + k] == t.words[k] for k in t.fixed):
                    if sum(idf[w] for k, w in enumerate(t.words) if own[at + k] == w) / sum(idf[w] for w in t.words) >= license_scan.THRESHOLD:
                        want.add(t.label)
        assert rows[d] == ",".join(sorted(want))


def test_rows_do_not_join(spark, make_docs):
    docs = make_docs([(1, "gnu general"), (2, "public license"), (3, "apache"), (4, "license")])
    assert all(r["n_base"] == 0 for r in license_scan.scan(docs).collect())
