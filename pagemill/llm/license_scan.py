"""License scans (operator 3): a positional rare-token index.

The templates' words form a small vocabulary whose document frequencies are counted over the
whole corpus (one row per word and batch before the shuffle). Each template is indexed under
its words of highest IDF, with their positions. A document's occurrences of such words look up
the postings; a posting fixes where the template would start, and occurrences that agree on
that relative position are intersected. What is left is verified: the words of every mandatory
phrase must stand at their places, and the score is the share of the template's IDF that lies
aligned with it.

A phrase template is mandatory as a whole and is looked up under its rarest word alone, so all
its places in a text are found.

Words are runs of digits, letters a-z and characters beyond ASCII after lower-casing A-Z.
Defined results: null and empty texts have no word, no label and score 0; repeated rows are
scored alike; an empty table gives an empty result. Other columns are carried through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import ALNUM, LOWER, guarded, run_hashes, slices, spans


@dataclass(frozen=True)
class Template:
    """`phrases`: mandatory ones, each part of the text; none given: the whole text."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    base: bool = False
    words: tuple[str, ...] = field(init=False)
    fixed: tuple[int, ...] = field(init=False)  # positions of mandatory words

    def __post_init__(self):
        words = tuple(self.text.split())
        fixed: set[int] = set()
        for p in self.phrases or (self.text,):
            q = tuple(p.split())
            at = next(i for i in range(len(words)) if words[i : i + len(q)] == q)
            fixed |= set(range(at, at + len(q)))
        object.__setattr__(self, "words", words)
        object.__setattr__(self, "fixed", tuple(sorted(fixed)))


# Phrases and labels of the contract, then opening words of public licence texts.
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)
TEMPLATES = BASE + (
    Template("agpl", "gnu affero general public license"),
    Template("all-rights-reserved", "all rights reserved"),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
             ("source and binary forms", "following conditions are met")),
    Template("cc-by-nc", "cc by nc"),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nd", "cc by nd"),
    Template("cc-by-sa", "cc by sa"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc0", "cc0 1 0 universal"),
    Template("epl", "eclipse public license"),
    Template("gpl-2.0", "under the terms of the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
             ("for any purpose with or without fee",)),
    Template("lgpl", "gnu lesser general public license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
             ("free of charge to any person obtaining a copy",)),
    Template("mit", "released under the mit license", ("the mit license",)),
    Template("mpl", "mozilla public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of "
             "the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed "
             "on an as is basis without warranties or conditions of any kind either express or implied",
             ("you may not use this file except in compliance with the license", "without warranties or conditions of any kind")),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must "
             "reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
             ("redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice")),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without "
             "specific prior written permission", ("names of its contributors may be used", "to endorse or promote products derived from this software")),
    *(Template(f"gpl-{v}.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software "
               f"foundation either version {v} of the license or at your option any later version", ("you can redistribute it and or modify it", f"either version {v} of the license")) for v in (2, 3)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software "
             "without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
             ("free of charge to any person obtaining a copy", "to deal in the software without restriction", "modify merge publish distribute sublicense")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one",
             ("subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file")),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
#: Share of a template's IDF that must be aligned for its label.
THRESHOLD = 0.6


def _vocabulary(templates: tuple[Template, ...]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words, their sorted hashes, and the word number of each hash."""
    words = sorted({w for t in templates for w in t.words})
    raw = [w.encode() for w in words]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    end = np.cumsum([len(r) for r in raw])
    h = run_hashes(buf, end - np.array([len(r) for r in raw]), end)
    order = np.argsort(h)
    return words, h[order], order


def _numbers(buf: np.ndarray, off: np.ndarray, hashes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary number of each word of the slice (-1: none) and the words per row."""
    low = LOWER[buf]
    starts, ends, words = spans(low, off, ALNUM)
    h = run_hashes(low, starts, ends)
    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
    return np.where(hashes[at] == h, order[at], -1), words


def document_frequencies(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> tuple[np.ndarray, int]:
    """Documents of the whole table that hold each vocabulary word, and all documents."""
    words, hashes, order = _vocabulary(templates)
    v = len(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(v + 1, np.int64)  # the last one: documents
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                number, n = _numbers(buf, off, hashes, order)
                hit = np.flatnonzero(number >= 0)
                row = np.repeat(np.arange(rows.num_rows), n)[hit]
                df[:v] += np.bincount(np.unique(row * v + number[hit]) % v, minlength=v)
                df[v] += rows.num_rows
        yield pa.record_batch([pa.array(np.arange(v + 1)), pa.array(df)], names=["w", "df"])

    got = docs.select("text").mapInArrow(count, "w bigint, df bigint").groupBy("w").agg(F.sum("df").alias("df")).collect()  # a row per vocabulary word
    df = np.zeros(v + 1, np.int64)
    for r in got:
        df[r["w"]] = r["df"]
    return df[:v], int(df[v])


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word, base_labels, labels, score, best_label. Columns of the same names
    are kept beside them."""
    return guarded(docs, ("doc_id", "text"), lambda d: _scan(d, templates, threshold))


def _scan(docs: DataFrame, templates: tuple[Template, ...], threshold: float) -> DataFrame:
    df, n_docs = document_frequencies(docs, templates)
    words, hashes, order = _vocabulary(templates)
    number_of = {w: i for i, w in enumerate(words)}
    idf = np.log((n_docs + 1) / (df + 0.5))
    spelled = [np.array([number_of[w] for w in t.words]) for t in templates]
    # word number -> (template, position): each template under the rarest word of each mandatory phrase; all of
    # them must agree on a position, which loses nothing, as the phrases must stand there anyway
    postings: dict[int, list[tuple[int, int]]] = {}
    indexed = []
    for k, (t, s) in enumerate(zip(templates, spelled)):
        cuts = [0, *(i for i in range(1, len(t.fixed)) if t.fixed[i] != t.fixed[i - 1] + 1), len(t.fixed)]
        rare = [min(t.fixed[lo:hi], key=lambda i: (-idf[s[i]], i)) for lo, hi in zip(cuts, cuts[1:])]
        indexed.append(len(rare))
        for i in rare:
            postings.setdefault(int(s[i]), []).append((k, i))
    keep = [c for c in docs.columns if c != "text"]
    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, best_label string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        looked_up = np.zeros(len(words) + 1, bool)
        looked_up[list(postings)] = True
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                number, n = _numbers(buf, off, hashes, order)
                first = np.cumsum(n) - n
                row_of = np.repeat(np.arange(rows.num_rows), n)
                cand: dict[int, list[np.ndarray]] = {}
                rare = np.flatnonzero(looked_up[number])
                for w in np.unique(number[rare]).tolist():
                    where = rare[number[rare] == w]
                    for k, i in postings[w]:
                        start = where - i
                        ok = (start >= first[row_of[where]]) & (start + len(spelled[k]) <= (first + n)[row_of[where]])
                        cand.setdefault(k, []).append(start[ok])
                n_base = np.zeros(rows.num_rows, np.int64)
                lo = np.full(rows.num_rows, np.iinfo(np.int64).max)
                hi = np.full(rows.num_rows, -1)
                score = np.zeros(rows.num_rows)
                best: dict[int, str] = {}
                base: dict[int, set[str]] = {}
                all_: dict[int, set[str]] = {}
                for k, lists in cand.items():
                    t, s = templates[k], spelled[k]
                    start, agree = np.unique(np.concatenate(lists), return_counts=True)
                    start = start[agree == indexed[k]]
                    for i in t.fixed:
                        start = start[number[start + i] == s[i]]
                    if not len(start):
                        continue
                    aligned = sum(idf[s[i]] * (number[start + i] == s[i]) for i in range(len(s))) / idf[s].sum()
                    row = row_of[start]
                    if t.base:
                        np.add.at(n_base, row, 1)
                        np.minimum.at(lo, row, start - first[row])
                        np.maximum.at(hi, row, start - first[row])
                    for r, a in zip(row.tolist(), aligned.tolist()):
                        if a > score[r] or (a == score[r] and t.label < best.get(r, "~")):
                            score[r], best[r] = a, t.label
                        if a >= threshold:
                            all_.setdefault(r, set()).add(t.label)
                            if t.base:
                                base.setdefault(r, set()).add(t.label)
                none = n_base == 0
                each = range(rows.num_rows)
                yield pa.record_batch(
                    [*(rows.column(c) for c in keep), pa.array(n), pa.array(n_base), pa.array(lo, mask=none), pa.array(hi, mask=none),
                     pa.array([",".join(sorted(base.get(r, ()))) for r in each]), pa.array([",".join(sorted(all_.get(r, ()))) for r in each]),
                     pa.array(np.clip(score, 0, 1)), pa.array([best.get(r) for r in each], pa.string())],
                    names=[*keep, "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "best_label"])

    return docs.select(*keep, "text").mapInArrow(run, schema)
