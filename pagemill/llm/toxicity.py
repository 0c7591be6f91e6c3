"""Toxicity (operator 5): FTRL-proximal logistic regression over hashed word n-grams.

Features are the distinct hashes (into 2^`bits` buckets) of a text's words, word pairs and
pairs that skip one word. Training reads a bounded sample of the labelled rows: the
`max_rows` with the smallest hash of their id (a documented bound; every other step covers
all rows). Each example updates its coordinates with their own learning rate, and the L1
term keeps most weights at zero, so the model that is broadcast is small: at most 2^`bits`
weights by construction, a few thousand in practice.

Defined results: null and empty texts have no feature and score by the bias alone; without
a usable label (or an empty table) every score is 0.5 by the zero model; labels repeated for
a doc_id count once, the higher; a null doc_id is never learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import ALNUM, LOWER, guarded, mixed, run_hashes, slices, spans

BITS = 20
MAX_ROWS = 16000
EPOCHS = 6


def features(buf: np.ndarray, off: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word, adjacent pair and one-skip pair; repeats not removed."""
    low = LOWER[buf]
    starts, ends, words = spans(low, off, ALNUM)
    h = run_hashes(low, starts, ends)
    row = np.repeat(np.arange(len(words), dtype=np.int64), words)
    rows, hashes = [row], [h]
    for gap, factor in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        if len(h) > gap:
            same = row[:-gap] == row[gap:]
            with np.errstate(over="ignore"):
                hashes.append(mixed(h[:-gap][same] * np.uint64(factor) + h[gap:][same]))
            rows.append(row[gap:][same])
    return np.concatenate(rows), (np.concatenate(hashes) >> np.uint64(64 - bits)).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal for binary features; coordinate 2^bits is the bias."""

    def __init__(self, size: int, alpha: float = 5.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, i: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[i], self.n[i]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        w[np.abs(z) <= self.l1] = 0.0
        return w

    def learn(self, i: np.ndarray, y: int) -> None:
        w = self.weights(i)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, weights) of the non-zero coordinates, learned from labelled rows that aren't held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).where(~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("bigint").alias("_id")).agg(F.max("toxic").cast("int").alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)  # the documented bound: ids and labels only
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), "text").join(F.broadcast(sample), "_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, off in slices(batch, "text", 1 << 20):
                row, bucket = features(buf, off, bits)
                key = np.unique(row << bits | bucket)
                count = np.bincount(key >> bits, minlength=part.num_rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array((key & ((1 << bits) - 1)).astype(np.int32)))
                yield pa.record_batch([part.column("_id"), part.column("_y"), lists], names=["id", "y", "f"])

    size = (1 << bits) + 1

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, ys, fs = [], [], []
        for b in batches:
            ids += b.column("id").to_pylist()
            ys += b.column("y").to_pylist()
            f = b.column("f")
            fs += [f[i].values.to_numpy() for i in range(len(f))]
        if not ids:
            return
        order = np.lexsort((ids, mixed(np.array(ids, np.int64).view(np.uint64))))  # no order of arrival
        model = Ftrl(size)
        for _ in range(epochs):
            for k in order.tolist():
                model.learn(np.append(fs[k], size - 1), ys[k])
        w = model.weights(slice(None))
        at = np.flatnonzero(w)
        yield pa.record_batch([pa.array(at), pa.array(w[at])], names=["i", "w"])

    # one task by design: the sample is bounded by max_rows
    fitted = rows.mapInArrow(extract, "id bigint, y int, f array<int>").repartition(1).mapInArrow(fit, "i bigint, w double").collect()
    return np.array([r["i"] for r in fitted], np.int64), np.array([r["w"] for r in fitted], float)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int = BITS) -> DataFrame:
    """`docs` with `_score`, the probability of label 1; only the text is looked at. A column of that name is
    kept beside it."""
    return guarded(docs, ("text",), lambda d: _scored(d, model, bits))


def _scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], bits: int) -> DataFrame:
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # at most 2^bits + 1 weights
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", _score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight = shared.value
        w = np.zeros((1 << bits) + 1)
        w[at] = weight
        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                row, bucket = features(buf, off, bits)
                hit = w[bucket] != 0
                key = np.unique(row[hit] << bits | bucket[hit])
                m = w[-1] + np.bincount(key >> bits, w[key & ((1 << bits) - 1)], part.num_rows)
                yield pa.record_batch([*part.columns, pa.array(1.0 / (1.0 + np.exp(-np.clip(m, -35, 35))))], names=[*part.schema.names, "_score"])

    return docs.mapInArrow(run, schema)
