"""Language identification (operator 12): string-kernel classification.

A text is the set of its hashed n-grams of 1 to 4 bytes (A-Z and À-Þ lower-cased, everything
that is not a letter one blank). The blended-spectrum presence kernel of two texts is
|A ∩ B| / sqrt(|A| |B|). Landmarks, drawn from the training rows, give each text its Nyström
features K_mm^(-1/2) k(x); one ridge regression a language, against the rest, is solved on them.
Scoring multiplies a block of texts by the landmarks, and the block's kernel rows by the solved
coefficients.

Bounds, all parameters: the classifier is fitted on at most `max_rows` different training rows, of each
language those with the smallest hash, languages in turn; at most `landmarks` of them are
landmarks (2^16 bits each, so the broadcast model has at most `landmarks` times 8 KB and one
coefficient a landmark and language). Every text is read and scored whole.

Defined results: `und` with score 0 where the text is null or has no letter, and for all rows where
nothing was learned (no training row with a language); rows without doc_id are held out; a
repeated doc_id is learned from as often as it stands. Ties go to the language that sorts first.
Columns of `docs` other than doc_id, text and lang pass unseen and unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import LOWER, guarded, slices

BUCKET_BITS = 16
GRAM = 4
MAX_ROWS = 4096
LANDMARKS = 256
RIDGE = 1e-3
BLOCK = 64

_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = _LETTER[0x80:] = True
#: Odd multipliers, one for each length of an n-gram.
_FACTORS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def symbols(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of the rows, runs of anything else as one blank (also before and after each
    row), and the row of each symbol."""
    low = LOWER[buf]
    if len(low) > 1:
        accented = (buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)
        low[1:][accented] += 0x20
    # a blank goes in front of each row, one more at the end of the last
    lengths = np.diff(off)
    s = np.insert(np.where(_LETTER[low], low, 0x20), off, 0x20).astype(np.uint32)
    row = np.repeat(np.arange(len(lengths) + 1), np.append(lengths + 1, 1))
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0x20) | (s[:-1] != 0x20) | (row[1:] != row[:-1])
    s, row = s[keep], row[keep]
    # the next row's blank closes a row: one that ends in a blank of its own drops that
    last = np.append(row[1:] != row[:-1], True)
    first = np.append(True, row[1:] != row[:-1])
    keep = (s != 0x20) | ~last | first
    return s[keep], row[keep]


def presence(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x 2^16 matrix: does the row hold an n-gram of that bucket?"""
    n = len(off) - 1
    flags = np.zeros((n + 1) << BUCKET_BITS, bool)
    s, row = symbols(buf, off)
    gram = np.zeros(len(s), np.uint32)
    for size in range(1, GRAM + 1):
        if len(s) < size:
            break
        gram = gram[: len(s) - size + 1] | s[size - 1 :] << np.uint32(8 * (size - 1))
        # the blank before the next row closes a row: only an n-gram's last symbol may be of that row
        inside = row[: len(gram)] == row[max(size - 2, 0) : max(size - 2, 0) + len(gram)]
        bucket = (gram * _FACTORS[size - 1]) >> np.uint32(32 - BUCKET_BITS)
        flags[(row[: len(gram)] << BUCKET_BITS | bucket.astype(np.int64))[inside]] = True
    return flags.reshape(n + 1, -1)[:n]


def _kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Presence kernel of two 0/1 matrices, in blocks of rows."""
    nb = np.sqrt(np.maximum(b.sum(1, dtype=np.float64), 1))
    bt = np.ascontiguousarray(b.T.astype(np.float32))
    out = np.empty((len(a), len(b)))
    for lo in range(0, len(a), BLOCK):
        part = a[lo : lo + BLOCK]
        na = np.sqrt(np.maximum(part.sum(1, dtype=np.float64), 1))
        out[lo : lo + BLOCK] = (part.astype(np.float32) @ bt) / na[:, None] / nb
    return out


def solve(flags: np.ndarray, y: np.ndarray, times: np.ndarray, n_classes: int, landmarks: np.ndarray, ridge: float = RIDGE) -> np.ndarray:
    """Coefficients (landmarks x classes) of the ridge regressions on the Nyström features of the
    rows, each of which stands `times` times."""
    k = _kernel(flags, flags[landmarks])
    w, v = np.linalg.eigh(k[landmarks])
    good = w > w.max() * 1e-8
    root = v[:, good] / np.sqrt(w[good])  # K_mm^(-1/2), in the eigenvectors' frame
    phi = k @ root
    target = np.where(y[:, None] == np.arange(n_classes), 1.0, -1.0)
    weight = times / np.maximum(np.bincount(y, times, minlength=n_classes), 1)[y]  # languages count alike
    gram = (phi * weight[:, None]).T @ phi
    return root @ np.linalg.solve(gram + ridge * np.eye(gram.shape[0]), (phi * weight[:, None]).T @ target)


def train(docs: DataFrame, max_rows: int = MAX_ROWS, landmarks: int = LANDMARKS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, packed landmark sets, coefficients), learned from text and lang of rows that aren't held out."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    rows = rows.select(F.col("lang").cast("string").alias("lang"), "doc_id", F.xxhash64("text").alias("t"))
    # the sample is drawn on ids and hashes alone; its texts are fetched after
    rows = rows.groupBy("lang", "doc_id", "t").agg(F.count(F.lit(1)).alias("n")).withColumn("h", F.xxhash64("doc_id", "t"))
    share = rows.groupBy("lang").agg((F.lit(2.0 * max_rows) / F.count(F.lit(1))).alias("share"))
    # of a common language only about 2 * max_rows rows of smallest hash are ranked
    few = rows.join(share, "lang").where(F.col("h") / 2.0**64 + 0.5 <= F.col("share"))
    ranked = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "t"))).where(F.col("r") <= max_rows)
    sample = ranked.orderBy("r", "h", "t", "lang").limit(max_rows).select("lang", "doc_id", "t", "r", "n")
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("t"))
    # at most max_rows rows of ids; equal rows of the table are one here, with their number beside them
    chosen = texts.join(F.broadcast(sample), ["lang", "doc_id", "t"]).dropDuplicates(["lang", "doc_id", "t"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                for part, buf, off in slices(batch.slice(lo, BLOCK), "text"):
                    bits = np.packbits(presence(buf, off), axis=1)
                    yield pa.record_batch([part.column("lang"), part.column("r"), part.column("n"), pa.array([b.tobytes() for b in bits], pa.binary())], names=["lang", "r", "n", "bits"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r["r"], r["lang"], r["n"], r["bits"]) for b in batches for r in b.to_pylist())
        if not got:
            return
        langs = sorted({g[1] for g in got})
        y, times = np.array([langs.index(g[1]) for g in got]), np.array([float(g[2]) for g in got])
        flags = np.unpackbits(np.frombuffer(b"".join(g[3] for g in got), np.uint8).reshape(len(got), -1), axis=1)
        first = np.arange(min(landmarks, len(got)))  # ranks in turn: every language has its share
        coef = solve(flags, y, times, len(langs), first)
        for i in first.tolist():
            yield pa.record_batch([pa.array([i], pa.int32()), pa.array([got[i][3]], pa.binary()), pa.array([coef[i].tolist()], pa.list_(pa.float64())), pa.array([langs], pa.list_(pa.string()))], names=["i", "bits", "coef", "langs"])

    # one task by design: the sample is bounded by max_rows
    fitted = chosen.mapInArrow(extract, "lang string, r int, n bigint, bits binary").repartition(1).mapInArrow(fit, "i int, bits binary, coef array<double>, langs array<string>").collect()
    fitted = sorted(fitted, key=lambda r: r["i"])
    if not fitted:
        return [], np.zeros((0, 1 << BUCKET_BITS - 3), np.uint8), np.zeros((0, 0))
    return list(fitted[0]["langs"]), np.frombuffer(b"".join(r["bits"] for r in fitted), np.uint8).reshape(len(fitted), -1), np.array([r["coef"] for r in fitted])


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """`docs` with lang_pred and score, the predicted language's share of the soft maximum of the
    regressions; only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most `landmarks` sets, see above
    known = ("text",)

    def run(d: DataFrame) -> DataFrame:
        schema = ", ".join(f"`{n}` {t}" for n, t in d.dtypes) + ", lang_pred string, score double"
        own_names = d.columns
        lettered = d.withColumn("has letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            langs, packed, coef = shared.value
            names = np.array([*langs, "und"], object)
            if langs:
                sets = np.unpackbits(packed, axis=1)
                used = np.flatnonzero(sets.any(0))
                norm = np.sqrt(np.maximum(sets.sum(1, dtype=np.float64), 1))
                columns = np.ascontiguousarray((sets[:, used].T / norm).astype(np.float32))
            for batch in batches:
                for lo in range(0, batch.num_rows, BLOCK):
                    for part, buf, off in slices(batch.slice(lo, BLOCK), "text"):
                        best, share = np.full(part.num_rows, len(langs)), np.zeros(part.num_rows)
                        letter = part.column("has letter").to_numpy(zero_copy_only=False).astype(bool)
                        if langs:
                            flags = presence(buf, off)
                            size = np.sqrt(np.maximum(flags.sum(1, dtype=np.float64), 1))
                            f = (flags[:, used].astype(np.float32) @ columns).astype(np.float64) / size[:, None] @ coef
                            best = np.where(letter, f.argmax(1), len(langs))
                            e = np.exp(4 * (f - f.max(1, keepdims=True)))
                            share = np.where(letter, 1 / e.sum(1), 0.0)
                        own = [c for c, n in zip(part.columns, part.schema.names) if n != "has letter"]
                        yield pa.record_batch([*own, pa.array(names[best].tolist(), pa.string()), pa.array(share)], names=[*own_names, "lang_pred", "score"])

        return lettered.mapInArrow(score, schema)

    return guarded(docs, known, run)
