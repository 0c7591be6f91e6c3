"""Helpers shared by the training-data operators.

Text is handled as UTF-8 bytes inside Arrow batches: one numpy pass over a slice
of whole documents instead of a Python call per word. Slices are bounded in
bytes (`slices`), so a task's memory does not depend on how many rows a batch
holds; only a single document is never split.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SLICE_BYTES = 1 << 20
MASK = (1 << 64) - 1

#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words `[^\x20\x09-\x0D]+`.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (digits, a-z, everything beyond ASCII).
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; one is made only where none
    is configured and Spark runs in a single local process, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            import tempfile

            named = tempfile.mkdtemp(prefix="llm-checkpoint-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back: cuts the lineage and
    survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """A new folder for written tables, below the checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, n + 1, column.offset * 8)
    lo, hi = int(offsets[0]), int(offsets[-1])
    buf = np.frombuffer(data, np.uint8, hi - lo, lo) if hi > lo else np.zeros(0, np.uint8)
    return buf, offsets - lo


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut a batch into runs of whole rows of about `limit` text bytes: (rows, bytes, offsets)."""
    buf, off = utf8(batch.column(text))
    lo, n = 0, batch.num_rows
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield batch.slice(lo, hi - lo), buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def spans(buf: np.ndarray, off: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-row counts of the maximal runs of `members` bytes; runs never cross rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off) - 1, np.int64)
    m = members[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True  # a row begins here (or the buffer ends)
    before = np.empty_like(m)
    before[0], before[1:] = False, m[:-1]
    starts = np.flatnonzero(m & (~before | edge[:-1]))
    after = np.empty_like(m)
    after[-1], after[:-1] = False, m[1:]
    ends = np.flatnonzero(m & (~after | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, off))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1024
        while size < n:
            size *= 2
        with np.errstate(over="ignore"):
            have = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, base, np.uint64))))
        _POWERS[base] = have
    return have


def mixed(h: np.ndarray) -> np.ndarray:
    """64-bit finaliser (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x9E3779B97F4A7C55) -> np.ndarray:
    """A 64-bit polynomial hash of each run of bytes [start, end); runs are disjoint and ascending."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    length = ends - starts
    total = int(length.sum())
    first = np.cumsum(length) - length
    local = np.arange(total, dtype=np.int64) - np.repeat(first, length)
    at = local + np.repeat(starts, length)
    with np.errstate(over="ignore"):
        v = (buf[at].astype(np.uint64) + np.uint64(1)) * powers(base, int(length.max()))[local]
        h = np.add.reduceat(v, first) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mixed(h)


def texts(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs [start, end) as an Arrow binary column."""
    length = ends - starts
    first = np.concatenate(([0], np.cumsum(length)))
    at = np.arange(int(first[-1]), dtype=np.int64) - np.repeat(first[:-1] - starts, length)
    data = buf[at]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(first.astype(np.int64)), pa.py_buffer(data.tobytes())]).cast(pa.binary())


def guarded(docs: DataFrame, known: tuple[str, ...], run) -> DataFrame:
    """run(docs) with every column but `known` under a neutral name, so that none can clash with
    columns that an operator adds; the names are put back on what comes out."""
    names = docs.columns
    to = [c if c in known else f"carried {i}" for i, c in enumerate(names)]
    back = dict(zip(to, names))
    out = run(docs.toDF(*to))
    return out.toDF(*(back.get(c, c) for c in out.columns))
