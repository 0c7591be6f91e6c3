"""Best-fit packing (operator 2): exact-complement hashing, then best fit.

Documents become token pieces of at most `capacity` ids. What to put together depends
only on how many pieces have each length, and there are at most `capacity` lengths: that
histogram (bounded, whatever the corpus) is packed on the driver into *groups*, each a
pattern of lengths used by so many sequences. A piece then finds its place from its rank
among the pieces of its length. Ranks are counted per (length, salt) and shifted by
prefix sums, so the most frequent length is never in one task.

Defined results: null text is empty (one piece holding the end id); rows that repeat a
doc_id are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import checkpointed, guarded, shuffle_partitions

CAPACITY = 1024
END_ID = 2
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Ids of the byte-level BPE in `path` (a tokenizers file). Latin text goes through the
    same vocabulary in tiktoken, about four times as fast; text with any character from
    U+0250 on is encoded by tokenizers itself, so no difference between the two libraries'
    Unicode tables can matter. tests/llm checks that the ids agree."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.slow = Tokenizer.from_file(path)
        self.fast = None
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            special = {t.content: i for i, t in self.slow.get_added_tokens_decoder().items()}
            self.special = tuple(special)
            self.fast = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=special)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def ids(self, text: str) -> list[int]:
        if self.fast is None or (not text.isascii() and max(text) >= "ɐ") or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32. Only documents longer than
    `capacity` are cut; then all pieces but the first hold `capacity` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(tokenizer)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = array("I", enc.ids(text.as_py() or ""))
                ids.append(end_id)
                raw = memoryview(np.asarray(ids, "<u4")).cast("B")
                start, k, n = 0, 0, len(ids)
                while start < n:
                    length = (n - start) % capacity or capacity
                    for out, v in zip(rows, (doc_id.as_py(), k, start, length, zlib.crc32(raw[4 * start : 4 * (start + length)]))):
                        out.append(v)
                    start, k = start + length, k + 1
            yield pa.record_batch([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Groups (lengths of one sequence, number of such sequences) for a histogram of lengths.

    Exact complements first, then best fit. Exact fills that spend many short pieces early
    can cost sequences later, so the histogram is packed with singles only, with singles and
    pairs, and with triples too, longest piece first or combination size first, and the
    plan with the fewest sequences is taken."""
    tries = [_plan(counts, capacity, order) for order in ((1,), (1, 2), (1, 2, 3), (2,), (3,))]
    return min(tries, key=lambda groups: sum(n for _, n in groups))


def _plan(counts: dict[int, int], capacity: int, passes: tuple[int, ...]) -> list[tuple[tuple[int, ...], int]]:
    """passes: largest combination size looked up in each pass over the lengths, longest first."""
    c = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        c[length] += n
    groups: list[tuple[tuple[int, ...], int]] = []

    def take(*lengths: int) -> None:
        """As many sequences of exactly these lengths as their counts allow."""
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        n = min(int(c[x]) // k for x, k in need.items())
        if n > 0:
            groups.append((lengths, n))
            for x, k in need.items():
                c[x] -= n * k

    def pairs(total: int, most: int) -> list[int]:
        """The longer halves of the available pairs with this sum, longest first."""
        a = np.arange((total + 1) // 2, min(most, total - 1) + 1)
        return a[(c[a] > 0) & (c[total - a] > 0)][::-1].tolist()

    take(capacity)
    for size in passes:
        for length in range(capacity - 1, 0, -1):
            gap = capacity - length
            if c[length]:
                take(length, gap)
            if size >= 2 and c[length]:
                for x in pairs(gap, capacity):
                    if not c[length]:
                        break
                    take(length, x, gap - x)
            if size >= 3 and c[length]:
                for x in range(gap - 2, (gap + 2) // 3 - 1, -1):
                    if not c[length]:
                        break
                    if c[x]:
                        for y in pairs(gap - x, x):
                            if not c[length] or not c[x]:
                                break
                            take(length, x, y, gap - x - y)
    # best fit decreasing of what is left, whole counts at a time; open_: free room -> patterns
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length in range(capacity, 0, -1):
        left = int(c[length])
        while left:
            room = min((r for r in open_ if r >= length and open_[r]), default=None)
            if room is None:
                each = capacity // length
                full, over = divmod(left, each)
                for n, k in ((full, each), (1 if over else 0, over)):
                    if n:
                        open_.setdefault(capacity - k * length, []).append(((length,) * k, n))
                break
            pattern, n = open_[room].pop()
            used = min(n, left)
            if used < n:
                open_[room].append((pattern, n - used))
            open_.setdefault(room - length, []).append(((*pattern, length), used))
            left -= used
    return groups + [g for r in sorted(open_) for g in open_[r]]


def intervals(groups: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each slot of each group, which ranks of its length it takes: key = length << 40 | first
    rank, first sequence and offset; sorted by key."""
    used: dict[int, int] = {}
    rows, seq = [], 0
    for pattern, n in groups:
        offset = 0
        for length in pattern:
            lo = used.get(length, 0)
            rows.append((length << 40 | lo, seq - lo, offset))
            used[length] = lo + n
            offset += length
        seq += n
    a = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return {"key": a[:, 0], "shift": a[:, 1], "offset": a[:, 2]}


def pack(cut: DataFrame, capacity: int = CAPACITY, salts: int | None = None) -> DataFrame:
    """Adds `sequence_id` and `offset` to a table of pieces. Any further columns are kept, those of these names
    beside the new ones.
    The pieces are written to the shared checkpoint folder first: they are read twice, and
    encoding again could not be reconciled with ranks already dealt."""
    salts = salts or max(16, shuffle_partitions(cut.sparkSession))
    return guarded(cut, ("doc_id", "piece", "length", "ids_crc32"), lambda c: _pack(c, capacity, salts))


def _pack(cut: DataFrame, capacity: int, salts: int) -> DataFrame:
    c = checkpointed(cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int")))
    counts = c.groupBy("length", "_salt").count()
    # at most `capacity` rows reach the driver
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    table = intervals(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shift"))
    order = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = c.withColumn("_rank", F.row_number().over(order) - 1).join(shift, ["length", "_salt"])
    ranked = ranked.select(*cut.columns, (F.col("_rank") + F.col("_shift")).cast("bigint").alias("_rank"))
    schema = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes) + ", sequence_id bigint, offset bigint"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column("_rank").to_numpy(zero_copy_only=False)
            at = np.searchsorted(table["key"], (b.column("length").to_numpy(zero_copy_only=False).astype(np.int64) << 40) | rank, "right") - 1
            names = [n for n in b.schema.names if n != "_rank"]
            yield pa.record_batch([*(b.column(n) for n in names), pa.array(table["shift"][at] + rank), pa.array(table["offset"][at])],
                                  names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)
