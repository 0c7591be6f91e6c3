"""Spelling variants (operator 13): Bloom-guided neighbourhoods over the corpus' vocabulary.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased; a run whose
crc32(`<doc_id>:<run>`) 97 divides loses one code point. The vocabulary holds the distinct words of
at least `MIN_LENGTH` code points that occur `MIN_COUNT` times. Two words are near if one inserted,
deleted or replaced code point makes one the other.

Method: the vocabulary is counted with a map-side phase. Its words go into Bloom filters, one shard a
word length, in blocks of 64 bits so that a probe reads one word of memory. The shards are broadcast,
and every word's edits (each deletion against the shard one shorter, each replacement by a
larger code point against its own; the opposite edits are the same pairs seen from the other word)
are hashed from the word's polynomial hash in one step each, without building the strings. Only
probes that hit are written out, as strings; joined with the vocabulary, those remain that are words.

Broadcast bound: filters are built and probed in waves of at most `limit` bytes. A shard that is larger
by itself is cut by ranges of its blocks, each a wave; every wave's probes test only its own blocks, so
a vocabulary of any size is covered whole and nothing grows on the driver beyond one wave.

A word's form is its near word of largest n (ties: smallest in code-point order) if that n is at least
twice the word's; roots follow the forms by pointer doubling. n at least doubles with each step, so
there are few rounds.

Defined results: null and empty texts hold no word; a null doc_id is written as nothing in
the hashed string; repeated rows count again; an empty table gives no row. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import LOWER, checkpointed, mixed, powers, slices, spans, texts

MIN_LENGTH = 5
MIN_COUNT = 3
DAMAGE = 97
FILTER_BYTES = 16 << 20
#: Words longer than this get a block of their own on average: they have many edits, and each false hit is a long string.
LONG = 32
PROBES = 1 << 20
FLUSH = 300_000

_BASE = 0x9E3779B97F4A7C55
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_YES = np.array([False, True])


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1).astype(np.uint32)
    return t


_CRC = _crc_table()


def crc32(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """zlib's crc32 of each run of bytes, continued from the crc32 `before` it."""
    length = ends - starts
    out = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    order = np.argsort(-length, kind="stable")
    lengths = -length[order]  # ascending
    for j in range(64):
        some = order[: np.searchsorted(lengths, -j, "left")]  # those longer than j
        if not len(some):
            break
        v = out[some]
        out[some] = _CRC[(v ^ buf[starts[some] + j]) & np.uint32(0xFF)] ^ (v >> np.uint32(8))
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(length > 64):
        out[i] = zlib.crc32(buf[starts[i] + 64 : ends[i]].tobytes(), int(out[i]))
    return out


def damaged_words(ids: list, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(lower-cased bytes, starts, ends) of the runs left as they are, and the runs that lost a code point."""
    low = LOWER[buf]
    letter = (low >= 0x61) & (low <= 0x7A)
    letter |= buf == 0xC3
    letter[1:] |= buf[:-1] == 0xC3
    starts, ends, counts = spans(letter.view(np.uint8), off, _YES)
    before = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in ids], np.uint32)
    hit = crc32(low, starts, ends, np.repeat(before, counts))
    cut = hit % DAMAGE == 0
    short = []
    for s, e, h in zip(starts[cut].tolist(), ends[cut].tolist(), hit[cut].tolist()):
        word = low[s:e].tobytes().decode()
        at = h % len(word)
        short.append((word[:at] + word[at + 1 :]).encode())
    return low, starts[~cut], ends[~cut], short


def words(docs: DataFrame) -> DataFrame:
    """(w, n): the words of at least MIN_LENGTH code points with their counts, partly summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def summed() -> pa.Table:
            t = pa.concat_tables(held).group_by("w").aggregate([("n", "sum")])
            return pa.table({"w": t["w"], "n": t["n_sum"]})

        for batch in batches:
            for part, buf, off in slices(batch, "text"):
                low, starts, ends, short = damaged_words(part.column("doc_id").to_pylist(), buf, off)
                points = np.concatenate(([0], np.cumsum((low & 0xC0) != 0x80)))
                enough = points[ends] - points[starts] >= MIN_LENGTH
                whole = texts(low, starts[enough], ends[enough])
                more = pa.array([w for w in short if len(w.decode()) >= MIN_LENGTH], pa.binary())
                v = pc.value_counts(pa.concat_arrays([whole, more]))
                held.append(pa.table({"w": v.field("values"), "n": v.field("counts")}))
                rows += len(v)
                if rows > 2 * FLUSH:
                    held = [summed()]
                    rows = held[0].num_rows
                    if rows > FLUSH:
                        yield from pa.table({"w": held[0]["w"].cast(pa.string()), "n": held[0]["n"]}).combine_chunks().to_batches(1 << 16)
                        held, rows = [], 0
        if held:
            t = summed()
            yield from pa.table({"w": t["w"].cast(pa.string()), "n": t["n"]}).combine_chunks().to_batches(1 << 16)

    return docs.select("doc_id", "text").mapInArrow(run, "w string, n bigint")


def vocabulary(docs: DataFrame) -> DataFrame:
    """(w, n, len): distinct words that occur at least MIN_COUNT times."""
    return words(docs).groupBy("w").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT).withColumn("len", F.length("w"))


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a string column (all below 256: one byte each) and the offsets of its rows."""
    column = column.cast(pa.large_string())
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    buf = np.frombuffer(data, np.uint8, int(off[-1]) - int(off[0]), int(off[0])) if off[-1] > off[0] else np.zeros(0, np.uint8)
    lead = buf == 0xC3
    code = buf.copy()
    code[1:][lead[:-1]] += 0x40
    return code[~lead], np.concatenate(([0], np.cumsum(~lead)))[off - off[0]]


def _by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix of code points) of the words, one length after the other."""
    code, off = _codes(column)
    length = np.diff(off)
    for size in np.unique(length).tolist():
        rows = np.flatnonzero(length == size)
        step = max(1, PROBES // size)
        for lo in range(0, len(rows), step):
            some = rows[lo : lo + step]
            yield size, some, code[off[some][:, None] + np.arange(size)]


def _hash(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((m.astype(np.uint64) + np.uint64(1)) * powers(_BASE, m.shape[1])[: m.shape[1]]).sum(1, dtype=np.uint64)


def _bits(size: int) -> tuple[int, int]:
    """(bits a word, bits set) of a length's shard."""
    return (16, 5) if size <= LONG else (64, 8)


def _place(h: np.ndarray, size: int, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and mask of finished hashes."""
    h = mixed(h)
    block = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    if blocks >> 31:
        raise ValueError("a length's shard has over 2^31 blocks")
    h = mixed(h ^ np.uint64(_BASE))
    mask = np.zeros(len(h), np.uint64)
    for k in range(_bits(size)[1]):
        mask |= np.uint64(1) << ((h >> np.uint64(6 * k)) & np.uint64(63))
    return block.astype(np.int64), mask


def plan_waves(counts: dict[int, int], limit: int) -> tuple[dict[int, int], list[list[tuple[int, int, int]]]]:
    """Blocks of each length's shard, and waves of (length, first block, end) of at most `limit` bytes each."""
    blocks = {size: n * _bits(size)[0] // 64 + 1 for size, n in counts.items()}
    waves, room = [], 0
    for size in sorted(blocks):
        lo = 0
        while lo < blocks[size]:
            if room < 8:
                waves.append([])
                room = limit
            hi = min(blocks[size], lo + room // 8)
            waves[-1].append((size, lo, hi))
            room -= 8 * (hi - lo)
            lo = hi
    return blocks, waves


def _filter(vocab: DataFrame, blocks: dict[int, int], wave: list[tuple[int, int, int]]) -> dict[int, tuple[int, np.ndarray]]:
    """The wave's part of the shards: length -> (first block, blocks). At most the wave's bytes reach the driver."""
    place = {size: (lo, hi) for size, lo, hi in wave}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, m in _by_length(batch.column("w")):
                if size in place:
                    block, mask = _place(_hash(m), size, blocks[size])
                    own = (block >= place[size][0]) & (block < place[size][1])
                    yield pa.record_batch([pa.array(np.full(own.sum(), size, np.int32)), pa.array(block[own]), pa.array(mask[own].view(np.int64))], names=["len", "block", "mask"])

    hashed = vocab.where(F.col("len").isin(list(place))).select("w").mapInArrow(run, "len int, block bigint, mask bigint")
    got = hashed.groupBy("len", "block").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = {size: (lo, np.zeros(hi - lo, np.uint64)) for size, lo, hi in wave}
    size, block, mask = (got[c].to_numpy() for c in ("len", "block", "mask"))
    for s, (lo, shard) in out.items():
        own = size == s
        shard[block[own] - lo] = mask[own].view(np.uint64)
    return out


def _edits(m: np.ndarray, size: int, alphabet: np.ndarray, blocks: dict[int, int], shards: dict[int, tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, candidate as code points) of the edits that the filters let through."""

    def passed(h: np.ndarray, length: int) -> np.ndarray:
        lo, shard = shards[length]
        block, mask = _place(h, length, blocks[length])
        inside = np.flatnonzero((block >= lo) & (block < lo + len(shard)))
        mask = mask[inside]
        return inside[shard[block[inside] - lo] & mask == mask]

    power = powers(_BASE, size)
    with np.errstate(over="ignore"):
        term = (m.astype(np.uint64) + np.uint64(1)) * power[:size]
        whole = term.sum(1, dtype=np.uint64)
        if size - 1 in shards:
            head = np.zeros(len(m), np.uint64)
            for p in range(size):
                # of a run of one letter, the first deletion stands for all
                rows = np.arange(len(m)) if p == 0 else np.flatnonzero(m[:, p] != m[:, p - 1])
                tail = (whole - head - term[:, p]) * _INVERSE
                hit = rows[passed((head + tail)[rows], size - 1)]
                yield hit, np.delete(m[hit], p, axis=1)
                head = head + term[:, p]
        if size in shards:
            step = max(1, PROBES // len(alphabet))
            for p in range(size):
                for lo in range(0, len(m), step):
                    part = m[lo : lo + step]
                    row, letter = np.nonzero(alphabet[None, :] > part[:, p, None])
                    h = whole[lo : lo + step][row] + (alphabet[letter].astype(np.uint64) - part[row, p].astype(np.uint64)) * power[p]
                    hit = passed(h, size)
                    found = part[row[hit]].copy()
                    found[:, p] = alphabet[letter[hit]]
                    yield lo + row[hit], found


def candidates(vocab: DataFrame, blocks: dict[int, int], wave: list[tuple[int, int, int]], alphabet: np.ndarray) -> DataFrame:
    """(w, n, cand): edits of the words that hit the wave's filters."""
    shared = vocab.sparkSession.sparkContext.broadcast(_filter(vocab, blocks, wave))  # at most the wave's bytes
    lengths = sorted({size + more for size, _, _ in wave for more in (0, 1)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = shared.value
        for batch in batches:
            for size, rows, m in _by_length(batch.column("w")):
                for row, found in _edits(m, size, alphabet, blocks, shards):
                    if len(row):
                        at = pa.array(rows[row])
                        cand = pa.array([c.tobytes().decode("latin-1") for c in found], pa.string())
                        yield pa.record_batch([batch.column("w").take(at), batch.column("n").take(at), cand], names=["w", "n", "cand"])

    return vocab.where(F.col("len").isin(lengths)).select("w", "n").mapInArrow(run, "w string, n bigint, cand string")


def near_pairs(vocab: DataFrame, limit: int = FILTER_BYTES) -> DataFrame:
    """(w, n, near, near_n): all ordered pairs of near words."""
    counts = {r["len"]: r["n"] for r in vocab.groupBy("len").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a length
    letters = vocab.select(F.explode(F.split("w", "")).alias("c")).where("c <> ''").distinct().collect()  # at most 90
    alphabet = np.array(sorted(ord(r["c"]) for r in letters), np.uint8)
    blocks, waves = plan_waves(counts, limit)
    found = None
    for wave in waves:
        one = candidates(vocab, blocks, wave, alphabet)
        found = one if found is None else found.unionAll(one)
    if found is None:
        return vocab.select("w", "n", F.col("w").alias("near"), F.col("n").alias("near_n")).where("false")
    true = found.join(vocab.select(F.col("w").alias("cand"), F.col("n").alias("cand_n")), "cand")
    both = F.array(F.struct("w", "n", F.col("cand").alias("near"), F.col("cand_n").alias("near_n")), F.struct(F.col("cand").alias("w"), F.col("cand_n").alias("n"), F.col("w").alias("near"), F.col("n").alias("near_n")))
    return true.select(F.inline(both))


def _roots(forms: DataFrame) -> DataFrame:
    """(w, root) of the words that have a form, by pointer doubling."""
    t = checkpointed(forms.select("w", F.col("form").alias("root")))
    while True:
        ahead = t.select(F.col("w").alias("root"), F.col("root").alias("ahead"))
        step = checkpointed(t.join(ahead, "root", "left").select("w", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")))
        t = step.select("w", "root")
        if step.where("moved").isEmpty():
            return t


def variants(docs: DataFrame, limit: int = FILTER_BYTES) -> DataFrame:
    """(w, n, form, form_n, n_near, root): one row a vocabulary word."""
    vocab = checkpointed(vocabulary(docs))
    near = near_pairs(vocab, limit).groupBy("w").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("b"))
    form = F.when(-F.col("b.m") >= 2 * F.col("n"), F.col("b.near"))
    all_ = vocab.join(near, "w", "left").select("w", "n", form.alias("form"), F.when(form.isNotNull(), -F.col("b.m")).alias("form_n"), F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"))
    all_ = checkpointed(all_)
    roots = _roots(all_.where(F.col("form").isNotNull()))
    return all_.join(roots, "w", "left").withColumn("root", F.coalesce("root", "w"))
