"""SimHash near-dedup (operator 4): fingerprints, then a binary-trie self-join.

Equal fingerprints are one node (grouped with a map-side phase), whatever number of copies
they have. Two fingerprints within `max_bits` agree on at least one of `max_bits + 1` bit
blocks, so each is sent to the tasks of its block values; a task sorts them (an implicit
binary trie: a node is a range of the sorted array) and walks pairs of trie nodes together,
level by level, adding up differing bits and dropping a pair of nodes when the sum exceeds
the budget. Tasks emit a spanning forest of the links they find, never the pairs. A block
value with more than `chunk` fingerprints is cut into chunks, and chunk pairs are joined in
separate tasks, so no link is lost and no task is unbounded.

Defined results: null, empty or blank text has fingerprint zero and links like any other;
fewer words than a shingle form one shingle; rows repeating a doc_id are separate rows with
one component each; a null doc_id never names a component unless all its members are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import LOWER, NOT_SPACE, checkpointed, guarded, shuffle_partitions, slices, spans
from pagemill.llm.components import components, forest

SHINGLE = 3
MAX_BITS = 3
SEED = 42
CHUNK = 4096
FRONTIER = 1 << 20


def _fingerprints(buf: np.ndarray, off: np.ndarray, shingle: int) -> np.ndarray:
    starts, ends, words = spans(buf, off, NOT_SPACE)
    out = np.zeros(len(words), np.uint64)
    if not len(starts):
        return out
    # words of the slice joined by single spaces; a shingle is one range of it
    length = ends - starts + 1
    first = np.cumsum(length) - length
    at = np.arange(int(length.sum())) - np.repeat(first - starts, length)
    at[first + length - 1] = 0
    joined = LOWER[buf[at]]
    joined[first + length - 1] = 0x20
    joined = memoryview(joined.tobytes())
    word0 = np.cumsum(words) - words
    n = np.where(words >= shingle, words - shingle + 1, np.minimum(words, 1))
    shingle0 = np.cumsum(n) - n
    i = np.arange(int(n.sum())) - np.repeat(shingle0 - word0, n)  # first word of each shingle
    last = i + np.repeat(np.minimum(words, shingle), n) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(first[i].tolist(), (first + length - 1)[last].tolist())), np.uint64, len(i))
    some = np.flatnonzero(n)
    step = 1 << 18
    bits = np.zeros((len(some), 64), np.int64)
    doc = np.repeat(np.arange(len(some)), n[some])
    for k in range(0, len(h), step):
        part = np.unpackbits(h[k : k + step].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        d = doc[k : k + step]
        cut = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        bits[d[cut]] += np.add.reduceat(part, cut, axis=0, dtype=np.int64)
    out[some] = np.packbits(2 * bits > n[some, None], axis=1).view(">u8").ravel()
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, carried: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, fp bigint): the 64-bit SimHash of the text's word shingles, repeats included; and the
    bigint columns `carried`."""
    names = ["doc_id", *carried, "fp"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                yield pa.record_batch([*(rows.column(c) for c in names[:-1]), pa.array(_fingerprints(buf, off, shingle).view(np.int64))], names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *carried, "text").mapInArrow(run, ", ".join(f"{c} bigint" for c in names))


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def trie_pairs(a: np.ndarray, roots: np.ndarray, top: int, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of `a` (uint64, sorted within each root) that share a root and differ in
    at most `max_bits` of their low `top` bits. roots: first index of each root, then len(a)."""
    work = [(top, roots[:-1], roots[1:], roots[:-1], roots[1:], np.zeros(len(roots) - 1, np.int8))]
    ones = {}
    while work:
        bit, alo, ahi, blo, bhi, d = work.pop()
        own = alo == blo
        # pairs of single leaves are decided at once
        leaf = ~own & (ahi - alo == 1) & (bhi - blo == 1)
        if leaf.any():
            i, j = alo[leaf], blo[leaf]
            near = _popcount((a[i] ^ a[j]) & np.uint64((1 << top) - 1)) <= max_bits
            if near.any():
                yield i[near], j[near]
        go = ~leaf & ~(own & (ahi - alo < 2))
        if not go.any() or bit == 0:
            continue
        alo, ahi, blo, bhi, d, own = alo[go], ahi[go], blo[go], bhi[go], d[go], own[go]
        if len(alo) > FRONTIER:  # bounded memory: halves one after the other
            h = len(alo) // 2
            work += [(bit, alo[s], ahi[s], blo[s], bhi[s], d[s]) for s in (slice(None, h), slice(h, None))]
            continue
        bit -= 1
        if bit not in ones:
            ones[bit] = np.concatenate(([0], np.cumsum((a >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        c = ones[bit]
        am, bm = ahi - (c[ahi] - c[alo]), bhi - (c[bhi] - c[blo])
        parts = [(alo, am, blo, bm, d), (am, ahi, bm, bhi, d), (alo, am, bm, bhi, d + 1), (am, ahi, blo, bm, d + 1)]
        parts[3] = tuple(x[~own] for x in parts[3])  # of a node with itself, the mixed pair counts once
        nxt = [np.concatenate(x) for x in zip(*parts)]
        ok = (nxt[0] < nxt[1]) & (nxt[2] < nxt[3]) & (nxt[4] <= max_bits)
        work.append((bit, *(x[ok] for x in nxt)))


def _blocks(max_bits: int) -> list[tuple[int, int]]:
    """(first bit from the top, width) of max_bits + 1 blocks covering 64 bits."""
    n = max_bits + 1
    cut = [64 * k // n for k in range(n + 1)]
    return [(cut[k], cut[k + 1] - cut[k]) for k in range(n)]


def links(nodes: DataFrame, max_bits: int = MAX_BITS, chunk: int = CHUNK) -> DataFrame:
    """(u, v): a spanning forest per task of all links between distinct fingerprints `fp`."""
    blocks = _blocks(max_bits)
    rotated = [F.when(F.lit(s == 0), F.col("fp")).otherwise(F.shiftleft("fp", s).bitwiseOR(F.shiftrightunsigned("fp", (64 - s) % 64))) for s, _ in blocks]
    value = [F.shiftrightunsigned(r, 64 - w) for r, (_, w) in zip(rotated, blocks)]
    rows = nodes.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), value[k].alias("value"), rotated[k].alias("r")) for k in range(len(blocks))])).alias("x")).select("x.*")
    hot = rows.groupBy("k", "value").count().where(F.col("count") > chunk).select("k", "value", F.ceil(F.col("count") / chunk).cast("int").alias("n"))
    rows = rows.join(hot, ["k", "value"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = F.pmod(F.xxhash64("r"), F.col("n")).cast("int")
    rows = rows.withColumn("c", own).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.select("k", "value", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "r")
    parts = shuffle_partitions(nodes.sparkSession)
    rows = rows.repartition(parts, "k", "value", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        col = {n: np.concatenate([b.column(n).to_numpy(zero_copy_only=False) for b in got]) for n in got[0].schema.names}
        r = col["r"].astype(np.int64).view(np.uint64)
        order = np.lexsort((r, col["j"], col["i"], col["k"]))
        r = r[order]
        keys = [col[n][order] for n in ("k", "value", "i", "j")]
        us, vs = [], []
        for k, (s, w) in enumerate(blocks):
            lo, hi = np.searchsorted(keys[0], [k, k + 1])
            if hi - lo < 2:
                continue
            part = [x[lo:hi] for x in keys[1:]]
            new = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in part], axis=0)))
            a = r[lo:hi]
            for i, j in trie_pairs(a, np.append(np.flatnonzero(new), len(a)), 64 - w, max_bits):
                back = (a << np.uint64((64 - s) % 64)) | (a >> np.uint64(s)) if s else a
                u, v = forest(back.view(np.int64)[i], back.view(np.int64)[j])
                us.append(u)
                vs.append(v)
        if us:
            u, v = forest(np.concatenate(us), np.concatenate(vs))
            yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.mapInArrow(run, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) per row of `docs`; component_id is the smallest doc_id reachable."""
    fps = checkpointed(fingerprints(docs, shingle))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    label = components(links(nodes, max_bits))
    nodes = nodes.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    least = nodes.groupBy("label").agg(F.min("least").alias("component_id"))
    return fps.join(nodes.join(least, "label").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def hex16(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _thinned(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The rows without most that repeat the keys of another row in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            first = []
            for i, key in enumerate(zip(*(b.column(c).to_pylist() for c in keys))):
                if key not in seen:
                    seen.add(key)
                    first.append(i)
            yield b if len(first) == b.num_rows else b.take(pa.array(first, pa.int64()))
            if len(seen) > 1 << 18:
                seen.clear()

    return rows.mapInArrow(run, rows.schema)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of `docs` that represent their component: one row of each component, with the columns of
    `docs`. It is the one with the smallest doc_id, null last, and of those with the smallest text hash."""
    hashes = ("_h1", "_h2")  # 128 bits of the text

    def pick(d: DataFrame) -> DataFrame:
        rows = d.withColumns({"_id": F.col("doc_id").cast("bigint"), "_h1": F.xxhash64("text"), "_h2": F.xxhash64(F.lit(1), "text")})
        fps = checkpointed(fingerprints(rows, shingle, hashes))
        nodes = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *hashes)).alias("least"))
        label = components(links(nodes, max_bits)).withColumnRenamed("node", "fp")
        kept = nodes.join(label, "fp", "left").groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("least").alias("least"))
        # a struct is never null, so rows without an id join too, and the window below needs no second shuffle
        kept = kept.select(F.struct("least.doc_id", "least._h1", "least._h2").alias("_key"))
        rows = _thinned(rows, ("_id", *hashes)).withColumn("_key", F.struct(F.col("_id").alias("doc_id"), *hashes)).join(kept, "_key", "left_semi")
        one = Window.partitionBy("_key").orderBy("_h1")  # rows with the same id and text
        return rows.withColumn("_one", F.row_number().over(one)).where("_one = 1").drop("_one", "_key", "_id", *hashes)

    return guarded(docs, ("doc_id", "text"), pick)
