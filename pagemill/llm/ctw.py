"""LM scoring (operator 8): context-tree weighting over bytes.

A text is its lower-cased words joined by single spaces, ended by a line feed. Each byte is
decomposed into eight binary decisions; for each of the 255 decision nodes, the contexts of
0 to `depth` preceding bytes form a tree whose nodes hold Krichevsky-Trofimov estimates.
The weighted probability of a node is half its own estimate plus half the product of its
children, so the prediction for a bit mixes the estimates of all depths on its path.

All that a byte's probability depends on is its gram: the `depth` bytes before it and itself.

1. Tasks count the distinct grams of the training texts.
2. One shuffle brings them together by their last two context bytes, packed as sorted numbers
   and counts. A task sums them, builds
   every subtree below such a context bottom-up, a piece of its contexts at a time, and writes,
   per gram, the mixture from depth 2 on as columns; depths 0 and 1 (at most 256 * 255 nodes)
   are aggregated and finished on the driver.
3. Documents are dealt into blocks. A block asks for its distinct grams and distinct words
   once each; one shuffle takes the questions to the values and one brings the answers back,
   which the block sums up. Both travel packed: what a block asks of one share of the grams and
   words is one row, and its answer one row of values in the same order. A task that answers
   also sends each block the sums over its words.

Nothing is broadcast but the two top levels. Counts cover all training texts.

Defined results: null and blank texts are one end token; a null doc_id is never learned
from (held_out is true); with no training text every bit has probability one half and the
base score is 0; repeated rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import lgamma

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import LOWER, MASK, NOT_SPACE, mixed, shared_folder, shuffle_partitions, slices, spans, texts

DEPTH = 5
END = 0x0A
SLICE = 1 << 19
#: Distinct grams held by a task before they are sent on.
FLUSH = 1 << 20
#: Distinct grams whose subtrees are built at a time, about; a context's subtree is never cut.
PIECE = 1 << 18
#: Rows of an Arrow batch.
ROWS = 1 << 16


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(True))


def grams(buf: np.ndarray, off: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams that end at each byte of the slice's token streams (rows one after the other, each after
    `depth` bytes to skip), bytes per row, and where each row's stream begins among the grams."""
    rows, pad = len(off) - 1, depth + 1
    padded = np.full(len(buf) + rows * pad, END, np.uint8)  # each text: `depth` ends, text, end
    begin = off[:-1] + np.arange(rows) * pad
    bounds = off.tolist()
    for at, lo, hi in zip((begin + depth).tolist(), bounds, bounds[1:]):
        padded[at : at + hi - lo] = buf[lo:hi]
    padded = LOWER[padded]
    word = NOT_SPACE[padded]
    keep = word.copy()
    keep[1:] |= word[:-1]  # one byte of white space after each word
    for k in range(depth):
        keep[begin + k] = True
    size = np.add.reduceat(keep, begin, dtype=np.int64) - depth if rows else np.zeros(0, np.int64)
    empty = size == 0
    keep[(off[1:] + np.arange(1, rows + 1) * pad - 1)[empty]] = True
    size[empty] = 1
    stream = np.where(word, padded, np.uint8(0x20))[keep]
    stop = np.cumsum(size + depth)
    first = stop - size
    stream[stop - 1] = END
    for k in range(depth):
        stream[first - 1 - k] = END
    whole = np.concatenate((np.zeros(7, np.uint8), stream))
    key = np.ndarray((len(stream),), ">u8", whole, 0, (1,)).astype(np.uint64) & np.uint64((1 << (8 * pad)) - 1)
    return key, size, first


def _skip(key: np.ndarray, first: np.ndarray, depth: int) -> np.ndarray:
    """The grams without those that end before a row's stream."""
    content = np.ones(len(key), bool)
    for k in range(depth):
        content[first - 1 - k] = False
    return key[content]


def _union(some: list[np.ndarray]) -> np.ndarray:
    """The distinct values of arrays, in order: sorted in place, with one copy beside."""
    a = np.concatenate(some)
    some.clear()
    a.sort()
    new = np.ones(len(a), bool)
    np.not_equal(a[1:], a[:-1], out=new[1:])
    return a[new]


class _Distinct:
    """Distinct values of the arrays that are added, brought together whenever those not yet in order are as many as the others."""

    def __init__(self) -> None:
        self.some: list[np.ndarray] = []
        self.held, self.limit = 0, FLUSH

    def add(self, a: np.ndarray) -> None:
        self.some.append(a)
        self.held += len(a)
        if self.held > self.limit:
            u = self.all()
            self.held, self.limit = len(u), max(FLUSH, 2 * len(u))

    def all(self) -> np.ndarray:
        self.some = [_union(self.some) if self.some else np.zeros(0, np.uint64)]
        return self.some[0]


def _distinct_grams(batch: pa.RecordBatch, depth: int) -> np.ndarray:
    u = _Distinct()
    for _, buf, off in slices(batch, "text", SLICE):
        g, _, first = grams(buf, off, depth)
        u.add(_union([_skip(g, first, depth)]))
    return u.all()


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate(keys)
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return key[new], np.add.reduceat(np.concatenate(counts)[order], np.flatnonzero(new))


def _context_rows(key: np.ndarray, n: np.ndarray, shares: int) -> Iterator[pa.RecordBatch]:
    order, share, cut = _shares((key >> np.uint64(8)) & np.uint64(0xFFFF), shares)
    yield pa.record_batch([pa.array(share.astype(np.int32)), _rows_of(key[order], cut), _rows_of(n[order], cut)], names=["share", "grams", "counts"])


def _gram_counts(docs: DataFrame, depth: int, shares: int) -> DataFrame:
    """(share, grams, counts): the distinct grams of all texts with their counts in the training texts, summed
    within the tasks only and packed by share, which the last two context bytes give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for batch in batches:
            for rows, buf, off in slices(batch, "text", SLICE):
                key, size, first = grams(buf, off, depth)
                learn = np.repeat(~rows.column("held").to_numpy(zero_copy_only=False), size)
                u, c = np.unique(_skip(key, first, depth) << np.uint64(1) | learn, return_counts=True)
                keys.append(u >> np.uint64(1))
                counts.append(c * (u & np.uint64(1)).astype(np.int64))
                held += len(u)
                if held > FLUSH:
                    key, n = _summed(keys, counts)
                    keys, counts, held = [key], [n], len(key)
                    if 2 * held > FLUSH:
                        yield from _context_rows(key, n, shares)
                        keys, counts, held = [], [], 0
        if keys:
            yield from _context_rows(*_summed(keys, counts), shares)

    return docs.select("held", "text").mapInArrow(run, "share int, grams binary, counts binary")


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """log Gamma of positive x: Stirling's series after shifting small x up."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(16):
        small = y < 16
        if not small.any():
            break
        shift[small] += np.log(y[small])
        y[small] += 1
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt_block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - 2 * lgamma(0.5)


def _weighted(a: np.ndarray, b: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log weighted probability and the posterior weight of a node's own estimate."""
    own = kt_block(a, b)
    both = np.logaddexp(own, children) - np.log(2.0)
    return both, np.exp(own - np.log(2.0) - both)


def _subtrees(gram: np.ndarray, n: np.ndarray, depth: int, top: int = 2) -> tuple[np.ndarray, list[np.ndarray]]:
    """For grams that hold whole subtrees below contexts of `top` bytes: per gram the probability of
    each of its 8 bits mixed over depths top..depth, and the nodes at depth top as columns
    (context << 8 | decision node, zeros, ones, log weighted probability)."""
    symbol = (gram & np.uint64(255)).astype(np.int64)
    context = np.zeros(len(gram), np.int64)  # nearest byte first, so that a prefix is a shorter context
    for k in range(depth):
        context |= ((gram >> np.uint64(8 * (k + 1))) & np.uint64(255)).astype(np.int64) << (8 * (depth - 1 - k))
    # per depth, deepest first: the grams by context and symbol, an order in which each node's grams are neighbours
    levels = []
    for d in range(depth, top - 1, -1):
        key = context >> (8 * (depth - d)) << 8 | symbol
        order = np.argsort(key)
        levels.append((order, key[order]))
    p = np.empty((len(gram), 8), np.float32)
    tops: list[list[np.ndarray]] = [[], [], [], []]
    for k in range(8):
        bit = (symbol >> (7 - k)) & 1
        ones = n * bit
        for order, key in levels:
            node = key >> (8 - k)  # context and the bits before
            new = np.ones(len(node), bool)
            new[1:] = node[1:] != node[:-1]
            at = np.empty(len(node), np.int64)  # per gram
            at[order] = np.cumsum(new) - 1
            if key is levels[0][1]:
                leaves = at
                a, b = np.bincount(at, n - ones), np.bincount(at, ones)
                log_w = kt_block(a, b)
                one = (b + 0.5) / (a + b + 1.0)  # per leaf
                first = some = order[new]  # a gram of each leaf, of each node below
            else:
                up = at[some]
                a, b, log_w = np.bincount(up, a), np.bincount(up, b), np.bincount(up, log_w)
                log_w, own = _weighted(a, b, log_w)
                leaf = at[first]  # each leaf's node at the present depth
                one = own[leaf] * ((b + 0.5) / (a + b + 1.0))[leaf] + (1 - own[leaf]) * one
                some = order[new]
        mine = one[leaves]
        p[:, k] = np.where(bit == 1, mine, 1 - mine)
        last = key[new]
        for out, v in zip(tops, (last >> 8 << 8 | (1 << k) | ((last & 255) >> (8 - k)), a, b, log_w)):
            out.append(v)
    return p, [np.concatenate(x) for x in tops]


def model(docs: DataFrame, depth: int = DEPTH, piece: int = PIECE) -> DataFrame:
    """(gram, lp): log10 probability of each gram's last byte given the others, for all grams of `docs`
    (held, text), learned from the rows that aren't held."""
    parts = shuffle_partitions(docs.sparkSession)
    counted = _gram_counts(docs, depth, SHARES * parts).repartition(parts, "share")
    bits = [f"p{k}" for k in range(8)]
    names = ["k", *bits, "a", "b", "w"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held, limit = [], [], 0, FLUSH
        for batch in batches:
            keys.append(_values(batch.column("grams"), np.uint64))
            counts.append(_values(batch.column("counts"), np.int64))
            held += len(keys[-1])
            if held > limit:
                keys, counts = ([x] for x in _summed(keys, counts))
                held = len(keys[0])
                limit = max(FLUSH, 2 * held)
        if not held:
            return
        g, n = _summed(keys, counts)
        del keys, counts
        near = ((g >> np.uint64(8)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = np.argsort(near, kind="stable")
        g, n, near = g[order], n[order], near[order]
        total = np.zeros((3, 1 << 16))
        lo = 0
        while lo < len(g):
            hi = int(np.searchsorted(near, near[min(lo + piece, len(g)) - 1], "right"))
            p, (key, a, b, w) = _subtrees(g[lo:hi], n[lo:hi], depth)
            # depth-2 nodes summed to their depth-1 parents: nearest byte and decision node
            up = (key >> 16 << 8) | (key & 255)
            for mine, x in zip(total, (a, b, w)):
                mine += np.bincount(up, x, 1 << 16)
            for at in range(lo, hi, ROWS):
                end = min(at + ROWS, hi)
                none = pa.nulls(end - at, pa.float64())
                yield pa.record_batch([pa.array(g[at:end].view(np.int64)), *(pa.array(np.ascontiguousarray(p[at - lo : end - lo, k])) for k in range(8)), none, none, none], names=names)
            lo = hi
        u = np.flatnonzero(total[0] + total[1] + (total[2] != 0))
        none = pa.nulls(len(u), pa.float32())
        yield pa.record_batch([pa.array(u), *([none] * 8), *(pa.array(x[u]) for x in total)], names=names)

    folder = f"{shared_folder(docs.sparkSession)}/grams"
    kinds = ", ".join(["k bigint", *(f"{c} float" for c in bits), "a double", "b double", "w double"])
    counted.mapInArrow(build, kinds).write.parquet(folder)
    built = docs.sparkSession.read.schema(kinds).parquet(folder)
    # at most 256 * 255 rows
    top = built.where("p0 is null").groupBy("k").agg(*(F.sum(c).alias(c) for c in "abw")).collect()
    a, b, w = np.zeros(1 << 16), np.zeros(1 << 16), np.zeros(1 << 16)
    for r in top:
        a[r["k"]], b[r["k"]], w[r["k"]] = r["a"], r["b"], r["w"]
    w1, own1 = _weighted(a, b, w)
    a0, b0 = a.reshape(256, 256).sum(axis=0), b.reshape(256, 256).sum(axis=0)
    _, own0 = _weighted(a0, b0, w1.reshape(256, 256).sum(axis=0))
    kt1, kt0 = (b + 0.5) / (a + b + 1.0), (b0 + 0.5) / (a0 + b0 + 1.0)
    levels = docs.sparkSession.sparkContext.broadcast((own0, kt0, own1, kt1))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own0, kt0, own1, kt1 = levels.value
        for batch in batches:
            g = batch.column("k").to_numpy().view(np.uint64)
            p = [batch.column(c).to_numpy().astype(float) for c in bits]
            symbol, near = (g & np.uint64(255)).astype(np.int64), ((g >> np.uint64(8)) & np.uint64(255)).astype(np.int64)
            total = np.zeros(len(g))
            for k in range(8):
                node, bit = (1 << k) | (symbol >> (8 - k)), (symbol >> (7 - k)) & 1
                one = near << 8 | node
                q1 = np.where(bit == 1, kt1[one], 1 - kt1[one])
                q0 = np.where(bit == 1, kt0[node], 1 - kt0[node])
                total += np.log10(own0[node] * q0 + (1 - own0[node]) * (own1[one] * q1 + (1 - own1[one]) * p[k]))
            yield pa.record_batch([batch.column("k"), pa.array(total)], names=["gram", "lp"])

    return built.where("p0 is not null").select("k", *bits).mapInArrow(finish, "gram bigint, lp double")


def _in_order(t: pa.Table) -> pa.RecordBatch:
    """A block's rows in an order that does not depend on how they arrived."""
    t = t.set_column(t.schema.get_field_index("text"), "text", t["text"].cast(pa.large_string()))  # a block may hold over 2 GB
    t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()
    return t.to_batches()[0]


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Words per row, token number of each word, training count of each token, and the tokens. Number 0
    is the end token, the others are numbered as they first occur."""
    spelled, count = [], []
    for _, buf, off in slices(batch, "text", SLICE):
        low = LOWER[buf]
        starts, ends, n = spans(low, off, NOT_SPACE)
        spelled.append(texts(low, starts, ends))
        count.append(n)
    words = np.concatenate(count)
    coded = pa.chunked_array(spelled).dictionary_encode()  # its chunks share one dictionary
    del spelled
    number = np.concatenate([c.indices.to_numpy() for c in coded.chunks]) if len(coded) else np.zeros(0, np.int32)
    tokens = coded.chunk(coded.num_chunks - 1).dictionary if len(coded) else pa.array([], pa.binary())
    learn = ~batch.column("held").to_numpy(zero_copy_only=False)
    n = np.bincount(number, np.repeat(learn, words), len(tokens)).astype(np.int64)
    return words, number + 1, np.concatenate(([int(learn.sum())], n)), pa.concat_arrays([pa.array([bytes([END])], pa.binary()), tokens])


def _run_sums(x: np.ndarray, at: np.ndarray, end: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of x[at] over runs of `n` that stop before `end`; a run may be empty."""
    cum = np.zeros(len(at) + 1, x.dtype)
    np.cumsum(x[at], out=cum[1:])
    return cum[end] - cum[end - n]


#: Rows that meet by `share`. kind 0: a block asks for the sorted `grams` and for `words`, one after the other, of `sizes`
#: bytes, that it counted `values` times; 1: values of `grams`.
ASK = "share int, kind int, block int, grams binary, `values` binary, words binary, sizes binary"
#: Values of a block's grams of a share and counts of its words, in order; without a share: sums over a task's words.
ANSWER = "block int, share int, `values` binary, counts binary, tokens bigint, distinct bigint"
DONE = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens", "_distinct")),
                  *((c, pa.float64()) for c in ("_log", "score", "bits_per_byte"))])
#: Bytes of a word that are hashed eight at a time.
LONG = 256
#: Shares a partition: some, so that partitions are even; few, since each block sends one row to each.
SHARES = 4


def _shares(gram: np.ndarray, shares: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The grams' places by share, in order within a share; the shares that have some; where each begins among the places,
    and the end. Hashed a piece at a time, since a block may hold many."""
    share = np.empty(len(gram), np.uint16 if shares <= 1 << 16 else np.uint32)
    for lo in range(0, len(gram), PIECE):
        share[lo : lo + PIECE] = (mixed(gram[lo : lo + PIECE]) >> np.uint64(32)) % np.uint64(shares)
    n = np.bincount(share, minlength=shares) if len(share) < PIECE else sum(np.bincount(share[lo : lo + PIECE], minlength=shares) for lo in range(0, len(share), PIECE))
    order = np.argsort(share, kind="stable")
    some = np.flatnonzero(n)
    return order, some, np.concatenate(([0], np.cumsum(n[some])))


def _rows_of(a: np.ndarray, cut: np.ndarray) -> pa.Array:
    """The stretches of an array between the cuts, as bytes, without a copy."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int64) * a.itemsize), pa.py_buffer(a)]).cast(pa.binary())


def _values(a: pa.Array, kind: type) -> np.ndarray:
    """The numbers packed in a binary column's rows, one after the other."""
    if not len(a):
        return np.zeros(0, kind)
    wide = np.dtype(np.int64 if pa.types.is_large_binary(a.type) else np.int32)
    off = np.frombuffer(a.buffers()[1], wide, len(a) + 1, a.offset * wide.itemsize)
    lo, hi = int(off[0]), int(off[-1])
    return np.frombuffer(a.buffers()[2], kind, (hi - lo) // np.dtype(kind).itemsize, lo) if hi > lo else np.zeros(0, kind)


def _ask_rows(kind: int, block: int, share: np.ndarray, **packed: pa.Array) -> pa.Table:
    n = len(share)
    rows = {"share": pa.array(share.astype(np.int32)), "kind": pa.array(np.full(n, kind, np.int32)), "block": pa.array(np.full(n, block, np.int32))}
    return pa.table(rows | {c: packed.get(c, pa.nulls(n, pa.binary())) for c in ("grams", "values", "words", "sizes")})


def _packed(gram: np.ndarray, shares: int, kind: int, block: int, values: np.ndarray | None = None) -> pa.Table:
    order, share, cut = _shares(gram, shares)
    some = {} if values is None else {"values": _rows_of(values[order].astype(np.float32), cut)}
    return _ask_rows(kind, block, share, grams=_rows_of(gram[order], cut), **some)


def _hashes(words: pa.Array) -> np.ndarray:
    """A hash of each word, eight bytes at a time; of a long one by its first bytes and its CRC."""
    data, size = _values(words, np.uint8), pc.binary_length(words).to_numpy().astype(np.int64)
    start = np.cumsum(size) - size
    eight = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), 0, (1,))
    h = mixed(size.astype(np.uint64))
    live = np.arange(len(size))
    for k in range(0, min(int(size.max(initial=0)), LONG), 8):
        live = live[size[live] > k]
        rest = np.minimum(size[live] - k, 8).astype(np.uint64)
        h[live] = mixed(h[live] ^ (eight[start[live] + k] & (np.uint64(MASK) >> (np.uint64(64) - np.uint64(8) * rest))))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] ^= np.uint64(zlib.crc32(data[start[i] : start[i] + size[i]])) << np.uint64(32)
    return h


def _asked(gram: np.ndarray, words: pa.Array, n: np.ndarray, shares: int, block: int) -> pa.Table:
    g = _packed(gram, shares, 0, block)
    order, share, cut = _shares(_hashes(words), shares)
    words = words.take(pa.array(order))
    size = pc.binary_length(words).to_numpy()
    ends = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    every = pa.array(np.union1d(g["share"].to_numpy(), share).astype(np.int32))
    at = pc.index_in(every, value_set=pa.array(share.astype(np.int32)))
    packed = {"words": _rows_of(_values(words, np.uint8), ends[cut]), "sizes": _rows_of(size, cut), "values": _rows_of(n[order], cut)}
    return _ask_rows(0, block, every.to_numpy(), grams=g["grams"].take(pc.index_in(every, value_set=g["share"].combine_chunks())), **{c: x.take(at) for c, x in packed.items()})


def _numbers(x: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind) if x.is_valid else np.zeros(0, kind)


def _places(u: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Where some of the sorted values `u` stand; looked up in order, which keeps to neighbouring memory."""
    order = np.argsort(some)
    at = np.empty(len(some), np.int64)
    at[order] = np.searchsorted(u, some[order])
    return at


def score(docs: DataFrame, depth: int = DEPTH, blocks: int | None = None, piece: int = PIECE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row."""
    parts = shuffle_partitions(docs.sparkSession)
    blocks = blocks or parts
    shares = SHARES * parts  # of the grams: more than partitions, so that these are even
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out("doc_id").alias("held"), "text")
    table = model(d, depth, piece)
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(blocks)).cast("int"))

    def ask(key: tuple, t: pa.Table) -> pa.Table:
        block = key[0].as_py()
        batch = _in_order(t)
        _, _, n, words = _words(batch)
        return _asked(_distinct_grams(batch, depth), words, n, shares, block)

    asked = d.groupBy("block").applyInArrow(ask, ASK)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, held = [], 0
        for b in batches:
            some.append(b)
            held += b.num_rows
            if held > PIECE:
                yield packed_known(some)
                some, held = [], 0
        if held:
            yield packed_known(some)

    def packed_known(some: list[pa.RecordBatch]) -> pa.RecordBatch:
        gram, lp = (np.concatenate([b.column(c).to_numpy() for b in some]) for c in ("gram", "lp"))
        return _packed(gram.view(np.uint64), shares, 1, -1, lp).combine_chunks().to_batches()[0]

    known = table.mapInArrow(pack, ASK)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a word stands at most once in a block's questions, a gram too: a task's share is even
        names = ["block", "share", "values", "counts", "tokens", "distinct"]
        questions, words, sizes, counts, lps, values = [], [], [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)]
        for b in batches:
            for kind, share, block, g, v, spelled, size in zip(*(b.column(c) for c in ("kind", "share", "block", "grams", "values", "words", "sizes"))):
                if kind.as_py():
                    lps.append(_numbers(g, np.uint64))
                    values.append(_numbers(v, np.float32))
                else:
                    questions.append((block.as_py(), share.as_py(), _numbers(g, np.uint64)))
                    words.append(_numbers(spelled, np.uint8))
                    sizes.append(_numbers(size, np.int32))
                    counts.append(_numbers(v, np.int64))
        if not questions:
            return
        lp, value = np.concatenate(lps), np.concatenate(values)
        order = np.argsort(lp)
        lp, value = lp[order], value[order]
        cut = np.concatenate(([0], np.cumsum([len(x) for x in sizes])))
        ends = np.concatenate(([0], np.cumsum(np.concatenate(sizes), dtype=np.int64)))
        coded = pc.dictionary_encode(_rows_of(np.concatenate(words), ends))
        at = coded.indices.to_numpy()
        c = np.bincount(at, np.concatenate(counts), len(coded.dictionary)).astype(np.int64)
        for lo in range(0, len(questions), 256):
            some = questions[lo : lo + 256]
            none = pa.nulls(len(some), pa.int64())
            yield pa.record_batch([pa.array([q[0] for q in some], pa.int32()), pa.array([q[1] for q in some], pa.int32()), pa.array([value[np.searchsorted(lp, g)].tobytes() for _, _, g in some], pa.binary()),
                                   pa.array([c[at[cut[i] : cut[i + 1]]].tobytes() for i in range(lo, lo + len(some))], pa.binary()), none, none], names=names)
        none = pa.nulls(blocks, pa.binary())
        yield pa.record_batch([pa.array(np.arange(blocks, dtype=np.int32)), pa.nulls(blocks, pa.int32()), none, none, pa.array(np.full(blocks, c.sum())), pa.array(np.full(blocks, (c > 0).sum()))], names=names)

    answered = asked.unionByName(known).repartition(parts, "share").mapInArrow(answer, ANSWER)

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:  # a block without documents
            return DONE.empty_table()
        row = {share: i for i, share in enumerate(right.column("share").to_pylist())}
        values, counts = (right.column(c).combine_chunks() for c in ("values", "counts"))
        train, distinct = (pc.sum(right.column(c)).as_py() for c in ("tokens", "distinct"))
        batch = _in_order(left)
        u = _distinct_grams(batch, depth)
        order, some, cut = _shares(u, shares)
        lp = np.empty(len(u), np.float32)
        for share, lo, hi in zip(some.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
            lp[order[lo:hi]] = _numbers(values[row[share]], np.float32)
        del order
        total, size = [], []
        for _, buf, off in slices(batch, "text", SLICE):  # read again: the places of all bytes' grams would be many times the text
            g, n, first = grams(buf, off, depth)
            coded = pc.dictionary_encode(pa.array(_skip(g, first, depth).view(np.int64)))
            own = lp[_places(u, coded.dictionary.to_numpy().view(np.uint64))].astype(float)  # a text's sum is kept in double precision
            total.append(np.add.reduceat(own[coded.indices.to_numpy()], np.cumsum(n) - n))
            size.append(n)
        total, size = np.concatenate(total), np.concatenate(size)
        del u, lp, coded
        words, token, c, spelled = _words(batch)
        order, some, cut = _shares(_hashes(spelled), shares)
        for share, lo, hi in zip(some.tolist(), cut[:-1].tolist(), cut[1:].tolist()):
            c[order[lo:hi]] = _numbers(counts[row[share]], np.int64)
        n = len(words)
        end = np.cumsum(words)
        log, seen = (_run_sums(x, token, end, words) for x in (np.log10(c + 1.0), (c > 0).astype(np.int64)))
        return pa.table({
            "doc_id": batch.column("doc_id"), "held_out": batch.column("held"), "n_tokens": pa.array(words + 1), "n_known": pa.array(seen + int(c[0] > 0)),
            "train_tokens": pa.array(np.full(n, train)), "_distinct": pa.array(np.full(n, distinct)),
            "_log": pa.array(log + np.log10(c[0] + 1.0)), "score": pa.array(total), "bits_per_byte": pa.array(-total * np.log2(10.0) / size)}, schema=DONE)

    done = d.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(
        finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, _distinct bigint, _log double, score double, bits_per_byte double")
    base = F.col("_log") - F.col("n_tokens") * F.log10((F.col("train_tokens") + F.col("_distinct") + 1).cast("double"))
    return done.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score", "bits_per_byte")
