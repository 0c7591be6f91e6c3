"""Suffix-array dedup (operator 1): remove every byte of a `width`-byte string that also starts earlier.

1. *Anchors.* Each window of `width` bytes has a minimizer: its `gram`-byte piece of least
   hash. Equal windows have equal minimizers, so windows of different anchors need no
   comparison. Documents are read once for the distinct anchors of a block of documents;
   one shuffle by anchor (a row per anchor and block, however often the anchor occurs)
   tells every block which of its anchors occur twice.
2. *Segments.* Consecutive windows with one anchor form a segment of at most
   2 * width - gram bytes. Blocks send the segments of repeated anchors; equal segments of
   a block are sent once (the earliest), the others are covered already.
3. *Suffix arrays.* A task gets all segments of its anchors, sets equal ones aside in the
   same way, and sorts the suffixes of the distinct ones by linear grouping construction
   (`gsaca`). The symbols are words (a run of bytes and the white space byte that ends it)
   in byte order, so the order is that of the bytes with a sixth of the suffixes; windows
   that start within a word are resolved by their bytes up to its end. Windows are equal
   where neighbours in the suffix array share all of `width` bytes; all but the earliest
   of equal windows are covered.
4. Blocks join their documents with the covered ranges and cut them out.

An anchor with more than `hot` occurrences is refined: its windows are split by where the
anchor lies in them, and the longer piece that all windows of a part share becomes the
anchor, so that a passage found in a third of all documents does not fill one task.

Order is (doc_id, start); a null doc_id comes after all others. Defined results: null text
is empty; texts under `width` bytes stay whole; rows with the same doc_id do not remove
each other's strings at the same start, so identical rows get the same result; an empty
table gives an empty result; other columns are carried through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import guarded, mixed, powers, run_hashes, shuffle_partitions, slices, texts, utf8
from pagemill.llm.gsaca import suffix_array

WIDTH = 100
GRAM = 32
HOT = 4096
PART = 9
BASE = 0x9E3779B97F4A7C55
BASE2 = 0xC2B2AE3D27D4EB4F
INVERSE = pow(BASE, -1, 1 << 64)
LAST = (1 << 63) - 1
#: Windows looked at together; longer documents are worked through in pieces of this many.
PIECE = 1 << 22
#: Bytes of segments whose suffixes are sorted together (whole anchor groups, at least one).
CHUNK = 1 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]*[\x20\x09-\x0D]|[^\x20\x09-\x0D]+")


def _prefix(b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(b))[: len(b)])))


def _ranges(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Content hash of [start, end) from the prefix sums, wherever it lies."""
    with np.errstate(over="ignore"):
        return mixed((prefix[end] - prefix[start]) * powers(INVERSE, int(start.max()) + 1 if len(start) else 1)[start])


def anchors(b: np.ndarray, width: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of a text: (prefix sums, offset of the piece, first window, last window + 1 and anchor
    position of each run of windows with one anchor); positions count from the piece."""
    w = width - gram + 1
    for lo in range(0, len(b) - width + 1, PIECE):
        part = b[lo : lo + PIECE + width - 1]
        prefix = _prefix(part)
        n = len(part) - gram + 1
        at = np.arange(n)
        h = _ranges(prefix, at, at + gram)
        # hash above, position below: the least is the leftmost gram of least hash
        m = (h >> np.uint64(24) << np.uint64(24)) | at.astype(np.uint64)
        s = 1
        while 2 * s <= w:
            m = np.minimum(m[:-s], m[s:])
            s *= 2
        if w > s:
            m = np.minimum(m[: s - w], m[w - s :])
        p = (m & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(p[1:] != p[:-1]) + 1))
        yield prefix, lo, h[p[first]], first, np.append(first[1:], len(p)), p[first]


def _earliest(keys: list[np.ndarray], doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order rows by keys, then (doc, pos). Returns the order, a flag for a new key, and a flag for rows
    that share the least (doc, pos) of their key."""
    order = np.lexsort((pos, doc, *keys[::-1]))
    k = [x[order] for x in keys]
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([x[1:] != x[:-1] for x in k], axis=0)
    head = np.flatnonzero(new)[np.cumsum(new) - 1] if len(order) else order
    d, p = doc[order], pos[order]
    return order, new, (d == d[head]) & (p == p[head])


def _merge(doc: np.ndarray, rid: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Union of ranges per (doc, rid); ranges that touch become one."""
    if not len(doc):
        return doc, rid, start, end
    order = np.lexsort((start, rid, doc))
    doc, rid, start, end = doc[order], rid[order], start[order], end[order]
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1])))
    # running maximum of the ends within a row: rows are lifted far apart
    lift = (np.cumsum(new) - 1) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + lift)
    new[1:] |= (start + lift)[1:] > reach[:-1]
    head = np.flatnonzero(new)
    last = np.append(head[1:], len(doc)) - 1
    return doc[head], rid[head], start[head], (reach - lift)[last]


#: Segments, or covered ranges where body is null. `meta` packs windows (for a range: its length), the
#: anchor's offset and the block; segments meet by anchor, ranges travel to their block's task.
SEGMENTS = "key bigint, doc bigint, rid int, start bigint, windows bigint, meta bigint, body binary"
_NAMES = [x.split()[0] for x in SEGMENTS.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
RANGES = "block int, doc bigint, rid int, start bigint, length bigint"


def _row_numbers(doc: np.ndarray, text_hash: np.ndarray) -> np.ndarray:
    """0, 1, ... for the different texts that share a doc_id (0 nearly always)."""
    order = np.lexsort((text_hash, doc))
    d, h = doc[order], text_hash[order]
    same = np.concatenate(([False], d[1:] == d[:-1]))
    step = (same & np.concatenate(([False], h[1:] != h[:-1]))).astype(np.int64)
    run = np.cumsum(step)
    head = np.flatnonzero(~same)[np.cumsum(~same) - 1]
    out = np.empty(len(doc), np.int64)
    out[order] = run - run[head]
    return out


def _rows(key, doc, rid, start, windows, meta, body) -> pa.RecordBatch:
    cols = [pa.array(np.asarray(c).astype(k.to_pandas_dtype())) for c, k in zip((key, doc, rid, start, windows, meta), _KINDS)]
    return pa.record_batch([*cols, body], names=_NAMES)


def _covers(block: int, doc, rid, start, end) -> pa.RecordBatch:
    n = len(doc)
    return _rows(np.full(n, block), doc, rid, start, end - start, np.full(n, block), pa.nulls(n, pa.binary()))


def _parts(first: np.ndarray, last: np.ndarray, anchor: np.ndarray, prefix: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of windows cut by where the anchor lies in the window. All windows of a part hold
    [anchor - low, anchor - high + width), whose hash is the part's key."""
    n = last - first
    i = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a = np.repeat(anchor, n)
    part = (a - i) // PART
    cut = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (part[1:] != part[:-1]))))
    low, high = part[cut] * PART, np.minimum(part[cut] * PART + PART - 1, width - gram)
    key = _ranges(prefix, a[cut] - low, a[cut] - high + width) + part[cut].astype(np.uint64)
    return key, i[cut], i[np.append(cut[1:], len(i)) - 1] + 1, a[cut]


def _segments(block: int, docs: pa.Table, flagged: pa.Table, width: int, gram: int, hot: int) -> pa.Table:
    """What a block sends: the segments of its repeated anchors, and ranges that it knows to be covered."""
    n = flagged.column("n").to_numpy()
    known = flagged.column("hash").to_numpy()
    copies = set(zip(known[n < 0].tolist(), flagged.column("h").to_numpy(zero_copy_only=False)[n < 0].tolist()))
    known, count = known[n > 0].view(np.uint64), n[n > 0]
    order = np.argsort(known)
    known, count = known[order], count[order]
    ids, hashes = docs.column("doc").to_numpy(), docs.column("h").to_numpy()
    rids = _row_numbers(ids, hashes)
    got: list[list[np.ndarray]] = [[] for _ in range(8)]  # key, digest, doc, rid, start, windows, anchor, place in buf
    whole: list[tuple[int, int, int, int]] = []
    text = docs.column("text").combine_chunks()
    buf, off = utf8(text.chunk(0) if isinstance(text, pa.ChunkedArray) else text)
    for r in range(docs.num_rows):
        b = buf[off[r] : off[r + 1]]
        if len(b) >= width and (int(ids[r]), int(hashes[r])) in copies:
            whole.append((int(ids[r]), int(rids[r]), 0, len(b)))
            continue
        if not len(known):
            continue
        for prefix, lo, h, first, last, a in anchors(b, width, gram):
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            if not hit.any():
                continue
            many = count[at] > hot
            if (hit & many).any():
                m = hit & many
                refined = _parts(first[m], last[m], a[m], prefix, width, gram)
                hit &= ~many
                h, first, last, a = (np.concatenate((x[hit], y)) for x, y in zip((h, first, last, a), refined))
            else:
                h, first, last, a = h[hit], first[hit], last[hit], a[hit]
            k = len(h)
            digest = _ranges(prefix, first, last + width - 1)
            for out, v in zip(got, (h.view(np.int64), digest, np.full(k, ids[r]), np.full(k, rids[r]), first + lo, last - first, a - first, first + (off[r] + lo))):
                out.append(v)
    out = []
    if whole:
        out.append(_covers(block, *np.array(whole).T))
    if got[0]:
        key, digest, doc, rid, start, windows, anchor, at = (np.concatenate(x) for x in got)
        order, _, least = _earliest([key, digest], doc, start)
        keep, rest = order[least], order[~least]
        out.append(_covers(block, *_merge(doc[rest], rid[rest], start[rest], start[rest] + windows[rest] + width - 1)))
        for lo in range(0, len(keep), 1 << 16):
            k = keep[lo : lo + (1 << 16)]
            out.append(_rows(key[k], doc[k], rid[k], start[k], windows[k], anchor[k] << 32 | block, texts(buf, at[k], at[k] + windows[k] + width - 1)))
    return pa.Table.from_batches(out, pa.schema(list(zip(_NAMES, _KINDS))))


def equal_windows(bodies: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes of equal `width`-byte windows of some strings, from the suffix array of their words:
    (string, offset, class) per window."""
    words = [WORD.findall(x) for x in bodies]
    names = sorted({x for s in words for x in s})
    number = {x: i + 2 for i, x in enumerate(names)}
    symbols: list[int] = []
    for s in words:
        symbols += [number[x] for x in s]
        symbols.append(1)
    symbols.append(0)
    order = np.array(suffix_array(symbols), np.int64)

    buf = np.frombuffer(b"".join(bodies) + bytes(width), np.uint8)
    size = np.array([len(x) for x in bodies], np.int64)
    base = np.cumsum(size) - size
    lengths = np.array([n for s in words for n in (*map(len, s), 0)] + [0], np.int64)
    at = np.cumsum(lengths) - lengths  # byte position of each suffix
    owner = np.repeat(np.arange(len(bodies)), [len(s) + 1 for s in words])
    room = np.append((base + size)[owner], base[-1] + size[-1]) - at  # bytes to the end of its string

    # bytes that neighbours in the order share, up to `width`
    a, b = order[:-1], order[1:]
    shared = np.minimum(np.minimum(room[a], room[b]), width)
    for lo in range(0, len(a), 1 << 15):
        x, y = at[a[lo : lo + (1 << 15)]], at[b[lo : lo + (1 << 15)]]
        off = np.arange(width)
        differ = buf[np.minimum(x[:, None] + off, len(buf) - 1)] != buf[np.minimum(y[:, None] + off, len(buf) - 1)]
        where = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        shared[lo : lo + (1 << 15)] = np.minimum(shared[lo : lo + (1 << 15)], where)
    shared = np.concatenate(([0], shared))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))

    # each window: its bytes up to the next word start after its own, and the suffix from there
    n = np.maximum(size - width + 1, 0)
    string = np.repeat(np.arange(len(bodies)), n)
    offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    pos = base[string] + offset
    begin = lengths > 0
    word_at, word_no = at[begin], np.flatnonzero(begin)
    nxt = np.searchsorted(word_at, pos, "right")
    stop = np.minimum(nxt, len(word_at) - 1)
    ahead = np.where(nxt < len(word_at), word_at[stop] - pos, width)
    ahead = np.minimum(ahead, width)  # a word may be longer than a window
    head = np.zeros(len(pos), np.uint64)
    head2 = np.zeros(len(pos), np.uint64)
    some = ahead > 0
    head[some], head2[some] = run_hashes(buf, pos[some], (pos + ahead)[some]), run_hashes(buf, pos[some], (pos + ahead)[some], BASE2)
    run = np.zeros(len(pos), np.int64)
    for k in np.unique(ahead).tolist():
        if k < width:
            mine = ahead == k
            run[mine] = np.cumsum(shared < width - k)[rank[word_no[stop[mine]]]]
    order = np.lexsort((head2, head, run, ahead))
    keys = [x[order] for x in (ahead, run, head, head2)]
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([x[1:] != x[:-1] for x in keys], axis=0)
    cls = np.empty(len(order), np.int64)
    cls[order] = np.cumsum(new)
    return string, offset, cls


def _resolve(t: pa.Table, width: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Covered ranges (block, doc, rid, start, end) among all segments of some anchors."""
    key, doc, rid, start, windows, meta = (t.column(n).to_numpy() for n in _NAMES[:-1])
    anchor, block = meta >> 32, meta & ((1 << 32) - 1)
    bodies = t.column("body").combine_chunks()
    bodies = (bodies.chunk(0) if isinstance(bodies, pa.ChunkedArray) else bodies).cast(pa.large_binary())
    off = np.frombuffer(bodies.buffers()[1], np.int64, len(bodies) + 1, bodies.offset * 8)
    buf = np.frombuffer(bodies.buffers()[2], np.uint8)
    lo, hi = off[:-1], off[1:]
    half = (width - gram) // 2
    # content hashes: of the whole segment, and of the longer pieces around its anchor that windows with
    # much before the anchor, and those with little, hold
    a = lo + anchor
    cuts = [(lo, hi), (a - half, a + gram), (a, a + width - half + 1)]
    has = [np.ones(len(lo), bool), anchor >= half, anchor - windows + 1 < half]
    digest = [np.zeros(len(lo), np.uint64) for _ in cuts]
    inside = [(s >= lo) & (e <= hi) for s, e in cuts]
    for i in range(0, len(lo), 1 << 13):
        prefix = _prefix(buf[lo[i] : hi[min(i + (1 << 13), len(lo)) - 1]])
        for out, (s, e), ok in zip(digest, cuts, inside):
            m = i + np.flatnonzero(ok[i : i + (1 << 13)])
            if len(m):
                out[m] = _ranges(prefix, s[m] - lo[i], e[m] - lo[i])
    order, new, least = _earliest([key, digest[0]], doc, start)
    rest = order[~least]
    yield block[rest], doc[rest], rid[rest], start[rest], start[rest] + windows[rest] + width - 1
    # rows at the least (doc, start) of equal segments: twins from repeated rows follow the first
    twin = order[least]
    reps = order[np.flatnonzero(new)]
    twins_of = np.searchsorted((np.cumsum(new) - 1)[least], np.arange(len(reps) + 1))
    # a window can only recur if such a piece recurs in another segment of the anchor
    live = np.zeros(len(reps), bool)
    for out, ok, h in list(zip(digest, inside, has))[1:]:
        i = np.flatnonzero((h & ok)[reps])
        o = i[np.lexsort((out[reps[i]], key[reps[i]]))]
        same = (key[reps[o[1:]]] == key[reps[o[:-1]]]) & (out[reps[o[1:]]] == out[reps[o[:-1]]])
        live[o[1:][same]] = live[o[:-1][same]] = True
        live |= (h & ~ok)[reps]
    chosen = np.flatnonzero(live)
    if not len(chosen):
        return
    k = key[reps[chosen]]
    bounds = np.append(np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))), len(k))  # groups of one anchor
    total = np.concatenate(([0], np.cumsum((hi - lo)[reps[chosen]])))
    g = 0
    while g < len(bounds) - 1:
        stop = max(int(np.searchsorted(total[bounds], total[bounds[g]] + CHUNK, "right")) - 1, g + 1)
        mine = chosen[bounds[g] : bounds[stop]]
        g = stop
        rows = reps[mine]
        string, offset, cls = equal_windows([bodies[int(i)].as_py() for i in rows], width)
        row = rows[string]
        where = start[row] + offset
        by = np.lexsort((where, doc[row], cls))
        first = np.concatenate(([True], cls[by][1:] != cls[by][:-1]))
        head = by[np.flatnonzero(first)[np.cumsum(first) - 1]]
        hit = by[(doc[row][by] != doc[row][head]) | (where[by] != where[head])]
        rep = mine[string[hit]]
        n = twins_of[rep + 1] - twins_of[rep]
        who = twin[np.repeat(twins_of[rep], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        s = np.repeat(where[hit], n)
        d, r, s, e = _merge(doc[who], rid[who] << 32 | block[who], s, s + width)
        yield r & ((1 << 32) - 1), d, r >> 32, s, e


def dedup(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot: int = HOT, blocks: int | None = None, as_text: bool = False) -> DataFrame:
    """The rows of `docs` with n_bytes, n_removed, n_spans and `kept`, the remaining bytes, instead of text;
    as_text: `kept` as a string, without what is left of characters that were cut in two."""
    return guarded(docs, ("doc_id", "text"), lambda d: _dedup(d, width, gram, hot, blocks, as_text))


def _dedup(docs: DataFrame, width: int, gram: int, hot: int, blocks: int | None, as_text: bool) -> DataFrame:
    parts = shuffle_partitions(docs.sparkSession)
    blocks = blocks or 4 * parts
    d = docs.select(
        *docs.columns, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST)).alias("doc"), F.xxhash64("text").alias("h"),
        F.pmod(F.xxhash64("doc_id", F.lit("block")), F.lit(blocks)).cast("int").alias("block"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, buf, off in slices(batch, "text"):
                block = rows.column("block").to_numpy()
                hs, bs = [], []
                for r in range(rows.num_rows):
                    for _, _, h, *_ in anchors(buf[off[r] : off[r + 1]], width, gram):
                        hs.append(h)
                        bs.append(np.full(len(h), block[r]))
                if not hs:
                    continue
                h, b = np.concatenate(hs), np.concatenate(bs)
                order = np.lexsort((b, h))
                h, b = h[order], b[order]
                head = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (b[1:] != b[:-1]))))
                yield pa.record_batch([pa.array(h[head].view(np.int64)), pa.array(b[head], pa.int32()), pa.array(np.diff(np.append(head, len(h))).astype(np.int32))],
                                      names=["hash", "block", "n"])

    # anchors that occur twice, per block
    found = d.select("block", "text").mapInArrow(find, "hash bigint, block int, n int")
    total = F.sum("n").over(Window.partitionBy("hash"))
    flagged = found.withColumn("n", total).where("n > 1").withColumn("h", F.lit(0).cast("bigint"))
    # whole copies of a text with a smaller doc_id need no segments (n = -1; hash and h name the row)
    same = d.where(F.octet_length("text") >= width).select("doc", "h", F.xxhash64(F.lit(1), "text").alias("h2"), "block")
    least = same.groupBy("h", "h2").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = same.join(least, ["h", "h2"]).where("doc > least").select(F.col("doc").alias("hash"), "block", F.lit(-1).cast("bigint").alias("n"), "h")
    flagged = flagged.select("hash", "block", "n", "h").unionByName(copies)

    def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return _segments(key[0].as_py(), left, right, width, gram, hot)

    segments = d.groupBy("block").cogroup(flagged.groupBy("block")).applyInArrow(send, SEGMENTS)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = []
        for b in batches:
            done = b.filter(pc.is_null(b.column("body")))
            if done.num_rows:
                yield pa.record_batch([done.column("meta").cast(pa.int32()), *(done.column(n) for n in ("doc", "rid", "start", "windows"))], names=["block", "doc", "rid", "start", "length"])
            rest = b.filter(pc.is_valid(b.column("body")))
            if rest.num_rows:
                own.append(rest)
        if own:
            for block, doc, rid, s, e in _resolve(pa.Table.from_batches(own), width, gram):
                yield pa.record_batch([pa.array(block.astype(np.int32)), pa.array(doc), pa.array(rid.astype(np.int32)), pa.array(s), pa.array(e - s)], names=["block", "doc", "rid", "start", "length"])

    covered = segments.repartition(parts, "key").mapInArrow(resolve, RANGES)
    keep = [c for c in docs.columns if c != "text"]
    kinds = dict(d.dtypes)
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in keep) + f", n_bytes bigint, n_removed bigint, n_spans bigint, kept {'string' if as_text else 'binary'}"

    def cut(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        doc = left.column("doc").to_numpy()
        rid = _row_numbers(doc, left.column("h").to_numpy())
        s = right.column("start").to_numpy()
        merged = _merge(right.column("doc").to_numpy(), right.column("rid").to_numpy().astype(np.int64), s, s + right.column("length").to_numpy())
        ranges: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for x in zip(*(c.tolist() for c in merged)):
            ranges.setdefault(x[:2], []).append(x[2:])
        n_bytes, removed, spans_, kept = [], [], [], []
        for k, text in zip(zip(doc.tolist(), rid.tolist()), left.column("text")):
            raw = (text.as_py() or "").encode()
            mine = ranges.get(k, ())
            at, out = 0, []
            for s0, e0 in mine:
                out.append(raw[at:s0])
                at = e0
            out.append(raw[at:])
            kept.append(b"".join(out))
            n_bytes.append(len(raw))
            removed.append(len(raw) - len(kept[-1]))
            spans_.append(len(mine))
        more = {"n_bytes": pa.array(n_bytes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans_, pa.int64()), "kept": pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())}
        return pa.Table.from_pydict({n: left.column(n) for n in keep} | more)

    # the same rows, dealt the same way as above, so that Spark shuffles the texts once
    return d.groupBy("block").cogroup(covered.groupBy("block")).applyInArrow(cut, schema)
