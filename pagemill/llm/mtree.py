"""Exact top-k search (operator 9): best-first search in M-trees.

Vectors become integers, floor(scale * x); the score is their inner product. The index is an M-tree in
two storeys: pages of entries, an entry holding a routing vector, a covering radius and (within a task) the
distance to the parent's routing vector. The root page has at most `ROOT_CELLS` entries, medoids of a sample of
`ROOT_SAMPLE` vectors; every vector goes to the cell of its nearest one, and the radius and the greatest
norm of a cell are taken over all its vectors. A cell's vectors are dealt by id to trees of about `TREE_ROWS`, each
built and searched by a task. A query walks pages best-first by the upper bound that a page's ball allows:
  q.x <= (|q|^2 + max|x|^2 - max(0, d(q, route) - radius)^2) / 2   and   q.x <= q.route + |q| radius.
Before the distance to an entry is computed, |d(q, parent) - d(parent, entry)| (stored) bounds
it from below; entries that this excludes cost nothing. A first round in one tree of the query's best cell gives the
score to beat; after it a query is sent to those trees only whose cell's bound reaches that score. A
task meets at most about `QUERY_ROWS` queries; a tree that more of them need is sent to several tasks.

Equal vectors are one entry with its smallest k + 1 ids, which is all that ties to the smaller
id can ever need; they are thinned in every task before the shuffle, so one vector that makes up
a third of the rows is not a hot group. Queries with equal vectors are searched once.

Scores are exact: in floating point where the lengths allow no rounding, else in whole numbers. Vectors whose squared
length passes 2^52 are a cell of their own, which every query visits.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor
do vectors of another length than the query, nor those with a component of 1e100 or more (no float is that large); a
score beyond the range of a long is the end of that range, and ties there go to the smaller id as anywhere; a null vec_id
takes no part; rows that repeat a vec_id with the same vector are one row, with another vector a row of their own; empty
tables give an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.common import checkpointed

SCALE = 64
PAGE = 512
FANOUT = 24
#: Vectors of a tree, about.
TREE_ROWS = 16384
#: Queries that a task searches for, about.
QUERY_ROWS = 16384
#: Entries of the root page at most, and the vectors they are chosen from.
ROOT_CELLS = 1024
ROOT_SAMPLE = 4096
#: Inner products of vectors up to this squared length are exact in floating point.
EXACT = 2.0**52
LONG = 2**63


def quantized(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): whole components, as doubles; rows without a usable vector are left out."""
    x = F.col(embedding)
    good = F.col(vec_id).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e100))

    def whole(c):
        y = c.cast("double") * scale
        return F.when(F.abs(y) < EXACT, F.floor(y).cast("double")).otherwise(y)  # larger doubles are whole

    return vectors.where(good).select(F.col(vec_id).cast("bigint").alias("vec_id"), F.transform(x, whole).alias("v"))


class MTree:
    """Rows are kept in leaf order, so that a leaf is a slice. Inner pages: (routing vectors, distances to the
    page's own routing vector, radii, greatest norms, squared lengths, children). Leaves: (None, first
    row, last row + 1, distances to the page's routing vector)."""

    def __init__(self, rows: np.ndarray, seed: int = 0):
        self.x = rows.astype(np.float64)
        self.norm2 = (self.x**2).sum(axis=1)
        self.rng = np.random.default_rng(seed)
        self.root = None
        if len(rows):
            route = self.x[0]
            d = self._far(np.arange(len(rows)), route)
            leaves: list[np.ndarray] = []
            self.root = self._page(np.arange(len(rows)), route, d, leaves)
            self.route, self.top = route, float(self.norm2.max()) ** 0.5
            self.rows = np.concatenate(leaves)
            self.x, self.norm2 = self.x[self.rows], self.norm2[self.rows]

    def _far(self, at: np.ndarray, route: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.x[at] - route) ** 2).sum(axis=1))

    def _page(self, at: np.ndarray, route: np.ndarray, d: np.ndarray, leaves: list[np.ndarray]):
        if len(at) <= PAGE:
            lo = sum(map(len, leaves))
            leaves.append(at)
            return (None, lo, lo + len(at), d)
        # promote well-spread entries and give each row to the nearest
        pick = [int(self.rng.integers(len(at)))]
        near = self._far(at, self.x[at[pick[0]]])
        owner = np.zeros(len(at), np.int64)
        fan = min(FANOUT, max(2, -(-2 * len(at) // PAGE)))  # pages come out about half full
        for k in range(1, fan):
            far = int(near.argmax())
            if near[far] == 0:
                break
            pick.append(far)
            to = self._far(at, self.x[at[far]])
            closer = to < near
            owner[closer] = k
            near = np.minimum(near, to)
        if len(pick) == 1:  # equal rows: split by number
            owner = np.arange(len(at)) * fan // len(at)
            pick = [int(np.flatnonzero(owner == k)[0]) for k in range(fan)]
        routes, radii, tops, pages = [], [], [], []
        for k, p in enumerate(pick):
            mine = owner == k
            if mine.any():
                r = self.x[at[p]]
                to = self._far(at[mine], r)
                routes.append(r)
                radii.append(to.max())
                tops.append(self.norm2[at[mine]].max())
                pages.append(self._page(at[mine], r, to, leaves))
        routes = np.array(routes)
        return (routes, np.sqrt(((routes - route) ** 2).sum(axis=1)), np.array(radii), np.array(tops), (routes**2).sum(axis=1), pages)

    def search(self, q: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows that may be among the k best, and their scores: all whose score is not below the k-th best
        seen or `floor`, so that ties are left to the caller."""
        rows, scores = self._search(q, k, -np.inf if floor <= -LONG else floor)
        if not len(rows):
            return rows, scores.astype(np.int64)
        if self.exact(q):
            return self.rows[rows], np.rint(scores).astype(np.int64)
        whole = [int(c) for c in q]
        true = (sum(a * int(b) for a, b in zip(whole, x)) for x in self.x[rows])
        return self.rows[rows], np.array([min(max(t, -LONG), LONG - 1) for t in true], np.int64)

    def exact(self, q: np.ndarray) -> bool:
        return self.root is None or float(q @ q) ** 0.5 * self.top < EXACT

    def _search(self, q: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        if self.root is None:
            return np.zeros(0, np.int64), np.zeros(0)
        qq = float(q @ q)
        size = qq**0.5
        error = 0.0 if self.exact(q) else 1e-9 * size * self.top
        floor -= error
        heap = [(-np.inf, 0, self.root, float(np.sqrt(((q - self.route) ** 2).sum())))]
        rows, scores, tick = [], [], 0
        best = np.zeros(0)
        while heap:
            bound, _, page, to_route = heapq.heappop(heap)
            if -bound < floor:
                break
            slack = floor - 1e-6 * (1 + abs(floor)) if floor > -np.inf else floor  # rounding never excludes
            if page[0] is None:
                _, lo, hi, d = page
                # the least distance that the triangle inequality allows, against the greatest that can score
                least = to_route - d
                live = np.flatnonzero(qq + self.norm2[lo:hi] - least * least >= 2 * slack)
                if not len(live):
                    continue
                few = 4 * len(live) < hi - lo
                s = self.x[lo + live] @ q if few else self.x[lo:hi] @ q
                keep = np.flatnonzero(s >= floor)
                if len(keep):
                    rows.append(lo + (live[keep] if few else keep))
                    scores.append(s[keep])
                    best = np.concatenate((best, s[keep]))
                    if len(best) >= k:
                        best = np.partition(best, len(best) - k)[len(best) - k :]
                        low = min(float(best[0]), float(LONG)) - 2 * error
                        if low > -LONG:  # scores below are one tie
                            floor = max(floor, low)
                continue
            routes, to_parent, radii, tops, length2, kids = page
            least = np.maximum(np.abs(to_route - to_parent) - radii, 0)
            live = np.flatnonzero(qq + tops - least * least >= 2 * slack)
            if not len(live):
                continue
            inner = (routes @ q)[live]
            d = np.sqrt(np.maximum(qq + length2[live] - 2 * inner, 0))
            least = np.maximum(d - radii[live], 0)
            upper = np.minimum((qq + tops[live] - least * least) / 2, inner + size * radii[live])
            upper += 1e-6 * (1 + np.abs(upper))
            for i, u, far in zip(live.tolist(), upper.tolist(), d.tolist()):
                if u >= floor:
                    tick += 1
                    heapq.heappush(heap, (-u, tick, kids[i], far))
        if not rows:
            return np.zeros(0, np.int64), np.zeros(0)
        rows, scores = np.concatenate(rows), np.concatenate(scores)
        keep = scores >= floor
        return rows[keep], scores[keep]


def _matrix(column: pa.Array) -> list[np.ndarray]:
    return [np.asarray(v.values.to_numpy()) if v.is_valid else np.zeros(0) for v in column]


def _thin(rows: DataFrame, keep: int) -> DataFrame:
    """The `keep` smallest ids of each vector, first within the tasks, then over all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[bytes, list[int]] = {}
        kept: dict[bytes, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            out = [(i, kept[k]) for k, v in ids.items() for i in v]
            return pa.record_batch([pa.array([i for i, _ in out], pa.int64()), pa.array([v for _, v in out], pa.list_(pa.float64()))], names=["vec_id", "v"])

        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), _matrix(b.column("v"))):
                k = v.tobytes()
                if k not in kept:
                    kept[k], ids[k] = v, []
                mine = ids[k]
                if i not in mine and (len(mine) < keep or i < mine[-1]):
                    mine.append(i)
                    mine.sort()
                    del mine[keep:]
            if len(kept) > 1 << 16:
                yield flush()
                ids.clear()
                kept.clear()
        if kept:
            yield flush()

    thin = rows.mapInArrow(run, "vec_id bigint, v array<double>").distinct()
    order = Window.partitionBy("v").orderBy("vec_id")
    return thin.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= keep).drop("_n")


class Root:
    """The root page: routing vectors by vector length and, once taken, each cell's (radius, greatest norm,
    first tree, trees). Cell -1 holds vectors too long to be routed; lengths that the sample lacks have cell 0 alone."""

    def __init__(self, sample: list[np.ndarray], cells: int):
        by_size: dict[int, list[np.ndarray]] = {}
        for v in sample:
            by_size.setdefault(len(v), []).append(v)
        self.routes = {n: self._medoids(np.array(vs), max(1, cells * len(vs) // len(sample))) for n, vs in by_size.items() if n}
        self.cells: dict[int, tuple] = {}

    @staticmethod
    def _medoids(x: np.ndarray, cells: int, rounds: int = 4) -> np.ndarray:
        routes = x[:: max(1, len(x) // cells)][:cells]
        for _ in range(rounds):
            owner = Root._far2(x, routes).argmin(axis=1)
            means = np.array([x[owner == c].mean(axis=0) if (owner == c).any() else routes[c] for c in range(len(routes))])
            routes = x[Root._far2(x, means).argmin(axis=0)]
        return np.unique(routes, axis=0)

    @staticmethod
    def _far2(x: np.ndarray, routes: np.ndarray) -> np.ndarray:
        return np.maximum((x**2).sum(axis=1)[:, None] + (routes**2).sum(axis=1) - 2 * (x @ routes.T), 0)

    def deal(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds each vector's length n, cell, distance to the routing vector and norm."""
        for b in batches:
            vs = _matrix(b.column("v"))
            size = np.array([len(v) for v in vs], np.int64)
            norm2 = np.array([float(v @ v) for v in vs])
            cell, far = np.where(norm2 > EXACT, -1, 0), np.zeros(len(vs))
            for n in set(size.tolist()) & set(self.routes):
                at = np.flatnonzero((size == n) & (cell == 0))
                if len(at):
                    x = np.array([vs[i] for i in at])
                    cell[at] = self._far2(x, self.routes[n]).argmin(axis=1)
                    far[at] = np.sqrt(((x - self.routes[n][cell[at]]) ** 2).sum(axis=1))
            more = [pa.array(size, pa.int32()), pa.array(cell, pa.int32()), pa.array(far), pa.array(np.sqrt(norm2))]
            yield pa.record_batch([b.column("vec_id"), b.column("v"), *more], names=["vec_id", "v", "n", "cell", "far", "norm"])

    def close(self, stats: list[tuple]) -> None:
        """Takes the cells' (n, cell, radius, greatest norm, first tree, trees)."""
        by_size: dict[int, list[tuple]] = {}
        for n, *cell in stats:
            by_size.setdefault(n, []).append(tuple(cell))
        for n, have in by_size.items():
            cell, radius, top, base, trees = (np.array(c) for c in zip(*have))
            near = np.flatnonzero(cell >= 0) if n in self.routes else np.zeros(0, np.int64)
            routes = self.routes[n][cell[near]] if len(near) else np.zeros((0, n))
            self.cells[n] = (near, routes, (routes**2).sum(axis=1), radius[near] * (1 + 1e-9), top[near] * (1 + 1e-9), base, trees)

    def _bounds(self, q: np.ndarray) -> tuple[int, np.ndarray]:
        """Of the cells with vectors as long as q: the one for the first round, and what no score in a cell exceeds."""
        near, routes, length2, radius, top, base, _ = self.cells[len(q)]
        upper = np.full(len(base), np.inf)
        if not len(near):
            return 0, upper
        qq, inner = float(q @ q), routes @ q
        least = np.sqrt(np.maximum(qq + length2 - 2 * inner - 1e-9 * (qq + length2), 0)) - radius
        best = np.minimum((qq + top**2 - np.maximum(least, 0) ** 2) / 2, inner + qq**0.5 * radius)
        upper[near] = best + 1e-6 * (1 + np.abs(best)) + 1e-9 * qq**0.5 * (top + radius)  # rounding never excludes
        return int(near[inner.argmax()]), upper

    def home(self, q: np.ndarray) -> list[int]:
        """The tree of the first round, if any vector is as long as q."""
        return [int(self.cells[len(q)][5][self._bounds(q)[0]])] if len(q) in self.cells else []

    def reached(self, q: np.ndarray, floor: float) -> list[int]:
        """The trees whose cell's bound reaches `floor`, but for that of the first round."""
        if len(q) not in self.cells:
            return []
        first, upper = self._bounds(q)
        base, trees = self.cells[len(q)][5:]
        live = np.flatnonzero(upper >= (-np.inf if floor <= -LONG else floor))
        return [t for i in live for t in range(int(base[i]), int(base[i] + trees[i])) if t != base[first]]

    def send(self, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vs = _matrix(b.column("v"))
                if first:
                    to = [self.home(v) for v in vs]
                else:
                    to = [self.reached(v, -np.inf if f is None else float(f)) for v, f in zip(vs, b.column("floor").to_pylist())]
                yield b.append_column("to", pa.array(to, pa.list_(pa.int32())))

        return run


def search_trees(data: DataFrame, sent: DataFrame) -> DataFrame:
    """data: (vec_id, v, tree); sent: (q, v, need, floor, block, tree). (q, vec_id, score): what a tree holds of each of
    its queries' `need` best, if not below `floor`."""

    def search(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            ids = left.column("vec_id").to_numpy()
            tree = MTree(np.array(_matrix(left.column("v").combine_chunks())))
            for q, v, need, floor in zip(right.column("q").to_pylist(), _matrix(right.column("v").combine_chunks()), right.column("need").to_pylist(), right.column("floor").to_pylist()):
                at, s = tree.search(v, need, -np.inf if floor is None else float(floor))
                if len(at) > need:  # ties: the smaller ids
                    o = np.lexsort((ids[at], ~s))[:need]  # ~s falls as s rises, at the ends of the range too
                    at, s = at[o], s[o]
                out[0].extend([q] * len(at))
                out[1].extend(ids[at].tolist())
                out[2].extend(s.tolist())
        return pa.table({"q": pa.array(out[0], pa.string()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    asked = sent.select(F.col("tree").alias("at"), F.col("block").alias("share")).distinct()
    needed = data.join(asked, F.col("tree") == F.col("at")).select("vec_id", "v", "at", "share")
    return needed.groupBy("at", "share").cogroup(sent.groupBy("tree", "block")).applyInArrow(search, "q string, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, tree_rows: int = TREE_ROWS, query_rows: int = QUERY_ROWS, root_cells: int = ROOT_CELLS) -> DataFrame:
    """vectors, queries: (vec_id, v) as from `quantized`. query_id, rank, vec_id, score of each query's k
    greatest inner products with other rows' vectors, ties to the smaller vec_id."""
    cells = min(-(-vectors.count() // tree_rows) or 1, root_cells)
    drawn = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(ROOT_SAMPLE) if cells > 1 else vectors.limit(0)
    sample = _matrix(drawn.select("v").toArrow().column("v").combine_chunks())
    root = Root([v for v in sample if float(v @ v) <= EXACT], cells)
    dealt = checkpointed(_thin(vectors, k + 1).mapInArrow(root.deal, "vec_id bigint, v array<double>, n int, cell int, far double, norm double"))
    # a row per cell: at most `root_cells`, and two for each length that vectors have
    trees, stats = 0, []
    for r in dealt.groupBy("n", "cell").agg(F.count(F.lit(1)).alias("rows"), F.max("far").alias("radius"), F.max("norm").alias("top")).orderBy("n", "cell").collect():
        own = -(-r.rows // tree_rows)
        stats.append((r.n, r.cell, r.radius, r.top, trees, own))
        trees += own
    root.close(stats)
    places = vectors.sparkSession.createDataFrame([(n, cell, base, own) for n, cell, _, _, base, own in stats], "n int, cell int, base int, own int")
    data = dealt.join(F.broadcast(places), ["n", "cell"]).select("vec_id", "v", (F.col("base") + F.pmod(F.xxhash64("vec_id"), F.col("own"))).cast("int").alias("tree"))

    named = F.concat_ws("-", F.xxhash64("v"), F.xxhash64(F.lit(1), "v"))  # a class of equal queries
    own = vectors.select("vec_id", named.alias("q")).distinct().groupBy("vec_id").agg(F.count(F.lit(1)).cast("int").alias("own"))
    # equal queries once; rows of a query's own id are left out at the end, so as many more hits are needed
    asked = queries.join(own, "vec_id", "left").groupBy("v").agg((k + F.coalesce(F.max("own"), F.lit(1))).cast("int").alias("need")).withColumn("q", named)
    asked = checkpointed(asked)
    blocks = -(-asked.count() // query_rows) or 1
    asked = asked.select("q", "v", "need", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int").alias("block"))
    shape = "q string, v array<double>, need int, block int, floor bigint, to array<int>"

    def sent(rows: DataFrame, first: bool) -> DataFrame:
        return rows.mapInArrow(root.send(first), shape).select("q", "v", "need", "floor", "block", F.explode("to").alias("tree"))

    first = checkpointed(search_trees(data, sent(asked.withColumn("floor", F.lit(None).cast("bigint")), True)))
    floor = first.groupBy("q").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s")).join(asked.select("q", "need"), "q").select("q", F.when(F.col("n") >= F.col("need"), F.col("s")).alias("floor"))
    rest = asked.join(floor, "q", "left").select("q", "v", "need", "block", "floor")
    more = search_trees(data, sent(rest, False))
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    best = first.unionByName(more).withColumn("rank", F.row_number().over(best)).join(asked.select("q", "need"), "q").where("rank <= need").drop("need")
    # every query with this vector, without its own row
    back = asked.select("q", "v").join(queries.select(F.col("vec_id").alias("query_id"), "v").distinct(), "v").select("q", "query_id")
    own = best.join(back, "q").where("vec_id <> query_id")
    order = Window.partitionBy("query_id", "q").orderBy(F.col("score").desc(), "vec_id")
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
