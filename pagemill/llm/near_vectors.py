"""Embedding near-dedup (operator 10): subspace pigeonhole join.

Unit vectors at cosine c are sqrt(2 - 2c) apart. After a rotation that spreads differences over
all coordinates, the coordinates are split into blocks, and the squared distance is budgeted to
the blocks in proportion to their width: two linked vectors are within budget in at least one
block. Each block is a range join: its first `grid` coordinates are cut into cells four radii
wide; a vector goes to its own cell and to the neighbours that its radius reaches. A task holds
the vectors of one cell, finds the pairs within the block's budget, and verifies their cosine
in double precision on the vectors as given.

A pair counts in the first block in which it is within budget, and in the cell of its smaller
node, so once. Tasks emit a count of links per vector and a spanning forest of links, not the
pairs. Equal vectors are one node that counts for all its rows, grouped with a map-side phase.
Cells with more than `chunk` vectors are cut into chunks whose pairs go to separate tasks.
`grid` grows with the logarithm of the largest label so that cells stay small; every choice of
it gives the same result.

Defined results: a null label, a null or zero vector, or one with a null or non-finite component
links with nothing (n_links 0, its own component); vectors of different length never link; rows
that repeat a vec_id are separate rows, linked or not as their vectors are; a null vec_id names no component unless
it is alone, then component_id is null and kept true; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import checkpointed, shuffle_partitions
from pagemill.llm.components import components, forest

COSINE = 0.98
BLOCKS = 4
CHUNK = 4096
#: Vectors of a label per cell that the number of grid coordinates aims at.
CELL_ROWS = 2048
TILE = 1024


def rotation(dim: int) -> np.ndarray:
    """A fixed random rotation; made on the driver, so that all tasks use the same."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int) -> list[tuple[int, int]]:
    n = min(blocks, dim)
    cut = [dim * k // n for k in range(n + 1)]
    return list(zip(cut, cut[1:]))


def _radius2(lo: int, hi: int, dim: int, cosine: float) -> float:
    return (2 - 2 * cosine) * (hi - lo) / dim * (1 + 1e-9) + 1e-12


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)  # no overflow, no underflow
    x = x / big
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _cells(nodes: DataFrame, rotate: dict[int, np.ndarray], blocks: int, cosine: float, grid: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == dim))
                u = _unit(_vectors(rows.column("x"), dim)) @ rotate[dim]
                for k, (lo, hi) in enumerate(block_edges(dim, blocks)):
                    r = _radius2(lo, hi, dim, cosine) ** 0.5
                    g = min(grid, hi - lo)
                    p = u[:, lo : lo + g] / (4 * r)
                    own, low, high = (np.floor(v).astype(np.int32) for v in (p, p - 0.2501, p + 0.2501))
                    for step in product((-1, 0, 1), repeat=g):
                        c = own + np.array(step, np.int32)
                        m = np.flatnonzero(((c >= low) & (c <= high)).all(axis=1))
                        if len(m):
                            at = np.column_stack((np.full(len(m), dim, np.int32), np.full(len(m), k, np.int32), c[m])).astype("<i4")
                            part = rows.take(pa.array(m))
                            yield pa.record_batch(
                                [part.column("label"), pa.array([x.tobytes() for x in at], pa.binary()), pa.array(np.full(len(m), not any(step))), part.column("node"), part.column("n"), part.column("x")],
                                names=["label", "cell", "home", "node", "n", "x"])

    kind = dict(nodes.dtypes)
    return nodes.mapInArrow(run, f"label {kind['label']}, cell binary, home boolean, node bigint, n bigint, x {kind['x']}")


def _pairs(home: np.ndarray, every: np.ndarray, x: np.ndarray, node: np.ndarray, dim: int, block: int, rotate: np.ndarray, blocks: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (home, other) that this block and cell answer for."""
    unit = _unit(x)
    norm = np.sqrt((x * x).sum(axis=1))
    u = unit @ rotate
    edges = block_edges(dim, blocks)
    budget = [_radius2(lo, hi, dim, cosine) for lo, hi in edges]
    lo, hi = edges[block]
    b = u[:, lo:hi]
    sq = (b * b).sum(axis=1)
    for i0 in range(0, len(home), TILE):
        i = home[i0 : i0 + TILE]
        for j0 in range(0, len(every), TILE):
            j = every[j0 : j0 + TILE]
            d = sq[i][:, None] + sq[j][None, :] - 2 * (b[i] @ b[j].T)
            s, t = np.nonzero((d <= budget[block] + 1e-9) & (node[i][:, None] < node[j][None, :]))
            for p0 in range(0, len(s), 1 << 17):
                a, c = i[s[p0 : p0 + (1 << 17)]], j[t[p0 : p0 + (1 << 17)]]
                cos = (x[a] * x[c]).sum(axis=1) / (norm[a] * norm[c])
                with np.errstate(invalid="ignore"):
                    ok = np.where(np.isfinite(cos), cos, (unit[a] * unit[c]).sum(axis=1)) >= cosine
                a, c = a[ok], c[ok]
                diff = (u[a] - u[c]) ** 2
                within = [diff[:, e0:e1].sum(axis=1) <= r for (e0, e1), r in zip(edges[: block + 1], budget)]
                first = within[block]
                for w in within[:block]:
                    first = first & ~w
                yield a[first], c[first]


def links(nodes: DataFrame, cosine: float = COSINE, blocks: int = BLOCKS, chunk: int = CHUNK, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(kind, a, b): kind 0, edges of spanning forests; kind 1, node a has b links found in one task.
    nodes: label, dim, node, n (rows it stands for), x."""
    spark = nodes.sparkSession
    shape = nodes.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("most")).collect()  # a row per vector length
    rotate = spark.sparkContext.broadcast({r["dim"]: rotation(r["dim"]) for r in shape})  # dim * dim each
    most = max((r["most"] for r in shape), default=1)
    grid = max(1, ceil(log(max(1.0, most / cell_rows)) / log(3)))
    rows = _cells(nodes, rotate.value, blocks, cosine, grid)
    hot = rows.groupBy("label", "cell").count().where(F.col("count") > chunk).select("label", "cell", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    rows = rows.join(hot, ["label", "cell"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    rows = rows.withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # task (i, j) joins the home rows of chunk i with all rows of chunk j
    away = F.col("home") & (F.col("c") != F.col("o"))
    both = F.array(F.struct(F.col("o").alias("i"), F.col("c").alias("j"), (F.col("home") & (F.col("c") == F.col("o"))).alias("own"), F.lit(True).alias("other")),
                   F.struct(F.col("c").alias("i"), F.col("o").alias("j"), F.lit(True).alias("own"), F.lit(False).alias("other")))
    both = F.slice(both, F.lit(1), F.when(away, 2).otherwise(1))
    rows = rows.withColumn("s", F.explode(both)).select("label", "cell", "s.*", "node", "n", "x")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        dim, block = np.frombuffer(key[1].as_py(), "<i4", 2).tolist()
        x = _vectors(t.column("x").combine_chunks(), dim)
        node, n = t.column("node").to_numpy(), t.column("n").to_numpy()
        home = np.flatnonzero(t.column("own").to_numpy())
        every = np.flatnonzero(t.column("other").to_numpy())
        count = np.zeros(len(node), np.int64)
        us, vs = [], []
        for a, c in _pairs(home, every, x, node, dim, block, rotate.value[dim], blocks, cosine):
            np.add.at(count, a, n[c])
            np.add.at(count, c, n[a])
            u, v = forest(node[a], node[c])
            us.append(u)
            vs.append(v)
        u, v = forest(np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2
        some = np.flatnonzero(count)
        return pa.table({"kind": pa.array(np.repeat([0, 1], [len(u), len(some)]), pa.int32()), "a": pa.array(np.concatenate((u, node[some]))), "b": pa.array(np.concatenate((v, count[some])))})

    return rows.groupBy("label", "cell", "i", "j").applyInArrow(run, "kind int, a bigint, b bigint")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", **how) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    x = F.col(embedding)
    good = F.col(label).isNotNull() & x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists(x, lambda c: c != 0)
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.when(good, x).alias("x"), F.col(label).alias("label"))
    # -0.0 is 0.0; a node is named by 128 bits of label and vector
    rows = rows.withColumn("x", F.transform("x", lambda c: c + 0)).withColumns({"k1": F.xxhash64("label", "x"), "k2": F.xxhash64(F.lit(1), "x", "label")})
    alone = rows.where("x is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    rows = rows.where("x is not null")
    classes = rows.groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"), F.any_value("x").alias("x"), F.any_value("label").alias("label"))
    # numbers that the checkpoint fixes: one vec_id may stand in several classes
    classes = checkpointed(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("x")))
    found = checkpointed(links(classes.select("label", "dim", "node", "n", "x"), cosine, **how))
    label_of = components(found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v")))
    count = found.where("kind = 1").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    c = classes.select("k1", "k2", "node", "least", "n").join(label_of, "node", "left").join(count, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = c.groupBy("label").agg(F.min("least").alias("component_id"))
    c = c.join(least, "label").select("k1", "k2", "component_id", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    linked = rows.select("vec_id", "k1", "k2").join(c, ["k1", "k2"])
    linked = linked.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
    return linked.unionByName(alone)
