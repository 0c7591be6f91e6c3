"""Connected components of an edge table by alternating large-star and small-star steps.

Only minima travel: each step is one aggregate with a map-side phase and one join, so the
centre of a big component is never collected. Every step is checkpointed; the loop ends
when a full round changes no edge.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with v < u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    out = both.join(least, "u")
    if large:
        out = out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = out.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        # a centre with one smaller neighbour keeps its edge; with several, the edge to the least is the first case
    return out.where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
    return r[0], r[1]


def components(edges: DataFrame) -> DataFrame:
    """(u, v) pairs of bigint nodes, any direction -> (node, label) for every node that has an edge
    and isn't its component's smallest; label is that smallest node."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = checkpointed(e)
    state = _state(e)
    while state[0]:
        e = checkpointed(_star(_star(e, True), False))
        new = _state(e)
        if new == state:
            break
        state = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node of its component) of the graph on these edges: what one task
    sends on instead of all the pairs that it found."""
    if not len(u):
        return u, v
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        lo, hi = np.minimum(ra, rb), np.maximum(ra, rb)
        move = lo < hi
        if not move.any():
            break
        np.minimum.at(root, hi[move], lo[move])
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        keep = root[a] != root[b]
        a, b = a[keep], b[keep]
    k = root != np.arange(len(nodes))
    return nodes[k], nodes[root[k]]
