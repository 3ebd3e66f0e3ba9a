"""Connected components of an edge table by alternating large-star and small-star steps.

The rounds follow Kiveris et al., "Connected Components in MapReduce and Beyond" (2014):
O(log^2 n) rounds, no node's neighbours in one task. A minimum per node is a partial
aggregate and the join back to the edges is one that adaptive execution may split, so a
hub with very many edges is spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def spanning(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (node, smallest node) with the components of the given edges."""
    nodes, index = np.unique(np.concatenate([src, dst]), return_inverse=True)
    a, b = index[: len(src)], index[len(src) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    keep = root != np.arange(len(nodes))
    return nodes[keep], nodes[root[keep]]


def _forest(frames):
    for pdf in frames:
        if len(pdf):
            u, v = spanning(pdf["u"].to_numpy(), pdf["v"].to_numpy())
            yield pd.DataFrame({"u": u, "v": v})


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def connected_components(edges: DataFrame, scratch: Scratch, src: str = "u", dst: str = "v") -> DataFrame:
    """(node, component) for each node that has an edge to another; component = smallest node.

    Nulls in either end, loops and repeated edges are ignored; an empty table gives an
    empty result. Each round is a table in the shared folder, so lineage stays short.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).filter("u <> v")
    e = scratch.write(e.mapInPandas(_forest, "u long, v long"), "edges")
    mark = None
    while True:
        new = scratch.write(_small_star(_large_star(e)), "stars")
        scratch.drop(e)
        e = new
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        mark = now
