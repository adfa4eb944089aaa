"""Connected components of a graph given by its edges, by alternating stars; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, tidy


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a batch as stars around the smallest node of each component of that batch."""
    for b in batches:
        u, v = b.column(0).to_numpy(), b.column(1).to_numpy()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        x, y, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
        while True:
            low = root.copy()
            np.minimum.at(low, root[x], root[y])
            np.minimum.at(low, root[y], root[x])
            low = low[low]
            new = low[root]
            if (new == root).all():
                break
            root = new
        own = np.flatnonzero(root != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["u", "v"])


def components(edges: DataFrame, a: str = "x", b: str = "y") -> DataFrame:
    """node, root (the smallest node of its component) for the nodes of edges (longs), without those that are roots."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").mapInArrow(tidy(_forest), "u long, v long").distinct()
    e = materialize(e, "edges")
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        # large star: every greater neighbour of a node is tied to the node's least neighbour
        both = e.union(e.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        # small star: a node's lesser neighbours are tied to the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("s")).select("s.u", F.col("s.m").alias("v")).where("u <> v").distinct()
        e = materialize(e, "edges")
