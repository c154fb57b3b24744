"""Connected components of a graph given as edges, by alternating star contractions.

Large-star and small-star steps (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014) point every node at the smallest node it can see.
Each step is a grouped minimum, which Spark sums up on the map side, and an
equi-join that adaptive execution can split where one node has many neighbours.
Each round is written to the shared folder, so neither lineage nor a lost
executor costs more than one round; tables of rounds before are deleted.
A graph of at most LOCAL edges, before the first round or after any, is worked
through by one task, which saves it the rounds that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, materialize, trimming

#: Edges that one task is given at most; two numbers each.
LOCAL = 1 << 20


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """Links each node's neighbours above it (large star) or not above it (small star), and itself, to their minimum."""
    u, v = F.col("u"), F.col("v")
    both = edges.select(F.greatest(u, v).alias("n"), F.least(u, v).alias("m"))
    if not small:
        both = edges.select(u.alias("n"), v.alias("m")).union(edges.select(v.alias("n"), u.alias("m")))
    lowest = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("low"))
    linked = both.join(lowest, "n")
    if small:
        out = linked.select(F.col("m").alias("u"), F.col("low").alias("v")).union(lowest.select(F.col("n").alias("u"), F.col("low").alias("v")))
    else:
        out = linked.filter("m > n").select(F.col("m").alias("u"), F.col("low").alias("v"))
        out = out.union(lowest.filter("low < n").select(F.col("n").alias("u"), F.col("low").alias("v")))
    return out.filter("u <> v").distinct()


def roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component) of a graph given by its edges' ends."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(u):
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while (higher := root[root] != root).any():
            root[higher] = root[root[higher]]
        u, v = root[u], root[v]
        u, v = u[u != v], v[u != v]
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    @trimming
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(i).to_numpy() for i in (0, 1)] for batch in batches]
        if parts:
            yield pa.record_batch([pa.array(x) for x in roots(*map(np.concatenate, zip(*parts, strict=True)))], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge to another; root is the smallest node of its component.

    edges: (u, v) of one orderable type without nulls; loops, repeats and both
    directions are allowed. A graph without edges gives an empty table.
    """
    edges = materialize(edges.select("u", "v").filter("u <> v").distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] <= LOCAL and edges.schema["u"].dataType == T.LongType():
            return _in_one_task(edges)
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v")).distinct()
        state = now
        before, edges = edges, materialize(_star(_star(edges, small=False), small=True))
        forget(before)
