"""Connected components by distributed star contraction.

Edges are first contracted inside each task: any batch of edges may be replaced by
stars that connect the same nodes, a combine step that needs no grouping and holds
one bounded batch at a time. What is left between tasks is contracted by minima per
node (combined before the shuffle) and equi-joins, for a logarithmic number of
rounds. No component is ever gathered in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kmerweave.operators.lineage import cut_lineage

BATCH_EDGES = 1 << 20


def spanning_stars(u, v):
    """Star forest (node, smallest node) with the connectivity of the edges."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = ends[:len(u)], ends[len(u):]
    label = np.arange(len(nodes))
    while len(x):
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], low)
        np.minimum.at(label, label[y], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[x] != label[y]
        x, y = x[open_], y[open_]
    inner = label != np.arange(len(nodes))
    return nodes[inner], nodes[label[inner]]


def _contract(batches):
    """Contracts the edges of one task, at most ``BATCH_EDGES`` plus one batch held."""
    held = []

    def merged():
        return spanning_stars(*(np.concatenate(side) for side in zip(*held)))

    def emit(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        if sum(len(u) for u, _ in held) > BATCH_EDGES:
            held = [merged()]
            if len(held[0][0]) > BATCH_EDGES // 2:
                yield emit(*held.pop())
    if held:
        yield emit(*merged())


def _contracted(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").mapInArrow(_contract, "u bigint, v bigint")


def _lowest(edges):
    return edges.groupBy("u").agg(F.min("v").alias("low"))


def _large_star(edges):
    """Points every larger neighbour of a node at the node's smallest one."""
    both = edges.select(F.explode(F.array(
        F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")
    ).select("e.u", "e.v")
    return both.join(_lowest(both), "u").where(F.col("v") > F.col("u")).select(
        F.col("v").alias("u"), F.least("u", "low").alias("v"))


def _small_star(edges):
    """Points a node and its smaller neighbours at the smallest of them; the
    edges come in with ``u > v``."""
    low = _lowest(edges)
    moved = edges.join(low, "u").where(F.col("v") != F.col("low")).select(
        F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(low.withColumnRenamed("low", "v"))


def _settled(edges) -> bool:
    """True once every edge points at a root: no node has two targets and no
    target has a target of its own."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("into")),
        F.struct(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("into")))).alias("e")
    ).groupBy("e.n").agg(F.sum("e.out").alias("out"), F.max("e.into").alias("into"))
    return ends.where("out > 1 OR (out > 0 AND into > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """Roots of all nodes that have an edge: ``(u, root)``.

    ``edges`` has bigint columns ``(u, v)``. The root is the smallest node of a
    component and is not itself listed.
    """
    state = cut_lineage(_contracted(edges), "edges")
    while not _settled(state):
        contracted = cut_lineage(_large_star(state), "large")
        state = cut_lineage(_contracted(_small_star(contracted)).distinct(), "small")
    return state.withColumnRenamed("v", "root")
