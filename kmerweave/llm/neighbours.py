"""Approximate nearest neighbours by inner product: a forest of random-projection trees.

The forest is grown on a bounded sample of the distinct vectors; its inner nodes are few and travel with the tasks. All
distinct vectors are filed in their leaf of every tree, and the filed table is the index. A query walks all trees through
one priority queue: whichever branch of any tree is least far on the wrong side comes next, until enough leaves are
found. Vectors in these leaves are candidates, and their exact inner products rank them.

Copies of a vector are one entry of the index, with their smallest ids kept aside, so a vector that a third of all rows
repeat costs no more than any other. A leaf with many vectors is dealt over several tasks.

For the largest inner product rather than the least angle, each vector gets one more coordinate that brings it to the
length of the longest; a query's is zero.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from kmerweave.llm.common import cut_lineage, shuffles_end_with_jobs

#: Bound of the sample that the forest is grown on: the distinct vectors with the smallest hashes.
SAMPLE = 20_000
TREES, LEAF, SEED = 8, 300, 7
#: Share of all trees' leaves that a query visits (two a tree at least). This sets recall against work: vectors without
#: any structure need this much for nine tenths of the neighbours, clustered ones far less.
VISITS = 0.15
#: Vectors of a leaf that one task ranks for the queries that visit it.
PART = 20_000


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees: an inner node has a normal, an offset and two children; a leaf's children are -1."""

    normals: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: tuple[int, ...]

    def leaves(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point in each tree."""
        found = np.empty((len(points), len(self.roots)), np.int32)
        for tree, root in enumerate(self.roots):
            node = np.full(len(points), root)
            while True:
                inner = np.flatnonzero(self.children[node, 0] >= 0)
                if not len(inner):
                    break
                at = node[inner]
                side = np.einsum("ij,ij->i", self.normals[at], points[inner]) > self.offsets[at]
                node[inner] = self.children[at, side.astype(int)]
            found[:, tree] = node
        return found

    def search(self, point: np.ndarray, share: float) -> list[int]:
        """The leaves nearest to a point, over all trees: a share of them, two a tree at least."""
        visits = max(2 * len(self.roots), int(np.ceil(share * np.count_nonzero(self.children[:, 0] < 0))))
        queue, found = [(-np.inf, root) for root in self.roots], []
        heapq.heapify(queue)
        while queue and len(found) < visits:
            missed, node = heapq.heappop(queue)
            while self.children[node, 0] >= 0:
                margin = float(self.normals[node] @ point - self.offsets[node])
                near, far = (1, 0) if margin > 0 else (0, 1)
                heapq.heappush(queue, (max(missed, abs(margin)), int(self.children[node, far])))
                node = int(self.children[node, near])
            found.append(node)
        return found


def grow(points: np.ndarray, trees=TREES, leaf=LEAF, seed=SEED) -> Forest:
    """Trees that split at the middle of their points' projections on the line between two random ones."""
    random = np.random.default_rng(seed)
    normals, offsets, children, roots = [], [], [], []

    def add() -> int:
        normals.append(np.zeros(points.shape[1]))
        offsets.append(0.0)
        children.append([-1, -1])
        return len(children) - 1

    for _ in range(trees):
        roots.append(add())
        waiting = [(roots[-1], np.arange(len(points)))]
        while waiting:
            node, rows = waiting.pop()
            if len(rows) <= leaf:
                continue
            some = points[random.choice(rows, min(len(rows), 16), replace=False)]
            half = len(some) // 2
            normal = some[:half].mean(axis=0) - some[half:].mean(axis=0)
            length = np.linalg.norm(normal)
            projected = points[rows] @ normal
            middle = float(np.median(projected))
            right = projected > middle
            if length == 0 or right.all() or not right.any():
                continue
            normals[node], offsets[node] = normal / length, middle / length
            children[node] = [add(), add()]
            waiting += [(children[node][0], rows[~right]), (children[node][1], rows[right])]
    return Forest(np.array(normals), np.array(offsets), np.array(children), tuple(roots))


def usable(vectors: Column) -> Column:
    """False for null and zero vectors and for those with null or non-finite components."""
    return F.coalesce(
        F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists(vectors, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _lifted(rows: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest - np.einsum("ij,ij->i", rows, rows), 0))
    return np.column_stack([rows, rest])


def _best(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """The ``k`` best vectors of a part of a leaf (``right``) for each query that visits it (``left``)."""
    queries = left.column("query").to_numpy()
    ids, vectors = right.column("vector_class").to_numpy(), _matrix(right.column("vector").combine_chunks(), right.num_rows)
    asked = _matrix(left.column("vector").combine_chunks(), left.num_rows)
    out = []
    for at in range(0, len(queries) if len(ids) else 0, 1024):
        scores = asked[at:at + 1024] @ vectors.T
        count = min(k, len(ids))
        kept = np.argpartition(-scores, count - 1, axis=1)[:, :count]
        least = np.take_along_axis(scores, kept, axis=1).min(axis=1)
        for tied in np.flatnonzero((scores >= least[:, None]).sum(axis=1) > count):
            kept[tied] = np.lexsort((ids, -scores[tied]))[:count]
        out.append((np.repeat(queries[at:at + 1024], count), ids[kept].ravel(),
                    np.take_along_axis(scores, kept, axis=1).ravel()))
    q, v, s = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 2 + (np.zeros(0),)
    return pa.table({"query": q, "vector_class": v, "score": s})


def nearest(vectors: DataFrame, queries: Column, k=20, id_col="vec_id", vector_col="embedding", visits=VISITS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row that ``queries`` selects, the ``k`` rows found with the largest
    inner products, its own left out, ties to smaller ids.

    Rows whose vector is not ``usable``, or without id, take no part. Shorter vectors count as filled up with zeros.
    Rows that repeat an id and vector count once. Recall grows with ``visits``; all rows are in the index.
    """
    spark = vectors.sparkSession
    with shuffles_end_with_jobs(spark):
        rows = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"), queries.alias("asks"))
        square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
        shape = rows.agg(F.max(F.size("vector")).alias("size"), F.max(square).alias("longest")).first()
        size, longest = shape["size"] or 1, shape["longest"] or 0.0
        zero = F.lit(0).cast(vectors.schema[vector_col].dataType.elementType)
        rows = rows.withColumn("vector", F.concat("vector", F.array_repeat(zero, F.lit(size) - F.size("vector"))))
        classes = cut_lineage(rows.groupBy("vector").agg(
            F.min("vec_id").alias("vector_class"), F.count(F.lit(1)).alias("n"), F.max("asks").alias("asks")), "vectors")
        sample = classes.orderBy(F.xxhash64("vector"), "vector_class").limit(SAMPLE).select("vector").toArrow()
        points = _matrix(sample.column("vector").combine_chunks(), sample.num_rows)
        forest = spark.sparkContext.broadcast(grow(_lifted(points, longest) if len(points) else np.zeros((0, size + 1))))

        def file(batches):
            for batch in batches:
                n = batch.num_rows
                if n:
                    leaves = forest.value.leaves(_lifted(_matrix(batch.column("vector"), n), longest)).ravel()
                    each = pa.array(np.repeat(np.arange(n), len(forest.value.roots)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaves), batch.column("vector_class").take(each), batch.column("vector").take(each)],
                        names=["leaf", "vector_class", "vector"])

        def ask(batches):
            for batch in batches:
                n = batch.num_rows
                if n:
                    points = np.column_stack([_matrix(batch.column("vector"), n), np.zeros(n)])
                    found = [forest.value.search(p, visits) for p in points]
                    each = pa.array(np.repeat(np.arange(n), [len(f) for f in found]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(found).astype(np.int32)), batch.column("vector_class").take(each),
                         batch.column("vector").take(each)], names=["leaf", "query", "vector"])

        kind = classes.schema["vector"].dataType.simpleString()
        index = cut_lineage(classes.select("vector_class", "vector").mapInArrow(
            file, f"leaf int, vector_class bigint, vector {kind}"), "forest-index")
        parts = cut_lineage(index.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts")),
                            "leaf-parts")
        filed = index.join(parts, "leaf").withColumn(
            "part", F.pmod(F.xxhash64("vector_class"), F.col("parts")).cast("int")).drop("parts")
        visited = parts.select(F.col("leaf").alias("visited"), F.col("parts").alias("its_parts"))
        asked = classes.where("asks").select("vector_class", "vector").mapInArrow(
            ask, f"leaf int, query bigint, vector {kind}").join(visited, F.col("leaf") == F.col("visited")).select(
            "leaf", "query", "vector", F.explode(F.sequence(F.lit(0), F.col("its_parts") - 1)).alias("part"))
        ranked = asked.groupBy("leaf", "part").cogroup(filed.groupBy("leaf", "part")).applyInArrow(
            lambda left, right: _best(left, right, k + 1), "query bigint, vector_class bigint, score double")
        best = Window.partitionBy("query").orderBy(F.desc("score"), "vector_class")
        found = cut_lineage(ranked.groupBy("query", "vector_class").agg(F.max("score").alias("score")).withColumn(
            "place", F.row_number().over(best)).where(F.col("place") <= k + 1).drop("place"), "candidates")

        named = rows.join(classes.select("vector", "vector_class", "n"), "vector").select(
            "vec_id", "vector_class", "asks").distinct()
        named = cut_lineage(named, "vector-names")
        first = Window.partitionBy("vector_class").orderBy("vec_id")
        members = named.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k + 1).select(
            "vector_class", "vec_id")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        answers = cut_lineage(found.join(members, "vector_class").withColumn("place", F.row_number().over(order)).where(
            F.col("place") <= k + 1).select("query", "vec_id", "score"), "answers")
    asking = named.where("asks").select(F.col("vec_id").alias("query_id"), F.col("vector_class").alias("query"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return asking.join(answers, "query").where("query_id != vec_id").withColumn("rank", place).where(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
