"""Approximate nearest neighbours by a forest of random-projection trees.

1. *Trees.* A node splits space by a random direction at the median of a sample of the vectors. The
   sample is bounded (``sample`` rows, 8,192 by default), the trees are small and go to every
   task; every vector of the table is put into a leaf of every tree. For inner products, vectors get one
   more component that brings all to one length, so that a larger product is a smaller distance.
2. *Queue.* A query goes down all trees with one priority queue: the least distance to a splitting plane
   that was crossed on the way comes first, whatever the tree. It takes leaves until it has ``visit`` times
   as many as one tree has.
3. *Leaves.* Queries meet the vectors of their leaves; each leaf gives each query its best, scored on the
   original vectors in doubles, components added in order.
4. *Rerank.* The best of all leaves of a query, a vector once, by score and then by smaller id.

Equal vectors are one entry with their smallest ids (one more than are asked for, which is all that
can be in an answer), and equal queries are searched once, so a vector that many rows hold fills no
leaf. A leaf holds about ``leaf`` entries as long as the sample has 64 rows for each leaf; for longer
tables the sample must grow too, or leaves do. The supplied vectors are nearly random, so most of a tree's worth of
leaves is visited to find nine in ten of the neighbours; where vectors form clusters a smaller
``visit`` will do.

Rows: vectors that are null, empty or zero, or have null or non-finite components take no part, nor do null
ids. Vectors of another length than most are searched among their own. Repeated ids are separate
candidates; a query never finds its own id. Fewer candidates than asked for are all returned. Other columns may
have any name; empty tables give empty tables.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import Scratch
from pagemill.llm.vectors import matrix, usable


class Forest:
    """Trees over vectors of one length; nodes are numbered as in a heap."""

    def __init__(self, sample: np.ndarray, longest: float, trees: int, depth: int, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.longest, self.depth, self.trees = longest, depth, trees
        inner = 2**depth - 1
        x = self.lifted(sample)
        self.normals = rng.normal(size=(trees, inner, x.shape[1]))
        self.normals /= np.linalg.norm(self.normals, axis=2, keepdims=True)
        self.cuts = np.zeros((trees, inner))
        for t in range(trees):
            node = np.zeros(len(x), np.int64)
            for k in range(inner):
                own = np.flatnonzero(node == k)
                if len(own):
                    p = x[own] @ self.normals[t, k]
                    self.cuts[t, k] = np.median(p)
                    node[own] = 2 * k + 1 + (p > self.cuts[t, k])

    def lifted(self, m: np.ndarray) -> np.ndarray:
        m = m / self.longest
        rest = np.sqrt(np.maximum(0.0, 1 - (m * m).sum(axis=1, keepdims=True)))
        return np.hstack([m, rest])

    def leaves(self, m: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        x, out = self.lifted(m), np.empty((len(m), self.trees), np.int32)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + ((x * self.normals[t, node]).sum(axis=1) > self.cuts[t, node])
            out[:, t] = node - (2**self.depth - 1)
        return out

    def search(self, q: np.ndarray, visits: int) -> list[tuple[int, int]]:
        """(tree, leaf) in the order of the shared queue."""
        q = np.append(q / np.linalg.norm(q), 0.0)
        margins = (self.normals @ q - self.cuts).tolist()
        inner, found = 2**self.depth - 1, []
        queue = [(0.0, t, 0) for t in range(self.trees)]
        while queue and len(found) < visits:
            crossed, t, k = heapq.heappop(queue)
            while k < inner:
                m = margins[t][k]
                near, far = (2 * k + 2, 2 * k + 1) if m > 0 else (2 * k + 1, 2 * k + 2)
                heapq.heappush(queue, (max(crossed, abs(m)), t, far))
                k = near
            found.append((t, k - inner))
        return found


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, components added one after the other."""
    out = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for i in range(a.shape[-1]):
        out += a[..., i] * b[..., i]
    return out


def _entries(shared, visits: float | None):
    """Rows (dim, tree, leaf, id, v): where each vector lies, or with visits where each query looks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("v").value_lengths())
            for dim in np.unique(sizes):
                own = pa.array(np.flatnonzero(sizes == dim))
                forest = shared.value[int(dim)]
                ids, vectors = batch.column("id").take(own), batch.column("v").take(own)
                m = matrix(vectors)
                if visits is None:
                    leaf = forest.leaves(m)
                    row = np.repeat(np.arange(len(m)), forest.trees)
                    tree, leaf = np.tile(np.arange(forest.trees), len(m)), leaf.ravel()
                else:
                    most = int(np.ceil(visits * 2**forest.depth))
                    hits = [(i, *h) for i, q in enumerate(m) for h in forest.search(q, most)]
                    row, tree, leaf = np.array(hits).T
                for at in range(0, len(row), 8192):  # bounded batches: vectors are repeated for each tree
                    r = pa.array(row[at : at + 8192])
                    cols = [pa.array(np.full(len(r), dim, np.int32)), *(pa.array(x[at : at + 8192].astype(np.int32)) for x in (tree, leaf))]
                    yield pa.RecordBatch.from_arrays([*cols, ids.take(r), vectors.take(r)], ["dim", "tree", "leaf", "id", "v"])

    return run


def _best(k: int):
    def run(key: tuple[pa.Scalar, ...], queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not len(queries) or not len(vectors):
            return pa.table({"q": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64()))})
        q, v = matrix(queries.column("v")), matrix(vectors.column("v"))
        ids = vectors.column("id").to_numpy()
        by = np.argsort(ids, kind="stable")
        ids, v = ids[by], v[by]
        top_ids, top_scores = [], []
        for at in range(0, len(q), 256):
            rough = q[at : at + 256] @ v.T
            for i, row in enumerate(rough):
                few = np.arange(len(ids))
                if len(ids) > k:  # all that rounding could bring among the first k
                    edge = np.partition(row, len(ids) - k)[len(ids) - k]
                    few = np.flatnonzero(row >= edge - 1e-9 * max(1.0, abs(edge)))
                exact = products(q[at + i], v[few])
                order = np.lexsort((ids[few], -exact))[:k]
                top_ids.append(ids[few][order])
                top_scores.append(exact[order])
        return pa.table({"q": queries.column("id"), "ids": pa.array(top_ids, pa.list_(pa.int64())), "scores": pa.array(top_scores, pa.list_(pa.float64()))})

    return run


def search(
    df: DataFrame,
    is_query: Column,
    k: int = 20,
    key: str = "vec_id",
    vector: str = "embedding",
    trees: int = 16,
    leaf: int = 100,
    visit: float = 1.4,
    sample: int = 8192,
) -> DataFrame:
    """Rows (query_id, rank, <key>, score): the ``k`` largest inner products found for each query.

    ``is_query`` is a condition on the key.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "forest")
    rows = scratch.keep(usable(df, key, vector))
    # One more than k of the smallest ids of equal vectors; Spark cuts these lists before its shuffle too.
    ranked = rows.withColumn("n", F.row_number().over(W.partitionBy("v").orderBy("id"))).filter(F.col("n") <= k + 1)
    members = scratch.keep(ranked.withColumn("rep", F.min("id").over(W.partitionBy("v"))))
    classes = scratch.keep(members.filter("n = 1").select(F.col("id"), "v"))
    asked = rows.withColumnRenamed("id", key).filter(is_query).withColumnRenamed(key, "id")
    sought = asked.groupBy("v").agg(F.min("id").alias("q"), F.count("*").alias("n"))
    sought = scratch.keep(sought)

    forests: dict[int, Forest] = {}
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    for r in classes.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(length).alias("longest")).collect():
        own = classes.filter(F.size("v") == r.dim).orderBy(F.xxhash64("v"), "id").limit(sample)
        m = matrix(pa.Table.from_batches(own.select("v").toArrow().to_batches()).column("v")) if r.n else np.zeros((0, r.dim))
        depth = max(0, int(np.log2(max(1, min(r.n / leaf, len(m) / 64)))))
        forests[r.dim] = Forest(m, r.longest, trees, depth)
    shared = spark.sparkContext.broadcast(forests)
    kind = "dim int, tree int, leaf int, id long, v array<double>"
    lists = classes.mapInArrow(_entries(shared, None), kind)
    looks = sought.select(F.col("q").alias("id"), "v").mapInArrow(_entries(shared, visit), kind)
    where = ("dim", "tree", "leaf")
    best = looks.groupBy(*where).cogroup(lists.groupBy(*where)).applyInArrow(_best(k + 1), "q long, ids array<long>, scores array<double>")
    best = best.select("q", F.inline(F.arrays_zip(F.col("ids").alias("rep"), F.col("scores").alias("score")))).distinct()
    near = W.partitionBy("q").orderBy(F.desc("score"), "rep")
    best = scratch.keep(best.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1).drop("r"))
    # Each class stands for its members; then every query leaves itself out.
    best = best.join(members.select("rep", "id"), "rep")
    near = W.partitionBy("q").orderBy(F.desc("score"), "id")
    best = best.withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1)
    best = best.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("found"))  # k + 1 at most
    same = asked.select("id", F.col("v").alias("w")).join(sought.select("q", F.col("v").alias("w")), "w").select("id", "q").distinct()
    out = same.join(best, "q")
    out = out.select(F.col("id").alias("query_id"), F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k).alias("found"))
    out = out.select("query_id", F.posexplode("found").alias("p", "f"))
    return out.select("query_id", (F.col("p") + 1).alias("rank"), F.col("f.id").alias(key), F.col("f.score").alias("score"))
