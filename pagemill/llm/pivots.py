"""Near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are a bounded sample of the vectors, thinned so that no two are ``close``: a group
of near copies would otherwise have pivots enough of its own, and their order is noise. A vector is described by its
``near`` nearest pivots in order; similar vectors have similar orders. Inverted lists are kept for
pairs of pivots: a list holds the vectors that have both among their nearest, so whatever meets in a list
shares two pivots at least. Within a list the shared pivots of two vectors are counted; those with
``shared`` or more have their cosine worked out in doubles and are linked at the threshold. A pair is
treated in the list of its two smallest shared pivots alone, so links are counted once.

Equal vectors are one class and are never expanded into pairs. Lists longer than ``block`` are dealt out as
pairs of blocks, each a task's work of its own. The result of a list is linear in its length: numbers of links
and a spanning forest of the links found.

Lists grow with the number of vectors per pivot, so the number of pivots grows with the square root of
the table up to ``max_pivots`` (4,096 by default). Links below the threshold are never given; a pair
with few shared pivots can be missed (recall on the supplied tables: see the README).

Rows: vectors that are null, empty or zero, or have null or non-finite components, link with nothing and
are their own component. Vectors of different lengths link with nothing of another length. Repeated ids are separate
vectors for the counts and one node for components. A null id gives a row without links or
component. Other columns may have any name; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Scratch, components, hot_join
from pagemill.llm.vectors import matrix, usable


def unit(m: np.ndarray) -> np.ndarray:
    # Scaling by the largest component first keeps squares from overflowing.
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def nearest(m: np.ndarray, pivots: np.ndarray, near: int) -> np.ndarray:
    """Numbers of the nearest pivots of each row, nearest first, ties to the smaller number."""
    sims = np.round(unit(m) @ pivots.T, 12)
    near = min(near, len(pivots))
    top = np.argsort(-sims, axis=1, kind="stable")[:, :near]
    return top.astype(np.int32)


def thinned(m: np.ndarray, near: int, close: float) -> np.ndarray:
    """Rows of which no two have a cosine above ``close``, the first ones kept; ``near`` rows at least, if there are as many."""
    kept = np.empty_like(m)
    chosen, dropped = [], []
    for i, row in enumerate(m):
        if len(chosen) and (kept[: len(chosen)] @ row).max() > close:
            dropped.append(i)
        else:
            kept[len(chosen)] = row
            chosen.append(i)
    return m[sorted(chosen + dropped[: max(0, near - len(chosen))])]


def _describe(shared, near: int):
    """Rows (id, v, weight, dim, pivots): the permutation of each vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            sizes = np.asarray(lists.value_lengths())
            perms: list = [[] for _ in sizes]
            for dim, pivots in shared.value.items():
                own = np.flatnonzero(sizes == dim)
                if len(own):
                    tops = nearest(matrix(lists.take(pa.array(own))), pivots, near)
                    for i, t in zip(own, tops, strict=True):
                        perms[i] = t
            cols = [*batch.select(["id", "v", "weight"]).columns, pa.array(sizes, pa.int32()), pa.array(perms, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "v", "weight", "dim", "near"])

    return run


def _keys(near: int) -> str:
    """SQL for the pairs of a vector's pivots, smaller number first."""
    return (
        "flatten(transform(sequence(0, size(s) - 2), i -> transform(slice(s, i + 2, size(s)), y ->"
        " struct(s[i] AS p, y AS q))))"
    )


def _link(threshold: float, shared: int):
    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q, same = key[1].as_py(), key[2].as_py(), key[3].as_py() == key[4].as_py()
        t = pa.Table.from_batches(list(batches))
        ids, w = t.column("id").to_numpy(), t.column("weight").to_numpy()
        side = t.column("block").to_numpy() == key[3].as_py()
        u, perms = unit(matrix(t.column("v"))), matrix(t.column("near"))
        left = np.arange(len(ids)) if same else np.flatnonzero(side)
        right = left if same else np.flatnonzero(~side)
        names, inverse = np.unique(perms, return_inverse=True)
        one_hot = np.zeros((len(ids), len(names)), np.float32)
        one_hot[np.arange(len(ids))[:, None], inverse.reshape(perms.shape)] = 1
        before = one_hot[:, (names < q) & (names != p)]  # a shared one of these: another list's pair
        # Two that share the commonest of these are never met here, so those that hold it come last and meet the others only.
        late = before[:, before.sum(axis=0).argmax()] > 0 if before.shape[1] else np.zeros(len(ids), bool)
        left, right = (x[np.argsort(late[x], kind="stable")] for x in (left, right))
        rest = right[: len(right) - late[right].sum()]
        n, weights = np.zeros(len(ids)), w.astype(float)
        edges: list[np.ndarray] = []
        group = np.arange(len(ids))  # smallest place of the rows linked so far
        for at in range(0, len(left), 512):
            rows = left[at : at + 512]
            if late[rows[0]]:
                against = right[:0] if same else rest
            else:
                against = right[at:] if same else right
            if not len(against):
                continue
            dots = u[rows] @ u[against].T
            ok = dots >= threshold - 1e-9
            i, j = np.nonzero(ok & (dots < threshold + 1e-9))
            ok[i, j] = np.einsum("ij,ij->i", u[rows[i]], u[against[j]]) >= threshold
            ok &= one_hot[rows] @ one_hot[against].T >= shared
            ok &= before[rows] @ before[against].T == 0
            ok &= ids[rows][:, None] != ids[against]
            if same:
                ok &= np.arange(len(rows))[:, None] < np.arange(len(against))
            met = ok.astype(float)
            n[rows] += met @ weights[against]
            n[against] += weights[rows] @ met
            while True:  # one link from each group to a smaller one, until none is left
                i, j = np.nonzero(ok & (group[rows][:, None] != group[against]))
                if not len(i):
                    break
                x, y = rows[i], against[j]
                high, low = np.maximum(group[x], group[y]), np.minimum(group[x], group[y])
                high, first = np.unique(high, return_index=True)
                edges.append(np.stack((x[first], y[first])))
                to = np.arange(len(ids))
                to[high] = low[first]
                while (to != to[to]).any():
                    to = to[to]
                group = to[group]
        n = np.rint(n).astype(np.int64)
        got = np.flatnonzero(n)
        a, b = np.concatenate(edges, axis=1) if edges else np.zeros((2, 0), np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((ids[got], ids[a]))), pa.array(np.concatenate((n[got], np.zeros(len(a), np.int64)))),
             pa.array(np.concatenate((ids[got], ids[b])))],
            ["a", "n", "b"],
        )

    return run


def linked(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    threshold: float = 0.9,
    near: int = 8,
    shared: int = 2,
    max_pivots: int = 4096,
    block: int = 2048,
    close: float = 0.7,
) -> DataFrame:
    """One row per vector: key, n_links, component_id and kept (it is the smallest id of its component)."""
    spark = df.sparkSession
    scratch = Scratch(spark, "pivots")
    rows = scratch.keep(usable(df, key, vector))
    everything = df.select(F.col(key).cast("long").alias("id"))
    # Equal vectors: the class is known by its smallest id.
    classes = rows.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("weight"))
    classes = scratch.keep(classes.select(F.col("rep").alias("id"), "v", "weight"))
    n = classes.count()
    wanted = int(min(max_pivots, max(near, 4 * n**0.5)))
    # The smallest hashes are a sample; it is bounded by max_pivots for each length of vectors.
    sample = classes.withColumn("dim", F.size("v")).orderBy(F.xxhash64("v"), "id").limit(wanted).collect()
    pivots: dict[int, np.ndarray] = {}
    for dim in sorted({r.dim for r in sample}):
        pivots[dim] = thinned(unit(np.array([r.v for r in sample if r.dim == dim])), near, close)
    for dim in [r.dim for r in classes.select(F.size("v").alias("dim")).distinct().collect() if r.dim not in pivots]:
        few = classes.filter(F.size("v") == dim).orderBy(F.xxhash64("v"), "id").limit(near).collect()
        pivots[dim] = unit(np.array([r.v for r in few]))
    told = classes.mapInArrow(
        _describe(spark.sparkContext.broadcast(pivots), near), "id long, v array<double>, weight long, dim int, near array<int>"
    )
    told = scratch.keep(told)
    # Vectors of a length with one pivot alone have no pair of pivots and nothing to link with.
    entries = told.select("id", "dim", F.sort_array("near").alias("s")).filter("size(s) > 1")
    entries = scratch.keep(entries.select("id", "dim", F.inline(F.expr(_keys(near)))))
    sizes = entries.groupBy("dim", "p", "q").agg(F.count("*").alias("m")).filter("m > 1")
    sizes = scratch.keep(sizes.withColumn("k", F.struct("dim", "p", "q")).select("k", "m"))
    entries = entries.withColumn("k", F.struct("dim", "p", "q")).select("id", "k")
    cut = hot_join(entries, sizes.withColumn("blocks", F.ceil(F.col("m") / block).cast("int")), "k", "m")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    cut = cut.select("id", "k", "block", other.alias("other"))
    cut = cut.select("id", "k.*", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    work = cut.join(told.select("id", "v", "weight", "near"), "id")
    found = work.groupBy("dim", "p", "q", "i", "j").applyInArrow(_link(threshold, shared), "a long, n long, b long")
    found = scratch.keep(found)
    counts = found.filter("n > 0").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    comps = scratch.keep(components(found.filter("a <> b").select("a", "b"), scratch))
    result = classes.join(counts, "id", "left").join(comps.withColumnRenamed("node", "id"), "id", "left")
    result = result.select(
        "v", "weight", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    own = hot_join(rows, result, "v", "weight").select("id", "n_links", "component_id")
    # Rows without a usable vector; an id may be on both sides when it is repeated.
    bad = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("e"))
    good = usable(df, key, vector).groupBy("id").agg(F.count("*").alias("good"))
    bad = bad.groupBy("id").agg(F.count("*").alias("all")).join(good, "id", "left")
    bad = bad.filter(F.col("all") > F.coalesce("good", F.lit(0)))
    bad = bad.select("id", F.explode(F.sequence(F.lit(1), (F.col("all") - F.coalesce("good", F.lit(0))).cast("int"))).alias("_"))
    bad = bad.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = own.unionByName(bad)
    return out.select(F.col("id").alias(key), "n_links", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))

