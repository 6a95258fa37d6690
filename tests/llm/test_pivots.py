"""Links of vectors against brute force."""

import os

import numpy as np
import pytest

from pagemill.llm import pivots, queries

SF = "/root/testdata/check_s"


def brute(rows, threshold=0.9):
    ok = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u = {k: v / np.linalg.norm(v) for k, (_, v) in enumerate(ok)}
    links = {k: [m for m in u if m != k and len(u[k]) == len(u[m]) and u[k] @ u[m] >= threshold] for k in u}
    return {ok[k][0]: len(m) for k, m in links.items()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no supplied tables")
def test_recall_and_precision(spark):
    df = queries.table(spark, SF, "embeddings")
    told = df.orderBy("vec_id").collect()
    u = pivots.unit(np.array([r.embedding for r in told], float))
    truth = {r.vec_id: int(n) - 1 for r, n in zip(told, (u @ u.T >= 0.9).sum(axis=1), strict=True)}
    rows = {r.vec_id: r for r in pivots.linked(df).collect()}
    assert len(rows) == df.count()
    found, wanted = sum(r.n_links for r in rows.values()), sum(truth.values())
    print("recall", found / wanted)
    assert all(r.n_links <= truth[i] for i, r in rows.items())
    assert found >= 0.95 * wanted > 0
    assert all(r.kept == (r.vec_id == r.component_id) and r.component_id <= r.vec_id for r in rows.values())


@pytest.mark.parametrize("block", [16, 2048])
def test_groups_and_blocks(spark, block):
    rng = np.random.default_rng(4)
    rows, base = [], rng.normal(size=(6, 16))
    for i in range(300):
        rows.append((i, (base[i % 6] + rng.normal(size=16) * (0.05 if i % 3 else 0)).tolist()))
    rows += [(1000 + i, rng.normal(size=16).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in pivots.linked(df, block=block).collect()}
    truth = brute(rows)
    assert sum(got.values()) >= 0.99 * sum(truth.values()) and all(got[i] <= truth[i] for i in got)


def dense_group(n, d=64, seed=7):
    """A third of the rows are near copies of one vector, a tenth near copies of one other row each."""
    rng = np.random.default_rng(seed)
    v = pivots.unit(rng.normal(size=(n, d)))
    g, h = n // 3, n // 10
    v[:g] = v[0] + pivots.unit(rng.normal(size=(g, d))) * rng.uniform(0.14, 0.31, size=(g, 1))
    v[-h:] = v[g : g + h] + pivots.unit(rng.normal(size=(h, d))) * 0.35
    return pivots.unit(v)[rng.permutation(n)]


def recall_in_dense_group(spark, n):
    v = dense_group(n)
    truth = np.concatenate([(v[i : i + 1000] @ v.T >= 0.9).sum(axis=1) - 1 for i in range(0, n, 1000)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in pivots.linked(df).collect()}
    assert all(got[i] <= truth[i] for i in got)
    return sum(got.values()) / truth.sum()


def test_near_copies_that_hold_a_third_of_the_rows(spark):
    assert recall_in_dense_group(spark, 3000) >= 0.99


def test_few_pivots_are_left_of_one_group(spark):
    v = pivots.unit(np.ones((60, 8)) + np.random.default_rng(1).normal(size=(60, 8)) * 0.05)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    assert {(r.n_links, r.component_id) for r in pivots.linked(df).collect()} == {(59, 0)}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1),
        (8, [inf, 1.0], 1), (9, [None, 1.0], 1), (10, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [-1.0, 0.0], 1),
        (13, [1e200, 1e199], 1), (14, [3.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, near int")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in pivots.linked(df).collect())
    near = [(1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False)]
    alone = [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 12)] + [(14, 0, 14, True)]
    assert got == sorted([(0, 0, 0, None), *near, *alone, (13, 3, 1, False)])
    assert pivots.linked(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (1, None)], "vec_id long, embedding array<double>")
    assert sorted(map(tuple, pivots.linked(twice).collect())) == [(1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True)]
