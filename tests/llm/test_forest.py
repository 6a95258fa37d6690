"""Neighbours against brute force."""

import numpy as np
from pyspark.sql import functions as F

from pagemill.llm import forest, queries

SF = "/root/testdata/sf0.1"


def brute(rows, k, step):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in ok:
        if i % step == 0:
            scores = [(-float(forest.products(q, v)), j) for j, v in ok if j != i and len(v) == len(q)]
            out[i] = [(j, -s) for s, j in sorted(scores)[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        got = out.setdefault(r.query_id, [])
        assert r["rank"] == len(got) + 1
        got.append((r.vec_id, r.score))
    return out


def test_recall(spark):
    df = queries.table(spark, SF, "embeddings")
    truth = brute([(r.vec_id, r.embedding) for r in df.collect()], 20, 20)
    got = answers(queries.op10_nearest_neighbours(spark, SF))
    assert got.keys() == truth.keys() and all(len(v) == 20 for v in got.values())
    exact = {(i, j): s for i, v in truth.items() for j, s in v}
    hits = [(i, j, s) for i, v in got.items() for j, s in v if (i, j) in exact]
    print("recall", len(hits) / len(exact))
    assert len(hits) >= 0.9 * len(exact) and all(s == exact[i, j] for i, j, s in hits)
    for v in got.values():
        assert v == sorted(v, key=lambda x: (-x[1], x[0]))


def test_equal_vectors_ties_and_few_candidates(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [1.0, 2.0]) for i in range(0, 60)] + [(100 + i, rng.normal(size=2).tolist()) for i in range(5)]
    rows += [(200, [3.0, 0.0, 0.0]), (201, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, q int")
    got = answers(forest.search(df, F.col("vec_id") % 20 == 0, k=7))
    assert got == brute(rows, 7, 20)
    few = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 5.0])], "vec_id long, embedding array<double>")
    assert answers(forest.search(few, F.col("vec_id") % 20 == 0)) == {20: [(21, 0.5)]}


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (20, []), (40, [0.0, 0.0]), (60, [nan, 1.0]), (80, [inf, 1.0]), (None, [1.0, 1.0]), (100, [1.0, 0.0]), (1, [None, 2.0]), (2, [-1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert answers(forest.search(df, F.col("vec_id") % 20 == 0)) == {100: [(2, -1.0)]}
    assert forest.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
