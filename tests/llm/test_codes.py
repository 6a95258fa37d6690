"""Trees against plain k-means over all points; the query against its SQL is in test_llm_oracles."""

import numpy as np
import pytest

from pagemill.llm import codes


def plain(x, start, rounds):
    book = start.copy()
    nearest = lambda b: ((x[:, None] - b) ** 2).sum(axis=2)
    for _ in range(rounds):
        own = nearest(book).argmin(axis=1)
        for e in range(len(book)):
            if (own == e).any():
                book[e] = x[own == e].sum(axis=0) // (own == e).sum()
    d = nearest(book)
    return book, d.argmin(axis=1), d.min(axis=1)


def points(kind, n, rng):
    if kind == "grid":  # ties everywhere
        return rng.integers(-2, 3, (n, 3))
    if kind == "equal":
        return np.vstack([np.full((n - 5, 3), 7), rng.integers(0, 9, (5, 3))])
    if kind == "groups":
        return (rng.normal(size=(9, 8))[rng.integers(0, 9, n)] * 900 + rng.normal(size=(n, 8)) * 30).astype(np.int64)
    if kind == "huge":
        return rng.integers(-(2**28), 2**28, (n, 8))
    return rng.integers(-4096, 4096, (n, 8))


@pytest.mark.parametrize("kind", ["grid", "equal", "groups", "even", "huge"])
def test_trees_give_what_comparing_everything_gives(kind):
    rng = np.random.default_rng(4)
    for n in (1, 20, 700, 3000):
        x = points(kind, max(n, 6), rng).astype(np.int64)
        tree = codes.Tree.grow(x)
        assert sorted(tree.order) == list(range(len(x)))
        assert (tree.points == x[tree.order]).all() and tree.start[0] == 0 and tree.end[0] == len(x)
        inner = np.flatnonzero(tree.left >= 0)
        assert (tree.total[inner] == tree.total[tree.left[inner]] + tree.total[tree.right[inner]]).all()
        entries = x[rng.integers(0, len(x), 16)]
        d = ((x[:, None] - entries) ** 2).sum(axis=2)
        code, error = tree.assigned(entries)
        assert (code == d.argmin(axis=1)).all() and (error == d.min(axis=1)).all()
        total, count = tree.sums(entries)
        for e in range(16):
            assert count[e] == (code == e).sum() and (total[e] == x[code == e].sum(axis=0)).all()


def test_lists_shrink():
    x = points("groups", 6000, np.random.default_rng(1)).astype(np.int64)
    tree = codes.Tree.grow(x)
    balls, _, single, _ = tree.owned(x[:9])
    assert len(single) < len(x) / 2 and len(balls) < len(x) / 10


def brute(rows, rounds=6):
    """By length: {id: (code, error)} and the codebooks."""
    out, books = {}, {}
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for n in {len(v) for _, v in good}:
        own = sorted((r for r in good if len(r[1]) == n), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        x = np.floor(np.array([v for _, v in own]).reshape(len(own), n) * 4096).astype(np.int64)
        cut, code, error = codes.bounds(n, 8), [], 0
        books[n] = []
        for a, b in zip(cut, cut[1:]):
            book, c, e = plain(x[:, a:b], x[:16, a:b], rounds)
            books[n].append(book)
            code.append(c)
            error = error + e
        for j, (i, v) in enumerate(own):
            out[i, tuple(v)] = ("".join(f"{c[j]:02x}" for c in code), int(error[j]))
    return out, books


def compressed(spark, rows):
    df = spark.createDataFrame([(i, v, "z", 1) for i, v in rows], "vec_id long, embedding array<double>, code string, length int")
    out, books = codes.compress(df, carry=["embedding"])
    return [(r.r.key, tuple(r.r.c0), r.code, r.error) for r in out.collect()], books


def test_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(8)
    vec = lambda n: rng.normal(size=n).round(3).tolist()
    rows = [(i, vec(24)) for i in range(500, 0, -1)]
    rows += [(1000 + i, vec(10)) for i in range(5)] + [(2000 + i, vec(3)) for i in range(40)] + [(3000, []), (3001, [])]
    rows += [(7000 + i, rows[0][1]) for i in range(30)] + [(None, vec(24)), (9, vec(24)), (9, rows[3][1])]
    bad = [(1, None), (2, [None] * 24), (3, [float("nan")] * 24), (4, [float("inf")] * 24)]
    want, books = brute(rows)
    monkeypatch.setattr(codes, "_BLOCK", 64)
    got, found = compressed(spark, rows + bad)
    assert len(got) == len(rows)
    assert all(want[i, v] == (code, error) for i, v, code, error in got)
    assert found.keys() == books.keys()
    assert all((a == b).all() for n in books for a, b in zip(books[n], found[n]))


def test_label_errors_and_empty(spark):
    df = spark.createDataFrame([(1, 5, [1.0] * 8), (2, 5, [0.0] * 8), (3, None, [0.5] * 8), (4, None, None)], "vec_id long, label int, embedding array<float>")
    out, books = codes.compress(df, carry=["label"], entries=2)
    got = {r.r.key: (r.error, r.label_error) for r in codes.label_errors(codes.with_books(out, books), out["r.c0"]).collect()}
    assert set(got) == {1, 2, 3} and got[1][1] == got[1][0] + got[2][0] == got[2][1] and got[3][0] == got[3][1] > 0
    out, books = codes.compress(df.limit(0))
    assert books == {} and codes.label_errors(codes.with_books(out, books), out["r.key"]).count() == 0


def test_far_components_are_held(spark):
    got, _ = compressed(spark, [(1, [1e300] * 8), (2, [-1e300] * 8), (3, [0.0] * 8)])
    assert len(got) == 3 and all(e == 0 for *_, e in got)
