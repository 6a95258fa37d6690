"""Links and components against brute force."""

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from pagemill.llm import jaccard, queries
from pagemill.llm.common import Scratch
from pagemill.llm.shingles import shingles

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows):
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return sorted((i, len(sets[i]), root(i)) for i in ids)


def got(df):
    return sorted(map(tuple, jaccard.linked(df).collect()))


def test_supplied_documents(spark):
    df = queries.table(spark, SF, "documents")
    assert got(df) == brute([(r.doc_id, r.text) for r in df.collect()])


@pytest.fixture(scope="module")
def groups():
    """Near copies in lists long enough for stars, drifting chains and documents at the border."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(60)]
    rows = []
    for _ in range(320):  # one word changed
        w = list(base)
        w[rng.randrange(60)] = word()
        rows.append(" ".join(w))
    for k in range(60):  # the beginning kept, the rest more and more different: some link, some don't
        rows.append(" ".join(base[:40] + [word() for _ in range(k % 20)] + base[50 + k % 10 :]))
    passage = [word() for _ in range(30)]
    for k in range(120):  # a passage that many share, some with little else
        rows.append(" ".join(passage + [word() for _ in range(k % 30)]))
    chain = [word() for _ in range(40)]
    for _ in range(60):
        rows.append(" ".join(chain))
        chain = chain[1:] + [word()]
    rows += ["a b c", "A B  C", "a b c d", "", None, "   \n", "é É", "x " * 4000]
    return list(enumerate(rows, 10))


def test_long_lists(spark, groups):
    batch = pa.RecordBatch.from_pydict({"text": [t for _, t in groups]})
    dealt = pa.Table.from_batches(jaccard._deal_prefixes(np.zeros(jaccard._CELLS, np.uint32), 8)([batch]))
    members = dealt.filter(pc.is_valid(dealt["g"]))
    several = members.group_by("g").aggregate([("sig", "count"), ("n", "min"), ("n", "max")])
    assert max(several["sig_count"].to_pylist()) > 20 and several["n_min"] == several["n_max"]
    df = spark.createDataFrame([(i, t, 1, "k") for i, t in groups], "doc_id long, text string, n int, sig string")
    assert got(df) == brute(groups)


def test_bits_never_lose_a_link():
    rng = np.random.default_rng(3)
    for _ in range(300):
        common, x, y = (np.unique(rng.integers(0, 2**63, rng.integers(0, 900), dtype=np.uint64)) for _ in range(3))
        x, y = np.union1d(common, x), np.union1d(common, y)
        both = len(np.intersect1d(x, y))
        bits = [jaccard._bits(z) for z in (x, y)]
        short = [b.reshape(jaccard._BITS // jaccard._FOLDED, -1) for b in bits]
        for p, q in (bits, [np.bitwise_or.reduce(b, axis=0) for b in short]):
            assert jaccard._most(len(x), len(y), int(np.bitwise_count(p ^ q).sum())) >= both


def test_lists_of_groups_are_one_list():
    members = pa.table({"g": [1, 2, 3], "rep": [10, 20, 30], "n": [4, 4, 4], "component": [10, 20, 20], "bits": [b"\0" * 512] * 3})
    one = pa.table({"token": pa.array([1, 1, 1], pa.int64()), "g": pa.array([1, 2, 3], pa.int64()), "data": pa.nulls(3, pa.binary())})
    assert jaccard._between(None)(None, one, members).to_pydict() == {"a": [10, 10], "b": [20, 30]}
    two = one.set_column(0, "token", pa.array([1, 2, 2], pa.int64()))
    assert len(jaccard._between(None)(None, two, members)) == 0


def test_exactly_at_the_threshold(spark):
    w = [f"w{i}" for i in range(104)]
    a, b, c = w[:100], w[:79], w[:76]  # 96 shingles; 75 and 72 of them: 78.1 and 75 in 100
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(w[:75]))]
    assert [len(shingles(t)) for _, t in rows] == [96, 75, 72, 71]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)


def test_stars_join_everything():
    for m in (2, 33, 257, 5000):
        docs = np.arange(m) * 7
        a, b = jaccard._stars(docs, docs % 5)
        assert len(a) == m - 1
        near = {}
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            near.setdefault(x, []).append(y)
            near.setdefault(y, []).append(x)
        assert max(map(len, near.values())) < 3 * 512 or m < 600
        todo, seen = [int(a[0])], {int(a[0])}
        while todo:
            for y in near[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        assert len(seen) == m


def test_repeated_ids_nulls_and_empty_tables(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, a), (7, a), (7, b), (9, b), (None, a), (None, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0) for r in jaccard.linked(df).collect())
    assert out == [(0, 0, 0), (0, 26, 0), (3, 0, 3), (5, 26, 5), (5, 26, 5), (7, 26, 5), (7, 26, 5), (9, 26, 5)]
    kept = sorted((r.doc_id or 0, r.text or "") for r in jaccard.one_of_each(df).collect())
    assert kept == [(0, ""), (0, a), (3, ""), (5, a)]
    assert jaccard.linked(df.limit(0)).count() == 0 and jaccard.one_of_each(df.limit(0)).count() == 0


def test_fixed_size_tables_come_in_one_job(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x y")], "doc_id long, text string")

    def one_job_for_each_partition(*_, **__):
        raise AssertionError("an iterator takes a job for each partition")

    monkeypatch.setattr(type(docs), "toLocalIterator", one_job_for_each_partition)
    assert sorted((r.doc_id, r.component_id) for r in jaccard.linked(docs).collect()) == [(1, 1), (2, 1), (3, 3)]


def test_remembered_words_are_few():
    from pagemill.llm import shingles as module

    module._words.clear()
    text = " ".join(f"word{i}" for i in range(120_000))
    whole = shingles(text)
    assert len(whole) == 120_000 - 4 and len(module._words) <= 50_000
    assert (shingles(text) == whole).all()
    module._words.clear()


def test_rows_that_a_join_drops_are_left_out_before_it(spark):
    rows = spark.range(20_000).selectExpr("id % 10000 AS rep", "id AS n")
    got = jaccard._among(rows, "rep", spark.range(0, 1000).selectExpr("id * 7 AS rep"), Scratch(spark, "test"))
    assert got.dtypes == rows.dtypes
    found = [tuple(r) for r in got.collect()]
    assert {r for r in found if r[0] % 7 == 0 and r[0] < 7000} == {(i % 10000, i) for i in range(20_000) if i % 10000 % 7 == 0 and i % 10000 < 7000}
    assert len(found) < 6000  # of 20,000; 2,000 have a partner


def test_what_is_sent_is_short(groups):
    texts = [t for _, t in groups if t and len(t) > 300]
    dealt = pa.Table.from_batches(jaccard._deal_prefixes(np.zeros(jaccard._CELLS, np.uint32), 8)([pa.RecordBatch.from_pydict({"text": texts})]))
    members = dealt.filter(pc.is_valid(dealt["g"]))
    assert len(members) and members["data"].null_count == len(members)  # bits stay where they are
    packed = dealt.filter(pc.is_null(dealt["g"]))["data"].to_pylist()
    prefixes = {(len(x := shingles(t)), np.sort(x)[: jaccard._prefix(len(x))].tobytes()) for t in texts}
    assert sum(map(len, packed)) == 20 * sum(len(p) // 8 for _, p in prefixes)

    class Full:
        value = np.full(8, 255, np.uint8)

    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts, "place": [i % 64 for i in range(len(texts))]})
    (sent,) = jaccard._texts(Full)([batch])
    sets = [shingles(t) for t in texts]
    assert all((jaccard._set(x) == y).all() for x, y in zip(sent["x"].to_pylist(), sets, strict=True))
    assert sum(map(len, sent["x"].to_pylist())) < 0.7 * sum(8 * len(y) for y in sets)


def test_bits_of_different_lengths_never_lose_a_link():
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(200):
        common, x, y = (np.unique(rng.integers(0, 2**63, rng.integers(1, 1500), dtype=np.uint64)) for _ in range(3))
        sets.append((np.union1d(common, x), np.union1d(common, y)))
    at = np.arange(len(sets))
    for each in (1, 2):
        sides = []
        for k in (0, 1):
            rows = pa.RecordBatch.from_pydict({"n": [len(s[k]) for s in sets], "bits": [jaccard._bits(s[k]).tobytes() for s in sets]})
            sides.append(jaccard._Bits(jaccard._short(each)(rows)["bits"].to_pylist()))
        assert len(set(sides[0].size.tolist())) > 2 and (sides[0].size != sides[1].size).any()
        differ = jaccard._differ(sides[0], at, sides[1], at)
        for (x, y), d in zip(sets, differ.tolist(), strict=True):
            assert jaccard._most(len(x), len(y), d) >= len(np.intersect1d(x, y))


def test_of_shingles_that_look_the_same_the_first_position_counts():
    token, g, n, pos = np.array([9, 9, 9]), np.array([1, 1, 2]), np.full(3, 100), np.array([20, 0, 0])
    for order in ([0, 1, 2], [1, 0, 2]):
        data = jaccard._pack(*(c[order] for c in (token, g, n, pos)), np.zeros(3, np.uint16))
        batch = pa.RecordBatch.from_arrays([pa.array([0]), pa.array([data], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64())], schema=jaccard._DEALT)
        found = [r for b in jaccard._first_round((pa.scalar(0),), [batch]) for r in b.to_pylist() if r["kind"] == 0]
        assert [(r["a"], r["b"]) for r in found] == [(1, 2)]


def near_misses(m):
    """Documents with most of a text in common; hardly any two of them link."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(m):
        w = list(base)
        for k in rng.sample(range(120), 3):
            w[k] = f"x{i}y{k}"
        rows.append((i + 1, " ".join(w)))
    return rows


def test_near_copies_that_do_not_link_cost_no_rows(spark, monkeypatch):
    rows, keep, written = near_misses(240), Scratch.keep, []

    def counted(self, df, *by):
        out = keep(self, df, *by)
        if out.columns == ["a", "b"]:  # pairs of documents or groups
            written.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
    assert max(written) < 8 * len(rows), written


def test_links_of_a_cell_are_fewer_than_its_members():
    m = 50
    members = pa.table({"g": range(m), "rep": range(m), "n": [9] * m, "component": range(m), "bits": [b"\0" * 512] * m})
    one = pa.table({"token": pa.array([1] * m, pa.int64()), "g": pa.array(range(m), pa.int64()), "data": pa.nulls(m, pa.binary())})
    assert len(jaccard._between(lambda i, j: True)(None, one, members)) == m - 1
    assert len(jaccard._between(lambda i, j: (i - j) % 2 == 0)(None, one, members)) == m - 2
    assert len(jaccard._between(lambda i, j: False)(None, one, members)) == 0


def test_parts_of_a_large_group_meet(spark, monkeypatch, groups):
    rows = [(i, t) for i, t in groups if t and t.strip()]
    ids = spark.createDataFrame(rows + rows[:9] + [(rows[0][0], rows[-3][1])], "id long, text string")
    names = spark.createDataFrame([(i,) for i, _ in rows], "rep long").selectExpr("1L AS main", "rep", "rep AS component", "array(X'01000000', X'0100000002000000') AS lists")
    sets = [(i, shingles(t)) for i, t in map(tuple, ids.collect())]
    bits = spark.createDataFrame([(i, len(x), jaccard._bits(x).tobytes()) for i, x in sets], "id long, n long, bits binary")
    for size in (512, 8):
        monkeypatch.setattr(jaccard, "_PART", size)
        links = {tuple(r) for r in jaccard._joined(ids, bits, names, Scratch(spark, "test")).collect()}
        parent = {i: i for i, _ in rows}

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in links:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
        again = {(rows[0][0], rows[-3][0])}  # an id with two texts links to what either links to
        want = {i: c for i, _, c in brute(rows)}
        assert again <= links and all(root(i) == root(want[i]) for i in parent)
        assert len({root(i) for i in parent}) == len({c for c in want.values()}) - 1


def test_sets_that_do_not_fit_are_made_again(monkeypatch):
    import zlib

    monkeypatch.setattr(jaccard, "_HELD", 30)
    texts = [" ".join(f"w{k + i}" for k in range(20)) for i in range(5)]
    sets = jaccard._Sets([zlib.compress(t.encode()) for t in texts])
    for _ in range(2):
        assert all((sets[i] == shingles(t)).all() for i, t in enumerate(texts))
    assert len(sets._known) == 1


def test_pipeline_stage_keeps_one_of_each_without_all_pairs(spark, monkeypatch):
    import corpus_pipeline

    rows, keep, written = near_misses(200), Scratch.keep, []

    def counted(self, df, *by):
        out = keep(self, df, *by)
        if out.columns == ["a", "b"]:  # pairs of documents or groups
            written.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect())
    assert kept == [i for i, _, c in brute(rows) if i == c]
    assert max(written) < 8 * len(rows), written
