"""The mix against targets worked out in Python, and the tree's draws against theory."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pagemill.llm import mixing, queries

SF = "/root/testdata/sf0.001"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def wanted(sizes, weights=(5, 2, 1), budget=1.5, repeat=2):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = budget * sum(sizes.values()), set()
    while True:
        rest = total - sum(repeat * sizes[s] for s in capped)
        free = sum(w[s] for s in names if s not in capped)
        out = {s: repeat * sizes[s] if s in capped else rest * w[s] / free for s in names}
        over = {s for s in names if out[s] > repeat * sizes[s]}
        if not over - capped:
            return out
        capped |= over


def check(docs, documents, segments):
    rows = mixing.taken(documents, segments).collect()
    sizes, source = Counter(), {d.doc_id: d.source for d in docs}
    for d in docs:
        sizes[d.source] += words(d.text)
    goal, got = wanted(sizes), Counter()
    assert len(rows) == len(docs)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(goal[s])
        assert 0 <= r.taken <= 2 * r["size"]
        got[s] += r.taken
    for s in sizes:
        assert abs(got[s] - goal[s]) <= 1
    return rows


def test_supplied_documents(spark):
    df = queries.table(spark, SF, "documents")
    docs = df.collect()
    documents, segments = mixing.mix(df, block_words=64, shard_words=4000)
    rows = check(docs, documents, segments)
    seg = segments.collect()
    assert len({s.shard for s in seg}) > 8
    places = defaultdict(list)
    per_shard = Counter()
    for s in seg:
        places[s.shard].append(s.place)
        per_shard[s.shard] += s.words
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
    assert len({(s.doc_id, s["pass"]) for s in seg}) == len(seg)  # disjoint
    again = mixing.taken(*mixing.mix(df, block_words=64, shard_words=4000)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    texts = mixing.mixed_texts(df, segments)
    assert texts.columns == [*df.columns, "shard", "place"]
    assert Counter(words(r.text) for r in texts.collect()) == Counter(s.words for s in seg)


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        df = spark.range(n).select("id", F.lit(n).cast("long").alias("n"), F.lit("k").alias("k"))
        got = [r.p for r in df.select("id", mixing.permuted("id", "n", "k", 3).alias("p")).orderBy("id").collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(n))


def test_tree_draws_are_hypergeometric(spark):
    """Every level keeps the sums, and the mean and variance of a half are as they should be."""
    q = spark.createDataFrame([([300, 100, 0, 600],)], "q array<bigint>")
    firsts = []
    for seed in range(60):
        rows = mixing.split_tree(spark, q, 2, seed).collect()
        assert [sum(r.q[i] for r in rows) for i in range(4)] == [300, 100, 0, 600]
        assert all(sum(r.q) == 250 and min(r.q) >= 0 for r in rows)
        firsts += [r.q[0] for r in rows]
    mean = sum(firsts) / len(firsts)
    var = sum((x - 75) ** 2 for x in firsts) / len(firsts)
    expected = 250 * 0.3 * 0.7 * 750 / 999
    assert abs(mean - 75) < 1e-9 and 0.6 * expected < var < 1.5 * expected


def test_odd_rows(spark):
    rows = [(1, None, "a", 1), (1, "", None, 2), (2, "x y z", None, 3), (2, "x y z", None, 4), (None, "p q", "a", 5)]
    rows += [(3, "w " * 30000, "b", 6), (4, "u " * 10, "b", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, h int")
    documents, segments = mixing.mix(df, block_words=8, shard_words=500)
    got = mixing.taken(documents, segments)
    assert got.count() == len(rows)
    by = {(r["size"], r.source_size) for r in got.collect()}
    assert (3, 6) in by and (30000, 30010) in by
    assert mixing.mixed_texts(df, segments).select("h").distinct().count() >= 3
    for empty in (df.limit(0), df.filter("size(split(text, ' ')) = 1 and text = ''")):
        d, s = mixing.mix(empty)
        assert s.count() == 0 and mixing.taken(d, s).count() == empty.count()


def test_no_python_on_the_main_path(spark):
    plan = queries.op8_mixing(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_one_id_and_text_in_two_sources(spark):
    rows = [(i, f"only {i} " + "w " * 30, s) for i in range(12) for s in ("a", "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    documents, segments = mixing.mix(df, block_words=64)
    got = mixing.taken(documents, segments).collect()
    assert len(got) == 36 and all(0 <= r.taken <= 2 * r["size"] for r in got)
    assert sum(r.taken for r in got) == sum(s.words for s in segments.collect())
    goal, out = wanted({s: 12 * 32 for s in ("a", "b", None)}), Counter()
    for r in mixing.mixed_texts(df, segments).collect():
        out[r.source] += words(r.text)
    assert all(abs(out[s] - goal[s]) <= 1 for s in goal)
