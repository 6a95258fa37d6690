"""The skyband and the audit against brute force; the query against its SQL is in test_llm_oracles."""

import random
import re
from collections import Counter

import numpy as np

from pagemill.llm import divergence


def test_skyband_keeps_what_fewer_than_k_dominate():
    rng = np.random.default_rng(5)
    for k, spread in ((1, 40), (3, 5), (7, 1000)):
        high, low = rng.integers(0, spread, 700), rng.integers(0, spread, 700)
        name = rng.permutation(700)
        over = [np.sum((high >= high[i]) & (low <= low[i]) & (name < name[i])) for i in range(700)]
        got = divergence.skyband(high, low, name, k, chunk=64)
        assert sorted(got) == [i for i in range(700) if over[i] < k]


def brute(rows, min_docs, top):
    docs = [(x or "", y or "", [t.translate({c: c + 32 for c in range(65, 91)}) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", z or "")]) for x, y, z in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t in df if df[t] >= min_docs]
        count = {s: Counter(t for d in mine if d[1] == s for t in d[2] if df[t] >= min_docs) for s in {d[1] for d in mine}}
        whole = sum(count.values(), Counter())
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))
        p = {s: {t: share(c[t], c.total()) for t in kept} for s, c in count.items()}
        for s, own in p.items():
            pairs = [(-sum(abs(own[t] - other[t]) for t in kept), o) for o, other in p.items() if o != s]
            terms = [(share(whole[t], whole.total()) - own[t], t) for t in kept if count[s][t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted((x for x in terms if x[0] < 0), key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, item) in enumerate(found)]
    return sorted(out)


def audited(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "lang string, source string, text string, term string, part int")
    out = divergence.audit(df, **options)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in out.collect())


def some_rows(n, words, sources, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("Été", "x", "日本", "q", "Zz") for b in "abcdefghij"][:words]
    rows = []
    for _ in range(n):
        s = rng.choice(sources)
        rows.append((rng.choice(["en", "en", None, "de"]), s, " 7".join(rng.choices(vocabulary, weights=range(1, words + 1), k=rng.randint(0, 12)))))
    return rows


def test_brute_force(spark):
    rows = some_rows(300, 50, ["a", "b", None, "", "c😀", "d"]) + [("en", "lone", None), ("xx", "s", "a b"), ("xx", "r", ""), (None, None, None)]
    assert audited(spark, rows, min_docs=4, top=5) == brute(rows, 4, 5)
    assert audited(spark, rows, min_docs=10_000) == brute(rows, 10_000, 50)
    assert audited(spark, [], min_docs=1) == []


def test_many_blocks_tiles_and_pieces(spark, monkeypatch):
    rows = some_rows(400, 40, list("abcdefghijk"), 2) + [("en", "a", "x" * 3000 + " y" * 500 + "é" * 3000)]
    whole = audited(spark, rows, min_docs=1, top=4)
    for name, value in (("_BLOCK", 7), ("_TILE", 3), ("_PIECE", 64), ("_HELD", 50)):
        monkeypatch.setattr(divergence, name, value)
    assert audited(spark, rows, min_docs=1, top=4) == whole == brute(rows, 1, 4)


def test_one_source_and_repeated_rows(spark):
    rows = [("en", "a", "one two two")] * 40
    assert audited(spark, rows) == []
    rows += [("en", "b", None)]
    assert audited(spark, rows) == brute(rows, 30, 50)
