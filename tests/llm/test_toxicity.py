"""Restoring disguised words, accuracy on rows held out, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import queries, toxicity
from pagemill.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return toxicity.fit(queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels"))


def test_disguised_words(model):
    r = toxicity.Restorer(model.costs)
    for text, word in {
        "1d10t": "idiot", "You id1ot!!": "idiot", "an i d i o t here": "idiot", "s-t-u-p-i-d": "stupid",
        "5tup1d,": "stupid", "stuuupid": "stupid", "M0R0N": "moron", "$cum.": "scum", "cl0wn": "clown",
    }.items():
        assert word in r.words(text), text
    assert r.words("Anat with,  by of!") == {"anat", "with", "by", "of"}
    assert r.words("108.51.216.133 ### --") == set() and "é" in r.words("é")


@pytest.mark.parametrize("text", ["such a i d i o t here", "y o u a r e a n i d i o t", "y o u  a r e  a n  i d i o t", "y.o.u i.d.i.o.o.o.t"])
def test_spread_words_in_spread_sentences(model, text):
    assert "idiot" in toxicity.Restorer(model.costs).words(text)


@pytest.mark.parametrize("text", ["idio+", "an idio+.", "with," * 12 + "1d10t,of", ",".join(["with"] * 9 + ["1d10t"] + ["by"] * 9)])
def test_signs_at_the_end_and_long_tokens(model, text):
    assert "idiot" in toxicity.Restorer(model.costs).words(text)


def test_no_state_is_dropped():
    """A token of ambiguous signs against all its readings, under random costs."""
    for seed in range(3):
        costs = np.random.default_rng(seed).random((28,) * 4).astype(np.float32) * 5
        readings = [toxicity._readings(c, 1) for c in "1|!1+0|1"]
        paths: dict[tuple, float] = {(0, 0, 0, ""): 0.0}  # by text: no text is given up
        for options in [*readings, [(" ", 0.0)]]:
            after: dict[tuple, float] = {}
            for (a, b, c, text), cost in paths.items():
                for letter, extra in options:
                    code = 0 if letter == " " else ord(letter) - 96 if letter else None
                    if code is None or (code == 0 and c == 0):
                        key, total = (a, b, c, text), cost + extra
                    else:
                        key, total = (b, c, code, text + letter), cost + extra + float(costs[a, b, c, code])
                    after[key] = min(total, after.get(key, 1e9))
            paths = after
        assert toxicity.Restorer(costs).decode("1|!1+0|1") == min(paths, key=paths.get)[3]


def test_viterbi_finds_the_cheapest_path():
    """Against all readings of short tokens under random costs."""
    rng = np.random.default_rng(3)
    costs = rng.random((28,) * 4).astype(np.float32) * 5
    r = toxicity.Restorer(costs)

    def cost(letters):
        s, total = (0, 0, 0), 0.0
        for c in letters:
            k = 0 if c == " " else ord(c) - 96
            total += float(costs[(*s, k)])
            s = (s[1], s[2], k)
        return total

    for a, b in (("o", 1.0), ("", 2.0), (" ", 1.0)):
        best = min(cost(f"x{z}y ") + e for z, e in (("o", 1.0), ("", 2.0), (" ", 1.0)))
        if cost(f"x{a}y ") + b == best:
            assert r.decode("x0y").strip() == f"x{a}y"


def test_held_out_rows(spark, model):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter(crc_mod(F.col("doc_id"), 5) == 0).collect()
    clean = [r.score for r in rows if r.toxic == 0]
    toxic = [r.score for r in rows if r.toxic == 1]
    assert sum(s < 0.5 for s in clean) >= 0.97 * len(clean)
    assert sum(s >= 0.5 for s in toxic) >= 0.6 * len(toxic)


def test_odd_rows(spark, model):
    df = spark.createDataFrame(
        [(1, None, 0.5), (1, "", 0.5), (None, "you 1d10t", 0.5), (2, "a" * 90000, 0.5), (3, "1a" * 40000, 0.5)],
        "doc_id long, text string, score double",
    )
    rows = toxicity.score(df, model).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert [r.score >= 0.5 for r in rows if r.doc_id is None] == [True]
    assert toxicity.score(df.limit(0), model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    empty = toxicity.fit(df, labels)
    assert not empty.lexicon and {r.score for r in toxicity.score(df, empty).collect()} == {0.0}
