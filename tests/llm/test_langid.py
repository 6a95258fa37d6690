"""Accuracy on rows held out, the codes, and odd rows."""

import numpy as np
import pytest

from pagemill.llm import langid, queries

SF = "/root/testdata/sf0.01"


def test_held_out_rows(spark):
    docs = queries.table(spark, SF, "documents").select("doc_id", "lang")
    rows = queries.op1_language_id(spark, SF).join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and len(held) > 100
    assert sum(r.lang_pred == r.lang for r in held) >= 0.99 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 40])
def test_codewords(n):
    code = langid.codewords(n)
    assert code.shape[0] == n and set(np.unique(code)) == {-1.0, 1.0}
    assert all(len(set(c)) == 2 for c in code.T) and len({tuple(r) for r in code}) == n
    if n > 5:
        least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert least >= code.shape[1] // 5


def test_decoding_mends_a_wrong_bit():
    """With one bit's classifier turned round the answers stay."""
    rng = np.random.default_rng(1)
    langs = [f"l{i}" for i in range(8)]
    texts = ["".join(rng.choice(list("abcdefgh"), p=np.roll([0.4, 0.2, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05], i), size=400)) for i in range(8)]
    counts = np.array([np.bincount(langid.grams(t), minlength=langid._CELLS) for t in texts], float)
    model = langid.Model(langs, counts)
    assert [model.answer(t)[0] for t in texts] == langs
    model.table[:, 3] *= -1
    assert [model.answer(t)[0] for t in texts] == langs


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(1, None, "en", 1), (2, "", "en", 1), (3, "12 _ -- ٣", "en", 2), (None, "the of and", "en", 1), (4, "und und Und", None, 1),
         (5, "und " * 60000, "de", 1), (5, "und " * 60000, "de", 1)],
        "doc_id long, text string, lang string, score int",
    )
    model = langid.fit(df)
    rows = langid.predict(df, model).collect()
    got = sorted((r.doc_id or 0, r.lang_pred) for r in rows)
    assert got == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "de"), (5, "de"), (5, "de")]
    one = langid.fit(df.filter("lang = 'de'"))
    assert {(r.lang_pred, r.score) for r in langid.predict(df, one).collect()} == {("und", 0.0), ("de", 1.0)}
    none = langid.fit(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, none).collect()} == {"und"}
    assert langid.predict(df.limit(0), model).count() == 0
