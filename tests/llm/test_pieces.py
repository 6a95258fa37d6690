"""The encoder against the library, on odd strings and on the supplied documents."""

import hashlib
import random

import numpy as np
import pytest

from pagemill.llm import pieces, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def enc():
    return pieces.Encoder(queries.piece_model())


def same(enc, text):
    assert np.frombuffer(enc.packed(text), np.int32).tolist() == enc.sp.encode(text, add_eos=True), repr(text[:80])


def test_odd_texts(enc):
    odd = ["", " ", "\x00", "a\x00b", "﻿x", "<s>", "</s>", "<0x0A>", "<unk>", "▁", "a▁b", "\r\n", "🎉é日本", "N°5"]
    odd += [" " * k for k in range(40)] + ["x" + " " * k + "y" for k in range(40)] + ["\n" * 30, "a" * 5000, "ab" * 3000]
    for text in odd:
        same(enc, text)


def test_random_strings(enc):
    rng = random.Random(7)
    letters = "aabcdeinorst ▁\n\té日本🎉0123.,'\"  the"
    names = list(enc.ids)
    for _ in range(4000):
        same(enc, "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))))
        same(enc, "".join(rng.choice(names) for _ in range(rng.randint(1, 8))))


def test_backtracking_takes_pieces_back():
    """A vocabulary in which the longest first piece leads nowhere."""
    enc = object.__new__(pieces.Encoder)
    import ahocorasick

    enc.scores = {"a": 0.0, "b": 0.0, "c": 0.0, "bc": -1.0, "ab": -2.0}
    enc.ids = {p: i for i, p in enumerate(enc.scores)}
    enc.pairs, enc.halves, enc.automaton = {}, {}, ahocorasick.Automaton()
    for p in enc.ids:
        enc.merged(p)
        enc.automaton.add_word(p, p)
    enc.automaton.make_automaton()
    for text in ("abc", "abcabc", "aabbcc", "ab", "abab"):
        assert enc.walk(text) == enc.merged(text)


def test_query_matches_library(spark, enc):
    rows = {r.doc_id: r for r in queries.op9_sentencepiece(spark, SF).collect()}
    docs = queries.table(spark, SF, "documents").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = enc.sp.encode(d.text or "", add_eos=True)
        got = rows[d.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(enc.sp.decode(ids).encode()).hexdigest()


def test_nulls_ties_and_clashing_columns(spark, enc):
    df = spark.createDataFrame(
        [(1, None, 5, "k"), (1, "a b", 5, "k"), (None, "", 6, None), (2, "long " * 30000, 7, "q")],
        "doc_id long, text string, ids int, key string",
    )
    out = pieces.encode(df, queries.piece_model(), decoded=True)
    rows = sorted(out.collect(), key=lambda r: (r.doc_id or 0, len(r.ids)))
    assert out.columns == ["doc_id", "ids", "decoded"]
    assert [r.ids for r in rows[:2]] == [[2], [2]] and rows[2].decoded == "a b" and rows[3].decoded == "long " * 30000
    back = pieces.decode(out.select("doc_id", "ids"), queries.piece_model())
    assert sorted(r.text for r in back.collect()) == sorted(r.decoded for r in rows)
    assert pieces.encode(df.limit(0), queries.piece_model()).count() == 0
