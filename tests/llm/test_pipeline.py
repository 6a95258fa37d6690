"""Every stage of the pipeline against what it should have done with its own input."""

import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pagemill.llm import pieces, queries, toxicity
from test_jaccard import brute as groups
from test_lines import brute as passages
from test_mixing import wanted, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        out.append((docs, docs := spark.read.parquet(path)))
    return out


def test_columns_and_names(spark, tables):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(after.columns == columns for _, after in tables[:-1])
    assert len(corpus_pipeline.STAGES) == len(tables) == 5


def test_toxic_documents_go(spark, tables):
    before, after = tables[0]
    model = toxicity.fit(before, queries.table(spark, SF, "labels"))
    keep = {r.doc_id for r in toxicity.score(before, model).collect() if r.score < 0.5}
    assert {r.doc_id for r in after.collect()} == keep


def test_passages_go(tables):
    before, after = tables[1]
    rows = [(r.doc_id, r.text) for r in before.orderBy("doc_id").collect()]
    assert [r.text for r in after.orderBy("doc_id").collect()] == passages(rows)
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_one_of_each_group_stays(tables):
    before, after = tables[2]
    truth = groups([(r.doc_id, r.text) for r in before.collect()])
    assert sorted(r.doc_id for r in after.collect()) == [i for i, _, c in truth if i == c]


def test_mix_reaches_its_targets(tables):
    before, after = tables[3]
    sizes, got, texts = Counter(), Counter(), {}
    for r in before.collect():
        sizes[r.source] += words(r.text)
        texts[r.doc_id] = r.text
    for r in after.collect():
        got[r.source] += words(r.text)
        assert texts[r.doc_id].startswith(r.text) or re.sub(r"\s", "", texts[r.doc_id]).startswith(re.sub(r"\s", "", r.text))
    assert all(abs(got[s] - t) <= 1 for s, t in wanted(sizes).items())


def test_ids_are_the_librarys(tables):
    before, after = tables[4]
    sp = pieces.Encoder(queries.piece_model()).sp
    truth = Counter((r.doc_id, tuple(sp.encode(r.text or "", add_eos=True))) for r in before.collect())
    rows = after.collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == truth
    assert all(r.decoded == sp.decode(np.array(r.ids).tolist()) for r in rows)


def test_odd_rows_pass(spark):
    df = spark.createDataFrame(
        [(1, None, None, None, None), (1, "", "en", "s", 0), (None, "a b c", "en", None, 5), (3, "w " * 5000, "en", "s", 10000)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
    assert sorted(r.doc_id or 0 for r in df.collect())[-1] == 3


def test_clashing_columns_and_empty_tables(spark):
    extra = "removed_lines int, __h int, __id string, __ranges int, shard int, place string, __n int, others int, sig string, ids int, score double"
    rows = [(i, t, "en", "s", len(t), 1, 2, "x", 3, 4, "p", 5, 6, "q", 7, 0.5) for i, t in enumerate(("one two three four five six", "seven eight nine ten eleven", "seven eight nine ten eleven"))]
    for data in (rows, []):
        df = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + extra)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, SF)
            if i < 4:
                assert out.columns == df.columns
                assert all((r["place"], r["__id"], r["shard"], r["ids"]) == ("p", "x", 4, 7) for r in out.collect())
            df = out
        assert bool(df.collect()) == bool(data)
