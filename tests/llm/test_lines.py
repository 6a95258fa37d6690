"""Line windows against brute force; the query against its SQL is in test_llm_oracles."""

import re

from pagemill.llm import lines


def brute(rows, long_words=10**9):
    count = lambda s: len(re.findall(r"[^\x20\x09-\x0D]+", s))
    windows = []
    for d, (_, text) in enumerate(rows):
        ls = (text or "").split("\n") if text else []
        for i in range(len(ls)):
            if i + 2 < len(ls) and sum(map(count, ls[i : i + 3])):
                windows.append((tuple(ls[i : i + 3]), d, i))
            for k in (1, 2):
                if i + k <= len(ls) and sum(map(count, ls[i : i + k])) >= long_words:
                    windows.append((tuple(ls[i : i + k]), d, i))
                    break
    seen, gone = set(), set()
    for w, d, i in sorted(windows, key=lambda x: (x[1], x[2])):
        if w in seen:
            gone |= {(d, j) for j in range(i, i + len(w))}
        seen.add(w)
    return [
        text if not text else "\n".join(x for j, x in enumerate(text.split("\n")) if (d, j) not in gone)
        for d, (_, text) in enumerate(rows)
    ]


def test_brute_force(spark):
    long_ = " ".join(f"w{i}" for i in range(55))
    half = " ".join(f"h{i}" for i in range(30))
    rows = [
        (1, "a\nb\nc\nd"), (2, "x\nb\nc\nd\ny"), (3, "a\nb\nc"), (4, f"q\n{long_}\nr"), (5, f"s\n{long_}\nt\n"),
        (6, f"{half}\n{half}"), (7, f"k\n{half}\n{half}\nm"), (8, ""), (9, None), (10, "\n\n\n\n"), (11, "\n\n\n"),
        (12, "r\nr\nr\nr\nr"), (13, "one"), (14, "v\n" * 3000), (15, "b\nc\nd"),
    ]
    df = spark.createDataFrame([(i, t, 0, "z", 1, 2) for i, t in rows], "doc_id long, text string, h int, ranges string, __h int, __ranges int")
    for options in ({}, {"long_words": 50}):
        out = lines.remove_repeats(df, **options)
        assert out.columns == ["doc_id", "text", "h", "ranges", "__h", "__ranges", "removed_lines"]
        assert [r.text for r in out.orderBy("doc_id").collect()] == brute(rows, **options)
    assert brute(rows) != brute(rows, 50)
    named = df.withColumnRenamed("h", "removed_lines")
    assert lines.remove_repeats(named, count=None).columns == named.columns


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "p\nq\nr"), (2, "p\nq\nr")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in lines.remove_repeats(df).collect())
    assert got == [(0, "p\nq\nr"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "")]
    assert lines.remove_repeats(df.limit(0)).count() == 0


def test_query_and_stage_take_long_lines(spark, tmp_path):
    import corpus_pipeline
    from pagemill.llm.queries import QUERIES

    long_ = " ".join(f"w{i}" for i in range(55))
    half = " ".join(f"h{i}" for i in range(30))
    rows = [(1, f"q\n{long_}\nr"), (2, f"s\n{long_}\nt"), (3, f"{half}\n{half}"), (4, f"k\n{half}\n{half}\nm")]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute(rows, 50)
    assert want != brute(rows)
    got = QUERIES["op7_line_dedup"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r.removed_lines, r.kept_chars) for r in got] == [(t.count("\n") - w.count("\n"), len(w)) for (_, t), w in zip(rows, want)]
    assert [r.text for r in corpus_pipeline.line_dedup(spark, docs, "").orderBy("doc_id").collect()] == want
