"""Layouts, escaping and the mask; the query against its SQL is in test_llm_oracles."""

import json
import random

from pagemill.llm import chat


def through(spark, records):
    df = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r)) for i, r in enumerate(records)], "id long, record string")
    out = chat.formatted(chat.to_turns(df, "id", "record")).withColumn("back", chat.read_back()).withColumn("loss", chat.masked())
    return out.orderBy("id").collect()


def test_layouts(spark):
    qa = [("user", "q"), ("assistant", "a")]
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "response": "a"}, {"prompt": "q", "completion": "a"}, {"question": "q", "answer": "a"},
        {"instruction": "q", "output": "a"}, {"output": "a", "instruction": "q", "input": ""},
        {"instruction": "q", "input": "i", "output": "a"}, {"system": "s", "prompt": "q", "response": "a"},
        {"turns": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a"}]},
        {"what": 1}, {"messages": [{"role": "user", "content": "q", "odd": {"x": [1]}}]}, "no json", None, "[1]",
        {"messages": []}, {"messages": [{"role": None, "content": 5}]},
    ]
    rows = through(spark, records)
    got = [None if r.turns is None else [tuple(t) for t in r.turns] for r in rows]
    assert got[:7] == [qa] * 7 and got[9] == qa
    assert got[7] == [("user", "q"), ("user", "i"), ("assistant", "a")] and got[8] == [("system", "s"), *qa]
    assert got[10:15] == [None] * 5 and got[15:] == [[], [("", "5")]]
    assert [r.fingerprint is None for r in rows[10:15]] == [False, False, True, True, True]
    assert rows[0].fingerprint != rows[1].fingerprint and rows[3].layout == "prompt-completion"


def test_round_trip_and_mask(spark):
    rng = random.Random(3)
    bits = ["<|im_start|>", "<|im_end|>", "<", "|", "\\", "\n", "im_end|>", "a", "é", "🎉", "<\\|", "<\\\\|", "assistant"]
    records, turns = [], []
    for _ in range(400):
        t = [
            (rng.choice(["user", "assistant", "".join(rng.choices(bits, k=3))]), "".join(rng.choices(bits, k=rng.randint(0, 8))))
            for _ in range(rng.randint(0, 4))
        ]
        turns.append(t)
        records.append({"messages": [{"role": r, "content": x} for r, x in t]})
    for r, t in zip(through(spark, records), turns, strict=True):
        assert [tuple(b) for b in r.back] == t
        assert r.loss == "".join(x for role, x in t if role == "assistant")
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == len(t)


def test_rows_to_records(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "b"), (1, 0, None, "a"), (None, 5, "user", "x"), (2, None, "user", ""), (2, 0, "user", "y" * 200000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, record string")
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in chat.to_turns(chat.as_records(df), "conv_id", "record").collect()}
    assert got == {1: [("", "a"), ("", "b"), ("assistant", "")], None: [("user", "x")], 2: [("user", ""), ("user", "y" * 200000)]}
    assert chat.formatted(chat.to_turns(chat.as_records(df.limit(0)), "conv_id", "record")).count() == 0
