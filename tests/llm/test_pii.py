"""Anchor expansion against the plain expressions, and the added kinds on planted texts."""

import random
import re

from pagemill.llm import pii, queries

SF = "/root/testdata/sf0.001"

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def check_sum(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])) % 10 == 0


def brute(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if max(map(int, m.group().split("."))) <= 255]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(digits(m)) <= 19 and check_sum(digits(m))]
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]
    return sorted(out)


def written(spans):
    return ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in spans)


def test_base_kinds_equal_the_expressions():
    rng, finder = random.Random(3), pii.Finder()
    pieces = [*"0123456789.@+-() ", "a", "b.c", "é", "😀", "\n", "4111111111111111", "255", "256", "1.2.3.4", "x@y.z", "+1 (603) 555-8791", "@", "..", "0000000001"]
    for _ in range(20_000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 25)))
        assert [s for s in finder.spans(text) if s[1] < 4] == brute(text), text


def test_long_runs():
    finder = pii.Finder()
    runs = ("1", "1.", "a@", "+1(", "1 ", "a.", "+", "iban ", "http://")
    for run in runs:
        text = run * 2000 + "@b.c"
        assert [s for s in finder.spans(text) if s[1] < 4] == brute(text)
        finder.spans(run * 300_000 + "@b.c")  # the time of the expressions would grow with the square
    assert finder.spans("9" * 400_000 + ".1.1.1") == []


def test_added_kinds():
    finder = pii.Finder()
    cases = {
        "write to jane.doe (at) example (dot) org now": "spelled_email:9:40",
        "jane[at]example.org": "spelled_email:0:19",
        "see https://bob:s3cret@host.example/x": "login:12:22,email:16:35",
        "IBAN: GB82 WEST 1234 5698 7654 32 and more": "iban:6:33",
        "iban DE89370400440532013000.": "iban:5:27",
        "IBAN DE89370400440532013001": "",
        "Account number: 12345678": "account:16:24",
        "Konto Nr. 123 456 789, x": "account:10:21",
        "on account of 1,000 people": "",
        "discount 12345678": "",
        "SSN 536-22-1234": "ssn:4:15",
        "SSN 000-22-1234": "",
        "at the account": "",
        "https://host.example/a@b": "",
    }
    for text, spans in cases.items():
        assert written(s for s in finder.spans(text) if s[1] != 2) == spans, text


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "é a@b.co 10.0.0.1", None), (3, "é a@b.co 10.0.0.1", None), (None, "+49 30 1234567", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = pii.with_spans(df)
    assert out.columns == ["doc_id", "text", "spans", "pii"]
    out = out.select("doc_id", pii.joined("pii").alias("s"), pii.redacted(out["text"], out["pii"]).alias("t"))
    got = sorted((r.doc_id or 0, r.s, r.t) for r in out.collect())
    three = (3, "email:2:8,ip:9:17", "é <email> <ip>")
    assert got == [(0, "phone:0:14", "<phone>"), (1, "", None), (2, "", ""), three, three]
    assert pii.with_spans(df.limit(0)).count() == 0


def test_query_against_expressions(spark):
    import hashlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = queries.QUERIES["op13_pii"](spark, SF).collect()
    assert len(out) == len(texts)
    for r in out:
        spans = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(written(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert r.spans == written(spans)
