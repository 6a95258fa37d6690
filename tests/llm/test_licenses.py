"""Notices in supplied texts against a search for their wording, and blocks made by hand."""

import random
import re
import textwrap

import pytest

from pagemill.llm import licenses, queries

SF = "/root/testdata/sf0.01"
#: The notices of the supplied documents.
NOTICES = {
    "Released under the MIT License.": "MIT-notice",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0-notice",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-notice",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-notice",
    "All rights reserved.": "all-rights-reserved",
}


def test_supplied_documents(spark):
    got = {(r.doc_id, r.start, r.license) for r in queries.op4_license_scan(spark, SF).collect() if r.license}
    wanted = set()
    for d in queries.table(spark, SF, "documents").collect():
        at = 0
        for line in d.text.split("\n"):
            wanted |= {(d.doc_id, at, name) for notice, name in NOTICES.items() if notice in line}
            at += len(line) + 1
    assert got == wanted and len(wanted) > 20


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.TEMPLATES)


@pytest.mark.parametrize(("block", "name"), [
    ("# released UNDER the mit license", "MIT-notice"),
    ("This project is licensed under the GNU General Public License, version 2.", "GPL-2.0-notice"),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0-notice"),
    ("This work is licensed under the GNU General Public License, version 4.", None),
    ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0-notice"),
    ("a license to talk about copyright in general", None),
    (licenses.TEMPLATES["MIT-grant"].replace("deal in", "trade in") + ", and so on", "MIT-grant"),
])
def test_blocks(scanner, block, name):
    got = scanner.best(block, 6, 0.34)
    assert got[0] == name
    if name == "MIT-grant":
        assert (got[2], got[3]) == (["deal"], ["trade"])


def test_compression_ranks_the_template_first(scanner):
    for name, text in licenses.TEMPLATES.items():
        ranked = scanner.reductions(text)
        assert name in [n for _, n in ranked[:3]] and ranked[0][0] > 0.3


def test_wrapped_and_neighbouring_notices(spark):
    texts = ["\n".join(textwrap.wrap(licenses.TEMPLATES[n], 78, initial_indent="# ", subsequent_indent="# ")) for n in ("MIT-grant", "BSD-grant", "ISC-grant")]
    texts += ["x\nReleased under the MIT License.\nLicensed under CC BY 4.0.\ny", "All rights\nreserved."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.line, r.license) for r in licenses.scan(df).collect())
    assert got == [(0, 0, "MIT-grant"), (1, 0, "BSD-grant"), (2, 0, "ISC-grant"), (3, 1, "MIT-notice"), (3, 2, "CC-BY-4.0-notice"), (4, 0, "all-rights-reserved")]


def test_notices_in_very_long_lines(scanner):
    rng = random.Random(5)
    some = [w for d in ("river stone apple the of and to in house walks slowly green under this work".split(),) for w in d]
    for name, text in licenses.TEMPLATES.items():
        noise = [rng.choice(some) + rng.choice(["", "", "s", "ing"]) + str(rng.randrange(300) or "") for _ in range(10_000)]
        line = " ".join([*noise[:6000], text, *noise[6000:]])
        rows = licenses._rows(scanner, line, re.compile(licenses._TRIGGER).finditer, 0.34)
        assert [r[3] for r in rows] == [name]


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x\nReleased under the MIT License."), (3, "license " * 20000), (4, "no notice"), (4, "All rights reserved.")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, license int")
    got = sorted((r.doc_id or 0, r.line, r.start, r.license) for r in licenses.scan(df).collect())
    assert got == [(0, 1, 2, "MIT-notice"), (3, 0, 0, None), (4, 0, 0, "all-rights-reserved")]
    assert licenses.scan(df.limit(0)).count() == 0
