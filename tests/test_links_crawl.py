"""Links, traversal, sitemaps, numbering: small cases against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pagemill.operators import crawl, dedup, links, numbering, report, sitemaps


def found(spark, base, text, **options):
    df = spark.createDataFrame([(1, base, text)], "src_key int, url string, html string")
    return [r.dst_url for r in links.extract_links(df, **options).orderBy("pos").collect()]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("![i](/x)", ["https://e.com/x"]),
        ("[](/x)", []),
        ('[t](/x "T")', ["https://e.com/x%20%22T%22"]),
        ("<a href='/x'>", ["https://e.com/x"]),
        ("[a](<https://e.com/x>) [b](%3Chttps://e.com)", []),
        ("[a](/x.PDF) [b](/y.tar) [c](/z.html)", ["https://e.com/z.html"]),
        ("[a](https://o.com/x) [b](http://e.com/x)", []),
        ("[a](mailto:x@e.com) [b](javascript:1) [c](#top)", []),
        ('<a href="/b"> [x](/a)', ["https://e.com/a", "https://e.com/b"]),
        ("[x](/a?q=1#f)", ["https://e.com/a"]),
    ],
)
def test_links_without_base_path(spark, text, expected):
    assert found(spark, "https://e.com/p/q", text) == expected


@pytest.mark.parametrize(
    "text,expected",
    [
        ("[a](/plugins)", ["https://e.com/docs/plugins"]),
        ("[a](/docs)", ["https://e.com/docs/docs"]),
        ("[a](/docs/x)", ["https://e.com/docs/x"]),
        ("[a](../out)", []),
        ("[a](https://e.com/out)", []),
        ("[a](c)", ["https://e.com/docs/c"]),
    ],
)
def test_links_with_base_path(spark, text, expected):
    assert found(spark, "https://e.com/docs/q", text) == expected


def test_external_links(spark):
    text = "[a](https://o.com/x) [b](https://img.o.com/x) [c](https://x.shields.io/y) [d](https://badges.o.com/)"
    assert found(spark, "https://e.com/p", text, include_external=True) == ["https://o.com/x"]


def test_titles_can_be_stripped(spark):
    assert found(spark, "https://e.com/p", '[t](/x "T")', strip_titles=True) == ["https://e.com/x"]


def brute_depths(edges, start, limit):
    seen, level = {start: 0}, [start]
    for d in range(1, limit + 1):
        level = [t for s in level for t in edges[s] if t not in seen and not seen.update({t: d})]
    return seen


def test_crawl_matches_brute_force_whatever_the_partitioning(spark):
    rng = random.Random(1)
    pairs = {(f"n{rng.randrange(60)}", f"n{rng.randrange(60)}") for _ in range(150)}
    # One hub leads to a third of everything, and everything leads back to it.
    pairs |= {("n0", f"n{i}") for i in range(30)} | {(f"n{i}", "n0") for i in range(60)}
    out = defaultdict(list)
    for s, t in pairs:
        out[s].append(t)
    rows = [(s, t, t, i) for i, (s, t) in enumerate(sorted(pairs))]
    entries = [("c1", "n5", "n5"), ("c2", "n0", "n0"), ("c3", "alone", "alone")]
    expected = {
        (c, k, d) for c, e, _ in entries for k, d in brute_depths(out, e, 3).items()
    }
    ent = spark.createDataFrame(entries, "crawl_id string, url_key string, url string")
    for parts in (1, 5):
        edges = spark.createDataFrame(rows, "src_key string, dst_key string, dst_url string, pos int")
        got = crawl.crawl(edges.repartition(parts), ent, 3).collect()
        assert {(r.crawl_id, r.url_key, r.depth) for r in got} == expected
        assert len(got) == len(expected)


def test_crawl_depth_zero_and_outcomes(spark):
    edges = spark.createDataFrame([("a", "b", "b", 0), ("b", "c", "c", 0), ("x", "b", "b", 0)], "src_key string, dst_key string, dst_url string, pos int")
    entries = spark.createDataFrame([("1", "a", "a"), ("2", "x", "x")], "crawl_id string, url_key string, url string")
    assert crawl.crawl(edges, entries, 0).count() == 2
    content = spark.createDataFrame(
        [("a", None, None), ("b", "empty", None), ("x", "cloudflare", None)],
        "url_key string, blocked_reason string, error string",
    )
    out = crawl.outcomes(crawl.crawl(edges, entries, 2), content)
    got = {(r.crawl_id, r.url_key): (r.status, r.reason, r.error) for r in out.collect()}
    assert got == {
        ("1", "a"): ("saved", None, None),
        ("1", "b"): ("blocked", "empty", None),
        ("1", "c"): ("failed", None, "not captured"),
        ("2", "x"): ("entry_failed", "cloudflare", None),
    }
    rep = {r.crawl_id: (r.visited, r.saved, r.blocked, r.failed) for r in report.crawl_report(out).collect()}
    assert rep == {"1": (3, 1, 1, 1), "2": (1, 0, 1, 0)}
    assert crawl.follow_content(edges, content).count() == 1


def test_numbers_of_a_skewed_group(spark):
    rows = [("big" if i % 3 == 0 else f"d{i % 5}", i) for i in range(3000)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int").repartition(7)
    got = {(r.g, r.i): r.number for r in numbering.number_rows(df, ["g"], ["i"]).collect()}
    count, expected = defaultdict(int), {}
    for g, i in sorted(rows, key=lambda r: r[1]):
        count[g] += 1
        expected[g, i] = count[g]
    assert got == expected


def test_collisions(spark):
    df = spark.createDataFrame([("a.md", 1), ("a.md", 3), ("a.md", 2), ("b.md", 4)], "local_path string, i int")
    out = dedup.resolve_collisions(df, ["local_path"], ["i"])
    assert {(r.local_path, r.i, r.writers) for r in out.collect()} == {("a.md", 3, 3), ("b.md", 4, 1)}
    with pytest.raises(Exception, match="several pages"):
        dedup.resolve_collisions(df, ["local_path"], ["i"], on_collision="error").collect()


def test_sitemaps(spark):
    rows = [
        ("root", "<sitemapindex><sitemap>\n<loc> a </loc></sitemap><sitemap><loc>gone</loc></sitemap><sitemap><loc>root</loc></sitemap><sitemap><loc>sub</loc></sitemap></sitemapindex>"),
        ("sub", "<sitemapindex><sitemap><loc>b</loc></sitemap><sitemap><loc>root</loc></sitemap></sitemapindex>"),
        ("a", "<urlset><url> <loc>https://e.com/1?a&amp;b</loc></url><url><lastmod/><loc>https://e.com/2</loc></url></urlset>"),
        ("b", "<urlset><url><loc><![CDATA[https://e.com/3]]></loc></url><url><loc>https://e.com/4"),
    ]
    df = spark.createDataFrame(rows, "sitemap_url string, body string")
    roots = spark.createDataFrame([("c", "root")], "crawl_id string, sitemap_url string")
    reached, missing = sitemaps.expand_sitemaps(df, roots)
    assert {r.sitemap_url for r in reached.collect()} == {"a", "b"}
    assert {r.sitemap_url for r in missing.collect()} == {"gone"}
    assert [r["loc"] for r in sitemaps.sitemap_pages(df, reached).collect()] == ["https://e.com/1?a&amp;b"]
