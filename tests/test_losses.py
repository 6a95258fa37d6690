"""Pages, crawls and entries that used to vanish, and untidy HTML."""

import pytest

from pagemill.functions import content
from pagemill.plans import pages as page_plan
from pagemill.plans import run as run_plan
from pagemill.sources import tables

GONE = ["", None, "<nav><ul><li>x", "<script>1</script>", "<!-- -->", "<body><main></main></body>"]


def markdown(spark, html):
    rows = [(i, f"https://e.com/{i}", h) for i, h in enumerate(html)]
    df = page_plan.pages_to_markdown(spark.createDataFrame(rows, tables.PAGES))
    return [(r.markdown, r.blocked_reason) for r in df.orderBy("page_id").collect()]


def test_pages_of_nothing_stay(spark):
    assert markdown(spark, GONE) == [("", "empty")] * len(GONE)


def test_untidy_html(spark):
    long_ = "<p>" + "text " * 30 + "</p>"
    pages = [
        f"<main></ul><ul><li>a<ul><li>b</li></ul></li></ul>{long_}</main>",
        f"<main></code><p>x <code>a_b</code></p>{long_}</main>",
        f"<main><table><tr><th>A<th>B<tr><td>1<td>2</table><h2>after</h2><p>para</p>{long_}</main>",
        "<main><p>a&#18;b&#146;s &#0000065;&#x0000042;</p></main>",
    ]
    nested, code, table, numbers = (m for m, _ in markdown(spark, pages))
    assert nested.startswith("-   a\n    -   b\n")
    assert "`a_b`" in code
    assert "## after" in table and "| A | B |" in table and "| 1 | 2 |" in table
    assert numbers == "ab’s AB"


@pytest.mark.parametrize(("text", "out"), [("&#65;", "A"), ("&#x1F389;", "🎉"), ("&#150;", "–"), ("&#99999999999;", "&#99999999999;"), ("&#38;lt;", "&lt;"), ("&#1;", "")])
def test_numeric_references(spark, text, out):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(content.decode_entities(df.t)).first()[0] == out


def test_entries_that_lead_nowhere(spark):
    pages = spark.createDataFrame([(0, "https://e.com/docs/", "<main><p>home page</p></main>")], tables.PAGES)
    entries = spark.createDataFrame([("a", "https://e.com/docs/"), ("b", "ftp://x"), ("c", "https://u:p@e.com/"), ("d", None)], "crawl_id string, url string")
    got = {r.crawl_id: (r.status, r.error) for r in run_plan.run(pages, entries).outcomes.collect()}
    assert got["a"] == ("saved", None) and got["b"][0] == got["c"][0] == got["d"][0] == "entry_failed"
    assert got["b"][1].startswith("Unsupported URL scheme") and got["c"][1].startswith("Invalid URL")


def test_crawls_without_a_sitemap(spark):
    pages = spark.createDataFrame([(0, "https://e.com/a", "<main><p>home page</p></main>")], tables.PAGES)
    entries = spark.createDataFrame([("e", "https://e.com/"), ("f", "https://f.com/"), ("g", "https://g.com/")], "crawl_id string, url string")
    maps = spark.createDataFrame([("https://e.com/sitemap.xml", "<urlset><url><loc>https://e.com/a</loc></url></urlset>")], tables.SITEMAPS)
    seen = spark.createDataFrame([("https://e.com/sitemap.xml", 200), ("https://g.com/sitemap.xml", 200)], "url string, status int")
    out = run_plan.run(pages, entries, mode="sitemap", sitemap_bodies=maps, responses=seen)
    got = {r.crawl_id: (r.status, r.error) for r in out.outcomes.collect()}
    assert got["e"] == ("saved", None) and "No sitemap found" in got["f"][1] and "not captured" in got["g"][1]
    assert out.report.count() == 3


def test_links_of_superseded_captures(spark):
    rows = [
        (0, "https://e.com/", '<main><p>first capture</p><a href="/a">a</a></main>'),
        (1, "https://e.com", '<main><p>second capture</p><a href="/b">b</a></main>'),
        (2, "https://e.com/a", "<main><p>page a</p></main>"),
        (3, "https://e.com/b", "<main><p>page b</p></main>"),
    ]
    entries = spark.createDataFrame([("e", "https://e.com/")], "crawl_id string, url string")
    for source in ("html", "markdown"):
        out = run_plan.run(spark.createDataFrame(rows, tables.PAGES), entries, link_source=source)
        assert {r.url_key.rstrip("/") for r in out.outcomes.collect()} == {"https://e.com", "https://e.com/a"}
