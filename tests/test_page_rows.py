"""What the steps from pages to tokens and Markdown read, carry and repeat."""

import re

from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.operators import markdown, tokens
from pagemill.plans import pages as plan


def pages(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id long, url string, html string")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_pages_are_taken_apart_once(spark):
    df = tokens.html_tokens(pages(spark, (1, "https://a.example/", "<p>x")))
    assert optimized(df).count("regexp_extract_all(") == 1


def test_empty_pages_are_one_token(spark):
    df = tokens.html_tokens(pages(spark, (1, "u", ""), (2, "u", None), (3, "u", "x")))
    found = [(r.page_id, r.pos, r.tag_text, r.text, r.tag, r.kind) for r in df.orderBy("page_id").collect()]
    assert found == [(1, 0, "", "", None, "text"), (2, 0, "", "", None, "text"), (3, 0, "", "x", None, "text")]


def test_code_blocks_sort_no_page_columns_and_resolve_no_links(spark):
    df = markdown.code_blocks(plan.main_tokens(pages(spark, (1, "https://a.example/", "<pre><code>x</code></pre>"))), plan.ROW, carry=["page_id"])
    text = df._jdf.queryExecution().sparkPlan().toString()
    windows = [line for line in text.split("\n") if "Window [" in line]
    assert windows
    # Code has no links: what resolves them goes, and nothing between the windows of the content upsets their order.
    content = text[: text.index("nth_value") if "nth_value" in text else text.index("first(__of_page")]
    assert "Generate" not in content
    # The parts of the page's URL are in no row that is sorted.
    explode = [line for line in text.split("\n") if "Generate explode" in line or "Generate posexplode" in line]
    assert len(explode) == 1 and "from_" not in re.sub(r".*Generate posexplode\(\S+ ", "", explode[0])


def test_page_columns_reach_all_content_tokens(spark):
    html = "<nav>n</nav><main>a<p>b<a href='x'>c</a></main>t"
    df = plan.main_tokens(pages(spark, (1, "https://a.example/d/", html), (1, "https://a.example/d/", html), (None, None, html)), carry=["url"])
    rows = df.groupBy("page_id", "url", "host", "config_key", *plan.ROW).count().collect()
    assert sorted((r.page_id or 0, r.url or "", r.host or "", r.config_key, r["count"]) for r in rows) == [
        (0, "", "", "__default__", 4),
        (1, "https://a.example/d/", "a.example", "__default__", 4),
        (1, "https://a.example/d/", "a.example", "__default__", 4),
    ]
    md = plan.pages_to_markdown(pages(spark, (1, "https://a.example/d/", html), (None, None, "")))
    got = {r.page_id: (r.url, r.host, r.framework, r.config_key) for r in md.collect()}
    assert got == {1: ("https://a.example/d/", "a.example", "custom", "__default__"), None: (None, None, "custom", "__default__")}


def test_expression_resolves_like_columns(spark):
    bases = ["https://e.com/a/b?q=1#f", "http://e.com:8080/ü/./c/../d", "https://e.com", "no url", None]
    refs = ["x", "../x y", "/p?a=b c#d e", "//h.example/%7e", "?q=ü", "#z", "", " \t", "mailto:a@b.c", "HTTP:\\\\e.com\\p", "https://e.com:99999/", "https://[::1]/", "./..//.", "%2e%2E/k", None]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "u string, r string")
    df = urls.with_resolved(urls.with_url_parts(df, "u", "b_"), "b_", "r")
    assert df.filter(~F.col("to_url").eqNullSafe(urls.resolved("b_", F.col("r")))).count() == 0
    assert df.filter(F.col("to_url").isNotNull()).count() > 30
