"""Golden rows for URL and path columns."""

from pyspark.sql import functions as F

from pagemill.functions import paths, urls

KEYS = [
    ("https://e.com/a/b#c", "https://e.com/a/b", "https://e.com/a/b"),
    ("https://e.com/a/b?q=1", "https://e.com/a/b", "https://e.com/a/b"),
    ("https://e.com/a/", "https://e.com/a/", "https://e.com/a"),
    ("https://e.com", "https://e.com/", "https://e.com/"),
    ("https://e.com/a//", "https://e.com/a//", "https://e.com/a/"),
    ("HTTPS://E.com:443/A", "https://e.com/A", "https://e.com/A"),
    ("http://e.com:80/?x", "http://e.com/", "http://e.com/"),
    ("http://e.com:8080/x", "http://e.com:8080/x", "http://e.com:8080/x"),
    ("https://e.com/a/./b/../c", "https://e.com/a/c", "https://e.com/a/c"),
    ("https://e.com/a/b/..", "https://e.com/a/", "https://e.com/a"),
    ("https://e.com/%2e%2e/x", "https://e.com/x", "https://e.com/x"),
    ("https://e.com/für/a b", "https://e.com/f%C3%BCr/a%20b", "https://e.com/f%C3%BCr/a%20b"),
    ("https://e.com/a+b,c'(d)!", "https://e.com/a+b,c'(d)!", "https://e.com/a+b,c'(d)!"),
    ("https://e.com/%7Ex%2F", "https://e.com/%7Ex%2F", "https://e.com/%7Ex%2F"),
    (" https://e.com/x\n", "https://e.com/x", "https://e.com/x"),
    ("no url", None, None),
    ("ftp://e.com/x", None, None),
    ("https://", None, None),
    ("https://e.com:99999/", None, None),
]


def test_keys(spark):
    df = spark.createDataFrame(KEYS, "url string, n string, k string")
    df = urls.with_url_parts(df, "url")
    for r in df.select("url", "n", "k", urls.normalized().alias("n2"), urls.key().alias("k2")).collect():
        assert (r.n2, r.k2) == (r.n, r.k), r.url


def test_keys_are_idempotent(spark):
    df = spark.createDataFrame([(k[0],) for k in KEYS], "url string")
    once = urls.with_url_key(df, "url", "k1").filter("k1 is not null")
    # The key of a path that ends in two slashes loses one of them each time, as it should.
    twice = urls.with_url_key(once, "k1", "k2").filter("not endswith(url, '//')")
    assert twice.filter("k1 <> k2").count() == 0


def test_errors(spark):
    rows = [
        ("https://e.com", None),
        ("nope", "Invalid URL: nope"),
        ("ftp://a/b", "Unsupported URL scheme: ftp: (only http/https allowed)"),
    ]
    df = urls.with_url_parts(spark.createDataFrame(rows, "url string, e string"), "url")
    for r in df.select("e", urls.url_error(F.col("url"), F.col("host")).alias("e2")).collect():
        assert r.e == r.e2


def test_paths(spark):
    rows = [
        ("https://e.com/docs/api/overview", "/docs/", "api/overview.md"),
        ("https://e.com/docs/getting-started", "/docs/", "getting-started.md"),
        ("https://e.com/docs/", "/docs/", "index.md"),
        ("https://e.com/", None, "index.md"),
        ("https://e.com/Docs/x", "/Docs/", "x.md"),
        ("https://e.com/en/25.html", None, "en/25.html.md"),
        ("https://e.com/docs/guide/a", "/docs/", "guide/a.md"),
        ("https://e.com/docsy/guide//a//b/", "/guide/", "a/b.md"),
    ]
    df = urls.with_url_parts(spark.createDataFrame(rows, "url string, b string, l string"), "url")
    p = F.col("path")
    for r in df.select("*", urls.base_path(p).alias("b2"), paths.local_path(p).alias("l2")).collect():
        assert (r.b2, r.l2) == (r.b, r.l), r.url


def test_numbers_and_dirs(spark):
    rows = [
        ("guides/config.md", 3, "guides/03-config.md", "guides"),
        ("index.md", 1, "01-index.md", ""),
        ("a/b/c.md", 100, "a/b/100-c.md", "a/b"),
    ]
    df = spark.createDataFrame(rows, "p string, n int, o string, d string")
    p = F.col("p")
    out = df.select("o", "d", paths.numbered_path(p, F.col("n")).alias("o2"), paths.dir_path(p).alias("d2"))
    for r in out.collect():
        assert (r.o2, r.d2) == (r.o, r.d)


def test_md_urls(spark):
    rows = [
        ("https://e.com/a", "https://e.com/a.md", "https://e.com/a.md"),
        ("https://e.com/a/", "https://e.com/a.md", "https://e.com/a.md"),
        ("https://e.com/a.md", "https://e.com/a.md", "https://e.com/a.md"),
        ("https://e.com/a.mdx", "https://e.com/a.mdx.md", "https://e.com/a.mdx"),
        ("https://e.com/", "https://e.com/.md", "https://e.com/.md"),
    ]
    df = urls.with_url_parts(spark.createDataFrame(rows, "url string, a string, b string"), "url")
    for r in df.select("a", "b", urls.md_url().alias("a2"), urls.md_url(keep_mdx=True).alias("b2")).collect():
        assert (r.a2, r.b2) == (r.a, r.b)


def test_resolve(spark):
    rows = [
        ("https://o.com/z", "https://o.com/z"),
        ("//h/p", "https://h/p"),
        ("/p", "https://e.com/p"),
        ("p", "https://e.com/docs/p"),
        ("../p", "https://e.com/p"),
        ("../../p", "https://e.com/p"),
        ("./p", "https://e.com/docs/p"),
        ("?q", "https://e.com/docs/a?q"),
        ("#f", "https://e.com/docs/a?x=1#f"),
        ("/für", "https://e.com/f%C3%BCr"),
        ("/a b?c d", "https://e.com/a%20b?c%20d"),
        ("\\x", "https://e.com/x"),
        ("mailto:x", "mailto:x"),
        ("tel:1", "tel:1"),
        ("https://", None),
    ]
    df = spark.createDataFrame(rows, "r string, o string").withColumn("u", F.lit("https://e.com/docs/a?x=1"))
    df = urls.with_resolved(urls.with_url_parts(df, "u", "b_"), "b_", "r")
    for r in df.collect():
        assert r.to_url == r.o, r.r


def test_safe_paths(spark):
    rows = [
        ("a/b.md", True), ("../x", True), ("a/../../x", False), ("/abs", False), ("./a", True),
        ("out/../out/x", True), ("out/..x", False), ("out/../x", False), ("out/a/../b", True),
    ]
    df = spark.createDataFrame(rows, "p string, ok boolean")
    for r in df.select("*", paths.is_safe_path(F.col("p")).alias("ok2")).collect():
        assert r.ok2 == r.ok, r.p
