"""Responses, sinks, streaming, the whole run, and the shape of its plans."""

import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.operators import crawl, links, responses, sitemaps
from pagemill.plans import pages as plan
from pagemill.plans import run as run_plan
from pagemill.session import materialize_bucketed
from pagemill.sources import sinks, tables
from pagemill.streaming import arrivals

RESPONSES = "url string, adapter string, status int, content_type string, body string"


def choose(spark, rows, **options):
    df = spark.createDataFrame(rows, RESPONSES)
    return {r.url: r for r in responses.choose_response(df, **options).collect()}


def test_first_usable_response_wins(spark):
    u, v, w = "https://docs.anthropic.com/a", "https://nextjs.org/b", "https://e.com/c"
    rows = [
        (u, "md-endpoint", 200, "text/html", "# A good page"),
        (u, "mdx", 200, None, "<!DOCTYPE html>"),
        (u, "jina", 200, None, "from reader"),
        (u, "playwright", 200, None, "from page"),
        (v, "md-endpoint", 200, None, "# not asked for this host"),
        (v, "mdx", 200, None, "source"),
        (w, "jina", 500, None, "x"),
        (w, "playwright", 200, None, "Just a moment..."),
    ]
    got = choose(spark, rows, use_reader=True)
    assert (got[u].adapter, got[u].body) == ("jina", "from reader")
    assert got[u].errors == (
        "md-endpoint: Received HTML instead of Markdown (Content-Type)\nmdx: HTML returned, not markdown"
    )
    assert got[v].adapter == "mdx" and got[v].errors == ""
    assert got[w].adapter is None and got[w].blocked_reason == "bot-detection"
    assert got[w].errors == "jina: Jina Reader error: 500 \nplaywright: Content blocked by e.com (bot detection)"
    assert choose(spark, rows)[u].adapter == "playwright"
    assert choose(spark, rows, use_md=True)[v].adapter == "md-endpoint"


@pytest.mark.parametrize(
    "status,kind,body,error",
    [
        (404, None, "x", "Fetch failed: 404 https://e.com/a.md"),
        (200, "application/json", "x", "Received JSON instead of Markdown"),
        (200, "text/html", "# x", "Received HTML instead of Markdown (Content-Type)"),
        (200, "text/html; text/markdown", "# long enough", None),
        (200, "text/plain", " <HTML>long enough", "Received HTML instead of Markdown"),
        (200, "text/plain", " [a](b) long", "Received JSON instead of Markdown"),
        (200, "text/plain", "# short  ", "Response too short to be valid Markdown"),
        (200, None, None, "Response too short to be valid Markdown"),
        (200, None, "# just right", None),
    ],
)
def test_md_checks(spark, status, kind, body, error):
    df = spark.createDataFrame([("https://e.com/a", "md-endpoint", status, kind, body)], RESPONSES)
    assert responses.with_response_error(df).first().error == error


SITE = [
    (0, "https://e.com/docs/", '<body><main><h1>Home</h1><a href="/docs/a">a</a> <a href="/docs/b?x">b</a> <a href="/docs/gone">g</a></main></body>'),
    (1, "https://e.com/docs/a", '<body><main><h1>A</h1><a href="/docs/">up</a> <a href="c/d">d</a></main></body>'),
    (2, "https://e.com/docs/b", "<body><main>Just a moment...</main></body>"),
    (3, "https://e.com/docs/c/d", '<body><main><h2>D</h2><a href="/docs/far">f</a></main></body>'),
    (4, "https://e.com/docs/b/", "<body><main>second capture of b</main></body>"),
    (5, "https://e.com/docs/far", "<body><main>far</main></body>"),
]


def site(spark):
    return spark.createDataFrame(SITE, tables.PAGES)


@pytest.mark.parametrize("source", ["html", "markdown"])
def test_link_run(spark, source):
    entries = spark.createDataFrame([("e", "https://e.com/docs/")], "crawl_id string, url string")
    out = run_plan.run(site(spark), entries, depth=2, link_source=source, numbered=True)
    status = {r.url_key.split("/docs")[1]: (r.depth, r.status) for r in out.outcomes.collect()}
    assert status == {
        "": (0, "saved"), "/a": (1, "saved"), "/b": (1, "blocked"), "/gone": (1, "failed"), "/c/d": (2, "saved"),
    }
    files = {r.local_path: r.markdown for r in out.files.collect()}
    assert set(files) == {"01-index.md", "02-a.md", "c/01-d.md"}
    assert files["c/01-d.md"].startswith("## D")
    assert tuple(out.report.first())[1:] == (5, 3, 1, 1)


def test_sitemap_run(spark):
    entries = spark.createDataFrame([("e", "https://e.com/docs/")], "crawl_id string, url string")
    maps = spark.createDataFrame(
        [
            ("https://e.com/sitemap_index.xml", "<sitemapindex><sitemap><loc>https://e.com/s1.xml</loc></sitemap></sitemapindex>"),
            ("https://e.com/s1.xml", "<urlset><url><loc>https://e.com/docs/a</loc></url><url><loc>https://e.com/docs/a/</loc></url><url><loc>https://e.com/blog/</loc></url><url><loc>https://e.com/docs/none</loc></url></urlset>"),
        ],
        tables.SITEMAPS,
    )
    seen = spark.createDataFrame(
        [("https://e.com/sitemap.xml", 404), ("https://e.com/sitemap_index.xml", 200)], "url string, status int"
    )
    out = run_plan.run(site(spark), entries, mode="sitemap", sitemap_bodies=maps, responses=seen)
    assert {r.url_key: r.status for r in out.outcomes.collect()} == {
        "https://e.com/docs/a": "saved", "https://e.com/docs/none": "failed",
    }
    assert [r.local_path for r in out.files.collect()] == ["a.md"]


def test_sinks(spark, tmp_path):
    rows = [("e.com", "a/b.md", "# B"), ("e.com", "../x.md", "no"), ("f.com", "c.md", "ü")]
    df = spark.createDataFrame(rows, "host string, local_path string, markdown string")
    sinks.write_markdown(df, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 3
    assert sorted(os.listdir(tmp_path / "table"))[-2:] == ["host=e.com", "host=f.com"]
    written = sinks.export_files(df, str(tmp_path / "files")).collect()
    assert {(r.path, r.n_bytes) for r in written} == {("a/b.md", 3), ("c.md", 2)}
    assert (tmp_path / "files" / "c.md").read_text(encoding="utf-8") == "ü"
    assert not (tmp_path / "x.md").exists()
    assert sinks.split_safe(df)[1].count() == 1


def test_sitemap_files_are_read_in_parts(spark, tmp_path):
    import gzip

    site_ = tmp_path / "maps" / "e.com"
    (site_ / "deep").mkdir(parents=True)
    entries = "\n".join(f"<url>\n <loc> https://e.com/docs/{i} </loc><lastmod>x</lastmod></url>" for i in range(50_000))
    (site_ / "big map.xml").write_text(f"<?xml version='1.0'?><urlset>{entries}</urlset>")
    with gzip.open(site_ / "small.xml.gz", "wt") as f:
        f.write("<urlset><url><loc>https://e.com/a</loc></url><url><x/><loc>https://e.com/b</loc></url><url><loc>no url</loc></url></urlset>")
    index = "".join(f"<sitemap><loc>https://e.com/{n}</loc></sitemap>" for n in ("big map.xml", "small.xml", "gone.xml", "deep/none.xml"))
    (site_ / "index.xml").write_text(f"<sitemapindex>{index}</sitemapindex>")
    (site_ / "deep" / "none.xml").write_text("<urlset></urlset>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400k")
    try:
        records = tables.read_sitemap_files(spark, str(tmp_path / "maps"))
        big = records.filter("kind = 'page' AND sitemap_url LIKE '%big%'").select(F.spark_partition_id().alias("p"), "pos", "loc")
        assert big.select("p").distinct().count() > 5
        kinds, children, pages = sitemaps.from_records(records)
        locs = [r.loc for r in pages.filter("sitemap_url LIKE '%big%'").orderBy("pos").collect()]
        assert locs == [f"https://e.com/docs/{i}" for i in range(50_000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    roots = spark.createDataFrame([("c", "https://e.com/index.xml")], "crawl_id string, sitemap_url string")
    reached, missing = sitemaps.expand_links(kinds, children, roots)
    name = lambda df: sorted(r.sitemap_url for r in df.collect())
    assert name(reached) == ["https://e.com/big map.xml", "https://e.com/deep/none.xml", "https://e.com/small.xml"]
    assert name(missing) == ["https://e.com/gone.xml"]
    assert [r.loc for r in pages.filter("sitemap_url LIKE '%small%'").collect()] == ["https://e.com/a"]
    whole = tables.read_sitemaps(spark, str(tmp_path / "maps"), fmt="xml-files")
    assert sorted(r.sitemap_url for r in whole.collect()) == sorted(r.sitemap_url for r in kinds.collect())


def test_short_sitemap_files_are_read_once(spark, tmp_path, monkeypatch):
    folder = tmp_path / "maps" / "e.com"
    folder.mkdir(parents=True)
    bodies = {"a": "<urlset><url><loc>https://e.com/1</loc></url><url><loc>https://e.com/ü</loc></url></urlset>", "b": "<url><loc>https://e.com/2</loc>", "c": "", "d": "<loc></loc>",
        "e": "<sitemapindex><sitemap><loc>https://e.com/a.xml</loc></sitemap></sitemapindex>"}
    for name, body in bodies.items():
        (folder / f"{name}.xml").write_text(body, encoding="utf-8")
    (folder / "plain").write_text(bodies["a"], encoding="utf-8")
    read = lambda: sorted(tables.read_sitemap_files(spark, str(tmp_path / "maps")).select("sitemap_url", "index", "kind", "loc").collect(), key=str)
    whole = read()
    monkeypatch.setattr(tables, "_SHORT_FILE", -1)
    assert read() == whole and len(whole) == 10
    monkeypatch.undo()
    kinds, children, pages = sitemaps.from_records(tables.read_sitemap_files(spark, str(tmp_path / "maps")))
    for df in (kinds, children, pages):  # the files have been read by then
        assert str(folder) not in "".join(df.inputFiles())
    assert sorted(r.loc for r in pages.collect()) == ["https://e.com/1", "https://e.com/1", "https://e.com/2", "https://e.com/ü", "https://e.com/ü"]
    assert [r.child for r in children.collect()] == ["https://e.com/a.xml"]


def test_sitemap_files_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    import bz2
    import gzip
    import random

    rng = random.Random(7)
    folder = tmp_path / "maps"
    bits = ["</loc>", "</loc", "<url><loc>", "<url> <loc>", "<sitemap><loc>", "<sitemapindex>", "https://e.com/ü", "a", "x" * 300, "</loc></loc>", "\n", "\ufeff"]
    body = lambda n: "".join(rng.choice(bits) for _ in range(n)).encode()
    for n, name in enumerate(["e.com/a.xml", "e.com/é+ %2B [x]{y}*?.xml", "e.com/plain", "f.com/a/b/c/d.xml", "f.com/a/_d=1.xml", "f.com/_metadata_of/x.xml"]):
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(body(n * 40))
    for name in ("e.com/_hidden.xml", "e.com/.x.xml", "e.com/x._COPYING_", "_e.com/a.xml", "f.com/_metadata"):
        (folder / name).parent.mkdir(exist_ok=True)
        (folder / name).write_bytes(b"<url><loc>no</loc>")
    (folder / "e.com/g.xml.gz").write_bytes(gzip.compress(body(99)) + gzip.compress(body(99)))  # two members
    (folder / "e.com/[b]*.xml.bz2").write_bytes(bz2.compress(body(99)))
    (folder / "e.com/cut.xml").write_bytes("ü".encode()[:1] + b"</loc><url><loc>\xff\xfe</loc>")

    def read(df):
        return sorted((r.sitemap_url, *r.pos, r["index"], r.kind, bytes(r["loc"]) if r["loc"] is not None else None) for r in df.withColumn("loc", F.col("loc").cast("binary")).collect())

    def of_files(rows):
        return [(url, *rest) for url, _, _, *rest in rows]

    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for short, part in ((1 << 20, "128m"), (-1, "997b"), (-1, "3b")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", part)
            monkeypatch.setattr(tables, "_SHORT_FILE", short)
            got = tables.read_sitemap_files(spark, str(folder))
            assert not [x for x in got.inputFiles() if "/maps/" in x and ".bz2" not in x]  # no list of them in the driver
            rows = read(got)
            if part == "128m":
                with monkeypatch.context() as m:
                    m.setattr(tables.folders, "address", lambda *_: None)
                    whole = of_files(read(tables.read_sitemap_files(spark, str(folder))))
            assert of_files(rows) == whole and len({x[0] for x in whole}) == 8 and len(whole) > 100
        _, children, pages = sitemaps.from_records(tables.read_sitemap_files(spark, str(folder)))
        for df in (children, pages):  # nor of the indexes among them
            assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
        empty = tmp_path / "none"
        empty.mkdir()
        assert tables.read_sitemap_files(spark, f"file:{empty}/").count() == 0
        assert of_files(read(tables.read_sitemap_files(spark, f"{tmp_path}/m*s"))) != []  # a pattern is Spark's to read
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_rejects_are_kept_and_counted(spark, tmp_path):
    lines = ['{"url": "https://e.com/a", "adapter": "mdx", "status": 200, "body": "x"}', '{"url": "https://e.com/b", "adapter": "mdx"', "not json", '{"url": " ", "adapter": "mdx"}',
        '{"url": "https://e.com/c", "status": "many", "adapter": "jina"}', '{"url": "https://e.com/d"}', '{"url": "https://e.com/e", "adapter": "ftp"}']
    (tmp_path / "r.json").write_text("\n".join(lines))
    seen = Observation()
    df = tables.counted(tables.read_checked_responses(spark, str(tmp_path / "r.json")), seen)
    got = [(r.url, r.reject, r.record) for r in df.collect()]
    assert [r for _, r, _ in got] == [None, "unreadable record", "unreadable record", "no url", "unreadable record", "no adapter", "unknown adapter: ftp"]
    assert [x for _, _, x in got if x] == [lines[1], lines[2], lines[4]]
    assert seen.get == {"rows": 7, "rejected": 6}
    spark.createDataFrame([("https://e.com/a", "mdx", 200, None, "x"), (None, "mdx", 200, None, "x")], RESPONSES).write.parquet(str(tmp_path / "p"))
    assert tables.read_checked_responses(spark, str(tmp_path / "p"), "parquet").filter("reject IS NULL").count() == 1


def test_export_replaces_and_failed_jobs_leave_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    rows = [(i, f"d{i % 3}/p{i}.md", f"text {i}") for i in range(40)]
    df = spark.createDataFrame(rows, "i int, local_path string, markdown string").repartition(4)
    assert sinks.export_files(df, str(folder)).count() == 40
    again = df.filter("i < 5").withColumn("markdown", F.lit(None).cast("string"))
    assert {r.n_bytes for r in sinks.export_files(again, str(folder)).collect()} == {0}
    assert (folder / "d0/p3.md").read_text() == "" and (folder / "d0/p9.md").read_text() == "text 9"
    # A row that fails, the last of its task: neither what this task nor what other tasks wrote is left.
    bad = df.withColumn("local_path", F.concat(F.lit("new/"), "local_path")).sortWithinPartitions("i")
    bad = bad.withColumn("markdown", F.when(F.col("i") == 39, F.raise_error(F.lit("torn page"))).otherwise(F.col("markdown")))
    with pytest.raises(Exception, match="torn page"):
        sinks.export_files(bad, str(folder))
    left = [p for p in folder.rglob("*.md")]
    assert len(left) == 40 and not [p for p in left if "new" in str(p)]
    assert sum(r.n_bytes for r in sinks.export_files(df, f"file://{folder}").collect()) == sum(len(t) for _, _, t in rows)


def test_tasks_that_go_on_after_their_job_failed_leave_nothing(tmp_path, monkeypatch):
    from pagemill.sources import files

    class Late(files.FilesWriter):
        def _list(self, *args):
            super()._list(*args)
            if self.run == "list":
                self.abort([])

    def rows(run):
        yield "a/1.md", "x"
        if run == "rows":
            Late(str(tmp_path), run).abort([])
        yield "2.md", "y"

    asked, told = [], files.FilesWriter._aborted
    for run in ("rows", "list", "move"):
        writer = Late(str(tmp_path), run)
        if run == "move":

            def aborted(self, store, root):
                asked.append(1)
                if len(asked) == 4:  # two files are written, one is moved
                    self.abort([])
                return told(self, store, root)

            monkeypatch.setattr(files.FilesWriter, "_aborted", aborted)
        with pytest.raises((RuntimeError, OSError)):
            writer.write(rows(run))
        assert not [*tmp_path.rglob("*.md"), *tmp_path.rglob("*.json")]
    monkeypatch.undo()
    assert files.FilesWriter(str(tmp_path), "next").write(rows("next")).name and len([*tmp_path.rglob("*.md")]) == 2


def test_arrivals(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    site(spark).filter("page_id < 3").write.parquet(source)
    for extra in (None, "page_id >= 3"):
        if extra:
            site(spark).filter(extra).write.mode("append").parquet(source)
        arrivals.convert_arrivals(arrivals.read_arriving_pages(spark, source), target, state).awaitTermination()
    out = spark.read.parquet(target)
    assert out.count() == out.select("url_key").distinct().count() == 5


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pipeline_has_one_shuffle_and_no_python(spark):
    text = plan_text(plan.pages_to_markdown(site(spark)))
    assert text.count("Exchange hashpartitioning") == 1
    assert "Exchange" not in text.replace("Exchange hashpartitioning", "")
    assert "Python" not in text and "Join" not in text


@pytest.fixture
def shuffled(spark):
    """Joins by shuffle or buckets only, as for tables too large to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_levels_fetch_without_a_shuffle(shuffled):
    responses = shuffled.createDataFrame([("https://e.com/docs/a", "mdx", 200, None, "x")], RESPONSES)
    captures = run_plan.Captures.of(site(shuffled), responses, False, True)
    keys = urls.with_url_key(site(shuffled).select("url"), "url").dropDuplicates(["url_key"])
    keys = materialize_bucketed(keys, "url_key")
    text = plan_text(captures.fetch(keys))
    # Pages and responses lie in buckets of their key; fetching and converting what is asked for moves none of them.
    assert "Exchange" not in text and "Python" not in text and "SortMergeJoin" in text


def test_crawl_leaves_edges_and_levels_in_place(shuffled):
    edges = [(f"p{i}", f"p{j}", f"u{j}", k) for i in range(40) for k, j in enumerate((2 * i, 2 * i + 1, 7))]
    edges = shuffled.createDataFrame(edges, "src_key string, dst_key string, dst_url string, pos int")
    entries = shuffled.createDataFrame([("c", "p1", "u1"), ("d", "p3", "u3"), (None, "p5", "u5")], "crawl_id string, url_key string, url string")
    cells, hubs = crawl.bucketed_edges(edges)
    levels = [crawl.start(entries)]
    found = crawl.follow(levels[0], cells, hubs)
    text = plan_text(found)
    # Only the frontier moves; the scan of the edges is read by buckets, right below its join.
    assert text.count("Exchange hashpartitioning(cell") == 1 and text.count("Bucketed: true") == 1
    new = crawl.next_level(found, 1, levels)
    text = plan_text(new.join(levels[0].select("node"), "node", "left_anti"))
    assert "Exchange" not in text
    out = crawl.crawl(edges, entries, 3)
    assert out.count() == out.select("crawl_id", "url_key").distinct().count()


def test_hubs_are_dealt_over_cells(spark, monkeypatch):
    monkeypatch.setattr(crawl, "HUB", 50)
    rows = [("hub", f"p{i}", f"u{i}", i) for i in range(1000)] + [(f"p{i}", "hub", "uh", 0) for i in range(1000)] + [("p3", "far", "f", 1)]
    edges = spark.createDataFrame(rows, "src_key string, dst_key string, dst_url string, pos int")
    entries = spark.createDataFrame([("c", "hub", "uh")], "crawl_id string, url_key string, url string")
    cells, hubs = crawl.bucketed_edges(edges)
    assert [tuple(r) for r in hubs.collect()] == [("hub", 20)]
    assert cells.filter("src_key = 'hub'").select("cell").distinct().count() == 20
    got = {r.url_key: (r.depth, r.pos) for r in crawl.crawl(edges, entries, 2).collect()}
    assert len(got) == 1002 and got["p7"] == (1, 7) and got["far"] == (2, 1)


RANKED = [
    ("https://nextjs.org/docs/", "mdx", 200, None, "[a](/docs/a) and [b](/docs/b) [c](/docs/c) [up](https://nextjs.org/docs)"),
    ("https://nextjs.org/docs/a", "mdx", 404, None, None),
    ("https://nextjs.org/docs/a/", "jina", 200, None, "reader text [d](/docs/d)"),
    ("https://nextjs.org/docs/b", "mdx", 200, None, "<!DOCTYPE html>"),
    ("https://nextjs.org/docs/c", "playwright", 403, None, "x"),
    ("https://nextjs.org/docs/d", "playwright", 200, None, "finished text of d"),
    ("https://nextjs.org/docs/d", "playwright", 200, None, "another finished text of d"),
]
RANKED_PAGES = [
    (None, "https://nextjs.org/docs/", "<main>never converted</main>"),
    (1, "https://nextjs.org/docs/b", "<main><p>b from its page</p><a href='/docs/e'>e</a></main>"),
    (1, "https://nextjs.org/docs/b#x", "<main><p>second capture</p></main>"),
    (2, "https://nextjs.org/docs/e", "<main><p>Just a moment...</p></main>"),
    (2, "https://nextjs.org/docs/d", "<main><p>d from its page</p></main>"),
]


@pytest.mark.parametrize("reader", [False, True])
def test_run_over_ranked_responses(spark, reader):
    pages = spark.createDataFrame(RANKED_PAGES, tables.PAGES)
    answers = spark.createDataFrame(RANKED, RESPONSES)
    entries = spark.createDataFrame([("n", "https://nextjs.org/docs/"), ("m", "https://nextjs.org/docs/a")], "crawl_id string, url string")
    out = run_plan.run(pages, entries, depth=2, responses=answers, use_reader=reader)
    got = {(r.crawl_id, r.url_key.rsplit("/", 1)[1]): r for r in out.outcomes.collect()}
    status = {k: (r.depth, r.status, r.adapter) for k, r in got.items()}
    want = {("n", "docs"): (0, "saved", "mdx"), ("n", "b"): (1, "saved", "playwright"), ("n", "c"): (1, "failed", None), ("n", "e"): (2, "blocked", None)}
    if reader:
        want |= {("n", "a"): (1, "saved", "jina"), ("n", "d"): (2, "saved", "playwright"), ("m", "a"): (0, "saved", "jina"), ("m", "d"): (1, "saved", "playwright")}
    else:
        want |= {("n", "a"): (1, "failed", None), ("m", "a"): (0, "entry_failed", None)}
    assert status == want
    assert got["n", "b"].tried == "mdx: HTML returned, not markdown" and got["n", "e"].reason == "bot-detection"
    assert got["n", "c"].error == "All adapters failed for https://nextjs.org/docs/c:\nplaywright: Fetch failed: 403 https://nextjs.org/docs/c"
    files = {(r.crawl_id, r.local_path): r.markdown for r in out.files.collect()}
    assert files["n", "b.md"].startswith("b from its page") and "never converted" not in "".join(files.values())
    assert not reader or files["n", "d.md"] == files["m", "d.md"] == "d from its page"


def test_run_keeps_pages_with_repeated_ids(spark):
    rows = [(1, "https://e.com/docs/", "<main><p>home</p><a href='a'>a</a></main>"), (1, "https://e.com/docs/a", "<main>a</main>"), (None, "https://e.com/docs/a/", "<main>late</main>")]
    entries = spark.createDataFrame([("e", "https://e.com/docs/")], "crawl_id string, url string")
    for source in ("html", "markdown"):
        out = run_plan.run(spark.createDataFrame(rows, tables.PAGES), entries, link_source=source)
        assert {(r.local_path, r.markdown.split("\n")[0]) for r in out.files.collect()} == {("index.md", "home"), ("a.md", "a")}


def test_unsafe_paths_and_blocking_hosts_show_in_outcomes(spark):
    rows = [("c", u, u, 0 if i == 0 else 1, None, 0, "saved", None, None, "playwright", None) for i, u in enumerate(("https://platform.openai.com/docs/", "https://e.com/docs/%2e%2e/x", "https://e.com/docs/a"))]
    df = spark.createDataFrame(rows, "crawl_id string, url_key string, url string, depth int, parent_key string, pos int, status string, reason string, error string, adapter string, tried string")
    df = df.withColumn("url", F.when(F.col("url").contains("%2e"), F.lit("https://e.com/docs/..%2F")).otherwise(F.col("url")))
    got = [(r.status, r.local_path, r.may_be_blocked) for r in run_plan.guarded(df).orderBy("url_key").collect()]
    assert got == [("failed", None, False), ("saved", "a.md", False), ("saved", "index.md", True)]
    assert run_plan.guarded(df).filter("status = 'failed'").first().error == "Path traversal detected: ..%2F.md"


def test_links_are_extracted_without_a_shuffle(spark):
    text = plan_text(links.extract_links(site(spark)))
    assert "Exchange" not in text and "Python" not in text


def test_scan_reads_only_what_is_needed(spark, tmp_path):
    site(spark).write.parquet(str(tmp_path / "p"))
    text = plan_text(tables.read_pages(spark, str(tmp_path / "p")).filter(F.col("page_id") > 3).select("url"))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in text and "GreaterThan(page_id,3)" in text


def test_result_does_not_depend_on_the_order_of_input(spark):
    one = plan.pages_to_markdown(site(spark)).select("page_id", "markdown")
    two = plan.pages_to_markdown(site(spark).orderBy(F.desc("page_id")).repartition(3)).select("page_id", "markdown")
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in two.collect()}
