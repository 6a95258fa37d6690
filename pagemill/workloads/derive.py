"""Inputs derived from the page table, row by row.

The expressions are plain SQL that Spark and a reference database read alike, so both
start from the same input. The pages as supplied hold no documentation words, no framework
marks and no links between captured pages; these expressions put them in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import urls

# Language segments become documentation words; Spanish pages stay outside.
DOC_URL = (
    "replace(replace(replace(url, '/en/', '/docs/'), '/fr/', '/x/Guide/'), '/de/', '/api/v1/')"
)

# Spellings of a URL that the parser has to see through, and some that are none.
ODD_URL = """CASE page_id % 9
  WHEN 0 THEN replace(url, '.example.', '.EXAMPLE.')
  WHEN 1 THEN replace(replace(url, '.com/', '.com:443/'), '.org/', '.org:8080/')
  WHEN 2 THEN concat('ftp', substring(url, 5))
  WHEN 3 THEN replace(url, 'http', 'HTTP')
  WHEN 4 THEN concat('no url ', url)
  WHEN 5 THEN replace(url, '/en/', '/für den Weg/%7Ea/')
  WHEN 6 THEN replace(url, '/en/', '/a/./b/../c/')
  WHEN 7 THEN concat(' ', url)
  ELSE url END"""

# References as a page may hold them.
REFS = [
    "concat('/p/', page_id)",
    "concat('q-', page_id)",
    "'../up'",
    "'./same/'",
    "concat('?page=', page_id)",
    "'#part'",
    "'//cdn.example.net/x'",
    "concat('https://other.example.org/', page_id, '/a/../b?x=1#y')",
    "'/für den'",
    "'mailto:a@example.org'",
    "''",
]

LINKS_HTML = """concat(html, '<p>[next](next-', page_id, ') [up](../up?q=1#f) [t](/p "T")',
  ' ![i](/i', page_id, '.PNG) [m](mailto:a@b.c) [a](<https://auto.example>)',
  ' <a href=', chr(39), 'single.html', chr(39), '>x</a>',
  ' <a href="//img.example.net/badge/x">b</a> <a href="https://other.example.net/docs/q">o</a>',
  ' [d](/docs) [w](/docs/within) <a href="a/../b/">d</a> [e](?page=3) <a href="#top">z</a>',
  ' [again](next-', page_id, ') <a href="javascript:void(0)">j</a></p>')"""

SITE_HOST = """CASE page_id % 11
  WHEN 0 THEN 'docs.anthropic.com' WHEN 1 THEN 'eu.code.claude.com'
  WHEN 2 THEN 'nextjs.org' WHEN 3 THEN 'notvercel.com'
  WHEN 4 THEN 'developers.cloudflare.com' WHEN 5 THEN 'platform.openai.com'
  WHEN 6 THEN 'docs.x.ai' WHEN 7 THEN 'developers.openai.com'
  ELSE concat('site', page_id % 97, '.example.com') END"""
SITE_URL = f"concat('https://', {SITE_HOST}, '/docs/', page_id)"

# Framework marks around the article, and content of every kind inside it.
_ARTICLE = """CASE page_id % 10
  WHEN 1 THEN '<article class="a theme-doc-markdown"><div class="pagination-nav">pn</div>'
  WHEN 2 THEN '<!-- vitepress.css --><article class="vp-doc content">'
  WHEN 3 THEN '<article class="sl-markdown-content" data-starlight="1">'
  WHEN 4 THEN '<article class="md-content" data-md-component="content"><i class="md-nav">mn</i>'
  WHEN 5 THEN '<a href="https://www.sphinx-doc.org/x">s</a><article role="main" class="document">'
  WHEN 6 THEN '<main class="gitbook-root xpage-width-defaulty"><article>'
  WHEN 7 THEN '<meta name="generator" content="Docusaurus v3"><article>'
  WHEN 8 THEN '<!-- made with vitepress --><article>'
  WHEN 9 THEN '<div class="vp-docs">no</div><div class="document md-nav">tie</div><article>'
  ELSE '<article>' END"""
SIDEBAR = '<div class="sidebar toc"><div>side</div>bar</div>'
_SNIPPET = f"""concat('{SIDEBAR}<h2>Part ', page_id, '</h2>',
  '<ul><li>one</li><li>two <em>x</em><ul><li>deep</li></ul></li></ul>',
  '<ol start="3"><li>a</li><li>b</li></ol>',
  '<div class="language-js"><span class="lang">js</span><pre><code>let a = ', page_id, ';</code></pre></div>',
  '<pre><code class="language-py">x_1 &lt; ', page_id, '</code></pre><pre><code>plain</code></pre>',
  '<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>',
  '<blockquote><p>q1</p><p>q2</p></blockquote><hr>',
  '<p><a href="/p?a=1" title="T">link</a> <a href="rel/', page_id, '">r</a> <a href="#f">f</a> <img src="i.png" alt="pic">',
  ' <img src="data:x"> <a href=', chr(39), '/single', chr(39), '>s</a> <code>c_d</code> <del>old</del></p>',
  '<noscript>no<b>js</b></noscript><astro-island>isle</astro-island>')"""
RICH_HTML = f"replace(html, '<article>', concat({_ARTICLE}, {_SNIPPET}))"

FOOTER = """concat(text, CASE doc_id % 8
  WHEN 0 THEN concat(chr(10), '-   **Resources**', chr(10), '-   [a](b)', chr(10), '-   **Support**', chr(10), '## Keep')
  WHEN 1 THEN concat(chr(10), '- **Support**', chr(10), 'x', chr(10), '- **Company**', chr(10), 'y', chr(10), '- **Other** z')
  WHEN 2 THEN concat(chr(10), '-   © 2024 Some Corp.', chr(10), '-   [Privacy Policy](/p)', chr(10), 'end')
  WHEN 3 THEN concat(chr(10), '- [terms of use](/t) x', chr(10), '- [Trademark](/t)', chr(10), '- [Report Security Issues](/r)')
  WHEN 4 THEN concat(chr(10), 'Last updated 3 days ago', chr(10), 'Was this helpful?', chr(10))
  WHEN 5 THEN concat(chr(10), '-  ![privacy options](x.png) Cookie Settings', chr(10), 'Last updated by me', chr(10), '- **Tools**', chr(10), '- **Community** c')
  ELSE '' END)"""
HEADINGS = """concat(text, chr(10), '## ', chr(10), chr(10), '[](#a', doc_id, ')', chr(10), chr(10), 'Title ', doc_id,
  chr(10), chr(10), chr(10), chr(10), 'x', chr(10), '# One', chr(10), chr(10), '[](#b)', chr(10), chr(10), 'Keep', chr(10))"""
BLANKS = """concat(chr(10), text, chr(10), chr(10), chr(10), chr(10), CASE doc_id % 3 WHEN 0 THEN concat('x', chr(10)) ELSE '  ' END, chr(10), chr(10), chr(10), '- y', chr(10))"""
SUSPECT = """CASE doc_id % 12
  WHEN 0 THEN '  ' WHEN 1 THEN concat(text, ' Cloudflare Ray ID: ', doc_id)
  WHEN 2 THEN concat('cf_chl_opt ', text) WHEN 3 THEN concat(text, ' 403 Forbidden')
  WHEN 4 THEN concat('Access Denied ', doc_id) WHEN 5 THEN 'Just a moment...'
  WHEN 6 THEN concat(' waiting for host', doc_id, ' to respond. ')
  WHEN 7 THEN concat('Please wait while we verify ', doc_id)
  WHEN 8 THEN concat('Just a moment ', doc_id) WHEN 9 THEN concat('access denied ', text)
  ELSE text END"""

# Responses of the four adapters for every page.
STATUS = "CASE (page_id + ord * 3) % 7 WHEN 0 THEN 404 WHEN 1 THEN 403 ELSE 200 END"
CONTENT_TYPE = """CASE (page_id + ord) % 6 WHEN 0 THEN 'application/json' WHEN 1 THEN 'text/html; charset=utf-8'
  WHEN 2 THEN 'text/html, text/markdown' ELSE 'text/markdown' END"""
BODY = """CASE (page_id + ord * 5) % 9 WHEN 0 THEN '  <!DOCTYPE html><p>x</p>' WHEN 1 THEN ' {"a": 1, "b": 2} '
  WHEN 2 THEN 'short' WHEN 3 THEN '   ' WHEN 4 THEN '[a](b) list first' WHEN 5 THEN '<Body>page body</Body>'
  WHEN 6 THEN 'Just a moment...' ELSE concat('# Page ', page_id, ' from ', adapter) END"""

SITEMAP_BODY = """concat('<urlset><url> <loc> ', {u}, ' </loc></url><url><loc>', {u}, '?v=2&amp;w</loc><x/></url>',
  '<url><lastmod>1</lastmod><loc>https://no.example.com/</loc></url><url><loc>nothing</loc></url>',
  '<url><loc>https://far.example.org/docs/', page_id, '/</loc></url></urlset>')"""
INDEX_BODY = """concat('<sitemapindex><sitemap><loc>https://maps.example.org/pages-', page_id, '.xml</loc></sitemap>',
  '<sitemap> <loc>https://maps.example.org/index-', page_id * 2 + 1, '.xml</loc></sitemap>',
  '<sitemap><loc>https://maps.example.org/index-', page_id, '.xml</loc></sitemap></sitemapindex>')"""




SITE_SIZE = 64


def site_no(p: str, size: int = SITE_SIZE) -> str:
    return f"CAST(floor(({p}) / {size}) AS BIGINT)"


def site_page(p: str) -> str:
    """The URL of page ``p`` on a made-up site of 64 pages, in one of three directories."""
    return f"concat('https://site', {site_no(p)}, '.example.com/docs/', ({p}) % 3, '/', {p})"


def children(link: Callable[[str], str], size: int = SITE_SIZE) -> str:
    """Links to the four pages below a page: a site is a tree over the numbers of its pages."""
    links = [f"CASE WHEN (page_id % {size}) * 4 + {k} < {size} THEN {link(f'page_id + (page_id % {size}) * 3 + {k}')} ELSE '' END" for k in range(1, 5)]
    return f"concat({', '.join(links)})"


# Every page of a site is within three links of its first one, so a crawl reaches as many pages as there are.
SITE_LINKS = f"""concat(html, {children(lambda p: f"""concat('<a href="', {site_page(p)}, '#x">n</a>')""")})"""

# Smaller sites whose pages other adapters serve, too.
RANKED_SIZE = 16
_RANKED_NO = site_no("{p}", RANKED_SIZE)
_RANKED_HOST = f"""CASE {_RANKED_NO} % 5 WHEN 0 THEN 'docs.anthropic.com' WHEN 1 THEN 'eu.code.claude.com'
  WHEN 2 THEN 'nextjs.org' WHEN 3 THEN 'platform.openai.com' ELSE concat('site', {_RANKED_NO}, '.example.com') END"""


def ranked_host(p: str) -> str:
    return _RANKED_HOST.format(p=p)


def ranked_page(p: str) -> str:
    return f"concat('https://', {ranked_host(p)}, '/docs/s', {site_no(p, RANKED_SIZE)}, '/', {p})"


# What of a page is there: most pages as HTML, some of them blocked; the others only as a finished response.
RANKED_CAPTURED = "page_id % 6 <> 5"
_RANKED_LINKS = children(lambda p: f"""concat('<a href="', {ranked_page(p)}, '">c</a> ')""", RANKED_SIZE)
RANKED_HTML = f"""CASE WHEN page_id % 11 = 7 THEN '<main><p>Just a moment...</p></main>'
  ELSE replace(html, '<article>', concat('<article><p>', {_RANKED_LINKS}, '</p>')) END"""
RANKED_ANSWERED = """CASE ord WHEN 3 THEN page_id % 6 = 5 OR page_id % 4 = 0 WHEN 2 THEN true ELSE page_id % 3 <> 2 END"""
RANKED_BODY = f"""CASE (page_id + ord * 5) % 9 WHEN 0 THEN '  <!DOCTYPE html><p>x</p>' WHEN 1 THEN ' {{"a": 1, "b": 2}} '
  WHEN 2 THEN 'short' WHEN 3 THEN '   ' WHEN 6 THEN 'Just a moment...'
  ELSE concat('# Page ', page_id, ' from ', adapter, {children(lambda p: f"concat(' [c](', {ranked_page(p)}, ')')", RANKED_SIZE)}) END"""

# The sitemap index of a site and its four parts: pages with other spellings of their URL, and pages outside the documentation.
SITE_MAP_ENTRY = f"""concat('<url><loc>', {site_page('page_id')}, CASE page_id % 7 WHEN 0 THEN '/?v=1' WHEN 1 THEN '#top' ELSE '' END, '</loc></url>',
  CASE WHEN page_id % 9 = 0 THEN concat('<url><loc>https://site', {site_no('page_id')}, '.example.com/blog/', page_id, '</loc></url>') ELSE '' END,
  CASE WHEN page_id % 13 = 0 THEN concat('<url><loc>https://site', {site_no('page_id')}, '.example.com/docs/new/', page_id, '</loc></url>') ELSE '' END)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A table of domains, and hosts that are among them, below them, or only look like it.
DOMAIN = f"""CASE page_id % 3 WHEN 0 THEN {SITE_HOST} WHEN 1 THEN concat('d', page_id, '.example.org') ELSE concat('www.', {SITE_HOST}) END"""
SUBHOST = f"concat(CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'www.' WHEN 2 THEN 'a.www.' ELSE 'x' END, {SITE_HOST})"

# Rules that users bring along: one configuration for most pages, and as many for hosts without any.
RULED_HOST = "concat('h', page_id, '.example.com')"


def rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages").select("page_id").filter("page_id % 5 <> 0")
    removed = """CASE page_id % 4 WHEN 0 THEN array('.sidebar', '#nothing')
      WHEN 1 THEN array('nav, .sidebar', 'div[class*="language-"]')
      WHEN 2 THEN array('h2', 'ul', 'div.toc.sidebar', '.toc-none') ELSE array('noscript') END"""
    own = df.select(F.expr(RULED_HOST).alias("config_key"), F.lit("main, article").alias("content_selector"), F.expr(removed).alias("remove_selectors"))
    more = df.select(F.concat(F.lit("n"), "page_id", F.lit(".example.org")).alias("config_key"), F.lit("main").alias("content_selector"),
        F.array(F.concat(F.lit(".c"), "page_id"), F.lit("p")).alias("remove_selectors"))
    rest = spark.range(1).select(F.lit("__default__").alias("config_key"), F.lit("main, article").alias("content_selector"), F.array().cast("array<string>").alias("remove_selectors"))
    return own.unionByName(more).unionByName(rest)


def doc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages")
    return df.withColumn("url", F.expr(DOC_URL))


def rich_pages(spark: SparkSession, sf_dir: str, sites: bool = False) -> DataFrame:
    df = table(spark, sf_dir, "pages").withColumn("html", F.expr(RICH_HTML))
    return df.withColumn("url", F.expr(SITE_URL)) if sites else df


def keyed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, url, url_key, host`` of the documentation pages."""
    df = urls.with_url_parts(doc_pages(spark, sf_dir).select("page_id", "url"), "url")
    df = df.withColumn("url_key", urls.key()).withColumn("host", F.col("host"))
    return df.select("page_id", "url", "url_key", "host")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A link graph by arithmetic on page numbers: page p leads to p+1, 2p+1 and 3p."""
    pages = keyed_pages(spark, sf_dir)
    targets = F.array(F.col("page_id") + 1, F.col("page_id") * 2 + 1, F.col("page_id") * 3)
    src = pages.select(
        F.col("url_key").alias("src_key"), F.posexplode(targets).alias("pos", "to_id")
    )
    dst = pages.select(
        F.col("page_id").alias("to_id"),
        F.col("url_key").alias("dst_key"),
        F.col("url").alias("dst_url"),
    )
    return src.join(dst, "to_id").drop("to_id")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page with the lowest number of each host starts one crawl."""
    pages = keyed_pages(spark, sf_dir)
    first = F.min_by(F.struct("url", "url_key", "page_id"), "page_id").alias("e")
    return pages.groupBy(F.col("host").alias("crawl_id")).agg(first).select("crawl_id", "e.*")


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each page, decided by its number."""
    pages = keyed_pages(spark, sf_dir).groupBy("url_key").agg(F.min("page_id").alias("page_id"))
    return pages.select(
        "url_key",
        F.expr("CASE page_id % 13 WHEN 3 THEN 'empty' WHEN 5 THEN 'cloudflare' END").alias("blocked_reason"),
        F.expr("CASE page_id % 17 WHEN 4 THEN 'timeout' END").alias("error"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages").select("page_id")
    names = F.array(*[F.lit(n) for n in ("md-endpoint", "mdx", "jina", "playwright")])
    df = df.select("page_id", F.posexplode(names).alias("ord", "adapter"))
    return df.select(
        "page_id",
        F.expr(SITE_URL).alias("url"),
        "adapter",
        F.expr(STATUS).alias("status"),
        F.expr(CONTENT_TYPE).alias("content_type"),
        F.expr(BODY).alias("body"),
    )


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages on their sites of 64, linked as trees."""
    return table(spark, sf_dir, "pages").select("page_id", F.expr(site_page("page_id")).alias("url"), F.expr(SITE_LINKS).alias("html"))


def first_of_each(pages: DataFrame, site: str) -> DataFrame:
    """The lowest page of each site, an entry."""
    named = pages.select(F.expr(site).alias("crawl_id"), "page_id", "url")
    return named.groupBy("crawl_id").agg(F.min_by("url", "page_id").alias("url"))


def ranked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages")
    return df.select("page_id", F.expr(ranked_page("page_id")).alias("url"), F.expr(RANKED_HTML).alias("html"))


def ranked_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages").select("page_id")
    names = F.array(*[F.lit(n) for n in ("md-endpoint", "mdx", "jina", "playwright")])
    df = df.select("page_id", F.posexplode(names).alias("ord", "adapter")).filter(RANKED_ANSWERED)
    return df.select(
        F.expr(ranked_page("page_id")).alias("url"),
        "adapter",
        F.expr(STATUS).alias("status"),
        F.expr(CONTENT_TYPE).alias("content_type"),
        F.expr(RANKED_BODY).alias("body"),
    )


def site_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index for each site, whose parts name every fifth page but one."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.expr(site_no("page_id")).alias("site"))
    host = F.concat(F.lit("https://site"), "site", F.lit(".example.com"))
    part = F.concat(host, F.lit("/part-"), F.col("page_id") % 4, F.lit(".xml"))
    named = pages.filter("page_id % 5 <> 3").select(part.alias("sitemap_url"), F.expr(SITE_MAP_ENTRY).alias("e"))
    parts = named.groupBy("sitemap_url").agg(F.concat(F.lit("<urlset>"), F.array_join(F.sort_array(F.collect_list("e")), ""), F.lit("</urlset>")).alias("body"))
    children = [x for m in range(4) for x in (F.lit("<sitemap><loc>"), host, F.lit(f"/part-{m}.xml</loc></sitemap>"))]
    index = F.concat(F.lit("<sitemapindex>"), *children, F.lit("</sitemapindex>"))
    indexes = pages.select("site").distinct().select(F.concat(host, F.lit("/sitemap_index.xml")).alias("sitemap_url"), index.alias("body"))
    return indexes.unionByName(parts)


def site_map_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every site but each eleventh has the second of the usual addresses."""
    sites = table(spark, sf_dir, "pages").select(F.expr(site_no("page_id")).alias("site")).distinct()
    url = F.concat(F.lit("https://site"), "site", F.lit(".example.com/sitemap_index.xml"))
    return sites.select(url.alias("url"), F.when(F.col("site") % 11 == 10, 404).otherwise(200).alias("status"))


# Lines as a capture job may leave them: most are responses, some are torn, empty or of an adapter that nobody knows.
RESPONSE_URL = f"CASE WHEN page_id % 11 = 3 AND ord = 1 THEN NULL ELSE {SITE_URL} END"
RESPONSE_ADAPTER = "CASE WHEN page_id % 13 = 5 AND ord = 2 THEN 'gopher' ELSE adapter END"
TORN = "page_id % 7 = 2 AND ord = 0"


def response_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages").select("page_id")
    names = F.array(*[F.lit(n) for n in ("md-endpoint", "mdx", "jina", "playwright")])
    df = df.select("page_id", F.posexplode(names).alias("ord", "adapter"))
    row = F.struct(F.expr(RESPONSE_URL).alias("url"), F.expr(RESPONSE_ADAPTER).alias("adapter"), F.expr(STATUS).alias("status"),
        F.expr(CONTENT_TYPE).alias("content_type"), F.expr(BODY).alias("body"))
    torn = F.concat(F.lit('{"url": "https://torn.example.com/'), "page_id")
    return df.select(F.when(F.expr(TORN), torn).otherwise(F.to_json(row)).alias("value"))


def sitemaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain sitemap and an index per page; indexes form a tree with loops."""
    df = doc_pages(spark, sf_dir).select("page_id", "url")
    maps = "https://maps.example.org/"
    rows = F.array(
        F.struct(
            F.concat(F.lit(f"{maps}pages-"), "page_id", F.lit(".xml")).alias("sitemap_url"),
            F.expr(SITEMAP_BODY.format(u="url")).alias("body"),
        ),
        F.struct(
            F.concat(F.lit(f"{maps}index-"), "page_id", F.lit(".xml")).alias("sitemap_url"),
            F.expr(INDEX_BODY).alias("body"),
        ),
    )
    return df.select(F.inline(rows))


def sitemap_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries(spark, sf_dir).select(
        "crawl_id",
        F.concat(F.lit("https://maps.example.org/index-"), "page_id", F.lit(".xml")).alias("sitemap_url"),
    )


def sitemap_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of the usual sitemap addresses of every entry's site."""
    df = entries(spark, sf_dir)
    places = F.array(F.lit("/sitemap.xml"), F.lit("/sitemap_index.xml"), F.lit("/sitemap-index.xml"))
    df = df.select("*", F.posexplode(places).alias("ord", "place"))
    return df.select(
        F.concat(F.regexp_extract("url", "^([a-z]+://[^/]+)", 1), F.col("place")).alias("url"),
        F.expr("CASE WHEN (page_id + ord) % 3 = 0 AND page_id % 4 < 3 THEN 200 ELSE 404 END").alias("status"),
    )
