"""One query per operator over the supplied tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions import content, paths, urls
from pagemill.operators import (
    crawl,
    dedup,
    frameworks,
    hosts,
    links,
    markdown,
    numbering,
    regions,
    report,
    responses,
    rule_tables,
    sitemaps,
    tokens,
)
from pagemill.plans import pages as page_plan
from pagemill.plans import run as run_plan
from pagemill.session import shared_folder
from pagemill.sources import sinks, tables
from pagemill.workloads import derive as d

ROW = page_plan.ROW
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _odd(spark, sf):
    df = d.table(spark, sf, "pages").select("page_id", F.expr(d.ODD_URL).alias("url"))
    return urls.with_url_parts(df, "url")


def _docs(spark, sf):
    return urls.with_url_parts(d.doc_pages(spark, sf).select("page_id", "url"), "url")


@query
def pages_scan(spark, sf):
    df = tables.read_pages(spark, f"{sf}/pages.parquet")
    return df.select("page_id", "url", F.length("html").alias("n_chars"))


@query
def url_validate(spark, sf):
    error = urls.url_error(F.col("url"), F.col("host"))
    return _odd(spark, sf).select("page_id", error.isNull().alias("ok"), error.alias("error"))


@query
def url_normalize(spark, sf):
    return _odd(spark, sf).select("page_id", urls.normalized().alias("normalized"))


@query
def url_key(spark, sf):
    return _odd(spark, sf).select("page_id", urls.key().alias("url_key"))


@query
def dedup_pages(spark, sf):
    df = urls.with_url_key(d.table(spark, sf, "pages").select("page_id", "url"))
    return dedup.dedup_pages(df, ["page_id"])


@query
def resolve_links(spark, sf):
    refs = F.array(*[F.expr(r) for r in d.REFS])
    df = d.doc_pages(spark, sf).select("page_id", "url", F.posexplode(refs).alias("n", "ref"))
    df = urls.with_resolved(urls.with_url_parts(df, "url", "b_"), "b_", "ref")
    return df.select("page_id", "n", "ref", F.col("to_url").alias("resolved"))


@query
def base_path(spark, sf):
    return _docs(spark, sf).select("page_id", urls.base_path(F.col("path")).alias("base_path"))


@query
def filter_base_path(spark, sf):
    """Every page against the base path of its host's entry page."""
    entry = urls.with_url_parts(d.entries(spark, sf).select("crawl_id", "url"), "url")
    base = entry.select(F.col("crawl_id").alias("host"), urls.base_path(F.col("path")).alias("base"))
    df = _docs(spark, sf).join(base, "host")
    return sitemaps.filter_base_path(df, "path", "base").select("page_id", "host", "base")


@query
def local_path(spark, sf):
    return _docs(spark, sf).select("page_id", paths.local_path(F.col("path")).alias("local_path"))


@query
def dir_path(spark, sf):
    df = _docs(spark, sf).select("page_id", paths.local_path(F.col("path")).alias("p"))
    return df.select("page_id", paths.dir_path(F.col("p")).alias("dir"))


@query
def numbered_paths(spark, sf):
    df = _docs(spark, sf).select(
        F.lit("all").alias("crawl_id"), "page_id", paths.local_path(F.col("path")).alias("local_path")
    )
    out = numbering.numbered_paths(df, ["crawl_id"], ["page_id"])
    return out.select("page_id", "dir", "number", "numbered_path")


@query
def md_url(spark, sf):
    df = _docs(spark, sf)
    return df.select(
        "page_id", urls.md_url().alias("md"), urls.md_url(keep_mdx=True).alias("md_or_mdx")
    )


@query
def host_match(spark, sf):
    df = d.table(spark, sf, "pages").select("page_id", F.expr(d.SITE_HOST).alias("host"))
    return df.select(
        "page_id",
        urls.host_matches(F.col("host"), rules.MD_ENDPOINT_HOSTS).alias("md"),
        urls.host_matches(F.col("host"), rules.MDX_HOSTS).alias("mdx"),
    )


@query
def host_domains(spark, sf):
    """The longest domain of a table of them that each host lies in."""
    pages = d.table(spark, sf, "pages")
    df = pages.select("page_id", F.expr(d.SUBHOST).alias("host"))
    return hosts.with_domain(df, pages.select(F.expr(d.DOMAIN).alias("domain"))).select("page_id", "host", "domain")


@query
def safe_path(spark, sf):
    p = F.expr(
        "concat(CASE page_id % 7 WHEN 0 THEN 'out/' WHEN 1 THEN '../' WHEN 2 THEN 'out/../../'"
        " WHEN 3 THEN '/' WHEN 4 THEN './' WHEN 5 THEN 'out/a/../../out/' ELSE 'out/..' END, 'f', page_id, '.md')"
    )
    df = d.table(spark, sf, "pages").select("page_id", p.alias("path"))
    return df.select("page_id", "path", paths.is_safe_path(F.col("path")).alias("safe"))


@query
def path_collisions(spark, sf):
    df = _docs(spark, sf).select("page_id", "url", paths.local_path(F.col("path")).alias("local_path"))
    return dedup.resolve_collisions(df, ["local_path"], ["page_id"])


# --- links


def _link_pages(spark, sf, rebase=False):
    url = d.DOC_URL if rebase else "url"
    df = d.table(spark, sf, "pages")
    return df.select("page_id", F.expr(url).alias("url"), F.expr(d.LINKS_HTML).alias("html"))


@query
def extract_links(spark, sf):
    return links.extract_links(_link_pages(spark, sf)).select("page_id", "pos", "raw", "dst_url")


@query
def links_external(spark, sf):
    df = links.extract_links(_link_pages(spark, sf), include_external=True)
    return df.select("page_id", "pos", "raw", "dst_url")


@query
def links_rebased(spark, sf):
    df = links.extract_links(_link_pages(spark, sf, rebase=True))
    return df.select("page_id", "pos", "raw", "dst_url")


@query
def link_edges(spark, sf):
    df = links.extract_links(_link_pages(spark, sf, rebase=True))
    return links.link_edges(df, "page_id").select("page_id", "dst_url", "dst_key", "pos")


@query
def link_counts(spark, sf):
    return links.link_counts(links.extract_links(_link_pages(spark, sf)), "page_id")


@query
def dangling_links(spark, sf):
    """Links that lead to no captured page: those in the text, not those added to it."""
    df = d.table(spark, sf, "pages")
    keys = urls.with_url_key(df.select("url"))
    own = F.concat(F.col("html"), F.lit('<a href="'), F.col("url"), F.lit('">self</a>'))
    found = links.extract_links(df.withColumn("html", own))
    edges = links.link_edges(found, "page_id")
    return links.dangling_links(edges, keys).select("page_id", "dst_key")


# --- crawl


@query
def crawl_bfs(spark, sf):
    out = crawl.crawl(d.edges(spark, sf), d.entries(spark, sf), 4)
    return out.select("crawl_id", "url_key", "depth")


@query
def crawl_depths(spark, sf):
    return crawl.crawl_depths(crawl.crawl(d.edges(spark, sf), d.entries(spark, sf), 3))


def _outcomes(spark, sf):
    good = d.contents(spark, sf)
    edges = crawl.follow_content(d.edges(spark, sf), good)
    return crawl.outcomes(crawl.crawl(edges, d.entries(spark, sf), 3), good)


@query
def crawl_outcomes(spark, sf):
    return _outcomes(spark, sf).select("crawl_id", "url_key", "depth", "status", "reason", "error")


@query
def crawl_report(spark, sf):
    return report.crawl_report(_outcomes(spark, sf))


@query
def blocked_pages(spark, sf):
    df = _outcomes(spark, sf).withColumn("url", F.col("url_key"))
    return report.blocked_pages(df).distinct()


@query
def blocked_by_host(spark, sf):
    df = urls.with_url_parts(d.keyed_pages(spark, sf).drop("host"), "url").select("url_key", "host")
    df = df.distinct().join(d.contents(spark, sf), "url_key")
    return report.blocked_by_host(df.withColumn("reason", F.col("blocked_reason")))


# --- sitemaps


@query
def sitemap_kind(spark, sf):
    df = d.sitemaps(spark, sf)
    return df.select("sitemap_url", sitemaps.is_index(F.col("body")).alias("is_index"))


@query
def sitemap_urls(spark, sf):
    df = sitemaps.sitemap_urls(d.sitemaps(spark, sf))
    return df.select("sitemap_url", "loc", urls.key().alias("url_key"))


@query
def sitemap_files(spark, sf):
    """Page URLs and child links of sitemaps that were written as raw files, each read in records by several tasks."""
    folder = f"{shared_folder(spark).rstrip('/')}/maps-{uuid.uuid4().hex}"
    raw = d.sitemaps(spark, sf).withColumn("name", F.regexp_replace("sitemap_url", "^https://", ""))
    sinks.export_files(raw.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), folder, path="name", text="body")
    _, children, pages = sitemaps.from_records(tables.read_sitemap_files(spark, folder))
    found = pages.select("sitemap_url", "loc", F.lit("page").alias("kind"))
    return found.unionByName(children.select("sitemap_url", F.col("child").alias("loc"), F.lit("child").alias("kind")))


@query
def sitemap_expand(spark, sf):
    reached, _ = sitemaps.expand_sitemaps(d.sitemaps(spark, sf), d.sitemap_roots(spark, sf))
    return reached.select("crawl_id", "sitemap_url")


@query
def sitemap_choose(spark, sf):
    entries = d.entries(spark, sf).select("crawl_id", F.col("url").alias("entry_url"))
    out = sitemaps.choose_sitemap(entries, d.sitemap_responses(spark, sf))
    return out.select("crawl_id", "sitemap_url", "error")


def _sitemap_found(spark, sf):
    maps = d.sitemaps(spark, sf)
    reached, _ = sitemaps.expand_sitemaps(maps, d.sitemap_roots(spark, sf))
    found = sitemaps.sitemap_pages(maps, reached)
    entry = urls.with_url_parts(d.entries(spark, sf), "url", "e_")
    base = entry.select("crawl_id", urls.base_path(F.col("e_path")).alias("base_path"))
    return found.join(base, "crawl_id")


@query
def sitemap_counts(spark, sf):
    return sitemaps.sitemap_counts(_sitemap_found(spark, sf))


@query
def crawl_sitemap(spark, sf):
    found = sitemaps.filter_base_path(_sitemap_found(spark, sf), "path", "base_path")
    found = found.withColumn("url_key", urls.key())
    once = dedup.first_per_key(
        found.select("crawl_id", "url_key", "loc"), ["crawl_id", "url_key"], [F.col("loc")]
    )
    captured = d.keyed_pages(spark, sf).select("url_key").distinct().withColumn("captured", F.lit(True))
    out = once.join(captured, "url_key", "left")
    return out.select("crawl_id", "url_key", "loc", F.coalesce("captured", F.lit(False)).alias("captured"))


# --- site configuration and frameworks


@query
def site_config(spark, sf):
    df = d.table(spark, sf, "pages").select("page_id", F.expr(d.SITE_HOST).alias("host"))
    df = frameworks.with_site_config(df)
    return df.select("page_id", "config_key", "content_selector", "framework", "may_be_blocked")


@query
def framework_signals(spark, sf):
    df = d.rich_pages(spark, sf).select("page_id", "html")
    return frameworks.framework_signals(df).select("page_id", "framework", "kind", "ord")


@query
def framework_scores(spark, sf):
    return frameworks.framework_scores(d.rich_pages(spark, sf).select("page_id", "html"))


def _detected(spark, sf, html_first=False):
    df = d.rich_pages(spark, sf).select("page_id", "html")
    df = frameworks.detect_framework(df, html_first=html_first)
    return df.select("page_id", "framework", "score", "confidence")


@query
def detect_framework(spark, sf):
    return _detected(spark, sf)


@query
def detect_framework_html(spark, sf):
    return _detected(spark, sf, html_first=True)


@query
def effective_config(spark, sf):
    df = d.rich_pages(spark, sf, sites=True)
    df = urls.with_url_parts(df, "url").select("page_id", "host", "html")
    return frameworks.with_effective_config(df).select("page_id", "host", "config_key")


@query
def framework_counts(spark, sf):
    return frameworks.framework_counts(_detected(spark, sf))


# --- HTML


def _joined(df, *also):
    pieces = F.array_sort(F.collect_list(F.struct("pos", F.concat("tag_text", "text").alias("t"))))
    out = df.groupBy(*ROW, "page_id", *also).agg(F.array_join(pieces.getField("t"), "").alias("html"))
    return out.drop(*ROW)


@query
def html_tokens(spark, sf):
    df = tokens.html_tokens(d.rich_pages(spark, sf).select("page_id", "html"))
    return df.select("page_id", "pos", "kind", "tag", F.length("text").alias("n_text"))


def _rich_tokens(spark, sf):
    return page_plan.page_tokens(d.rich_pages(spark, sf).select("page_id", "html"))


@query
def selector_match(spark, sf):
    """First match of a few selectors per page."""
    df = _rich_tokens(spark, sf)
    picks = {
        "cls": ".lang",
        "child": 'div[class*="language-"] > span.lang',
        "deep": "article blockquote p",
        "attr": 'article[role="main"], [data-starlight], a[href*="sphinx"]',
        "none": "nav > a",
    }
    for name, selector in picks.items():
        df = regions.with_selector_match(df, selector, ROW, name)
    counts = df.groupBy(*ROW, "page_id").agg(*[F.count_if(F.col(n)).alias(n) for n in picks])
    return counts.drop(*ROW)


def _drop(df, *selectors):
    flag = F.lit(False)
    df = df.withColumn("remove", flag)
    for s in selectors:
        df = regions.with_selector_match(df, s, ROW, "hit")
        df = df.withColumn("remove", F.col("remove") | F.col("hit")).drop("hit")
    return regions.drop_regions(df, ROW)


@query
def strip_noise(spark, sf):
    df = _rich_tokens(spark, sf).withColumn(
        "remove", regions.removal_flag((), F.lit(rules.DEFAULT_KEY))
    )
    return _joined(regions.drop_regions(df, ROW))


@query
def remove_regions(spark, sf):
    return _joined(_drop(_rich_tokens(spark, sf), "nav, footer, .ad", ".sidebar", ".toc"))


@query
def rule_table_removal(spark, sf):
    """Pages without what a table with a configuration for each host removes."""
    df = d.rich_pages(spark, sf).select("page_id", F.expr(d.RULED_HOST).alias("host"), "html")
    df = rule_tables.with_rules(page_plan.spread(df), d.rule_table(spark, sf))
    df = regions.with_regions(rule_tables.with_flags(tokens.html_tokens(df)), ROW)
    kept = _joined(regions.drop_regions(df, ROW), "config_key")
    return kept.select("page_id", "config_key", "html")


@query
def code_language(spark, sf):
    df = regions.with_code_language(_rich_tokens(spark, sf), ROW)
    df = df.filter((F.col("tag") == "pre") & (F.col("kind") == "open"))
    out = df.groupBy(*ROW, "page_id").agg(
        F.count("*").alias("n_pre"), F.count("parent_lang").alias("n_lang"), F.max("parent_lang").alias("lang")
    )
    return out.drop(*ROW)


@query
def main_content(spark, sf):
    """The inner text of the content element under the default rules, tags left out."""
    configs = (rules.SITE_CONFIGS[-1],)
    df = regions.cut_content(
        _rich_tokens(spark, sf), ROW, F.lit(rules.DEFAULT_KEY), configs
    )
    return _joined(df.withColumn("tag_text", F.lit("")))


@query
def absolutize_urls(spark, sf):
    df = d.rich_pages(spark, sf)
    df = tokens.html_tokens(urls.with_url_parts(df, "url", "b_"))
    df = df.filter(F.col("tag").isin("a", "img") & F.col("kind").isin("open", "void"))
    out = markdown.absolutize_urls(df, "b_")
    return out.select("page_id", "pos", "tag_text", "absolute_text")


@query
def html_to_markdown(spark, sf):
    df = page_plan.main_tokens(d.table(spark, sf, "pages"))
    return markdown.html_to_markdown(df, ROW, carry=["page_id"]).drop(*ROW)


@query
def code_blocks(spark, sf):
    df = page_plan.main_tokens(d.rich_pages(spark, sf))
    out = markdown.code_blocks(df, ROW, carry=["page_id"])
    return out.select("page_id", "language", "code")


@query
def pages_to_markdown(spark, sf):
    df = page_plan.pages_to_markdown(d.rich_pages(spark, sf, sites=True))
    return df.select("page_id", "host", "framework", "config_key", "markdown", "blocked_reason")


@query
def markdown_sink(spark, sf):
    """Write the corpus and read back what is in each host's folder."""
    md = page_plan.pages_to_markdown(d.table(spark, sf, "pages"))
    target = f"{shared_folder(spark).rstrip('/')}/markdown-{uuid.uuid4().hex}"
    sinks.write_markdown(md.select("page_id", "host", "markdown"), target)
    out = spark.read.parquet(target)
    return out.groupBy("host").agg(F.count("*").alias("n_pages"), F.sum(F.length("markdown")).alias("n_chars"))


def _docs_text(spark, sf, expr):
    return d.table(spark, sf, "documents").select("doc_id", F.expr(expr).alias("text"))


@query
def clean_footer(spark, sf):
    df = _docs_text(spark, sf, d.FOOTER)
    return df.select("doc_id", content.clean_footer(F.col("text")).alias("text"))


@query
def fix_headings(spark, sf):
    df = _docs_text(spark, sf, d.HEADINGS)
    return df.select("doc_id", content.fix_headings(F.col("text")).alias("text"))


@query
def collapse_blank(spark, sf):
    df = _docs_text(spark, sf, d.BLANKS)
    return df.select("doc_id", content.collapse_blank(F.col("text")).alias("text"))


# --- content checks and fallback


@query
def blocked_reason(spark, sf):
    df = _docs_text(spark, sf, d.SUSPECT)
    return df.select("doc_id", content.blocked_reason(F.col("text")).alias("reason"))


@query
def blocked_advice(spark, sf):
    df = blocked_reason(spark, sf)
    return df.select("doc_id", content.blocked_advice(F.col("reason")).alias("advice"))


@query
def responses_read(spark, sf):
    """Response lines written by a capture job and read back: what is usable, and why the rest is not."""
    folder = f"{shared_folder(spark).rstrip('/')}/responses-{uuid.uuid4().hex}"
    d.response_lines(spark, sf).write.text(folder)
    df = tables.read_checked_responses(spark, folder)
    return df.select("url", "adapter", "status", "content_type", F.md5("body").alias("body_md5"), "reject", "record")


def _checked(spark, sf, adapter):
    df = d.responses(spark, sf).filter(F.col("adapter") == adapter)
    return responses.with_response_error(df).select("page_id", "error")


@query
def validate_md(spark, sf):
    return _checked(spark, sf, "md-endpoint")


@query
def validate_mdx(spark, sf):
    return _checked(spark, sf, "mdx")


@query
def validate_reader(spark, sf):
    return _checked(spark, sf, "jina")


def _hosts(spark, sf):
    return d.table(spark, sf, "pages").select("page_id", F.expr(d.SITE_HOST).alias("host"))


@query
def adapter_plan(spark, sf):
    df = responses.adapter_plan(_hosts(spark, sf), use_reader=True)
    return df.select("page_id", "ord", "adapter")


@query
def preferred_adapter(spark, sf):
    return responses.preferred_adapter(_hosts(spark, sf)).select("page_id", "adapter")


def _chosen(spark, sf):
    return responses.choose_response(d.responses(spark, sf), use_reader=True)


@query
def choose_response(spark, sf):
    return _chosen(spark, sf).select("url", "adapter", "body")


@query
def fallback_errors(spark, sf):
    return responses.fallback_errors(_chosen(spark, sf))


@query
def adapter_counts(spark, sf):
    return responses.adapter_counts(_chosen(spark, sf))


_SITE = f"concat('site', {d.site_no('page_id')})"


def crawl_run(spark: SparkSession, sf: str, depth: int = 3, numbered: bool = True):
    """Crawl all sites from their first page; three levels of links reach every page of a site."""
    pages = d.site_pages(spark, sf)
    return run_plan.run(pages, d.first_of_each(pages, _SITE), depth=depth, link_source="html", numbered=numbered)


@query
def full_run(spark, sf):
    """The report of a whole link crawl."""
    return crawl_run(spark, sf).report


@query
def run_files(spark, sf):
    """The files of a whole link crawl: numbered paths and text lengths."""
    files = crawl_run(spark, sf).files
    return files.select("crawl_id", "local_path", "url", F.length("markdown").alias("n_chars"))


@query
def run_responses(spark, sf):
    """A whole link crawl over ranked responses: outcomes with the adapter that served each page and the failed tries."""
    pages = d.ranked_pages(spark, sf)
    entries = d.first_of_each(pages, f"concat('s', {d.site_no('page_id', d.RANKED_SIZE)})")
    captured = pages.filter(d.RANKED_CAPTURED)
    out = run_plan.run(captured, entries, depth=2, responses=d.ranked_responses(spark, sf)).outcomes
    return out.select("crawl_id", "url_key", "depth", "status", "reason", "adapter", "tried", "error", "local_path", "may_be_blocked")


@query
def run_sitemap(spark, sf):
    """A whole sitemap crawl: what became of every page that the sitemaps of the sites name."""
    pages = d.site_pages(spark, sf)
    entries = d.first_of_each(pages, _SITE)
    out = run_plan.run(pages, entries, mode="sitemap", sitemap_bodies=d.site_maps(spark, sf), responses=d.site_map_responses(spark, sf))
    return out.outcomes.select("crawl_id", "url_key", "status", "error", "adapter", "local_path")
