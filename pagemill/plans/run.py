"""The whole job: discover pages, convert them, assign paths, report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions import content as answer_text
from pagemill.functions import paths, urls
from pagemill.operators import crawl as bfs
from pagemill.operators import dedup, links, numbering, report, sitemaps
from pagemill.operators import responses as answer
from pagemill.plans import pages as page_plan
from pagemill.session import materialize, materialize_bucketed
from pagemill.sources import tables


@dataclass
class RunResult:
    """Tables of one run; the files are worked out when they are asked for."""

    outcomes: DataFrame
    content: DataFrame
    numbered: bool

    @property
    def report(self) -> DataFrame:
        return report.crawl_report(self.outcomes)

    @cached_property
    def files(self) -> DataFrame:
        """Saved pages with their ``local_path`` and Markdown, one per path and crawl."""
        saved = self.outcomes.filter(F.col("status") == "saved")
        files = urls.with_url_parts(saved, "url")
        order = ["depth", "parent_key", "pos", "url_key"]
        files = files.select("crawl_id", "url", "host", *order, "local_path")
        if self.numbered:
            files = numbering.numbered_paths(files, ["crawl_id"], order)
            files = files.drop("local_path", "dir", "number").withColumnRenamed(
                "numbered_path", "local_path"
            )
        files = dedup.resolve_collisions(files, ["crawl_id", "local_path"], order)
        return files.join(self.content.select("url_key", "markdown"), "url_key")


@dataclass
class Captures:
    """What there is to fetch, in buckets of the page key: page captures, and responses of other adapters if any.

    Levels of a crawl join with these buckets, so HTML and bodies are shuffled once per run, however deep it goes.
    """

    pages: DataFrame
    served: DataFrame | None

    @classmethod
    def of(cls, pages: DataFrame, responses: DataFrame | None, use_md: bool, use_reader: bool) -> Captures:
        # Which capture of a key counts: the lowest number, then the lowest address and text.
        keyed = urls.with_url_key(pages.select("page_id", "url", "html"), "url").filter(F.col("url_key").isNotNull())
        order = [F.col("page_id").isNull(), F.col("page_id"), F.col("url"), F.xxhash64("html"), F.col("html")]
        once = dedup.first_per_key(keyed.select("url_key", "page_id", "url", "html"), ["url_key"], order)
        once = materialize_bucketed(once, "url_key", spread=False)
        if responses is None or "adapter" not in responses.columns:
            return cls(once, None)
        answers = urls.with_url_key(responses.filter(F.col("adapter").isNotNull()), "url").filter(F.col("url_key").isNotNull())
        found = answer.served(answers.select("url_key", *tables.RESPONSES.names), use_md, use_reader)
        return cls(once, materialize_bucketed(found, "url_key", spread=False))

    def fetch(self, keys: DataFrame, convert: bool = True) -> DataFrame:
        """The content of pages by the first adapter that has any: a row for every one of ``keys``.

        ``keys`` has ``url_key, url`` and is bucketed. Adds ``adapter``, ``markdown``, ``blocked_reason``, ``error`` and ``tried``, the failed tries. Only pages
        that no other adapter serves are converted. Without ``convert`` their ``markdown`` is the page source.
        """
        page_adapter = rules.ADAPTERS[-1]
        if self.served is None:
            df, nothing = keys, F.lit(None).cast("string")
            df = df.withColumns({"adapter": nothing, "body": nothing, "errors": F.lit(""), "page": F.lit(None).cast(_PAGE)})
        else:
            df = keys.join(self.served, "url_key", "left").withColumn("errors", F.coalesce("errors", F.lit("")))
        asked = df.filter(F.col("adapter").isNull()).select("url_key")
        pages = self.pages.join(asked, "url_key", "left_semi")
        if convert:
            # A number ahead of the key: rows sort by it, where addresses all begin alike. The key keeps the rows where they are.
            pages = pages.withColumn("__row", F.monotonically_increasing_id())
            pages = page_plan.pages_to_markdown(pages, key="url_key", row=["__row", "url_key"])
            pages = pages.select("url_key", F.col("markdown").alias("text"), F.col("blocked_reason").alias("reason"))
        else:
            pages = pages.select("url_key", F.coalesce("html", F.lit("")).alias("text"), F.lit(None).cast("string").alias("reason"))
        df = df.join(pages, "url_key", "left")
        df = urls.with_url_parts(df, "url").withColumn("page_error", answer_text.page_error(F.col("reason"), F.col("host")))
        other, own = F.col("adapter").isNotNull(), F.col("text").isNotNull()
        error = F.when(other, None).when(own, F.col("page_error")).otherwise(F.col("page.error"))
        reason = F.when(other, None).when(own, F.col("reason")).otherwise(F.col("page.blocked_reason"))
        last = F.when(~other & error.isNotNull(), F.concat(F.lit(f"{page_adapter}: "), error))
        none = ~other & ~own & F.col("page").isNull()
        tried = F.concat_ws("\n", F.when(F.col("errors") != "", F.col("errors")), last)
        failed = F.concat(F.lit("All adapters failed for "), F.col("url"), F.lit(":\n"), tried)
        return df.select(
            "url_key",
            "url",
            F.when(other, F.col("adapter")).when(~none & error.isNull(), page_adapter).alias("adapter"),
            F.when(other, F.col("body")).when(own, F.col("text")).otherwise(F.col("page.body")).alias("markdown"),
            reason.alias("blocked_reason"),
            F.when(reason.isNotNull(), None)
            .when(error.isNotNull() | (none & (tried != "")), failed)
            .when(none, "not captured")
            .alias("error"),
            F.when(tried != "", tried).alias("tried"),
            (F.col("adapter").isNull() & own).alias("converted"),
        )


_PAGE = "struct<body:string,blocked_reason:string,error:string>"


def page_edges(pages: DataFrame, content: str = "html") -> DataFrame:
    """The distinct links between page keys; ``pages`` has ``url_key, url`` and the content."""
    found = links.extract_links(
        pages.select(F.col("url_key").alias("src_key"), "url", content), content=content
    )
    return links.link_edges(found)


def lost_entries(entries: DataFrame, url: str, error: Column, where: Column) -> DataFrame:
    """Failed outcomes of entries that lead nowhere."""
    return entries.filter(where).select(
        "crawl_id",
        "url_key",
        F.col(url).alias("url"),
        F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("parent_key"),
        F.lit(0).alias("pos"),
        F.lit("entry_failed").alias("status"),
        F.lit(None).cast("string").alias("reason"),
        error.alias("error"),
    )


def sitemap_reach(
    pages: DataFrame, sitemap_bodies: DataFrame, responses: DataFrame, entries: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Pages named by the sitemaps of the entry sites, limited to the entry's base path, and the
    outcomes of entries that have no sitemap or whose sitemap or a part of it was not captured.

    No link is followed and other hosts are allowed. A URL is fetched with its query, but a key
    only once.
    """
    chosen = sitemaps.choose_sitemap(entries.withColumnRenamed("url", "entry_url"), responses)
    reached, absent = sitemaps.expand_sitemaps(
        sitemap_bodies, chosen.filter(F.col("sitemap_url").isNotNull())
    )
    none = chosen.filter(F.col("sitemap_url").isNull()).select("crawl_id", "entry_url", "error")
    gone = F.concat(F.lit("Sitemap not captured: "), F.col("sitemap_url"))
    absent = absent.join(chosen.select("crawl_id", "entry_url"), "crawl_id").select("crawl_id", "entry_url", gone.alias("error"))
    failed = none.unionByName(absent).withColumn("url_key", F.lit(None).cast("string"))
    failed = lost_entries(failed, "entry_url", F.col("error"), F.lit(True))
    found = sitemaps.sitemap_pages(sitemap_bodies, reached)
    base = urls.with_url_parts(entries, "url", "e_").select(
        "crawl_id", urls.base_path(F.col("e_path")).alias("base_path")
    )
    found = found.join(base, "crawl_id")
    found = sitemaps.filter_base_path(found, "path", "base_path")
    found = found.withColumn("url_key", urls.key())
    named = dedup.first_per_key(
        found.select("crawl_id", "url_key", "sitemap_url", "pos", F.col("loc").alias("url")),
        ["crawl_id", "url_key"],
        [F.col("sitemap_url"), F.col("pos"), F.col("url")],
    ).select(
        "crawl_id",
        "url_key",
        "url",
        F.lit(1).alias("depth"),
        F.col("sitemap_url").alias("parent_key"),
        F.col("pos").cast("int").alias("pos"),
    )
    return named, failed


def _keys(level: DataFrame, fetched: list[DataFrame]) -> DataFrame:
    """The pages of a level that were not fetched for an earlier one, once for all crawls."""
    keys = dedup.first_per_key(level.select("url_key", "url"), ["url_key"], [F.col("url")])
    for done in fetched:
        keys = keys.join(done.select("url_key"), "url_key", "left_anti")
    return materialize_bucketed(keys, "url_key", spread=False)


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def link_levels(captures: Captures, entries: DataFrame, depth: int, convert: bool) -> tuple[list, list, list]:
    """Levels of pages, the content fetched for each of them, and the links of that content.

    The frontier drives: a level fetches its new pages, takes the links of what it got and leaves out pages that were reached
    before. Nothing is fetched, converted or searched for links that no link leads to.
    """
    levels, fetched, edges = [bfs.start(entries)], [], []
    for at in range(depth + 1):
        content = materialize_bucketed(captures.fetch(_keys(levels[-1], fetched), convert), "url_key", spread=False)
        fetched.append(content)
        if at == depth:
            break
        good = content.filter(F.col("blocked_reason").isNull() & F.col("error").isNull())
        edges.append(materialize_bucketed(page_edges(good.select("url_key", "url", "markdown"), "markdown"), "src_key"))
        here = levels[-1].select("crawl_id", F.col("url_key").alias("src_key"))
        # A page that another crawl reached earlier has its links in an earlier table.
        found = _union([here.join(e, "src_key") for e in edges])
        new = bfs.next_level(found, at + 1, levels)
        if new.isEmpty():
            break
        levels.append(new)
    return levels, fetched, edges


def guarded(outcomes: DataFrame) -> DataFrame:
    """Adds ``local_path`` of saved pages and ``may_be_blocked``; pages whose path would leave the output folder failed."""
    df = urls.with_url_parts(outcomes, "url", "__u_")
    saved = F.col("status") == "saved"
    path = paths.local_path(F.col("__u_path"))
    df = df.withColumn("local_path", F.when(saved, path))
    unsafe = saved & ~paths.is_safe_path(F.concat(F.lit("out/"), F.col("local_path")))
    df = df.withColumns(
        {
            "error": F.when(unsafe, F.concat(F.lit("Path traversal detected: "), F.col("local_path"))).otherwise(F.col("error")),
            "status": F.when(unsafe, F.when(F.col("depth") == 0, "entry_failed").otherwise("failed")).otherwise(F.col("status")),
            "may_be_blocked": F.coalesce(F.col("__u_host").isin(*[c.key for c in rules.SITE_CONFIGS if c.may_be_blocked]), F.lit(False)),
        }
    )
    df = df.withColumn("local_path", F.when(F.col("status") == "saved", F.col("local_path")))
    return df.drop(*[c for c in df.columns if c.startswith("__u_")])


def run(
    pages: DataFrame,
    entries: DataFrame,
    mode: str = "links",
    depth: int = 1,
    link_source: str = "markdown",
    numbered: bool = False,
    sitemap_bodies: DataFrame | None = None,
    responses: DataFrame | None = None,
    use_md: bool = False,
    use_reader: bool = False,
) -> RunResult:
    """Crawl captured pages from entries and turn what is reached into files.

    ``entries`` has ``crawl_id, url``. ``responses`` has ``url, status``, for the usual sitemap addresses, and, with ``adapter``,
    ``content_type`` and ``body``, what other adapters got for pages: a page is served by the first adapter whose response
    passes its check, in the order of the adapters that apply to its host or are switched on by ``use_md`` and ``use_reader``. A captured page is
    converted only if it is reached and none of them serves it.

    Links come from the final content, from whose text navigation is cut, or with ``link_source='html'`` from the source of
    converted pages. Entries without a usable URL and, in sitemap mode, entries without a captured sitemap are failed outcomes.
    """
    captures = Captures.of(pages, responses, use_md, use_reader)
    entries = urls.with_url_key(entries, "url")
    lost = lost_entries(entries, "url", urls.url_error(F.col("url"), F.lit(None).cast("string")), F.col("url_key").isNull())
    entries = entries.filter(F.col("url_key").isNotNull())
    if mode == "sitemap":
        reached, missing = sitemap_reach(pages, sitemap_bodies, responses, entries)
        reached = materialize(reached)
        content = [materialize(captures.fetch(_keys(reached, [])))]
        lost = lost.unionByName(missing)
    elif mode == "links" and link_source == "markdown":
        levels, content, _ = link_levels(captures, entries, depth, convert=True)
        reached = bfs.reached(levels)
    elif mode == "links":
        # Sources need no conversion to be followed. Whether a page is blocked shows afterwards; then the links of blocked
        # pages go, and the levels are worked out again from those that are left.
        levels, sources, edges = link_levels(captures, entries, depth, convert=False)
        keys = materialize_bucketed(_union([s.select("url_key", "url") for s in sources]), "url_key")
        content = [materialize(captures.fetch(keys))]
        reached = bfs.reached(levels)
        if edges and not content[0].filter(F.col("blocked_reason").isNotNull()).isEmpty():
            reached = bfs.crawl(bfs.follow_content(_union(edges), content[0]), entries, depth)
    else:
        raise ValueError(f"unknown mode: {mode!r}")
    content = _union(content)
    outcomes = bfs.outcomes(reached, content, carry=["adapter", "tried"])
    extra = {c: F.lit(None).cast("string") for c in ("adapter", "tried")}
    outcomes = outcomes.unionByName(lost.withColumns(extra).select(outcomes.columns))
    return RunResult(materialize(guarded(outcomes)), content, numbered)
