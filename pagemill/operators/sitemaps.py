"""Sitemaps: kinds, page URLs, index expansion and choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions import urls
from pagemill.session import materialize


def is_index(body: Column) -> Column:
    """The body is an index of other sitemaps."""
    return body.contains("<sitemapindex")


def _locations(sitemaps: DataFrame, pattern: str) -> DataFrame:
    found = F.regexp_extract_all(F.col("body"), F.lit(pattern), F.lit(1))
    df = sitemaps.withColumn("__locs", found).drop("body")
    df = df.select("*", F.posexplode("__locs").alias("pos", "loc")).drop("__locs")
    return df.withColumn("loc", urls.trimmed(F.col("loc")))


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """Page URLs of plain sitemaps: ``pos, loc`` and the URL's parts; other text is dropped."""
    df = _locations(sitemaps.filter(~is_index(F.col("body"))), rules.SITEMAP_PAGE)
    return urls.with_url_parts(df, "loc").filter(F.col("host").isNotNull())


def child_sitemaps(sitemaps: DataFrame) -> DataFrame:
    """Child sitemap URLs of indexes: ``pos, loc``."""
    df = _locations(sitemaps.filter(is_index(F.col("body"))), rules.SITEMAP_CHILD)
    return df.filter(F.col("loc") != "")


def from_records(records: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Kinds, child links and page URLs of sitemap files read in records (:func:`pagemill.sources.tables.read_sitemap_files`).

    Returns ``(sitemap_url, is_index)``, ``(sitemap_url, child)`` and, like :func:`sitemap_urls`, ``(sitemap_url, pos, loc, …)``.
    The records are written once, so that no file is opened again for any of the three. Files are told apart by one aggregate over
    short rows; entries are joined with the indexes among them. These may be many, and what takes little
    room in a file, by which Spark would choose a broadcast, takes many times as much in the driver.
    """
    records = materialize(records)
    kinds = materialize(records.groupBy("sitemap_url").agg(F.bool_or("index").alias("is_index")))
    entries = records.filter(F.col("kind").isNotNull()).withColumn("loc", urls.trimmed(F.col("loc")))
    indexes = kinds.filter("is_index").select("sitemap_url").hint("merge")
    children = entries.filter("kind = 'child'").join(indexes, "sitemap_url", "left_semi").filter("loc <> ''")
    pages = entries.filter("kind = 'page'").join(indexes, "sitemap_url", "left_anti").select("sitemap_url", "pos", "loc")
    pages = urls.with_url_parts(pages, "loc").filter(F.col("host").isNotNull())
    return kinds, children.select("sitemap_url", F.col("loc").alias("child")).distinct(), pages


def expand_sitemaps(
    sitemaps: DataFrame, roots: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Follow indexes from root sitemaps, see :func:`expand_links`; ``sitemaps`` has ``sitemap_url, body``."""
    edges = child_sitemaps(sitemaps).select("sitemap_url", F.col("loc").alias("child")).distinct()
    kinds = sitemaps.select("sitemap_url", is_index(F.col("body")).alias("is_index")).distinct()
    return expand_links(materialize(kinds), materialize(edges), roots)


def expand_links(kinds: DataFrame, edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Follow indexes from root sitemaps.

    ``roots`` has ``crawl_id, sitemap_url``. Returns ``(reached, missing)``: the plain
    sitemaps of each crawl, and the sitemaps that were named but not captured. Every level is
    an equi-join; sitemaps seen before are left out, so cycles end,
    and the loop goes as deep as the indexes do. Only addresses take part in
    the loop, the bodies are joined by the caller. ``kinds`` has ``sitemap_url, is_index``, ``edges`` ``sitemap_url, child``.
    """
    level = materialize(roots.select("crawl_id", "sitemap_url").distinct())
    seen = level
    while True:
        nxt = (
            level.join(edges, "sitemap_url")
            .select("crawl_id", F.col("child").alias("sitemap_url"))
            .distinct()
            .join(seen, ["crawl_id", "sitemap_url"], "left_anti")
        )
        level = materialize(nxt)
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    known = seen.join(kinds, "sitemap_url", "left")
    reached = known.filter(~F.col("is_index")).drop("is_index")
    return reached, known.filter(F.col("is_index").isNull()).drop("is_index")


def sitemap_pages(sitemaps: DataFrame, reached: DataFrame) -> DataFrame:
    """The page URLs of every crawl's sitemaps."""
    return sitemap_urls(sitemaps.join(reached, "sitemap_url"))


def choose_sitemap(entries: DataFrame, responses: DataFrame) -> DataFrame:
    """The first existing of a site's usual sitemap addresses.

    ``entries`` has ``crawl_id, entry_url``; ``responses`` has ``url, status``. A crawl without
    any gets a null ``sitemap_url`` and an ``error``.
    """
    df = urls.with_url_parts(entries, "entry_url").withColumn("origin", urls.origin())
    df = df.select("crawl_id", "entry_url", "origin")
    candidates = df.select(
        "*", F.posexplode(F.array(*[F.lit(p) for p in rules.SITEMAP_PATHS])).alias("ord", "place")
    ).withColumn("url", F.concat("origin", "place"))
    ok = responses.filter(F.col("status").between(200, 299)).select("url").distinct()
    found = candidates.join(ok.withColumn("found", F.lit(True)), "url", "left")
    out = found.groupBy("crawl_id", "entry_url", "origin").agg(
        F.min_by(F.when(F.col("found"), F.col("url")), F.when(F.col("found"), F.col("ord"))).alias(
            "sitemap_url"
        )
    )
    message = F.concat(F.lit(rules.NO_SITEMAP), F.col("origin"))
    return out.withColumn("error", F.when(F.col("sitemap_url").isNull(), message)).drop("origin")


def filter_base_path(df: DataFrame, path: str, base: str) -> DataFrame:
    """Keep the URLs below a base path; without a base path all stay."""
    return df.filter(F.col(base).isNull() | F.col(path).startswith(F.col(base)))


def sitemap_counts(found: DataFrame, path: str = "path", base: str = "base_path") -> DataFrame:
    """URLs per crawl, before and after the base-path filter."""
    kept = F.col(base).isNull() | F.col(path).startswith(F.col(base))
    return found.groupBy("crawl_id").agg(
        F.count("*").alias("n_found"), F.count_if(kept).alias("n_kept")
    )
