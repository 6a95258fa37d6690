"""Link extraction: from page content to an edge table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions import urls
from pagemill.functions.content import js_trim
from pagemill.functions.let import let


def raw_links(content: Column) -> Column:
    """All link targets of a text: Markdown links first, then href attributes."""
    find = lambda rx: F.regexp_extract_all(content, F.lit(rx), F.lit(1))
    return F.concat(find(rules.MARKDOWN_LINK), find(rules.HREF))


def extract_links(
    pages: DataFrame,
    content: str = "html",
    url: str = "url",
    include_external: bool = False,
    rebase: bool = True,
    strip_titles: bool = False,
) -> DataFrame:
    """One row per link that may lead to a page.

    Adds ``pos`` (order within the page), ``raw``, ``dst_url`` (no query or fragment) and
    ``dst_key``; ``content`` is dropped before the links are exploded. A page inside a
    documentation tree keeps only links into that tree, rooted ones being moved into it.
    """
    df = urls.with_url_parts(pages, url, "from_")
    df = df.withColumn("__raws", raw_links(F.col(content))).drop(content)
    df = df.select("*", F.posexplode("__raws").alias("pos", "__raw")).drop("__raws")
    raw = js_trim(F.split_part(F.col("__raw"), F.lit("#"), F.lit(1)))
    if strip_titles:
        raw = F.regexp_replace(raw, r"\s+[\"'].*\z", "")
    df = let(df, {"raw": raw}).drop("__raw")
    r = F.col("raw")
    df = df.filter((r != "") & ~r.rlike(r"\A(?:mailto:|javascript:|<|%3C)"))
    df = urls.with_resolved(df, "from_", "raw").filter(F.col("to_url").isNotNull())

    external = ~urls.origin("to_").eqNullSafe(urls.origin("from_"))
    if include_external:
        host = F.coalesce(F.col("to_host"), F.lit(""))
        badge = reduce(lambda a, b: a | b, [host.contains(x) for x in rules.BADGE_HOST_PARTS])
        df = df.filter(~(external & badge))
    else:
        df = df.filter(~external)
    df = df.withColumn("base_path", urls.base_path(F.col("from_path")))
    if rebase:
        df = _into_base_path(df)
    files = rf"(?i)\.(?:{'|'.join(rules.SKIPPED_SUFFIXES)})\z"
    df = df.filter(~F.coalesce(F.col("to_path"), F.col("to_url")).rlike(files))
    plain = F.regexp_replace(F.col("to_url"), r"(?s)[?#].*\z", "")
    slash = urls.key_path(F.col("to_path"))
    return let(
        df,
        {
            "dst_url": plain,
            "dst_key": F.coalesce(F.concat(urls.origin("to_"), slash), plain),
        },
    ).drop(*_parts("from_"), *_parts("to_"), "to_url", "base_path")


def _parts(prefix: str) -> list[str]:
    return [f"{prefix}{n}" for n in ("scheme", "host", "port", "path", "query", "fragment")]


def _into_base_path(df: DataFrame) -> DataFrame:
    """Move rooted links into the page's documentation tree; drop what stays outside."""
    base, path, r = F.col("base_path"), F.col("to_path"), F.col("raw")
    outside = base.isNotNull() & ~F.coalesce(path.startswith(base), F.lit(False))
    movable = outside & r.startswith("/") & ~r.startswith(base)
    bare = F.regexp_replace(r, r"(?s)\?.*\z", "")
    moved = F.when(
        movable,
        urls.fold_dots(urls.escape_path(F.concat(F.regexp_replace(base, r"/\z", ""), bare))),
    )
    df = let(df, {"__outside": outside, "__moved": moved})
    df = df.filter(~F.col("__outside") | F.coalesce(F.col("__moved").startswith(base), F.lit(False)))
    new = F.col("__moved")
    return df.withColumns(
        {
            "to_path": F.coalesce(new, path),
            "to_url": F.when(new.isNotNull(), F.concat(urls.origin("from_"), new)).otherwise(
                F.col("to_url")
            ),
            **{
                f"to_{n}": F.when(new.isNotNull(), F.col(f"from_{n}")).otherwise(F.col(f"to_{n}"))
                for n in ("scheme", "host", "port")
            },
        }
    ).drop("__outside", "__moved")


def link_edges(links: DataFrame, src: str = "src_key") -> DataFrame:
    """Distinct links of each page with the place of their first occurrence.

    Links of one page leave the same task, so most duplicates are gone before the shuffle.
    """
    return links.groupBy(src, "dst_url", "dst_key").agg(F.min("pos").alias("pos"))


def link_counts(links: DataFrame, src: str = "src_key") -> DataFrame:
    """Number of distinct links per page."""
    return link_edges(links, src).groupBy(src).agg(F.count("*").alias("n_links"))


def dangling_links(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Edges whose target is not among the captured pages (``pages`` has ``url_key``)."""
    return edges.join(
        pages.select(F.col("url_key").alias("dst_key")), "dst_key", "left_anti"
    )
