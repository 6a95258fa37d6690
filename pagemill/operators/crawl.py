"""Breadth-first traversal of a link graph as a loop of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.dedup import first_per_key
from pagemill.session import materialize, materialize_bucketed

#: A hub has more links than this, and than a thousandth of all links, so that there are at most a thousand hubs.
HUB = 20_000

_REACHED = ("crawl_id", "url_key", "url", "depth", "parent_key", "pos")


def node() -> Column:
    """One text for a page of a crawl, the key that levels are bucketed by."""
    return F.concat(F.coalesce(F.col("crawl_id").cast("string"), F.lit("")), F.lit("\x1f"), F.col("url_key"))


def start(entries: DataFrame) -> DataFrame:
    """The first level: the entry pages."""
    depth0 = entries.select(
        "crawl_id",
        "url_key",
        "url",
        F.lit(0).alias("depth"),
        F.lit(None).cast("string").alias("parent_key"),
        F.lit(None).cast("int").alias("pos"),
    )
    return _level(depth0, [F.col("url")], ())


def next_level(found: DataFrame, depth: int, levels: Sequence[DataFrame]) -> DataFrame:
    """The pages that links lead to and no earlier level has, each with the first link to it.

    ``found`` has ``crawl_id, src_key, dst_key, dst_url, pos``. It is reduced to a row per page in every task before
    its one shuffle; the earlier levels are bucketed the same way and stay where they are.
    """
    found = found.select(
        "crawl_id",
        F.col("dst_key").alias("url_key"),
        F.col("dst_url").alias("url"),
        F.lit(depth).alias("depth"),
        F.col("src_key").alias("parent_key"),
        F.col("pos").cast("int").alias("pos"),
    )
    return _level(found, [F.col("parent_key"), F.col("pos"), F.col("url")], levels)


def _level(found: DataFrame, order: list[Column], levels: Sequence[DataFrame]) -> DataFrame:
    new = first_per_key(found.withColumn("node", node()), ["node"], order)
    for level in levels:
        new = new.join(level.select("node"), "node", "left_anti")
    return materialize_bucketed(new, "node", spread=False)


def bucketed_edges(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges in buckets of ``cell``, and the hubs.

    A cell is a source page, or a share of the links of a hub, so that one page with very many links is dealt over many
    buckets. The hubs (``src_key, shares``) are a thousand rows at most.
    """
    sizes = materialize(edges.groupBy("src_key").agg(F.count("*").alias("n")).filter(F.col("n") > HUB))
    # Fewer links than this in all, and there are no hubs; their number is bounded by the links that hubs alone have.
    limit = max(HUB, (sizes.agg(F.sum("n")).first()[0] or 0) // 1000)
    hubs = sizes.filter(F.col("n") > limit).select("src_key", F.ceil(F.col("n") / limit).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("dst_key", "dst_url", "pos"), F.col("shares"))
    cells = edges.join(F.broadcast(hubs), "src_key", "left").withColumn("cell", _cell(F.coalesce(share, F.lit(0))))
    return materialize_bucketed(cells.drop("shares"), "cell"), hubs


def _cell(share: Column) -> Column:
    return F.concat(F.col("src_key"), F.lit("\x1f"), share.cast("string"))


def follow(level: DataFrame, edges: DataFrame, hubs: DataFrame) -> DataFrame:
    """The links of the pages of a level; only the level is shuffled, the edges stay in their buckets."""
    asked = level.select("crawl_id", F.col("url_key").alias("src_key")).join(F.broadcast(hubs), "src_key", "left")
    shares = F.sequence(F.lit(0), F.coalesce(F.col("shares"), F.lit(1)) - 1)
    asked = asked.select("crawl_id", "src_key", F.explode(shares).alias("share"))
    asked = asked.select("crawl_id", _cell(F.col("share")).alias("cell"))
    return asked.join(edges, "cell").drop("cell")


def crawl(edges: DataFrame, entries: DataFrame, max_depth: int = 1) -> DataFrame:
    """Reach pages from entry pages, many crawls at once.

    ``edges`` has ``src_key, dst_key, dst_url, pos``; ``entries`` has ``crawl_id, url_key,
    url``. Returns ``crawl_id, url_key, url, depth, parent_key, pos``: each key once per crawl at
    its smallest depth, with the first link that led to it.

    Edges are written once in buckets of their source, and each level in buckets of its pages. A level joins the frontier with the edges, reduces
    to one row per new key before the shuffle and leaves out what earlier levels have: what is shuffled is the frontier and the links it has, never
    all edges or all visited pages. Levels are files in the shared folder, so the plan does not grow with what was computed
    before, and a lost executor costs at most one level.
    """
    edges, hubs = bucketed_edges(edges.select("src_key", "dst_key", "dst_url", "pos"))
    levels = [start(entries)]
    for depth in range(1, max_depth + 1):
        new = next_level(follow(levels[-1], edges, hubs), depth, levels)
        if new.isEmpty():
            break
        levels.append(new)
    return reached(levels)


def reached(levels: Sequence[DataFrame]) -> DataFrame:
    """All levels as one table."""
    out = levels[0].select(*_REACHED)
    for level in levels[1:]:
        out = out.unionByName(level.select(*_REACHED))
    return out


def crawl_depths(reached: DataFrame) -> DataFrame:
    """How many pages each crawl reached at each depth."""
    return reached.groupBy("crawl_id", "depth").agg(F.count("*").alias("n_pages"))


def outcomes(reached: DataFrame, content: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """What became of every page that was reached.

    ``content`` has ``url_key``, ``blocked_reason`` and ``error`` (both null for a good page); other columns that ``carry`` names
    are kept. A page that is not there at all failed. A crawl whose entry page did not succeed ends there:
    its rows carry ``entry_failed``.
    """
    have = content.select("url_key", "blocked_reason", "error", *carry, F.lit(True).alias("__have"))
    df = reached.join(have, "url_key", "left")
    status = (
        F.when(F.col("__have").isNull() | F.col("error").isNotNull(), "failed")
        .when(F.col("blocked_reason").isNotNull(), "blocked")
        .otherwise("saved")
    )
    df = df.withColumns(
        {
            "status": status,
            "reason": F.col("blocked_reason"),
            "error": F.when(F.col("__have").isNull(), "not captured").otherwise(F.col("error")),
        }
    ).drop("__have", "blocked_reason")
    bad = df.filter((F.col("depth") == 0) & (F.col("status") != "saved")).select("crawl_id")
    bad = bad.distinct().withColumn("__bad", F.lit(True))
    df = df.join(bad, "crawl_id", "left").filter((F.col("depth") == 0) | F.col("__bad").isNull())
    return df.withColumn(
        "status", F.when(F.col("__bad"), "entry_failed").otherwise(F.col("status"))
    ).drop("__bad")


def follow_content(
    edges: DataFrame, content: DataFrame
) -> DataFrame:
    """Only links of pages that were saved: failed and blocked pages lead nowhere."""
    good = content.filter(F.col("blocked_reason").isNull() & F.col("error").isNull())
    return edges.join(good.select(F.col("url_key").alias("src_key")), "src_key", "left_semi")
