"""Choosing one response per URL: ranked fallback over captured responses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions import content, urls


def applicable(
    host: Column,
    use_md: bool = False,
    use_reader: bool = False,
    md_hosts: Sequence[str] = rules.MD_ENDPOINT_HOSTS,
    mdx_hosts: Sequence[str] = rules.MDX_HOSTS,
) -> list[tuple[int, str, Column]]:
    """``(order, adapter, applies)`` for a page's host."""
    md, mdx, reader, page = rules.ADAPTERS
    return [
        (1, md, F.lit(True) if use_md else urls.host_matches(host, md_hosts)),
        (2, mdx, urls.host_matches(host, mdx_hosts)),
        (3, reader, F.lit(use_reader)),
        (4, page, F.lit(True)),
    ]


def adapter_plan(df: DataFrame, host: str = "host", **options) -> DataFrame:
    """One row per URL and adapter to try, with its order."""
    rows = [
        F.when(applies, F.struct(F.lit(i).alias("ord"), F.lit(name).alias("adapter")))
        for i, name, applies in applicable(F.col(host), **options)
    ]
    return df.select("*", F.inline(F.array_compact(F.array(*rows))))


def preferred_adapter(df: DataFrame, host: str = "host", **options) -> DataFrame:
    """Add the first adapter that applies."""
    picks = [F.when(applies, F.lit(name)) for _, name, applies in applicable(F.col(host), **options)]
    return df.withColumn("adapter", F.coalesce(*picks))


def with_response_error(responses: DataFrame) -> DataFrame:
    """Add ``error``, why a response is of no use; null when it passes its adapter's check.

    Needs ``url, adapter, status, content_type, body``. The page adapter's body is finished
    Markdown: it is checked for blocking, the others are not.
    """
    df = urls.with_url_parts(responses, "url", "__u_")
    status, body = F.col("status"), F.col("body")
    md, mdx, reader, page = rules.ADAPTERS
    reason = content.blocked_reason(F.coalesce(body, F.lit("")))
    df = df.withColumn(
        "blocked_reason", F.when((F.col("adapter") == page) & status.between(200, 299), reason)
    )
    df = df.withColumns(
        {
            "__md_url": urls.md_url("__u_"),
            "__mdx_url": urls.md_url("__u_", keep_mdx=True),
        }
    )
    failed = F.concat(F.lit("Fetch failed: "), status.cast("string"), F.lit(" "), F.col("url"))
    page_error = F.when(~F.coalesce(status.between(200, 299), F.lit(False)), failed).otherwise(
        content.page_error(F.col("blocked_reason"), F.col("__u_host"))
    )
    adapter = F.col("adapter")
    error = (
        F.when(
            adapter == md,
            content.md_endpoint_error(status, F.col("content_type"), body, F.col("__md_url")),
        )
        .when(adapter == mdx, content.mdx_error(status, body, F.col("__mdx_url")))
        .when(adapter == reader, content.reader_error(status, body))
        .when(adapter == page, page_error)
    )
    df = df.withColumn("error", error)
    return df.drop("__md_url", "__mdx_url", *[c for c in df.columns if c.startswith("__u_")])


def _folded(responses: DataFrame, use_md: bool, use_reader: bool, key: str, page: bool) -> DataFrame:
    """All tries of a key in one row: the winner and the error of each adapter.

    One shuffle: all adapters of a key are folded by one aggregate, which every task starts on its own rows, so a
    key with very many responses is no hot spot. Without ``page`` the page adapter can't win; its try is kept apart.
    """
    df = urls.with_url_parts(with_response_error(responses), "url")
    order = F.lit(None)
    for i, name, applies in reversed(applicable(F.col("host"), use_md, use_reader)):
        order = F.when((F.col("adapter") == name) & applies, i).otherwise(order)
    df = df.withColumn("ord", order).filter(F.col("ord").isNotNull())
    ok, last = F.col("error").isNull(), len(rules.ADAPTERS)
    wins = ok if page else ok & (F.col("ord") < last)
    win = F.struct("ord", "adapter", "body")
    own = F.struct("body", "blocked_reason", "error")
    return df.groupBy(key).agg(
        F.min_by(F.when(wins, win), F.when(wins, F.struct("ord", "body"))).alias("__win"),
        F.max("blocked_reason").alias("blocked_reason"),
        F.min_by(F.when(F.col("ord") == last, own), F.when(F.col("ord") == last, F.struct("error", "blocked_reason", "body"))).alias("__page"),
        *[
            F.min(
                F.when((F.col("ord") == i) & ~ok, F.concat(F.col("adapter"), F.lit(": "), F.col("error")))
            ).alias(f"__e{i}")
            for i in range(1, last + 1)
        ],
        *[F.bool_or((F.col("ord") == i) & ok).alias(f"__ok{i}") for i in range(1, last + 1)],
    )


def _tried(upto: int) -> Column:
    """One ``adapter: text`` line per failed try ahead of the winner."""
    lines = [
        F.when(F.coalesce(F.lit(i) < F.col("__win.ord"), F.lit(True)) & ~F.col(f"__ok{i}"), F.col(f"__e{i}"))
        for i in range(1, upto + 1)
    ]
    return F.concat_ws("\n", *lines)


def choose_response(responses: DataFrame, use_md: bool = False, use_reader: bool = False, key: str = "url") -> DataFrame:
    """The first usable response of each key in adapter order.

    Adds ``adapter, body`` (null when all failed), ``blocked_reason`` of the page
    adapter and ``errors``: one ``adapter: text`` line per failed try up to the winner.
    """
    out = _folded(responses, use_md, use_reader, key, page=True)
    return out.select(
        key,
        F.col("__win.adapter").alias("adapter"),
        F.col("__win.body").alias("body"),
        F.when(F.col("__win").isNull(), F.col("blocked_reason")).alias("blocked_reason"),
        _tried(len(rules.ADAPTERS)).alias("errors"),
    )


def served(responses: DataFrame, use_md: bool = False, use_reader: bool = False) -> DataFrame:
    """What each ``url_key`` is served with ahead of its page, and the page as a response.

    Adds ``adapter, body`` (null where every adapter ahead of the page failed), ``errors`` of these, and ``page``: body, reason and error
    of the page adapter's response, null where there is none.
    """
    out = _folded(responses, use_md, use_reader, "url_key", page=False)
    return out.select(
        "url_key",
        F.col("__win.adapter").alias("adapter"),
        F.col("__win.body").alias("body"),
        _tried(len(rules.ADAPTERS) - 1).alias("errors"),
        F.col("__page").alias("page"),
    )


def fallback_errors(chosen: DataFrame) -> DataFrame:
    """The message for every URL that no adapter could serve."""
    failed = chosen.filter(F.col("adapter").isNull())
    text = F.concat(F.lit("All adapters failed for "), F.col("url"), F.lit(":\n"), F.col("errors"))
    return failed.select("url", text.alias("error"))


def adapter_counts(chosen: DataFrame) -> DataFrame:
    """How many URLs each adapter served."""
    return chosen.filter(F.col("adapter").isNotNull()).groupBy("adapter").agg(
        F.count("*").alias("n_pages")
    )
