"""From captured pages to Markdown: one shuffle by page, everything else in place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions import content, urls
from pagemill.operators import frameworks, markdown, regions, rule_tables, tokens


#: What tells one row of a page table from all others, whatever its key is.
ROW = ("__page", "__page_row")


def spread(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """Hash pages over ``partitions`` tasks, by default all shuffle partitions, and number their rows.

    The hash is of the whole row, so a key that is null or that many rows share is no hot spot; rows get their
    number where they arrive, and the two together are the identity of a row without another shuffle.
    The number of tasks is given, so that a small input is not put back into few: what follows is
    bound by CPU, not by the bytes that Spark would otherwise size the tasks by.
    """
    n = partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    page, row = ROW
    parts = [c for c, kind in pages.dtypes if "map<" not in kind and "variant" not in kind]
    df = pages.withColumn(page, F.xxhash64(*parts)).repartition(n, page)
    return df.withColumn(row, F.monotonically_increasing_id())


def page_tokens(pages: DataFrame) -> DataFrame:
    """Pages spread by row, then exploded: the token windows need no shuffle of their own."""
    return regions.with_regions(tokens.html_tokens(spread(pages)), ROW)


def main_tokens(
    pages: DataFrame,
    key: str = "page_id",
    configs: Sequence[rules.SiteConfig] = rules.SITE_CONFIGS,
    partitions: int | None = None,
    row: Sequence[str] | None = None,
    carry: Sequence[str] = (),
    rule_table: DataFrame | None = None,
) -> DataFrame:
    """The tokens of the main content of each page, links made absolute.

    ``pages`` has the key, ``url`` and ``html``. Adds the page's ``config_key``, ``framework``
    and ``host`` to its tokens, and ``ROW``. Rows are told apart by themselves, the key is only carried. ``row`` names columns that
    already tell them apart and by which the pages are spread; the columns in ``carry`` stay. A ``rule_table`` with the columns of
    ``frameworks.config_table`` takes the place of ``configs`` and may have any number of rows.
    """
    df = _main_tokens(pages, key, configs, partitions, row, carry, rule_table)
    return df.select("*", "__of_page.*").drop("__of_page", "__first")


def _main_tokens(pages, key, configs, partitions, row, carry, rule_table) -> DataFrame:
    """:func:`main_tokens` with all that is the same on the tokens of a page in the struct ``__of_page``, and ``__first``.

    Every window and sort copies whole rows, so up to the content only the first token of a page has it; that one always stays.
    """
    df = pages.select(*dict.fromkeys([key, "url", "html", *carry, *(row or ())]))
    if row is None:
        df = spread(df, partitions)
        row = ROW
    df = urls.with_url_parts(df, "url", "from_").withColumn("host", F.col("from_host"))
    if rule_table is None:
        df = frameworks.with_effective_config(df, configs=configs).drop("confidence", "score")
    else:
        df = rule_tables.with_rules(df, rule_table)
    tested = ["config_key"] if rule_table is None else ["rules"]
    same = [c for c in df.columns if c not in ("html", "rules", *row)]
    df = tokens.html_tokens(df.select(*row, *tested, "html", F.struct(*same).alias("__of_page")))
    df = df.withColumn("__of_page", F.when(F.col("pos") == 0, F.col("__of_page")))
    if rule_table is None:
        df = regions.with_regions(df, row)
        df = regions.with_removal(df, row, configs, F.col("config_key"))
    else:
        # The rules go with the tokens no further than this.
        df = regions.with_regions(rule_tables.with_flags(df), row)
    df = regions.drop_regions(df, row)
    df = regions.with_code_language(df, row)
    df = regions.drop_regions(df, row)
    if rule_table is not None:
        df = regions.cut_to(df, row, "is_content", "__of_page", "__first")
    else:
        df = regions.cut_content(df, row, F.col("config_key"), configs, "__of_page", "__first")
    # Last, so that only links of the content are resolved; navigation holds most of a page's.
    base = [f"from_{n}" for n in urls.PARTS]
    df = df.drop("config_key").withColumns({c: F.col(f"__of_page.{c}") for c in base})
    df = markdown.with_reference(df, "from_")
    return df.withColumn("__of_page", F.struct(*[F.col(f"__of_page.{c}").alias(c) for c in same if c not in base]))


def pages_to_markdown(
    pages: DataFrame,
    key: str = "page_id",
    configs: Sequence[rules.SiteConfig] = rules.SITE_CONFIGS,
    strict_access_denied: bool = False,
    partitions: int | None = None,
    row: Sequence[str] | None = None,
    carry: Sequence[str] = (),
    rule_table: DataFrame | None = None,
) -> DataFrame:
    """Cleaned Markdown of every page with its ``framework`` and ``blocked_reason``.

    Every row of ``pages`` is a page and stays one, also where keys are null or repeated.
    """
    df = _main_tokens(pages, key, configs, partitions, row, carry, rule_table)
    kept = dict.fromkeys([key, "url", "host", "framework", "config_key", *carry])
    own = row or ROW
    df = df.withColumn("__of_page", F.when(F.col("__first"), F.col("__of_page"))).drop("__first")
    df = markdown.html_to_markdown(df, own, carry=["__of_page"])
    df = df.select(*[c if c in own else F.col(f"__of_page.{c}").alias(c) for c in kept], *[c for c in own if row is not None and c not in kept], "markdown")
    df = df.withColumn("markdown", content.clean_markdown(F.col("markdown")))
    return df.withColumn(
        "blocked_reason", content.blocked_reason(F.col("markdown"), strict_access_denied)
    )
