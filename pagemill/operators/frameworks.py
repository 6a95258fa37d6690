"""Site configuration and framework detection, all within the row of a page."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions import selectors
from pagemill.operators import tokens


def site_config_key(
    host: Column, configs: Sequence[rules.SiteConfig] = rules.SITE_CONFIGS
) -> Column:
    """The configuration of a host: its own one or the default."""
    own = [c.key for c in configs if not c.key.startswith("__")]
    return F.when(host.isin(*own), host).otherwise(F.lit(rules.DEFAULT_KEY))


def config_table(spark, configs: Sequence[rules.SiteConfig] = rules.SITE_CONFIGS) -> DataFrame:
    """The configurations as a table, for joins and reports."""
    return spark.createDataFrame(
        [(c.key, c.content, list(c.remove), c.framework, c.may_be_blocked) for c in configs],
        "config_key string, content_selector string, remove_selectors array<string>, "
        "framework string, may_be_blocked boolean",
    )


def with_site_config(
    pages: DataFrame, host: str = "host", configs: Sequence[rules.SiteConfig] = rules.SITE_CONFIGS
) -> DataFrame:
    """Join each page with the configuration of its host (the table has one row per rule set)."""
    df = pages.withColumn("config_key", site_config_key(F.col(host), configs))
    return df.join(F.broadcast(config_table(pages.sparkSession, configs)), "config_key")


def _searchable(pages: DataFrame, html: str) -> DataFrame:
    """Add the page's opening tags and its text in lower case, both made once."""
    return pages.withColumns(
        {"__tags": tokens.open_tags(F.col(html)), "__lower": F.lower(F.col(html))}
    )


def signal_columns(
    html: str, rule_set: Sequence[rules.FrameworkRule] = rules.FRAMEWORK_RULES
) -> list[tuple[rules.FrameworkRule, str, int, str, Column]]:
    """``(rule, kind, order, pattern, found)`` for every signal of every framework.

    Patterns are searched only in pages that hold one of the words they need.
    """
    out = []
    for rule in rule_set:
        for i, s in enumerate(rule.selectors, 1):
            out.append((rule, "selector", i, s, selectors.page_has(F.col("__tags"), s)))
        words = [F.col("__lower").contains(w) for w in rule.hints] or [F.lit(True)]
        hinted = reduce(lambda a, b: a | b, words)
        for i, rx in enumerate(rule.html, 1):
            out.append((rule, "html", i, rx, hinted & F.col(html).rlike(rx)))
    return out


def framework_signals(pages: DataFrame, html: str = "html") -> DataFrame:
    """One row per signal that a page shows."""
    df = _searchable(pages, html)
    found = [
        F.struct(
            F.lit(rule.framework).alias("framework"),
            F.lit(kind).alias("kind"),
            F.lit(i).alias("ord"),
            F.lit(pattern).alias("pattern"),
            hit.alias("__hit"),
        )
        for rule, kind, i, pattern, hit in signal_columns(html)
    ]
    kept = [c for c in pages.columns if c != html]
    return df.select(*kept, F.inline(F.array(*found))).filter("__hit").drop("__hit")


def _with_scores(
    pages: DataFrame, html: str, html_first: bool
) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Add one column of points per framework; also return ``(framework, column)`` pairs.

    Selectors count the full weight and patterns half of it; ``html_first`` swaps the two.
    """
    df = _searchable(pages, html)
    points: dict[str, list[Column]] = {}
    for rule, kind, _, _, hit in signal_columns(html):
        full = (kind == "html") == html_first
        weight = rule.weight if full else rule.weight // 2
        points.setdefault(rule.framework, []).append(F.when(hit, weight).otherwise(0))
    names = [(name, f"__score_{i}") for i, name in enumerate(points)]
    sums = {col: reduce(lambda a, b: a + b, points[name]) for name, col in names}
    return df.withColumns(sums).drop("__tags", "__lower"), names


def framework_scores(pages: DataFrame, html: str = "html", html_first: bool = False) -> DataFrame:
    """One row per page and framework with points."""
    df, names = _with_scores(pages, html, html_first)
    rows = [F.struct(F.lit(n).alias("framework"), F.col(c).alias("score")) for n, c in names]
    out = [c for c in pages.columns if c != html]
    return df.select(*out, F.inline(F.array(*rows))).filter("score > 0")


def detect_framework(pages: DataFrame, html: str = "html", html_first: bool = False) -> DataFrame:
    """Add ``framework, score, confidence``: the best score, ties to the earlier rule."""
    df, names = _with_scores(pages, html, html_first)
    df = df.withColumn("score", F.greatest(*[F.col(c) for _, c in names]))
    best = reduce(
        lambda acc, row: acc.when(F.col(row[1]) == F.col("score"), row[0]),
        names,
        F.when(F.col("score") == 0, "custom"),
    )
    return df.withColumns(
        {
            "framework": best,
            "confidence": F.least(F.round(F.col("score") / rules.FULL_SCORE, 4), F.lit(1.0)),
        }
    ).drop(*[c for _, c in names])


def with_effective_config(
    pages: DataFrame,
    html: str = "html",
    host: str = "host",
    configs: Sequence[rules.SiteConfig] = rules.SITE_CONFIGS,
) -> DataFrame:
    """Add ``config_key``: the host's own configuration, else that of the detected framework."""
    df = detect_framework(pages, html)
    own = site_config_key(F.col(host), configs)
    detected = F.concat(F.lit("__"), F.col("framework"), F.lit("__"))
    known = [c.key for c in configs if c.key.startswith("__")]
    sure = F.col("score") >= rules.MIN_CONFIDENCE * rules.FULL_SCORE
    return df.withColumn(
        "config_key",
        F.when((own == rules.DEFAULT_KEY) & sure & detected.isin(*known), detected).otherwise(own),
    )


def framework_counts(detected: DataFrame) -> DataFrame:
    """How many pages each framework made, and how sure the detection is on average."""
    return detected.groupBy("framework").agg(
        F.count("*").alias("n_pages"), F.round(F.avg("confidence"), 4).alias("avg_confidence")
    )
