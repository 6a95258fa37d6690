"""Run reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crawl_report(outcomes: DataFrame, by: str = "crawl_id") -> DataFrame:
    """Pages visited, saved, blocked and failed per crawl."""
    status = F.col("status")
    blocked = (status == "blocked") | ((status == "entry_failed") & F.col("reason").isNotNull())
    return outcomes.groupBy(by).agg(
        F.count("*").alias("visited"),
        F.count_if(status == "saved").alias("saved"),
        F.count_if(blocked).alias("blocked"),
        F.count_if((status != "saved") & ~blocked).alias("failed"),
    )


def blocked_pages(outcomes: DataFrame) -> DataFrame:
    """URL and reason of every blocked page."""
    return outcomes.filter(F.col("reason").isNotNull()).select("url", "reason")


def blocked_by_host(outcomes: DataFrame, host: str = "host") -> DataFrame:
    """Blocked pages per host and reason."""
    return (
        outcomes.filter(F.col("reason").isNotNull())
        .groupBy(host, "reason")
        .agg(F.count("*").alias("n_pages"))
    )
