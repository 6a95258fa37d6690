"""Matching hosts against large tables of domains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_domain(df: DataFrame, domains: DataFrame, host: str = "host", domain: str = "domain", out: str = "domain") -> DataFrame:
    """Add the longest domain of a table that the host equals or lies below, null without one.

    ``functions.urls.host_matches`` is a chain of tests for a short list; here the table may have any number of rows. Each different host is
    exploded into its suffixes, and one equi-join finds the domains among them. What a host has found is joined back by host, so
    a host with very many rows is exploded once.
    """
    known = domains.select(F.lower(domain).alias("__suffix")).filter(F.col("__suffix") != "").distinct()
    names = df.select(F.col(host).alias("__host")).filter(F.col("__host").isNotNull()).distinct()
    labels = F.split("__host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = names.select("__host", F.explode(suffixes).alias("__suffix")).join(known, "__suffix")
    best = found.groupBy("__host").agg(F.max_by("__suffix", F.length("__suffix")).alias(out))
    kept = [c for c in df.columns if c != out]
    return df.join(best, F.col(host) == F.col("__host"), "left").select(*[df[c] for c in kept], best[out])
