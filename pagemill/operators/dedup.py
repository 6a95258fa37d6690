"""One row per key, without gathering the rows of a key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(
    df: DataFrame, keys: list[str], order: list[Column], last: bool = False, count: str | None = None
) -> DataFrame:
    """Keep the first (or last) row of each key in a total order.

    An aggregate rather than a window: every task reduces its own rows to one per key before
    the shuffle, so a key that holds a third of all rows costs no more than any other.
    """
    pick = F.max_by if last else F.min_by
    row = F.struct(*[F.col(c) for c in df.columns if c not in keys])
    aggs = [pick(row, F.struct(*order)).alias("__row")]
    if count:
        aggs.append(F.count("*").alias(count))
    out = df.groupBy(*keys).agg(*aggs)
    return out.select(*keys, "__row.*", *([count] if count else []))


def dedup_pages(pages: DataFrame, order: list[str], key: str = "url_key") -> DataFrame:
    """One page per URL key; rows without a key (no http(s) URL) are left out."""
    kept = pages.filter(F.col(key).isNotNull())
    return first_per_key(kept, [key], [F.col(c) for c in order])


def resolve_collisions(
    files: DataFrame, keys: list[str], order: list[str], on_collision: str = "last"
) -> DataFrame:
    """One file per output path: the last writer wins; ``writers`` counts the candidates.

    With ``on_collision='error'`` a path with several writers fails the job.
    """
    out = first_per_key(files, keys, [F.col(c) for c in order], last=True, count="writers")
    if on_collision == "error":
        message = F.concat(F.lit("several pages for path "), F.col(keys[-1]))
        return out.withColumn(
            "writers", F.when(F.col("writers") > 1, F.raise_error(message)).otherwise(F.col("writers"))
        )
    return out
