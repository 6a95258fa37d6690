"""Naming an expression so that it is evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that later filters and joins refer to by name only.

    The optimizer moves a filter on a computed column below the projection by repeating the
    expression, once per use; for long expressions that multiplies the work. Columns that come
    out of a generator are not repeated, so the values pass through a one-row ``inline``.
    """
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(row)))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, within one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
