"""Vectors of a table as classes of equal ones, and packed for numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, v) with a vector that is not null, empty or zero and has finite components only.

    Components are doubles. Rows of a null id take no part.
    """
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    finite = "forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    return rows.filter(f"{finite} AND exists(v, x -> x <> 0)")


def matrix(column, dim: int | None = None) -> np.ndarray:
    """An Arrow column of lists of doubles, all of one length, as a matrix."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    values = flat.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(flat), -1 if len(flat) else dim or 0)
