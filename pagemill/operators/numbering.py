"""Running numbers within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions import paths
from pagemill.session import materialize


def number_rows(df: DataFrame, group: list[str], order: list[str], out: str = "number") -> DataFrame:
    """Number the rows of each group from 1 in a total order.

    The rows are range-partitioned by group and order, so one big group spreads over many
    tasks. Each task numbers its own part; the sizes of the earlier parts, at most one row
    per task and group, are added afterwards. The range-partitioned rows are written once,
    because both steps must see the same ranges.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        df.repartitionByRange(n, *group, *order).withColumn("__part", F.spark_partition_id())
    )
    part = [*group, "__part"]
    local = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    sizes = ranged.groupBy(*part).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = sizes.select(*part, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in part]
    joined = ranged.withColumn("__local", local).alias("r").join(offsets.alias("o"), on)
    return joined.select(
        *[F.col(f"r.{c}") for c in df.columns],
        (F.col("__local") + F.col("__before")).cast("bigint").alias(out),
    )


def numbered_paths(
    files: DataFrame, group: list[str], order: list[str], path: str = "local_path"
) -> DataFrame:
    """Prefix file names with their number within the directory."""
    df = files.withColumn("dir", paths.dir_path(F.col(path)))
    df = number_rows(df, [*group, "dir"], order)
    return df.withColumn("numbered_path", paths.numbered_path(F.col(path), F.col("number")))
