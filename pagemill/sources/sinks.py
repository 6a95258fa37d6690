"""Writing Markdown: as a table, or as one file per page."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions import paths
from pagemill.sources.files import Files


def split_safe(files: DataFrame, path: str = "local_path") -> tuple[DataFrame, DataFrame]:
    """Rows whose path stays below the output folder, and the others."""
    safe = paths.is_safe_path(F.concat(F.lit("out/"), F.col(path)))
    return files.filter(safe), files.filter(~safe)


def write_markdown(files: DataFrame, target: str, partition: str = "host") -> None:
    """Write one folder per host.

    Rows are rebalanced by host before writing: Spark merges small hosts into few files and
    splits a host that holds much of the data over many tasks.
    """
    files.hint("rebalance", F.col(partition)).write.partitionBy(partition).mode(
        "overwrite"
    ).parquet(target)


def export_files(
    files: DataFrame, folder: str, path: str = "local_path", text: str = "markdown"
) -> DataFrame:
    """Write one UTF-8 file per row below ``folder``, a place that all executors reach; an existing file is replaced.

    Files show when their task has written all of them, and go again if the job fails. Returns the paths
    written with their sizes in bytes. Rows with an unsafe path are left out (:func:`split_safe` gives them).
    """
    safe, _ = split_safe(files, path)
    spark, run = files.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(Files)
    rows = safe.select(F.col(path).alias("path"), F.col(text).alias("body"))
    rows.write.format(Files.name()).option("run", run).mode("append").save(folder)
    return spark.read.schema("path string, n_bytes long").json(f"{folder.rstrip('/')}/_written/{run}")
