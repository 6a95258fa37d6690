"""Page files that arrive over time, through the same row-local operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.functions import urls
from pagemill.operators import dedup
from pagemill.plans import pages as page_plan
from pagemill.sources import tables


def read_arriving_pages(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New Parquet page files of a folder as a stream."""
    return (
        spark.readStream.schema(tables.PAGES)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def convert_arrivals(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Convert each page key once and append it to ``target``.

    A batch keeps the first page of every key and leaves out the keys written by earlier
    batches, so the written table is the set of visited pages. A batch that is repeated after a
    failure replaces its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = dedup.dedup_pages(urls.with_url_key(batch, "url"), ["page_id"])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            done = spark.read.schema("url_key string, batch long").parquet(target)
            new = new.join(done.filter(F.col("batch") != batch_id).select("url_key"), "url_key", "left_anti")
        out = page_plan.pages_to_markdown(new, key="url_key")
        out.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
