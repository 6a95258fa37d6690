"""Captured inputs as tables with fixed schemas."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagemill import rules
from pagemill.sources import folders

PAGES = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("html", T.StringType()),
    ]
)
RESPONSES = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("adapter", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("body", T.StringType()),
    ]
)
SITEMAPS = T.StructType(
    [T.StructField("sitemap_url", T.StringType()), T.StructField("body", T.StringType())]
)


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    return spark.read.format(fmt).schema(schema).load(path)


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured pages: ``page_id, url, html``. Unused columns are never read."""
    return _read(spark, path, PAGES, fmt)


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured responses of the adapters, one row per URL and adapter."""
    return _read(spark, path, RESPONSES, fmt)


def read_checked_responses(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Captured responses with ``reject``, why a row is of no use, and ``record``, its raw text where it could not be read.

    Nothing is dropped: rows with a ``reject`` are the side output, those without are responses. ``fmt`` is ``json`` (one record a line) or a
    table format, whose rows are always readable.
    """
    if fmt == "json":
        schema = T.StructType([*RESPONSES.fields, T.StructField("record", T.StringType())])
        df = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "record").json(path)
    else:
        df = _read(spark, path, RESPONSES, fmt).withColumn("record", F.lit(None).cast("string"))
    reject = (
        F.when(F.col("record").isNotNull(), "unreadable record")
        .when(F.coalesce(F.btrim("url"), F.lit("")) == "", "no url")
        .when(F.col("adapter").isNull(), "no adapter")
        .when(~F.col("adapter").isin(*rules.ADAPTERS), F.concat(F.lit("unknown adapter: "), F.col("adapter")))
    )
    return df.withColumn("reject", reject)


def counted(checked: DataFrame, observation: Observation) -> DataFrame:
    """The same rows; ``observation`` gets their number and that of rejects from whatever job reads them, without a pass of its own."""
    return checked.observe(observation, F.count(F.lit(1)).alias("rows"), F.count("reject").alias("rejected"))


def read_sitemaps(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Captured sitemaps; ``fmt='xml-files'`` takes a folder of raw files, each named ``<host>/<path>`` below it."""
    if fmt == "xml-files":
        files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
        return files.select(_file_url(path), F.col("value").alias("body"))
    return _read(spark, path, SITEMAPS, fmt)


def _file_url(path: str, scheme: str = "https") -> Column:
    """The address that a file below ``path`` was captured from."""
    folder = path.rstrip("/").rsplit("://", 1)[-1].removeprefix("file:").lstrip("/")
    below = F.regexp_extract("_metadata.file_path", rf"(?s)/{re.escape(folder)}/(.*)\z", 1)
    name = F.url_decode(F.replace(below, F.lit("+"), F.lit("%2B")))
    return _url_of(name, scheme)


def _url_of(name: Column, scheme: str) -> Column:
    return F.concat(F.lit(f"{scheme}://"), F.regexp_replace(name, r"\.gz\z", "")).alias("sitemap_url")


#: Files of this many bytes at most are read as a whole: opening a reader of records costs more than reading so little.
_SHORT_FILE = 1 << 20


def read_sitemap_files(spark: SparkSession, path: str, scheme: str = "https") -> DataFrame:
    """The records of raw sitemap files, each named ``<host>/<path>`` below ``path``: ``sitemap_url, index, pos, kind, loc``.

    A record ends with each ``</loc>``, so a file of any length is read by many tasks, each from its own part on; compressed files
    (``.gz``) are read by one, and so are files of a megabyte at most. Tasks list the folders too (``sources.folders``): the driver holds no list of files.
    Only what tasks can't open on their own, patterns and stores that only Spark reads, and other compressed files, are listed by Spark. ``kind`` is ``page`` or
    ``child``, null for records without an entry; ``pos`` orders the records of a file; ``index`` marks the record that says its file is an index.
    ``operators.sitemaps.from_records`` takes them from here.
    """
    folder = folders.address(spark, path)
    df = _listed_by_spark(spark, path, scheme) if folder is None else _listed_by_tasks(spark, path, folder, scheme)
    page, child = (F.regexp_extract("v", rf"(?s){rx.removesuffix('</loc>')}\z", 1) for rx in (rules.SITEMAP_PAGE, rules.SITEMAP_CHILD))
    df = df.withColumns({"page": page, "child": child, "index": F.col("v").contains("<sitemapindex")})
    kind = F.when(F.col("page") != "", "page").when(F.col("child") != "", "child")
    df = df.select("sitemap_url", "index", F.struct("__part", "__row").alias("pos"), kind.alias("kind"), F.coalesce(F.nullif("page", F.lit("")), F.nullif("child", F.lit(""))).alias("loc"))
    return df.hint("rebalance") if folder is None else df  # the tasks that listed the files share them evenly


def _listed_by_tasks(spark: SparkSession, path: str, folder: str, scheme: str) -> DataFrame:
    files = folders.listed(spark, folder)
    foreign = reduce(or_, [F.col("name").endswith(x) for x in folders.codecs(spark) if x != ".gz"], F.lit(False))
    df = folders.records(files.filter(~foreign), folder, "</loc>", _SHORT_FILE)
    df = df.select(_url_of(F.col("name"), scheme), "__part", "__row", "v")
    literal = lambda name: re.sub(r"([\\{}\[\]*?])", r"\\\1", f"{path.rstrip('/')}/{name}")
    if others := [literal(r["name"]) for r in files.filter(foreign).collect()]:
        df = df.unionByName(_lines(spark, others, path, scheme, F.lit(True)))
    return df


def _listed_by_spark(spark: SparkSession, path: str, scheme: str) -> DataFrame:
    short = F.col("_metadata.file_path").endswith(".xml") & (F.col("_metadata.file_size") <= _SHORT_FILE)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(short)
    files = files.select(_file_url(path, scheme), F.split(F.col("content").cast("string"), F.lit("</loc>"), -1).alias("__all"))
    # What follows the last end is a record unless it is empty.
    records = F.when(F.element_at("__all", -1) == "", F.slice("__all", 1, F.size("__all") - 1)).otherwise(F.col("__all"))
    files = files.select("sitemap_url", F.lit(0).cast("long").alias("__part"), F.posexplode(records).alias("__row", "v"))
    return _lines(spark, path, path, scheme, ~short).unionByName(files.withColumn("__row", F.col("__row").cast("long")))


def _lines(spark: SparkSession, paths: str | list[str], path: str, scheme: str, taken: Column) -> DataFrame:
    # Within a part the order is that of the rows of its task.
    lines = spark.read.option("lineSep", "</loc>").option("recursiveFileLookup", "true").text(paths).filter(taken)
    return lines.select(_file_url(path, scheme), F.col("_metadata.file_block_start").alias("__part"), F.monotonically_increasing_id().alias("__row"), F.col("value").alias("v"))
