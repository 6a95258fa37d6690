"""Folders of raw files, listed and read by tasks.

Spark's readers list a folder in the driver, which holds the status of every file and a plan of who opens it: too much for millions of
short files. Here tasks list the folders of a level, one level after the other, and what they find is a table, as are the parts of files
that tasks read. The driver counts folders only. An entry of a local or shared folder is handed on as soon as it is seen; other stores give
the entries of one folder at once, to the task that lists it.
"""

from __future__ import annotations

import gzip
import os
from collections.abc import Callable, Iterator
from functools import partial
from itertools import islice

import pyarrow as pa
from py4j.protocol import Py4JError
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import materialize
from pagemill.sources.files import opened

#: Entries or records of an output batch, its bytes at most (a longer record is a batch of its own), and bytes read at once.
_ROWS, _BATCH, _CHUNK = 10_000, 4_000_000, 1 << 20


def address(spark: SparkSession, path: str) -> str | None:
    """The address of a folder that tasks can open on their own; None for patterns, single files and stores that only Spark reads."""
    try:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        place = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(place).toUri().toASCIIString()
        place = f"file:///{place.removeprefix('file:').lstrip('/')}" if place.startswith("file:") else place
        store, root = opened(place)
        return place if store.get_file_info(root).type == fs.FileType.Directory else None
    except (OSError, ValueError, NotImplementedError, Py4JError):
        return None


def codecs(spark: SparkSession) -> list[str]:
    """The extensions of files that Spark's readers decompress."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory.getCodecClasses(conf)
    return sorted(jvm.org.apache.hadoop.util.ReflectionUtils.newInstance(c, conf).getDefaultExtension() for c in found)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """The files below the address of a folder that aren't empty: ``name``, from the folder on, and ``size``. Hidden ones are left out as Spark does."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level, files, left = spark.range(1).select(F.lit("").alias("name")), None, 1
    while left:
        found = materialize(level.repartition(min(n, left)).mapInArrow(partial(_list, folder), "name string, size long"))
        files = found.filter("size > 0") if files is None else files.unionByName(found.filter("size > 0"))
        level = found.filter("size IS NULL").select("name")
        left = level.count()
    return files


def records(files: DataFrame, folder: str, end: str, short: int) -> DataFrame:
    """What lies between the ends in these files: ``name, __part, __row, v``, in the order of parts and rows.

    Parts are as long as Spark's partitions of files; files of ``short`` bytes at most and ``.gz`` files are one. A record belongs to the
    part in which it begins; a last one without an end is a record unless it is empty.
    """
    spark = files.sparkSession
    step = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    whole = F.col("name").endswith(".gz") | (F.col("size") <= short)
    starts = F.when(whole, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long")))
    parts = files.select("name", F.explode(starts).alias("start"), F.when(~whole, F.lit(step)).alias("length"))
    parts = parts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    read = parts.mapInArrow(partial(_read, folder, end.encode()), "name string, __part long, __row long, v binary")
    return read.withColumn("v", F.col("v").cast("string"))


def _hidden(name: str, is_folder: bool) -> bool:
    """As Spark's listing has it."""
    kept = is_folder and name.startswith(("_metadata", "_common_metadata"))
    return (name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")) and not kept


def _entries(store: fs.FileSystem, folder: str) -> Iterator[tuple[str, int | None]]:
    """Names in a folder with their sizes, None for folders."""
    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(folder) as found:
            for entry in found:
                if entry.is_dir():
                    yield entry.name, None
                elif entry.is_file():
                    yield entry.name, entry.stat().st_size
    else:
        for info in store.get_file_info(fs.FileSelector(folder)):
            yield info.base_name, info.size if info.is_file else None


def _list(address: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, root = opened(address)
    for batch in batches:
        for folder in batch.column(0).to_pylist():
            below = f"{folder}/" if folder else ""
            found = ((below + name, size) for name, size in _entries(store, f"{root}/{folder}") if not _hidden(name, size is None))
            while rows := list(islice(found, _ROWS)):
                names, sizes = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], ["name", "size"])


def _read(address: str, end: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, root = opened(address)
    names, types = ("name", "__part", "__row", "v"), (pa.string(), pa.int64(), pa.int64(), pa.binary())
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    for name, start, length in (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)):
        with store.open_input_file(f"{root}/{name}") as f:
            for k, v in enumerate(_between(f, end, start, length, name.endswith(".gz"))):
                if rows and (len(rows) >= _ROWS or held + len(v) > _BATCH):
                    yield batch()
                    rows, held = [], 0
                rows.append((name, start, k, v))
                held += len(v)
    if rows:
        yield batch()


def _between(f: pa.NativeFile, end: bytes, start: int, length: int | None, packed: bool) -> Iterator[bytes]:
    """The records of a file that begin in a part, or all of them without a length."""
    at = max(start - len(end), 0)  # an end before the part begins its first record
    f.seek(at)
    read: Callable[[int], bytes] = gzip.GzipFile(fileobj=f).read if packed else f.read
    stop = None if length is None else start + length
    rest, begun = b"", start == 0
    while chunk := read(max(_CHUNK, len(rest))):  # twice as much each time while there is no end
        *whole, rest = (rest + chunk).split(end)
        for v in whole:
            if begun and at >= start:
                yield v
            at, begun = at + len(v) + len(end), True
            if stop is not None and at >= stop:
                return
    if rest and begun and at >= start:
        yield rest
