"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.session import shared_folder

#: A word is a run of characters other than space, tab and the four line controls.
WORD = r"[^\x20\x09-\x0D]+"


class Scratch:
    """One folder in the shared place for the intermediate tables of one run.

    ``keep`` writes a table and reads it back: its lineage is a file scan, so lost executors
    cost at most the task they ran. ``drop`` removes tables that nothing reads any longer.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def keep(self, df: DataFrame, *by: str) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        writer = df.write.partitionBy(*by) if by else df.write
        writer.parquet(path)
        # With partition columns the file schema lacks them; Spark appends them on reading.
        schema = df.select(*[c for c in df.columns if c not in by], *by).schema
        out = self.spark.read.schema(schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(conf).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that ``df`` does not have."""
    taken, tag = {c.lower() for c in df.columns}, "__"
    while any(f"{tag}{n}".lower() in taken for n in names):
        tag += "_"
    return [f"{tag}{n}" for n in names]


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``: the fixed split of labelled rows."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def hot_join(
    left: DataFrame, right: DataFrame, key: str, count: str, how: str = "inner", limit: int = 20_000
) -> DataFrame:
    """Join ``left`` with one row per key on the right, spreading keys that many left rows share.

    ``right[count]`` is the number of left rows with that key. Keys above the limit are dealt
    over several partitions: the right row is repeated once per share and left rows take a
    share by the hash of their own row. Only the hot keys are broadcast, and the limit grows
    with the data so that there are at most a thousand of them.
    """
    total = right.agg(F.sum(count)).first()[0] or 0
    limit = max(limit, total // 1000)
    hot = right.filter(F.col(count) > limit).select(
        F.col(key).alias("__hot"), F.ceil(F.col(count) / limit).cast("int").alias("__shares")
    )
    right = right.withColumn("__n", F.when(F.col(count) > limit, F.ceil(F.col(count) / limit)).otherwise(1))
    right = right.withColumn("__share", F.explode(F.sequence(F.lit(0), (F.col("__n") - 1).cast("int"))))
    mine = F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.coalesce(F.col("__shares"), F.lit(1)))
    left = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__share", mine.cast("int"))
    return left.drop("__hot", "__shares").join(right.drop("__n"), [key, "__share"], how).drop("__share")


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected edges as rows (node, component), the smallest node.

    Alternating large-star and small-star steps: every step replaces edges by edges to the
    smallest neighbour, found by an aggregate that combines before its shuffle, and writes the
    result. Each step joins on the node; nodes with very many edges are dealt out by ``hot_join``.
    Nodes without edges are not in the result.
    """
    e = edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    )
    e = scratch.keep(e.distinct())
    while True:
        large = scratch.keep(_star(e, scratch, large=True))
        small = scratch.keep(_star(large, scratch, large=False))
        # Done when nothing changed: as many edges, and each of them was there before.
        same = small.count() == e.count() and small.join(e, ["u", "v"], "left_anti").isEmpty()
        scratch.drop(e, large)
        e = small
        if same:
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _star(e: DataFrame, scratch: Scratch, large: bool) -> DataFrame:
    """One step over edges u > v. Large: strictly larger neighbours go to the smallest one.
    Small: smaller neighbours and the node itself go to the smallest one."""
    if large:
        both = e.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(
            e.select(F.col("v").alias("n"), F.col("u").alias("o"))
        )
    else:
        both = e.select(F.col("u").alias("n"), F.col("v").alias("o"))
    least = scratch.keep(both.groupBy("n").agg(F.min("o").alias("m"), F.count("*").alias("c")))
    least = least.withColumn("m", F.least("n", "m"))
    joined = hot_join(both, least, "n", "c")
    if large:
        out = joined.filter(F.col("o") > F.col("n")).select(F.col("o").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select(F.col("n").alias("u"), F.col("m").alias("v"))
        out = joined.select(F.col("o").alias("u"), F.col("m").alias("v")).unionByName(own)
    return out.filter(F.col("u") != F.col("v")).distinct()
