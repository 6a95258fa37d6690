"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Toxic documents go, repeated passages are taken out of texts, one document of each near-duplicate
group stays, the sources are mixed to their target weights, and what is left is encoded. Each stage reads
what its predecessor kept, whole; nothing of it is limited or sampled but for the labelled rows
that the toxicity classifier learns from.

A document with a null or empty text passes every filter; it is never taken into the mix, which counts words.
Repeated rows count as documents of their own until the near-duplicate stage leaves one of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import jaccard, lines, mixing, pieces
from pagemill.llm import toxicity as toxic
from pagemill.llm.common import Scratch, fresh
from pagemill.llm.queries import piece_model


def _apart(stage: Callable) -> Callable:
    """Keeps columns that no stage knows together in one while a stage runs, so that they may have any name. A
    column with the name of one that the last stage adds gives way to it."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in _KNOWN]
        if not others:
            return stage(spark, docs, sf_dir)
        held = fresh(docs, "others")[0]
        known = [c for c in docs.columns if c in _KNOWN]
        out = stage(spark, docs.select(*known, F.struct(*[F.col(f"`{c}`") for c in others]).alias(held)), sf_dir)
        if held not in out.columns:  # the last stage keeps the id only
            return out
        added = [c for c in out.columns if c not in (*known, held)]
        kept = [F.col(c) if c in known else F.col(f"{held}.`{c}`") for c in docs.columns if c not in added]
        return out.select(*kept, *added)

    return run


_KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


@_apart
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose restored words are not toxic."""
    model = toxic.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxic.without_toxic(docs, model)


@_apart
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of passages that an earlier one has."""
    return _counted(lines.remove_repeats(docs, long_words=50, count=None), docs)


@_apart
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group."""
    return jaccard.one_of_each(docs)


@_apart
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last of a source cut at its target."""
    _, segments = mixing.mix(docs)
    return _counted(mixing.mixed_texts(docs, segments, numbered=False), docs)


@_apart
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, the end id included, and the text they decode to."""
    return pieces.encode(docs, piece_model(), decoded=True)


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` with the number of characters of changed texts."""
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


STAGES = [
    ("toxicity", toxicity),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix),
    ("SentencePiece encoding and decoding", encode),
]

#: The classifier, the hashed permutations of the mix and the encoder can't be said in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
