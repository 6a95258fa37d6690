"""Removing repeated passages by overlapping windows of three lines.

Every three consecutive lines of a document are a window. A window found more than once in all
documents keeps its first occurrence, by document id, hash of the text and position; the lines of
later ones are removed, overlapping windows merged into ranges. Windows without a word count for nothing. With
the option ``long_words``, off unless it is given, long lines are passages by themselves: where one or two lines have that many
words, these are a window as well, so that an unwrapped passage is found whatever its neighbours.

Windows are compared by two 64-bit hashes. A window that very many documents share is reduced to
its first occurrence before any shuffle, and its later occurrences are dealt over several tasks.

Rows: null stays null and empty stays empty. Rows that share id and text are one document, with
the same result for each; rows that share an id alone are two. A null id is an id. A
document all of whose lines are removed has an empty text. Empty tables give empty tables, and
other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import WORD, Scratch, fresh, hot_join

#: SQL for the windows that start at line i; h has hashes a and b and the number of words of each line.
_WINDOWS = """filter(array(
  IF(i + 2 < size(h) AND h[i].c + h[i + 1].c + h[i + 2].c > 0,
     struct(struct(xxhash64(3, h[i].a, h[i + 1].a, h[i + 2].a) AS a, xxhash64(3, h[i].b, h[i + 1].b, h[i + 2].b) AS b) AS w, i AS lo, i + 2 AS hi), NULL),
  CASE WHEN h[i].c >= {n} THEN struct(struct(h[i].a AS a, h[i].b AS b) AS w, i AS lo, i AS hi)
       WHEN i + 1 < size(h) AND h[i].c + h[i + 1].c >= {n}
       THEN struct(struct(xxhash64(2, h[i].a, h[i + 1].a) AS a, xxhash64(2, h[i].b, h[i + 1].b) AS b) AS w, i AS lo, i + 1 AS hi) END
), x -> x IS NOT NULL)"""


def repeated_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text", long_words: int | None = None) -> DataFrame:
    """Rows (id, h, ranges): the merged line numbers, first and last counted from 0, of repeated windows.

    ``h`` is a hash of the text. Documents without repeated windows have no row.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    lines = F.transform(
        F.split(F.col(text), "\n", -1),
        lambda x: F.struct(
            F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"), F.regexp_count(x, F.lit(WORD)).alias("c")
        ),
    )
    rows = docs.filter(F.col(text) != "").select(F.col(key).alias("id"), F.xxhash64(text).alias("h0"), lines.alias("h"))
    starts = F.expr(f"flatten(transform(sequence(0, size(h) - 1), i -> {_WINDOWS.format(n=2**31 - 1 if long_words is None else long_words)}))")
    found = rows.select("id", F.col("h0").alias("h"), F.inline(starts))
    found = scratch.keep(found)
    place = F.struct("id", "h", "lo")
    first = found.groupBy("w").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = scratch.keep(first)
    later = hot_join(found, first, "w", "n").filter(F.col("first") != place).select("id", "h", "lo", "hi")
    earlier = W.partitionBy("id", "h").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    fresh = F.coalesce(F.col("lo") > F.max("hi").over(earlier) + 1, F.lit(True))
    later = later.distinct().withColumn("fresh", fresh.cast("int"))
    upto = W.partitionBy("id", "h").orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, 0)
    later = later.withColumn("range", F.sum("fresh").over(upto))
    merged = later.groupBy("id", "h", "range").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return merged.groupBy("id", "h").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", long_words: int | None = None, count: str | None = "removed_lines"
) -> DataFrame:
    """``docs`` with repeated passages taken out of the text, and the number of lines taken out in the column ``count``."""
    if count in docs.columns:
        raise ValueError(f"there is a column {count!r}; name another one in `count`, or none")
    i, h, r = fresh(docs, "id", "h", "ranges")
    ranges = repeated_ranges(docs, key, text, long_words).select(F.col("id").alias(i), F.col("h").alias(h), F.col("ranges").alias(r))
    same = F.col(key).eqNullSafe(F.col(i)) & (F.xxhash64(text) == F.col(h))
    out = docs.join(ranges, same, "left")
    inside = lambda at: F.exists(r, lambda x: (at >= x["lo"]) & (at <= x["hi"]))
    kept = F.array_join(F.filter(F.split(F.col(text), "\n", -1), lambda x, at: ~inside(at)), "\n")
    removed = F.aggregate(r, F.lit(0), lambda n, x: n + x["hi"] - x["lo"] + 1)
    out = out.withColumn(text, F.when(F.col(r).isNotNull(), kept).otherwise(F.col(text)))
    return out.select(*docs.columns, *([F.coalesce(removed, F.lit(0)).alias(count)] if count else []))
