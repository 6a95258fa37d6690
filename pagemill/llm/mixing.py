"""Mixing sources to target weights, with DataFrame operations alone.

1. *Targets.* Sources, by code point and null last, take the given weights in turn and share
   ``budget`` times all words. A target stops at ``repeat`` times its source's words; the excess is
   shared by weight among the others (the level at which the sum is right is found over the
   sources ordered by cap over weight). The table of sources has one row per source.
2. *Blocks.* Within a source, documents stand in a hashed order; a block is the documents
   that start in the same ``block_words`` words. For each repetition the blocks of a source are
   permuted by a keyed swap-or-not permutation of their numbers, which needs no sort, and the first
   blocks are drawn until the target is reached; the last document is cut there. Running totals
   are taken in two steps (sums of parts, then within a part), so a source with a third of
   all words is spread like any other.
3. *Tree.* Numbers of drawn blocks per source are split in half again and again by exact
   multivariate hypergeometric draws until there is one vector per output shard. Shards take
   disjoint, consecutive ranges of each source's permuted blocks and order their documents by a hash.

Every random choice is a hash of the seed and of what is chosen, so reruns agree.

Rows: null and empty texts have no words and are never taken. Repeated rows and rows that share
an id are separate documents; a null id is an id. A source of null is a source. Other columns
may have any name. Empty tables, and tables without a word, give targets of 0 and no segments.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import WORD, Scratch, fresh

#: Rounds of the permutation; rows that share one step of a running total.
_ROUNDS, _STEP = 20, 1000


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))


def targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, repeat: int) -> DataFrame:
    """One row per source key: source_size and target."""
    by = sizes.groupBy("s").agg(F.max("source").alias("source"), F.sum("size").alias("source_size"))
    everything = W.partitionBy()
    rank = F.row_number().over(W.orderBy(F.col("source").isNull(), "source"))
    turn = F.pmod(rank - 1, F.lit(len(weights))).cast("int")
    by = by.withColumn("w", F.array(*map(F.lit, weights))[turn].cast("long"))
    by = by.withColumn("cap", F.col("source_size") * repeat)
    by = by.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(budget)))
    order = W.orderBy(F.col("cap") / F.col("w"), "s")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_w = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    by = by.withColumn("level", (F.col("total") - capped) / open_w)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct("level", capped.alias("c"), open_w.alias("o")))
    by = by.withColumn("fit", fits)
    # Of the rows that fit, the first in the order has the largest share of capped sources behind it.
    chosen = F.min_by("fit", F.when(F.col("fit").isNotNull(), F.struct(F.col("cap") / F.col("w"), F.col("s"))))
    by = by.withColumn("fit", chosen.over(everything))
    share = F.col("w") * (F.col("total") - F.col("fit.c")) / F.col("fit.o")
    target = F.least(F.coalesce(share, F.col("cap").cast("double")), F.col("cap").cast("double"))
    return by.select("s", "source_size", target.alias("target"))


def running(df: DataFrame, part: list[str], step: Column, order: list[Column], value: str, name: str) -> DataFrame:
    """Sum of ``value`` over earlier rows of the part; ``step`` ascends with ``order``."""
    df = df.withColumn("__step", step)
    sums = df.groupBy(*part, "__step").agg(F.sum(value).alias("__sum"))
    before = W.partitionBy(*part).orderBy("__step").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*part, "__step", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inner = W.partitionBy(*part, "__step").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = df.join(sums, [*part, "__step"])
    out = out.withColumn(name, F.col("__base") + F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return out.drop("__step", "__base")


def permuted(number: str, n: str, key: str, seed: int) -> Column:
    """A permutation of 0 .. n-1: each round swaps a number with its mirror image or not."""
    image = f"pmod(xxhash64({seed}, {key}, r) - x, {n})"
    coin = f"xxhash64({seed}, {key}, r, greatest(x, {image})) & 1 = 1"
    return F.expr(f"aggregate(sequence(1, {_ROUNDS}), {number}, (x, r) -> IF({coin}, {image}, x))")


def _hypergeometric(rest: str, marked: str, need: str, u: str) -> str:
    """SQL for how many of ``need`` drawn from ``rest`` are among the ``marked``.

    Inverse transform over nine standard deviations around the mean, which leave out less than
    1e-18; weights follow from each other, so no factorials are needed.
    """
    mean = f"(double({need}) * {marked} / greatest({rest}, 1))"
    sd = f"sqrt(greatest({mean} * (1 - double({marked}) / greatest({rest}, 1)) * ({rest} - {need}) / greatest({rest} - 1, 1), 0D))"
    low = f"greatest(0L, {need} - ({rest} - {marked}), bigint(floor({mean} - 9 * {sd} - 2)))"
    high = f"least({marked}, {need}, bigint(ceil({mean} + 9 * {sd} + 2)))"
    ratio = f"(double({marked} - x) * ({need} - x) / (double(x + 1) * ({rest} - {marked} - {need} + x + 1)))"
    steps = "IF(z.lo < z.hi, sequence(z.lo, z.hi - 1), array())"
    whole = f"aggregate({steps}, struct(1D AS w, 1D AS c), (a, x) -> struct(a.w * {ratio} AS w, a.c + a.w * {ratio} AS c)).c"
    # Count the places whose running weight stays below the drawn part of the whole.
    pick = (
        f"aggregate({steps}, struct(1D AS w, 1D AS c, 0L AS k), (a, x) -> struct(a.w * {ratio} AS w,"
        f" a.c + a.w * {ratio} AS c, a.k + IF(a.c <= z.uu * whole, 1L, 0L) AS k)).k"
    )
    return (
        f"element_at(transform(array(struct({low} AS lo, {high} AS hi, {u} AS uu)), z ->"
        f" element_at(transform(array({whole}), whole -> z.lo + {pick}), 1)), 1)"
    )


def split_tree(spark, quotas: DataFrame, levels: int, seed: int) -> DataFrame:
    """Rows (node, q): one vector of block numbers per shard, from one row with the vector of all."""
    tree = quotas.select(F.lit(1).cast("long").alias("node"), "q")
    x = _hypergeometric("acc.rest", "q[i]", "acc.need", f"(pmod(xxhash64({seed}, node, i), 9007199254740992L) / 9007199254740992D)")
    step = f"element_at(transform(array({x}), x -> struct(concat(acc.out, array(x)) AS out, acc.rest - q[i] AS rest, acc.need - x AS need)), 1)"
    total = "aggregate(q, 0L, (t, y) -> t + y)"
    # An odd number of blocks goes to either half by a coin.
    need = f"({total} + IF(xxhash64({seed}, node) & 1 = 1, 1, 0)) div 2"
    left = (
        f"aggregate(sequence(0, size(q) - 1), struct(cast(array() AS array<bigint>) AS out, {total} AS rest, {need} AS need),"
        f" (acc, i) -> {step}).out"
    )
    for _ in range(levels):
        tree = tree.withColumn("l", F.expr(left))
        halves = F.expr("array(struct(node * 2 AS node, l AS q), struct(node * 2 + 1 AS node, zip_with(q, l, (a, b) -> a - b) AS q))")
        tree = tree.select(F.inline(halves))
    return tree


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    budget: float = 1.5,
    repeat: int = 2,
    block_words: int = 1024,
    shard_words: int = 1 << 24,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """The mix as (documents, segments).

    documents: key, h, copy, size, source_size, target; a row per input row, where ``h`` is a hash
    of the text and ``copy`` numbers the rows of an id and text, by source. segments: key, h, copy, pass, shard, place,
    words; the first ``words`` words of the document stand at ``place`` of the shard.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    rows = docs.select(
        F.col(key).alias("id"),
        F.xxhash64(text).alias("h"),
        F.col(source).alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    rows = rows.groupBy("id", "h", "source", "size").agg(F.count("*").alias("n"))
    rows = rows.withColumn("s", _source_key("source"))
    # Copies are numbered over all sources of an id and text.
    earlier = W.partitionBy("id", "h").orderBy("s", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("to", F.coalesce(F.sum("n").over(earlier), F.lit(0)) + F.col("n"))
    copies = F.sequence((F.col("to") - F.col("n") + 1).cast("int"), F.col("to").cast("int"))
    rows = rows.select("*", F.explode(copies).alias("copy")).drop("n", "to")
    order = F.xxhash64(F.lit(seed), F.col("id").cast("string"), "h", "copy")
    sizes = scratch.keep(rows.withColumn("o", order))

    goal = scratch.keep(targets(sizes, weights, budget, repeat))
    steps = max(1, sizes.count() // _STEP)
    # Equal shares of the hash range, ascending with the hash.
    step = F.floor((F.col("o") / F.lit(2.0**64) + 0.5) * steps).cast("long")
    placed = running(sizes, ["s"], step, [F.col("o"), F.col("id"), F.col("h"), F.col("copy")], "size", "at")
    placed = placed.withColumn("block", F.expr(f"at div {block_words}"))
    placed = scratch.keep(placed.join(goal, "s").drop("o", "source"))

    # Blocks without a start of a document have no row, so they are numbered anew.
    found = placed.groupBy("s", "block").agg(
        F.sum("size").alias("words"), F.min("at").alias("first"), F.max("source_size").alias("source_size"), F.max("target").alias("target")
    )
    found = found.withColumn("one", F.lit(1))
    found = running(found, ["s"], F.expr(f"block div {_STEP}"), [F.col("block")], "one", "nr").drop("one")
    found = scratch.keep(found)
    count = found.groupBy("s").agg(F.count("*").alias("blocks"))
    blocks = found.join(count, "s").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))))
    blocks = blocks.withColumn("t", F.expr("greatest(0L, least(source_size, bigint(round(target)) - pass * source_size))"))
    blocks = blocks.filter("t > 0").withColumn("rank", permuted("nr", "blocks", "s, pass", seed))
    blocks = running(blocks, ["s", "pass"], F.expr(f"rank div {_STEP}"), [F.col("rank")], "words", "before")
    blocks = scratch.keep(blocks.filter("before < t"))

    drawn = blocks.groupBy("s", "pass").agg(F.count("*").alias("q"))
    earlier = F.coalesce(F.sum("q").over(W.partitionBy("s").orderBy("pass").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    drawn = scratch.keep(drawn.withColumn("skip", earlier))
    totals = drawn.groupBy("s").agg(F.sum("q").alias("q"))
    wanted = goal.agg(F.sum("target")).first()[0] or 0.0
    levels = max(0, math.ceil(math.log2(max(1.0, wanted / shard_words))))
    vector = totals.agg(F.array_sort(F.collect_list(F.struct("s", "q"))).alias("v")).filter(F.size("v") > 0)
    tree = split_tree(spark, vector.select(F.col("v.q").alias("q")), levels, seed)
    names = vector.select(F.posexplode("v.s").alias("i", "s"))
    leaves = tree.select((F.col("node") - (1 << levels)).alias("shard"), F.posexplode("q").alias("i", "take"))
    leaves = leaves.withColumn("to", F.sum("take").over(W.partitionBy("i").orderBy("shard")))
    leaves = leaves.withColumn("from", F.col("to") - F.col("take")).filter("take > 0").join(names, "i")
    leaves = leaves.join(totals.withColumnRenamed("q", "all"), "s")
    # Ranges meet block numbers through cells about as wide as a range.
    width = F.expr(f"greatest(1L, `all` div {1 << levels})")
    leaves = leaves.withColumn("width", width)
    leaves = leaves.withColumn("cell", F.explode(F.expr("sequence(`from` div width, (`to` - 1) div width)")))
    leaves = leaves.select("s", "cell", "shard", "from", "to")
    blocks = blocks.join(drawn.drop("q"), ["s", "pass"]).join(totals.withColumnRenamed("q", "all"), "s")
    blocks = blocks.withColumn("draw", F.col("skip") + F.col("rank")).withColumn("cell", F.expr(f"draw div greatest(1L, `all` div {1 << levels})"))
    dealt = blocks.join(leaves, ["s", "cell"]).filter("draw >= `from` AND draw < `to`")
    dealt = scratch.keep(dealt.select("s", "block", "pass", "first", "before", "t", "shard"))

    segments = placed.join(dealt, ["s", "block"])
    segments = segments.withColumn("words", F.expr("least(size, t - (before + at - first))")).filter("words > 0")
    shuffle = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "id", "h", "copy", "pass"), "id", "h", "copy", "pass")
    segments = segments.select(
        F.col("id").alias(key), "h", "copy", "pass", "shard", F.row_number().over(shuffle).alias("place"), "words"
    )
    documents = placed.select(F.col("id").alias(key), "h", "copy", "size", "source_size", "target")
    return documents, segments


def taken(documents: DataFrame, segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with the number of words that the mix takes of each, repeats counted."""
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (key, "h", "copy")]
    words = segments.groupBy(key, "h", "copy").agg(F.sum("words").alias("taken"))
    out = documents.alias("d").join(words.alias("t"), same, "left")
    return out.select(*[f"d.{c}" for c in documents.columns], F.coalesce("t.taken", F.lit(0).cast("long")).alias("taken"))


def mixed_texts(
    docs: DataFrame, segments: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", numbered: bool = True
) -> DataFrame:
    """Rows of ``docs`` as the mix takes them: repeated, cut where a target ends, with the columns
    shard and place if ``numbered``; then ``docs`` may have none of that name. A text taken whole is unchanged; a cut one ends after its last word."""
    i, h, copy, shard, place, n = fresh(docs, "id", "h", "copy", "shard", "place", "words")
    cut = F.expr(f"array_join(slice(regexp_extract_all({text}, r'[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), 1, int({n})), '')")
    # Rows are numbered within their id and text, by source, which is how segments name them.
    mine = docs.withColumn(h, F.xxhash64(text))
    mine = mine.withColumn(copy, F.row_number().over(W.partitionBy(key, h).orderBy(_source_key(source))))
    seg = segments.select(F.col(key).alias(i), F.col("h").alias("__seg_h"), F.col("copy").alias("__seg_copy"), F.col("shard").alias(shard), F.col("place").alias(place), F.col("words").alias(n))
    same = F.col(key).eqNullSafe(F.col(i)) & (mine[h] == seg["__seg_h"]) & (mine[copy] == seg["__seg_copy"])
    out = mine.join(seg, same)
    whole = F.regexp_count(text, F.lit(WORD)) == F.col(n)
    out = out.withColumn(text, F.when(whole, F.col(text)).otherwise(cut))
    if not numbered:
        return out.select(*docs.columns)
    return out.select(*docs.columns, F.col(shard).alias("shard"), F.col(place).alias("place"))
