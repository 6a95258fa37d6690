"""Auditing how far the sources of a language differ in their words.

Every language keeps the terms that enough of its documents have. A term's share in a group, one source of one
language, or in the whole language is the integer ``1 + scale * (count + prior) / (total + prior * terms)``, rounded
down. Two reports come from it: how far each pair of sources of a language is apart, summed over
all terms, and which terms a source has most above its language.

The second report is found by a dominance skyband. A term dominates another of its group if it has no lower count in the
group, no higher one in the language and an earlier name: then its excess is at least as large, and it ranks
before. So parts of a group, split by a hash of the term, keep only terms that fewer than ``top`` others of the part
dominate; the skybands of parts are merged and thinned again as long as that takes terms away, and the rest is ranked exactly.

Counting: every task adds up its documents before the shuffle, which brings a term of a language together, and
terms that too few documents have go before anything is written. Pairs of sources are worked out for blocks of
terms in tiles of sources: a block adds what its terms change against two groups that lack them all, and what
such groups differ by is added once. A hot source or language only has more blocks. All numbers are exact:
shares come from decimal arithmetic, counts from 64-bit integers.

Rows: null text, language and source are read as empty ones. Every row is a document, repeated or not. Very long texts are
read in pieces that end between terms. Groups without terms take part. Empty tables give empty tables; other
columns may have any name.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.common import Scratch

#: Runs of letters A-Z and characters beyond ASCII, in UTF-8 after lower-casing A-Z.
_TERM = re.compile(rb"[a-z\x80-\xff]+")
_BREAK = re.compile(rb"[^a-z\x80-\xff]")
_PIECE = 1 << 20  # bytes of a text that are split into terms at once
_HELD = 400_000  # distinct terms of groups that a task adds up before it passes them on
_BLOCK = 16_384  # rows that a part of a group, or a block of terms, has on average
_TILE = 256  # sources on one side of a tile


def _terms(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, at most some hundred thousand at a time."""
    data, start = data.lower(), 0  # bytes: A-Z only
    while start < len(data):
        end = _BREAK.search(data, start + _PIECE) if len(data) - start > _PIECE else None
        upto = end.start() if end else len(data)
        yield _TERM.findall(data, start, upto)
        start = upto


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, n, d): occurrences, and documents that have the term, of a part of the documents."""
    counts, docs, held = defaultdict(Counter), defaultdict(Counter), 0

    def flush():
        for (lang, source), found in counts.items():
            have = docs[lang, source]
            terms = list(found)
            size = len(terms)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size, pa.string()),
                    pa.array([source] * size, pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array(list(found.values()), pa.int64()),
                    pa.array([have[t] for t in terms], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "d"],
            )

    for batch in batches:
        texts = batch.column(2).cast(pa.binary())
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            found, have, own = counts[lang, source], docs[lang, source], set()
            before = len(found)
            for words in _terms(text.as_py()):
                found.update(words)
                own.update(words)
            have.update(own)
            held += len(found) - before
            if held > _HELD:
                yield from flush()
                counts.clear()
                docs.clear()
                held = 0
    yield from flush()


def skyband(high: np.ndarray, low: np.ndarray, name: np.ndarray, k: int, chunk: int = 512) -> np.ndarray:
    """Indexes of points that fewer than ``k`` others dominate: higher or equal ``high``, lower or equal ``low`` and earlier ``name``.

    No two points share a name. Of the points that dominate one, those inside the skyband are
    enough to tell: if there are ``k``, ``k`` of them are in the skyband.
    """
    order = np.lexsort((name, low, -high))  # a point comes after all that dominate it
    kept = order[:0]
    for at in range(0, len(order), chunk):
        new = order[at : at + chunk]
        over = np.count_nonzero((low[kept] <= low[new, None]) & (name[kept] < name[new, None]), axis=1)
        new, over = new[over < k], over[over < k]
        inside = (low[new] <= low[new, None]) & (name[new] < name[new, None]) & np.tri(len(new), k=-1, dtype=bool)
        kept = np.concatenate([kept, new[over + np.count_nonzero(inside, axis=1) < k]])
    return kept


def _thinned(k: int):
    def run(rows):
        name = np.empty(len(rows), np.int64)
        name[pc.sort_indices(rows["term"].cast(pa.binary())).to_numpy()] = np.arange(len(rows))
        return rows.take(np.sort(skyband(rows["n"].to_numpy(), rows["c"].to_numpy(), name, k)))

    return run


def top_terms(terms: DataFrame, scratch: Scratch, top: int) -> DataFrame:
    """The ``top`` terms of each group by ``p - q``, ties by name: rows (lang, source, term, value, rank).

    ``terms`` has (lang, source, term, n, c, p, q) and only terms with n > 0 and p > q.
    """
    group = ["lang", "source"]
    rows, size = scratch.keep(terms), None
    while True:
        sizes = scratch.keep(rows.groupBy(*group).agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("parts")))
        before, most = rows.count(), sizes.agg(F.max("parts")).first()[0] or 0
        if size is not None and (most <= 1 or before > 0.8 * size):
            break
        size = before
        part = F.pmod(F.xxhash64(F.lit(before), "term"), F.col("parts"))
        dealt = rows.join(sizes, group).withColumn("part", part)
        thin = dealt.groupBy(*group, "part").applyInArrow(_thinned(top), dealt.schema).select(rows.columns)
        rows = scratch.keep(thin)
    ranked = rows.withColumn("value", F.col("p") - F.col("q"))
    order = W.partitionBy(*group).orderBy(F.desc("value"), "term")
    return ranked.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(*group, "term", "value", "rank")


def _tile(key, rows):
    """Sums of one block of terms for the pairs of sources of one tile.

    Rows without a term are the sources, with the share of a term they lack and the number of all terms.
    """
    _, left, right, block = (k.as_py() for k in key)
    heads = rows.filter(pc.is_null(rows["term"]))
    names = heads["source"].to_pylist()
    place = {s: i for i, s in enumerate(names)}
    base, tile = heads["p"].to_numpy(), heads["tile"].to_numpy()
    first, second = np.flatnonzero(tile == left), np.flatnonzero(tile == right)
    body = rows.filter(pc.is_valid(rows["term"])).sort_by("term")
    codes = pc.dictionary_encode(body["term"].combine_chunks()).indices.to_numpy()
    source = np.array([place[s] for s in body["source"].to_pylist()], np.int64)
    share = body["p"].to_numpy()
    apart = np.abs(base[first][:, None] - base[second])
    total = np.zeros_like(apart)
    step = 2048
    for lo in range(0, int(codes[-1]) + 1 if len(codes) else 0, step):
        a, b = np.searchsorted(codes, (lo, lo + step))
        shares = np.repeat(base[:, None], min(step, codes[-1] + 1 - lo), axis=1)
        shares[source[a:b], codes[a:b] - lo] = share[a:b]
        own = shares[second]
        for i, s in enumerate(first):
            total[i] += np.abs(own - shares[s]).sum(axis=1) - apart[i] * shares.shape[1]
    if block == 0 and len(heads):
        total += apart * heads["vocabulary"].to_numpy()[0]
    i, j = np.nonzero(np.ones_like(total, bool) if left != right else first[:, None] < second)
    names = pa.array(names, pa.string())
    lang = pa.array([key[0].as_py()] * len(i), pa.string())
    return pa.table([lang, names.take(first[i]), names.take(second[j]), total[i, j]], names=["lang", "a", "b", "v"])


def source_pairs(terms: DataFrame, groups: DataFrame, scratch: Scratch) -> DataFrame:
    """How far the sources of each language are apart: rows (lang, source, other, value), both ways round.

    ``terms`` has (lang, source, term, p), ``groups`` every (lang, source) with ``base``, the
    share of a term it lacks, and ``vocabulary``, the number of terms of the language.
    """
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / _TILE).cast("int").alias("tiles"))
    sizes = terms.groupBy("lang").agg(F.ceil(F.count("*") / _BLOCK).cast("int").alias("blocks"))
    tiles = tiles.join(sizes, "lang", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    tile = F.pmod(F.xxhash64("source"), F.col("tiles")).cast("int").alias("tile")
    # Written, so that its size is known: joined by group, never by language alone.
    dealt = scratch.keep(groups.join(tiles, "lang").select("lang", "source", "base", "vocabulary", tile, "tiles", "blocks"))
    heads = dealt.select("lang", "source", "tile", "tiles", F.lit(None).cast("string").alias("term"),
        F.col("base").alias("p"), "vocabulary", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    body = terms.join(dealt.drop("base", "vocabulary"), ["lang", "source"]).select("lang", "source", "tile", "tiles", "term", "p",
        F.lit(None).cast("long").alias("vocabulary"), F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block"))
    rows = heads.unionByName(body).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumns({"left": F.least("tile", "t"), "right": F.greatest("tile", "t")}).drop("t", "tiles")
    sums = rows.groupBy("lang", "left", "right", "block").applyInArrow(_tile, "lang string, a string, b string, v long")
    sums = sums.groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    both = F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("other")), F.struct(F.col("b").alias("source"), F.col("a").alias("other")))
    return sums.select("lang", F.inline(both), "value")


def audit(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    min_docs: int = 30,
    prior: int = 5,
    scale: int = 1_000_000_000,
    top: int = 50,
) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part ``pair`` for every other source of the language, by
    distance, and part ``term`` for the ``top`` terms above the language."""
    scratch = Scratch(docs.sparkSession, "divergence")
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(read(lang).alias("lang"), read(source).alias("source"), read(text).alias("text"))
    found = docs.mapInArrow(_count, "lang string, source string, term string, n long, d long")
    # Brought together by term, both sums need this one shuffle.
    found = found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    same = W.partitionBy("lang", "term")
    found = found.withColumns({"c": F.sum("n").over(same), "in_docs": F.sum("d").over(same), "once": F.min("source").over(same) == F.col("source")})
    kept = scratch.keep(found.filter(F.col("in_docs") >= min_docs).drop("d", "in_docs"))

    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count_if("once").alias("terms"))
    langs = totals.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.sum("terms").alias("vocabulary"))
    groups = docs.select("lang", "source").distinct().join(totals.drop("terms"), ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "lang_total", "vocabulary"])

    def share(count: Column, total: Column) -> Column:
        above = F.col(count).cast("decimal(20,0)") + F.lit(prior).cast("decimal(20,0)")
        below = F.col(total).cast("decimal(38,0)") + F.col("vocabulary").cast("decimal(38,0)") * F.lit(prior)
        return F.call_function("div", (above * F.lit(scale)).cast("decimal(38,0)"), below.cast("decimal(38,0)")) + 1

    lacking = F.when(F.col("vocabulary") > 0, share("none", "total")).otherwise(0).cast("long")
    groups = scratch.keep(groups.withColumn("none", F.lit(0)).withColumn("base", lacking).drop("none"))
    terms = kept.join(groups, ["lang", "source"])
    terms = scratch.keep(terms.select("lang", "source", "term", "n", "c", share("n", "total").alias("p"), share("c", "lang_total").alias("q")))

    pairs = source_pairs(terms, groups, scratch)
    order = W.partitionBy("lang", "source").orderBy(F.desc("value"), "other")
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    best = top_terms(terms.filter(F.col("p") > F.col("q")), scratch, top)
    row = lambda part, item: ["lang", "source", F.lit(part).alias("part"), F.col(item).alias("item"), "value", "rank"]
    return pairs.select(row("pair", "other")).unionByName(best.select(row("term", "term")))
