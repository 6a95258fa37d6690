"""Toxicity of texts whose words may be disguised.

A disguised word is read as a noisy copy of a plain one: digits and signs stand for letters
(``1d10t``), letters are spread (``i d i o t``, ``i.d.i.o.t``) or repeated (``idiooot``). Each suspicious stretch of
a text becomes a lattice of characters: a sign may be a letter or a word end, a run of equal
letters may be one, two or all of them, each separator of a spread-out stretch may be a word end or nothing. The Viterbi path through it
under a character language model and the costs of the channel is the restored word. Stretches with one
reading only (plain words, nearly all) need no decoding.

1. ``language_model`` counts the 4-grams of letters of all documents, one vector of fixed size per task,
   summed. 2. ``restored`` gives the words of a text, the plain ones as they are and the others
decoded. 3. ``fit_words`` learns from a bounded sample of labelled rows how much each restored word,
or its beginning of three to six letters, speaks for the label. 4. ``score`` combines the words of a whole text.

The sample: the ``sample`` labelled rows (20,000 by default) whose ids have the smallest hashes. Words and beginnings
found in ``min_rows`` toxic rows or more whose share of toxic rows is surely above 0.7
(by the lower end of a Wilson interval) make up the lexicon; of copies and near copies in the sample one counts.
A text is as toxic as its words together: one minus the product of what each word leaves; without such a word the score is the share of toxic rows among
the sampled rows without one, capped below one half.

Rows: null, empty and wordless texts get the score of texts without a lexicon word. Repeated rows
are scored each. Labels of null count as none; an id with several labels counts as toxic if one says
so. Without labelled rows the lexicon is empty and every score 0. Other columns may have any name,
and empty tables give empty tables.
"""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import Scratch, crc_mod
from pagemill.llm.shingles import mixed, shingles

#: Letters of the model: 0 is a word end, 1-26 a-z, 27 any other letter.
_LETTERS = 28
_CELLS = _LETTERS**4
_ROW = _LETTERS**2
#: What a sign or digit may stand for, and the cost of each change, in nats.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t"}
_SWAP, _COLLAPSE, _DROP = 1.0, 0.5, 2.0
#: Signs around a word that stand for no letter; longest stretch whose reading is remembered.
_AROUND = "".join(c for c in string.punctuation if c not in SIGNS)
_SHORT = 64

_TRIPLE = re.compile(r"([^\W\d_])\1\1", re.UNICODE)
#: Single letters or signs, three or more, each set apart by the same few separators.
_SPREAD = re.compile(r"(?<![^\W_])(?:[^\W_@$!|+]|[@$!|+])(?:[ .\-_*]{1,2}(?:[^\W_]|[@$!|+])(?![^\W_])){2,}", re.UNICODE)
_SEPARATORS = re.compile(r"([ .\-_*]+)")


def _codes(text: str) -> np.ndarray:
    """Letters of a text as numbers, every other stretch as one word end."""
    data = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.zeros(len(data), np.int64)
    plain = (data >= 97) & (data <= 122)
    codes[plain] = data[plain] - 96
    codes[data >= 0xC0] = 27  # accented letters and other scripts
    keep = (codes != 0) | np.concatenate(([True], codes[:-1] != 0))
    return codes[keep]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(_CELLS, np.int64)
    for batch in batches:
        for text in batch.column(0):
            c = np.concatenate(([0, 0, 0], _codes(text.as_py()), [0]))
            if len(c) > 4:
                grams = ((c[:-3] * _LETTERS + c[1:-2]) * _LETTERS + c[2:-1]) * _LETTERS + c[3:]
                found, n = np.unique(grams, return_counts=True) if len(grams) < 20_000 else _bins(grams)
                counts[found] += n
    rows = counts.reshape(-1, _ROW)
    used = np.flatnonzero(rows.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array([rows[i].tobytes() for i in used], pa.binary())], ["row", "data"])


def _bins(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.bincount(grams, minlength=_CELLS)
    found = np.flatnonzero(n)
    return found, n[found]


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_ROW, np.int64)
    for b in batches:
        for data in b.column("data"):
            total += np.frombuffer(data.as_py(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([total.tobytes()], pa.binary())], ["row", "data"])


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Cost, in nats, of each letter after three others, from all documents.

    Backs off from three letters to two, one and none by a fixed weight. The counts have a fixed size
    (614,656), whatever the corpus, so their sum may come to the driver.
    """
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    sums = rows.mapInArrow(_count, "row long, data binary").groupBy("row").applyInArrow(_add, "row long, data binary")
    counts = np.zeros((_CELLS // _ROW, _ROW))
    for r in sums.toLocalIterator():
        counts[r.row] = np.frombuffer(r.data, np.int64)
    four = counts.reshape((_LETTERS,) * 4)
    p = (four.sum(axis=(0, 1, 2)) + 1) / (four.sum() + _LETTERS)
    for table in (four.sum(axis=(0, 1)), four.sum(axis=0), four):
        p = (table + 5 * p) / (table.sum(axis=-1, keepdims=True) + 5)
    return -np.log(p).astype(np.float32)


def _readings(c: str, n: int) -> list[tuple[str, float]]:
    """What a run of one character may be: (letters, cost)."""
    if c.isalpha():
        return [(c * n, 0.0)] if n < 3 else [(c, _COLLAPSE), (c * 2, _COLLAPSE)]
    options = [(" ", 0.0 if not c.isdigit() else 1.0), ("", _DROP * min(n, 3))]
    for letter in SIGNS.get(c, ""):
        options += [(letter * k, _SWAP * k) for k in range(1, min(n, 2) + 1)]
    return options


def _steps(token: str) -> list[list[tuple[str, float]]]:
    return [_readings(m[1], len(m[0])) for m in re.finditer(r"(.)\1*", token, re.DOTALL)]


def _spread_steps(stretch: str) -> list[list[tuple[str, float]]]:
    """Readings of single characters and of the separators between them, by turns."""
    parts = _SEPARATORS.split(stretch)
    signs, gaps = parts[::2], [(len(g), " " in g) for g in parts[1::2]]
    wide = [g > min(gaps[max(0, i - 1) : i + 2]) for i, g in enumerate(gaps)]
    steps, i = [], 0
    while i < len(signs):
        c, n = signs[i], 1
        while c.isalpha() and i + n < len(signs) and signs[i + n] == c and not wide[i + n - 1]:
            n += 1
        options = _readings(c, n)
        for a in (1, 2):  # one of the separators within a run of equal letters may be a word end
            options += [(c * a + " " + c * b, 0.0 if a + b == n else _COLLAPSE) for b in (1, 2) if a + b <= n]
        steps.append(options)
        i += n
        if i < len(signs):
            steps.append([(" ", 0.0), ("", _DROP)] if wide[i - 1] else [("", 0.0), (" ", 0.0)])
    return steps


class Restorer:
    """Words of a text, the disguised ones decoded."""

    def __init__(self, costs: np.ndarray):
        self.costs = costs
        self.memo: dict[tuple[str, bool], str] = {}

    def words(self, text: str) -> set[str]:
        """Distinct restored words; spread-out stretches give their word besides the rest."""
        text = text.lower()
        found: set[str] = set()
        for m in _SPREAD.finditer(text):
            found.update(self.decode(m[0], spread=True).split())
        triple = _TRIPLE.search if _TRIPLE.search(text) else lambda _: None
        for token in set(text.split()):
            if not token.isalpha():
                token = token.strip(_AROUND)
            if token.isalpha() and not triple(token):
                found.add(token)
            elif token:
                found.update(self.decode(token).split())
        return found

    def decode(self, token: str, spread: bool = False) -> str:
        """The cheapest path through the lattice of a token or spread-out stretch; memory is bounded."""
        known = self.memo.get((token, spread))
        if known is None:
            if len(self.memo) >= 200_000:
                self.memo.clear()
            known = self._viterbi(_spread_steps(token) if spread else _steps(token))
            if len(token) <= _SHORT:
                self.memo[token, spread] = known
        return known

    def _viterbi(self, steps: list[list[tuple[str, float]]]) -> str:
        # States are the last three letters; few are alive at a time. Paths are chains (earlier, letters) with common beginnings.
        alive: dict[tuple[int, int, int], tuple[float, tuple | None]] = {(0, 0, 0): (0.0, None)}
        for options in [*steps, [(" ", 0.0)]]:
            after: dict[tuple[int, int, int], tuple[float, tuple | None]] = {}
            for state, (cost, path) in alive.items():
                for letters, extra in options:
                    s, total, out = state, cost + extra, ""
                    for c in letters:
                        code = 0 if c == " " else ord(c) - 96 if "a" <= c <= "z" else 27
                        if code == 0 and s[2] == 0:
                            continue  # word ends don't add up
                        total += float(self.costs[s[0], s[1], s[2], code])
                        out += c
                        s = (s[1], s[2], code)
                    if s not in after or total < after[s][0]:
                        after[s] = (total, (path, out) if out else path)
            alive = after
        path, parts = min(alive.values(), key=lambda x: x[0])[1], []
        while path is not None:
            path, out = path
            parts.append(out)
        return "".join(reversed(parts))


def features(word: str) -> list[str]:
    """A word and, so that inflected and compound forms are known by their stem, its beginnings."""
    return [word, *("^" + word[:n] for n in range(3, min(6, len(word)) + 1))]


def _word_rows(shared):
    """Counts of documents by feature and label, those of a task added up as far as memory allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        counts: dict[str, list[int]] = {}

        def flush():
            cols = [pa.array(list(counts), pa.string()), *(pa.array([v[i] for v in counts.values()], pa.int64()) for i in (0, 1))]
            counts.clear()
            return pa.RecordBatch.from_arrays(cols, ["word", "n", "t"])

        for batch in batches:
            for toxic, text in zip(batch.column(0), batch.column(1), strict=True):
                t = int(toxic.as_py() == 1)
                for f in {f for w in restorer.words(text.as_py()) for f in features(w)}:
                    own = counts.setdefault(f, [0, 0])
                    own[0] += 1
                    own[1] += t
                if len(counts) > 300_000:
                    yield flush()
        yield flush()

    return run


def _weigher(model):
    """A function of a text: the log of what its lexicon words leave."""
    costs, lexicon = model
    restorer, stems = Restorer(costs), {f[1:4] for f in lexicon if f[0] == "^"}

    def weigh(text: str | None) -> float:
        left = 0.0
        for w in restorer.words(text or "") if lexicon else ():
            if w[:3] in stems or w in lexicon:
                left += min(lexicon.get(f, 0.0) for f in features(w))
        return left

    return weigh


def _flag_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = _weigher(shared.value)
        for batch in batches:
            left = [weigh(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(left, pa.float64())], ["id", "left"])

    return run


def _families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two min-hashes of the word shingles; near copies agree in one of them, nearly always."""
    for batch in batches:
        a, b = [], []
        for text in batch.column(1):
            x = shingles(text.as_py())
            a.append(int(x[0]) >> 1 if len(x) else 0)  # the shingles are hashes and ascend
            b.append(int(mixed(x ^ np.uint64(0x5DEECE66D)).min()) >> 1 if len(x) else 0)
        cols = [batch.column(0), batch.column(1), pa.array(a, pa.int64()), pa.array(b, pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["toxic", "text", "a", "b"])


class Model:
    """Costs of letters, weight of each lexicon word and the score of texts without one."""

    def __init__(self, costs: np.ndarray, lexicon: dict[str, float], base: float):
        self.costs, self.lexicon, self.base = costs, lexicon, base


def fit(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    sample: int = 20_000,
    min_rows: int = 8,
    lexicon_size: int = 10_000,
) -> Model:
    """Learn from labelled rows outside the fold that is held out (crc32 of the id, 0 of 5)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    costs = language_model(docs, text)
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull())
    known = known.filter(crc_mod(F.col(key), 5) != 0).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("id"), F.col(text).alias("text"))
    rows = rows.join(known, "id").select(F.col("toxic").cast("int").alias("toxic"), "text")
    rows = rows.mapInArrow(_families, "toxic int, text string, a long, b long")
    for family in ("a", "b"):  # copies and near copies share all their words, so one of them counts
        one = F.min_by(F.struct("toxic", "text", "a", "b"), F.struct(F.xxhash64("text"), "text")).alias("r")
        rows = rows.groupBy(F.col(family).alias("f")).agg(one).select("r.*")
    rows = scratch.keep(rows.select("toxic", "text"))
    totals = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in totals}
    shared = spark.sparkContext.broadcast(costs)
    counts = rows.mapInArrow(_word_rows(shared), "word string, n long, t long").groupBy("word")
    counts = counts.agg(F.sum("n").alias("n"), F.sum("t").alias("t")).filter(F.col("t") >= min_rows)
    share, z = F.col("t") / F.col("n"), 2.0
    centre = share + z * z / 2 / F.col("n")
    spread = F.lit(z) * F.sqrt(share * (1 - share) / F.col("n") + z * z / 4 / F.col("n") / F.col("n"))
    counts = counts.withColumn("low", (centre - spread) / (1 + z * z / F.col("n"))).filter("low > 0.7")
    chosen = counts.orderBy(F.desc("low"), "word").limit(lexicon_size).collect()
    best = {r.word: r for r in chosen}
    for r in chosen:  # a beginning goes if a longer one has most of its toxic rows and fewer others
        for shorter in features(r.word.lstrip("^"))[1:]:
            s = best.get(shorter)
            if s and s.word != r.word and r.t >= 0.8 * s.t and r.n - r.t < s.n - s.t:
                del best[shorter]
    lexicon = {w: math.log(max(1e-6, 1 - r.low)) for w, r in best.items()}
    base = n.get(1, 0) / max(1, sum(n.values())) / 2
    return Model(costs, lexicon, min(base, 0.45))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, score)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.costs, model.lexicon))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_flag_rows(shared), f"id {kind}, `left` double")
    value = F.when(F.col("left") < 0, 1 - F.exp("left")).otherwise(F.lit(model.base))
    return out.select(F.col("id").alias(key), value.alias("score"))


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` whose text scores below the threshold, in one pass without a join."""
    shared = docs.sparkSession.sparkContext.broadcast((model.costs, model.lexicon))
    at, base = docs.columns.index(text), model.base

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = _weigher(shared.value)
        for batch in batches:
            left = np.array([weigh(t.as_py()) for t in batch.column(at)], float)
            scores = np.where(left < 0, 1 - np.exp(left), base)
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
