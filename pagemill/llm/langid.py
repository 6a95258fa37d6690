"""Language of a text by error-correcting output codes.

Every language has a codeword of bits. A binary classifier per bit tells the languages with a one from
those with a zero by the byte n-grams (one to three bytes of lower-case letters, a space for
whatever stands between words) of a text; the answer is the language whose codeword is nearest.

1. *Counting.* n-grams are hashed to a table of fixed size; each task adds up one table per
   language over its labelled rows, and the tables are summed. 2. *Bits.* The classifier of a bit weighs an
n-gram by the log-ratio of its smoothed shares on the two sides. A bit that separates the sides
better (divergence of the two distributions) has more weight in decoding. 3. *Decoding.* The loss
of a codeword is the weighted sum of the logistic losses of its bits; the language with the least loss wins,
and its share among the exponentiated negative losses is the score. An answer is ambiguous where the
runner-up is closer than a margin.

Codes: with few languages all different splits of them, else hashed words of 10 log2 n bits, the
best of a fixed number of tries by the least distance between two codewords.

Rows: null texts and texts without a letter are ``und`` with score 0. Repeated rows are answered
each. Labels of null aren't learned from. Without labelled rows every answer is ``und``; with one
language it is that one with score 1. Other columns may have any name; empty tables give empty tables.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
#: Size of the n-gram table.
_CELLS = 1 << 16
_LETTER = re.compile(r"[^\W\d_]")
#: ASCII bytes that aren't letters become spaces; bytes of other characters stay.
_SPACES = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_RUNS = re.compile(rb" +")


def grams(text: str) -> np.ndarray:
    """Table cells of the n-grams of a text, one for each occurrence."""
    data = b" " + text.lower().encode("utf-8", "replace").translate(_SPACES) + b" "
    b = np.frombuffer(_RUNS.sub(b" ", data), np.uint8).astype(np.uint32)
    two = b[:-1] << 8 | b[1:]
    three = two[:-1] << 8 | b[2:]
    # Single bytes have 256 cells of their own, longer n-grams share the others by a hash.
    two, three = ((x * np.uint32(k)) >> np.uint32(16) for x, k in ((two + 1, 2654435761), (three, 2246822519)))
    return np.concatenate((b[1:-1], two, three)) % _CELLS


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tables: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py()
            if _LETTER.search(text):
                own = tables.setdefault(lang.as_py(), np.zeros(_CELLS, np.int64))
                own += np.bincount(grams(text), minlength=_CELLS)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(tables), pa.string()), pa.array([t.tobytes() for t in tables.values()], pa.binary())], ["lang", "data"]
    )


def _add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_CELLS, np.int64)
    for b in batches:
        for data in b.column("data"):
            total += np.frombuffer(data.as_py(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.string()), pa.array([total.tobytes()], pa.binary())], ["lang", "data"])


def codewords(n: int, tries: int = 50) -> np.ndarray:
    """Rows of -1 and 1, one for each of n languages; every column has both."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:  # all splits, a split and its mirror image being one
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, float).T
    rng = np.random.default_rng(n)
    best, apart = None, -1
    for _ in range(tries):
        code = rng.choice((-1.0, 1.0), (n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        least = min((code[i] != code[i + 1 :]).sum(axis=1).min() for i in range(n - 1))
        if least > apart:
            best, apart = code, least
    return best


class Model:
    """Languages, their codewords, n-gram weights and offsets per bit, and the weight of each bit."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        bits = self.code.shape[1]
        self.weights, self.trust = np.zeros((bits, _CELLS), np.float32), np.ones(bits)
        # Each language counts the same on its side, however many texts it has.
        shares = (counts + 0.1) / (counts.sum(axis=1, keepdims=True) + 0.1 * _CELLS) if langs else counts
        for j in range(bits):
            p, q = (shares[self.code[:, j] == side].mean(axis=0) for side in (1, -1))
            self.weights[j] = np.log(p) - np.log(q)
            m = (p + q) / 2
            self.trust[j] = 0.5 * (p * np.log(p / m) + q * np.log(q / m)).sum()
        if bits:
            self.trust /= self.trust.sum()
        self.table = np.ascontiguousarray(self.weights.T)

    def answer(self, text: str | None, margin: float = 0.1) -> tuple[str, float, bool]:
        """Language, score and whether the answer is ambiguous."""
        if not text or not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        cells = grams(text)
        n = np.bincount(cells, minlength=_CELLS)
        used = np.flatnonzero(n)
        # The sum of log-ratios, damped: the n-grams of a text are far from independent.
        f = n[used] @ self.table[used] / np.sqrt(len(cells))
        losses = (np.logaddexp(0, -self.code * f) * self.trust).sum(axis=1)
        likely = np.exp(losses.min() - losses)
        score = float(likely.max() / likely.sum())
        two = np.sort(losses)[:2]
        return self.langs[int(losses.argmin())], score, bool(two[1] - two[0] < margin)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", where: Column | None = None) -> Model:
    """Learn from all rows that have a language, or from those of them that ``where`` admits."""
    rows = docs if where is None else docs.filter(where)
    rows = rows.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sums = rows.mapInArrow(_tables, "lang string, data binary").groupBy("lang").applyInArrow(_add, "lang string, data binary")
    found = sorted((r.lang, r.data) for r in sums.toLocalIterator())  # one row per language
    counts = np.array([np.frombuffer(d, np.int64) for _, d in found], float).reshape(len(found), _CELLS)
    return Model([lang for lang, _ in found], counts)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, lang_pred, score, ambiguous)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            out = [model.answer(t.as_py()) for t in batch.column(1)]
            cols = [pa.array([r[i] for r in out], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], ["key", "lang_pred", "score", "ambiguous"])

    out = rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, ambiguous boolean")
    return out.withColumnRenamed("key", key)
