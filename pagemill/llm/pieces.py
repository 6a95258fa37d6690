"""Encoding and decoding with a SentencePiece model of the merge type.

The encoder doesn't run the merges over the text. A sequence of pieces is what the merges would
give exactly when every two neighbours are: re-merging the two alone must yield the same two
pieces. So a chunk is walked from the left with the longest piece at each position (one
Aho-Corasick pass finds all pieces by start), the pair with the piece before is checked by
re-merging, and on failure the next shorter piece is tried, then the piece before is taken back;
a bitfield remembers positions from which no encoding follows, which keeps the walk linear.

Rows: null text counts as empty; empty text has the end id alone. Repeated rows stay, texts of any
length are encoded whole, other columns are not carried. An empty table gives an empty table.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import groupby
from math import inf

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Words remembered by a task, and pairs of pieces; memory is bounded, results don't depend on it.
_WORDS, _PAIRS = 1_000_000, 500_000
#: Bytes of text per output batch.
_BATCH = 4_000_000


class Encoder:
    """Exact encoder of a model file; the library is used only to read the model and to decode."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.eos, self.unk = sp.eos_id(), sp.unk_id()
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: list[int] = [self.unk] * 256
        self.byte_fallback = False
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.byte_fallback = True
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.scores[piece], self.ids[piece] = sp.get_score(i), i
        self.known = {c for p in self.ids for c in p}
        missing = sorted(c for c in self.known if c not in self.ids)
        if missing:
            raise ValueError(f"characters without a piece of their own: {missing[:5]}")
        if any(SPACE in p.lstrip(SPACE) or (p[1:2] == SPACE and p.strip(SPACE)) for p in self.ids):
            raise ValueError("pieces that reach over a word boundary are not supported")
        # No piece reaches over these borders, so what lies between them is encoded on its own.
        stop = SPACE + "\n" * (not any("\n" in p for p in self.ids if len(p) > 1))
        # Digits and punctuation, with what shares a piece with them; letters mostly don't.
        marks, grown = set(string.digits + string.punctuation), 0
        while len(marks) != grown:
            grown = len(marks)
            marks.update(*(p for p in self.ids if not marks.isdisjoint(p)))
            marks.discard(SPACE)
        m = re.escape("".join(sorted(marks - {"\n"})))
        self.chunks = re.compile(f"{SPACE}*[^{stop}{m}]+|{SPACE}*[{m}]+|{SPACE}+|\n").findall
        self.words: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.halves: dict[str, tuple[str, str]] = {}
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            if self.merged(piece) == [piece]:  # others never come out of the merges
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()

    def merged(self, text: str) -> list[str]:
        """The merges themselves, for short strings: best score first, the leftmost of equals.
        The halves of a piece's last merge are remembered."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            if len(parts) == 2:
                self.halves[text] = parts[0], parts[1]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether re-merging the two pieces alone yields them again.

        Their merges are undone, the latest first. While two parts stand at the border, they must
        not form a piece that would have been merged before the merge just undone; of equal
        scores, the left one comes first. Runs of spaces share one score and are merged instead.
        """
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        if len(self.pairs) >= _PAIRS:
            self.pairs.clear()
        key = a, b
        if a[-1] == SPACE and b[0] == SPACE:
            fit = self.merged(a + b) == [a, b]
        else:
            score, halves = self.scores, self.halves
            fit = a + b not in score
            while fit and (len(a) > 1 or len(b) > 1):
                if len(b) == 1 or (len(a) > 1 and score[a] < score[b]):
                    undone = score[a]
                    a = halves[a][1]
                    fit = score.get(a + b, -inf) <= undone
                else:
                    undone = score[b]
                    b = halves[b][0]
                    fit = score.get(a + b, -inf) < undone
        self.pairs[key] = fit
        return fit

    def walk(self, text: str) -> list[str]:
        """Encode a string of known characters: longest pieces first, then backtracking."""
        out: list[str] = []
        for _, piece in self.automaton.iter_long(text):
            if out and not self.fits(out[-1], piece):
                break
            out.append(piece)
        else:
            return out
        return self.backtrack(text, out[:-1])

    def backtrack(self, text: str, out: list[str]) -> list[str]:
        """Go on from pieces that fit so far."""
        n = len(text)
        starts: list[list[str]] = [[] for _ in range(n + 1)]
        for end, piece in self.automaton.iter(text):
            starts[end - len(piece) + 1].append(piece)  # shortest first at each start
        open_ = bytearray(b"\xff" * (n // 8 + 1))
        tried, pos = [], 0  # how many shorter pieces were left where each piece was chosen
        for piece in out:
            tried.append(starts[pos].index(piece))
            pos += len(piece)
        left = len(starts[pos])
        while pos < n:
            here, last = starts[pos], out[-1] if out else None
            while left:
                left -= 1
                piece = here[left]
                end = pos + len(piece)
                if open_[end >> 3] >> (end & 7) & 1 and (last is None or self.fits(last, piece)):
                    out.append(piece)
                    tried.append(left)
                    pos, left = end, len(starts[end])
                    break
            else:
                open_[pos >> 3] &= ~(1 << (pos & 7)) & 0xFF
                if not out:
                    raise ValueError(f"no encoding for {text[:60]!r}")
                left = tried.pop()
                pos -= len(out.pop())
        return out

    def chunk(self, text: str) -> list[int]:
        out: list[int] = []
        for known, run in groupby(text, self.known.__contains__):
            if known:
                out += [self.ids[p] for p in self.walk("".join(run))]
            elif self.byte_fallback:
                out += [self.bytes[b] for b in "".join(run).encode("utf-8", "replace")]
            else:
                out.append(self.unk)
        return out

    def packed(self, text: str) -> bytes:
        """The ids of a whole text, the end id included, as 32-bit numbers."""
        eos = self.eos.to_bytes(4, "little")
        if not text:
            return eos
        parts, words = [], self.words
        for c in self.chunks(SPACE + text.replace(" ", SPACE)):
            got = words.get(c)
            if got is None:
                got = b"".join(i.to_bytes(4, "little") for i in self.chunk(c))
                if len(c) <= 64:
                    if len(words) >= _WORDS:
                        words.clear()
                    words[c] = got
            parts.append(got)
        parts.append(eos)
        return b"".join(parts)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and model."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _int_lists(packed: list[bytes]) -> pa.Array:
    ends, at = [0], 0
    for p in packed:
        at += len(p) // 4
        ends.append(at)
    values = pa.Array.from_buffers(pa.int32(), at, [None, pa.py_buffer(b"".join(packed))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)


def encode(df: DataFrame, model: str, key: str = "doc_id", text: str = "text", decoded: bool = False) -> DataFrame:
    """Rows (key, ids) and, if asked for, the text that the ids decode to."""
    import numpy as np

    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        for batch in batches:
            keys, texts, start = batch.column(0), batch.column(1), 0
            packed, back, size = [], [], 0
            for i, t in enumerate(texts):
                t = t.as_py()
                p = enc.packed(t)
                packed.append(p)
                if decoded:
                    back.append(enc.sp.decode(np.frombuffer(p, np.int32).tolist()))
                size += len(p)
                if size > _BATCH or i == len(texts) - 1:
                    cols = [keys.slice(start, len(packed)), _int_lists(packed)] + [pa.array(back, pa.string())] * decoded
                    yield pa.RecordBatch.from_arrays(cols, ["key", "ids", "decoded"][: len(cols)])
                    packed, back, size, start = [], [], 0, i + 1

    out = rows.mapInArrow(run, f"key {kind}, ids array<int>" + ", decoded string" * decoded)
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, model: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows (key, text): what the library's ``decode`` gives; null ids count as none."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(ids), F.array().cast("array<int>")).alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = encoder(model).sp
        for batch in batches:
            texts = [sp.decode(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "text"])

    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
