"""Finding personal data by anchor expansion.

One Aho-Corasick automaton runs over each whole text and finds anchors: at-signs, schemes, words
that announce an identifier, and the smallest pieces that every number of a kind has (two digits with at most one
separator, digits around a dot, a plus with a digit). At each anchor a local parser expands to the boundaries of
the candidate and checks it. A parser never goes back behind the candidate before, so that a text is read
once per kind whatever it holds.

Base kinds have the matches of these expressions, leftmost and without overlaps within the kind; a match
that fails its check is dropped and not tried again in another length:

- ``email``: ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
- ``ip``: four numbers with dots between them, each at most 255
- ``card``: ``[0-9]([\\x20-]?[0-9])+`` with 12 to 19 digits whose Luhn sum is right
- ``phone``: ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 9 to 15 digits

Added kinds need an anchor that says what they are, hence have few false findings:

- ``spelled_email``: ``name (at) host (dot) tld`` or the same in square brackets
- ``login``: user name, and password if any, in front of the host of a URL
- ``iban``: an account number behind the word IBAN, right modulo 97
- ``account``: 6 to 17 digits behind a word for account
- ``ssn``: nine digits behind a word for social security, with valid groups

Rows: null and empty texts have no spans. Texts are scanned whole, in code points. Repeated rows are scanned
each. Empty tables give empty tables; other columns stay and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE = ("email", "ip", "card", "phone")
ADDED = ("spelled_email", "login", "iban", "account", "ssn")
KINDS = (*BASE, *ADDED)

_DIGITS = "0123456789"
_PAIRS = [(a, b) for a in _DIGITS for b in _DIGITS]
_CUES = {
    "spelled_email": ["(at)", "[at]"],
    "login": ["http://", "https://", "ftp://", "sftp://", "ssh://"],
    "iban": ["iban"],
    "account": ["account", "acct", "konto", "kontonummer", "compte", "cuenta"],
    "ssn": ["ssn", "social security"],
}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_LETTER = re.compile(r"[^\W_]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED = re.compile(r" ?([A-Za-z0-9-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]+)+)", re.IGNORECASE)
_LOGIN = re.compile(r"[^\s/?#@<>\"']+(?=@[A-Za-z0-9\[])")
#: What may stand between a word and the number that it announces.
_BEHIND = r"(?:[ \t]*(?:number|numero|nummer|num|no|nr)\b\.?)?[ \t]*[:#=]?[ \t]*"
_IBAN = re.compile(_BEHIND + r"([A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30})(?![A-Za-z0-9])", re.IGNORECASE)
_ACCOUNT = re.compile(_BEHIND + r"([0-9](?:[ -]?[0-9]){5,16})(?![A-Za-z0-9]|[.,][0-9])", re.IGNORECASE)
_SSN = re.compile(_BEHIND + r"(([0-9]{3})([ -]?)([0-9]{2})\3([0-9]{4}))(?![0-9])", re.IGNORECASE)


def _automaton() -> ahocorasick.Automaton:
    anchors = {"@": "email"}
    anchors |= {f"{a}.{b}": "ip" for a, b in _PAIRS}
    anchors |= {a + sep + b: "card" for a, b in _PAIRS for sep in ("", " ", "-")}
    anchors |= {f"+{a}": "phone" for a in _DIGITS}
    for kind, cues in _CUES.items():
        anchors |= {form: kind for cue in cues for form in (cue, cue.upper(), cue.title())}
    out = ahocorasick.Automaton()
    for anchor, kind in anchors.items():
        out.add_word(anchor, (KINDS.index(kind), len(anchor)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit of the others."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _iban_end(text: str, start: int, end: int) -> int | None:
    """The end of the longest beginning of a candidate that is right modulo 97; the next word may look like a part."""
    while end > start:
        number = text[start:end].replace(" ", "").upper()
        if len(number) < 15:
            return None
        value = "".join(str(int(c, 36)) for c in number[4:] + number[:4])
        if int(value) % 97 == 1:
            return end
        end = text.rfind(" ", start, end)
    return None


def _left(text: str, end: int, least: int) -> int:
    """Where the run of local-part characters before ``end`` starts."""
    start = end
    while start > least and text[start - 1] in _LOCAL:
        start -= 1
    return start


class Finder:
    """The automaton and the parsers at its anchors."""

    def __init__(self):
        self._anchors = _automaton()
        self._parsers = [getattr(self, f"_{kind}") for kind in KINDS]

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) in this order; the end is exclusive."""
        found: list[tuple[int, int, int]] = []
        done = [0] * len(KINDS)  # up to where each kind has read
        for last, (kind, size) in self._anchors.iter(text):
            at = last + 1 - size
            if at >= done[kind]:
                spans, upto = self._parsers[kind](text, at, last + 1, done[kind])
                found += [(s, kind, e) for s, e in spans]
                done[kind] = max(done[kind], upto)
        found.sort()
        return found

    # Each parser has the text, where its anchor starts and ends, and how far its kind has read.

    def _email(self, text, at, after, least):
        domain = _DOMAIN.match(text, after)
        start = _left(text, at, least) if domain else at
        return ([(start, domain.end())], domain.end()) if start < at else ([], least)

    def _ip(self, text, at, after, least):
        start = at
        while start > least and text[start - 1] in _DIGITS:
            start -= 1
        chain = _DOTTED.match(text, start)
        spans, place, parts = [], start, chain.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            size = sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                spans.append((place, place + size))
            place += size + 1
        return spans, chain.end()

    def _card(self, text, at, after, least):
        chain = _CHAIN.match(text, at)
        digits = chain.group().replace(" ", "").replace("-", "")
        return ([chain.span()] if 12 <= len(digits) <= 19 and luhn(digits) else []), chain.end()

    def _phone(self, text, at, after, least):
        number = _PHONE.match(text, at)
        if not number:
            return [], least
        return ([number.span()] if 9 <= sum(c in _DIGITS for c in number.group()) <= 15 else []), number.end()

    def _spelled_email(self, text, at, after, least):
        end = at - 1 if at > least and text[at - 1] == " " else at
        host = _SPELLED.match(text, after)
        start = _left(text, end, least) if host else end
        return ([(start, host.end())], host.end()) if start < end else ([], least)

    def _login(self, text, at, after, least):
        user = _LOGIN.match(text, after)
        return ([user.span()], user.end()) if user else ([], least)

    def _cued(self, text, at, after, least, rx):
        """The number behind a word; the word must not be a part of a longer one."""
        if at > 0 and _LETTER.match(text[at - 1]):
            return None
        return rx.match(text, after)

    def _iban(self, text, at, after, least):
        number = self._cued(text, at, after, least, _IBAN)
        end = number and _iban_end(text, *number.span(1))
        return ([(number.start(1), end)], end) if end else ([], least)

    def _account(self, text, at, after, least):
        number = self._cued(text, at, after, least, _ACCOUNT)
        return ([number.span(1)], number.end()) if number else ([], least)

    def _ssn(self, text, at, after, least):
        number = self._cued(text, at, after, least, _SSN)
        good = number and number[2] not in ("000", "666") and number[2] < "900" and number[4] != "00" and number[5] != "0000"
        return ([number.span(1)], number.end()) if good else ([], least)


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer"))


def with_spans(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """``docs`` with the column ``out``: the spans (kind, start, end) of every text, by start and kind."""
    if out in docs.columns:
        raise ValueError(f"there is a column {out!r}; name another one in `out`")
    place = docs.columns.index(text)
    names = pa.array(KINDS)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            offsets, flat = [0], []
            for value in batch.column(place):
                value = value.as_py()
                if value:
                    flat += finder.spans(value)
                offsets.append(len(flat))
            start, number, end = zip(*flat) if flat else ((), (), ())
            spans = pa.StructArray.from_arrays(
                [names.take(pa.array(number, pa.int32())), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                fields=list(kind.value_type),
            )
            column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), spans, type=kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, SPANS)]))


def joined(spans: Column) -> Column:
    """Spans as ``kind:start:end`` with commas between them."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def base(spans: Column) -> Column:
    """Only the spans of base kinds."""
    return F.filter(spans, lambda s: s["kind"].isin(*BASE))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; spans that overlap an earlier one join it."""
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("at"))
    step = lambda a, s: F.struct(
        F.when(s["start"] < a["at"], a["t"])
        .otherwise(F.concat(a["t"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit("<"), s["kind"], F.lit(">")))
        .alias("t"),
        F.greatest(a["at"], s["end"]).alias("at"),
    )
    return F.aggregate(spans, start, step, lambda a: F.concat(a["t"], F.substring(text, a["at"] + 1, F.length(text))))
