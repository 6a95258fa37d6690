"""Scanning texts for licenses by conditional compression.

A trigger is a word that notices have (license, copyright, permission and so on), also across the end of a line. The
words around triggers, as many as the longest template has and may gain, are searched for every template at every place:
places are the longest common runs of words, and each is confirmed by the exact differences of the wording, the words
that it lacks or adds. A template is left out only where it can't fit, since too few of its words, or not all of its
telling ones, are there at all. Of places that overlap the one with the fewest differences wins, ties going to
the larger reduction and then to the name. The reduction is the share of the size under zstandard that the template as raw
dictionary takes away from the wording found. What differs is part of the result, so ``version 3`` is not taken
for ``version 2``: words marked as telling must be the same.

Rows: null and empty texts have no triggers. Texts are scanned whole. Repeated rows are scanned each. Neighbouring lines
with triggers where no template fits are returned too, without a license. Other columns may have any name; empty
tables and texts without triggers give no rows.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Wording of common notices.
TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "BSD-3-Clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software"
    ),
    "ISC-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        "the above copyright notice and this permission notice appear in all copies."
    ),
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}
#: Names and versions: a template fits only with these as they are.
TELLING = frozenset(
    "mit apache gnu lesser affero general mozilla bsd cc by by-sa by-nc by-nd cc0 isc 1.0 2 2.0 3 3.0 4.0 v version".split()
)
#: Blanks, line ends and the marks of comments at the beginning of lines.
_GAP = r"[\s#*/;>-]+"
_TRIGGER = (
    r"(?i)licen[sc]e|copyright|\(c\) *[12]\d{3}|©|permission~is|permission~to~use|permitted|all~rights~reserved|spdx|public~domain|waived~all"
).replace("~", _GAP)
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*|©")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    """Compressors and words of a set of templates."""

    def __init__(self, templates: dict[str, str], level: int = 3):
        import zstandard

        self.longest = max(len(words(t)) for t in templates.values())
        self.plain = zstandard.ZstdCompressor(level=level)
        self.words = {name: words(t) for name, t in templates.items()}
        self.with_ = {
            name: zstandard.ZstdCompressor(
                level=level, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            )
            for name, t in templates.items()
        }

    def reductions(self, block: str) -> list[tuple[float, str]]:
        """Share of the compressed size that each template takes away, largest first."""
        data = block.lower().encode("utf-8", "replace")
        alone = len(self.plain.compress(data))
        return sorted(((1 - len(c.compress(data)) / alone, name) for name, c in self.with_.items()), key=lambda x: (-x[0], x[1]))

    def differences(self, block: list[str], name: str) -> tuple[list[str], list[str], int, int]:
        """Words that the template has and the block lacks, and the other way round where they meet, and that range."""
        wanted = self.words[name]
        match = difflib.SequenceMatcher(None, wanted, block, autojunk=False)
        spans = [m for m in match.get_matching_blocks() if m.size]
        if not spans:
            return wanted, block, 0, len(block)
        lo, hi = spans[0].b, spans[-1].b + spans[-1].size
        # The template's first and last words may have been replaced by as many others.
        lo, hi = max(0, lo - spans[0].a), min(len(block), hi + len(wanted) - spans[-1].a - spans[-1].size)
        lacks, adds = [], []
        for op, a, b, c, d in difflib.SequenceMatcher(None, wanted, block[lo:hi], autojunk=False).get_opcodes():
            if op != "equal":
                lacks += wanted[a:b]
                adds += block[lo:hi][c:d]
        return lacks, adds, lo, hi

    def possible(self, block: list[str], name: str, tolerance: float) -> bool:
        """Whether the words, in any order, could do: no template that fits fails this."""
        bag, wanted = Counter(block), Counter(self.words[name])
        missing = sum((wanted - bag).values())
        return missing <= tolerance * len(self.words[name]) and all(bag[w] >= n for w, n in wanted.items() if w in TELLING)

    def places(self, block: list[str], tolerance: float) -> list[tuple[int, int, int, str, list[str], list[str]]]:
        """(from, to, differences, template, lacks, adds) of every confirmed place, which may overlap."""
        out = []
        for name, wanted in self.words.items():
            slack = int(tolerance * len(wanted))
            parts = [(0, len(block))]
            while parts:
                lo, hi = parts.pop()
                part = block[lo:hi]
                if not self.possible(part, name, tolerance):
                    continue
                m = difflib.SequenceMatcher(None, wanted, part, autojunk=False).find_longest_match()
                fits = []
                for more in (0, slack):  # words that were added or left out move the ends
                    x, y = max(0, m.b - m.a - more), m.b - m.a + len(wanted) + more
                    lacks, adds, a, b = self.differences(part[x:y], name)
                    changed = len(lacks) + len(adds)
                    if changed <= tolerance * len(wanted) and TELLING.isdisjoint(lacks) and TELLING.isdisjoint(adds):
                        fits.append((changed, lo + x + a, lo + x + b, lacks, adds))
                if fits:
                    changed, a, b, lacks, adds = min(fits)
                    out.append((a, b, changed, name, lacks, adds))
                    parts += [(lo, a), (b, hi)]
                elif m.size:
                    parts += [(lo, lo + m.b), (lo + m.b + m.size, hi)]
        return out

    def chosen(self, text: str, tokens: list[tuple[int, int, str]], tolerance: float):
        """(from, to, license, reduction, lacks, adds) in characters: of overlapping places the best."""
        hits = sorted(self.places([t[2] for t in tokens], tolerance))
        out, at = [], 0
        while at < len(hits):
            end, stop = hits[at][1], at + 1
            while stop < len(hits) and hits[stop][0] < end:
                end = max(end, hits[stop][1])
                stop += 1
            share = {name: r for r, name in self.reductions(text[tokens[hits[at][0]][0] : tokens[end - 1][1]])}
            taken: list[tuple[int, int]] = []
            for a, b, _, name, lacks, adds in sorted(hits[at:stop], key=lambda h: (h[2], -share[h[3]], h[3], h[0])):
                if all(b <= x or y <= a for x, y in taken):
                    taken.append((a, b))
                    out.append((tokens[a][0], tokens[b - 1][1], name, share[name], lacks, adds))
            at = stop
        return out

    def best(self, block: str, candidates: int, tolerance: float):
        """(license, reduction, lacks, adds) of the best confirmed template, or the best one unconfirmed as None.

        All templates are compared, whatever ``candidates`` is.
        """
        tokens = _tokens(block)
        found = self.chosen(block, tokens, tolerance)
        if not found:
            return None, self.reductions(block)[0][0], [], []
        return min(found, key=lambda f: (len(f[4]) + len(f[5]), -f[3], f[2]))[2:]


def _tokens(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text)]


def _ranges(spans: list[tuple[int, int]], gap: int) -> list[list[int]]:
    """Ascending ranges joined where they overlap or are no more than ``gap`` apart."""
    out: list[list[int]] = []
    for a, b in spans:
        if out and a <= out[-1][1] + gap:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _rows(scanner: Scanner, text: str, trigger, tolerance: float) -> list[tuple]:
    """(line, start, length, license, reduction, lacks, adds), ascending."""
    spans = [m.span() for m in trigger(text)]
    if not spans:
        return []
    lines = [0, *(m.end() for m in re.finditer("\n", text)), len(text) + 1]
    line = lambda at: bisect_right(lines, at) - 1
    tokens = _tokens(text)
    starts, reach = [t[0] for t in tokens], int(scanner.longest * (1 + tolerance)) + 1
    near = [(max(0, bisect_right(starts, a) - 1 - reach), min(len(tokens), bisect_right(starts, b - 1) + reach)) for a, b in spans]
    out, taken = [], set()
    for lo, hi in _ranges(near, 0):
        for a, b, *found in scanner.chosen(text, tokens[lo:hi], tolerance):
            first, last = line(a), line(b - 1)
            taken.update(range(first, last + 1))
            out.append((first, lines[first], lines[last + 1] - 1 - lines[first], *found))
    for first, last in _ranges([(line(a), line(b - 1)) for a, b in spans], 1):
        if taken.isdisjoint(range(first, last + 1)):
            start, end = lines[first], lines[last + 1] - 1
            # Reductions tell little on long stretches, so the largest of bounded, overlapping ones counts.
            own = [t for t in tokens if start <= t[0] < end]
            parts = [own[i : i + 2 * reach] for i in range(0, max(1, len(own) - reach), reach)]
            parts = {text[p[0][0] : p[-1][1]] if p else text[start:end] for p in parts}
            out.append((first, start, end - start, None, max(scanner.reductions(p)[0][0] for p in parts), [], []))
    return sorted(out, key=lambda r: (r[0], r[3] or ""))


def scan(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    templates: dict[str, str] | None = None,
    tolerance: float = 0.34,
) -> DataFrame:
    """Rows (key, line, start, length, license, reduction, lacks, adds), one for each place of a template and
    for each run of lines with triggers where none fits.

    ``line`` counts from 0; ``start`` and ``length`` are code points of the text and take in the lines of the place.
    """
    templates = dict(templates or TEMPLATES)
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.filter(F.col("text").rlike(_TRIGGER))
    kind = rows.schema["key"].dataType.simpleString()
    trigger = re.compile(_TRIGGER).finditer

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for k, t in zip(batch.column(0), batch.column(1), strict=True):
                for row in _rows(scanner, t.as_py(), trigger, tolerance):
                    for column, value in zip(out, (k.as_py(), *row), strict=True):
                        column.append(value)
            types = (batch.schema.field(0).type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string()))
            cols = [pa.array(c, t) for c, t in zip(out, types, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, ["key", "line", "start", "length", "license", "reduction", "lacks", "adds"])

    schema = f"key {kind}, line int, start long, length long, license string, reduction double, lacks array<string>, adds array<string>"
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)
