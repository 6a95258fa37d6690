"""CSS selectors as predicates on tag text.

Supported are the forms that site rules use: tag, ``.class``, ``#id``, ``[attr]``,
``[attr="v"]``, ``[attr*="v"]``, compounds of these, descendant and child combinations and
comma lists. Anything else raises, so that no rule is silently ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_SIMPLE = re.compile(
    r"(?P<tag>[a-zA-Z][\w-]*)"
    r"|\.(?P<cls>[\w-]+)"
    r"|#(?P<id>[\w-]+)"
    r"|\[(?P<attr>[\w-]+)(?:(?P<op>\*?=)[\"']?(?P<val>[^\"'\]]*)[\"']?)?\]"
)


_COMMA = r",(?![^\[]*\])"


@dataclass(frozen=True)
class Compound:
    """Conditions on one element; ``link`` says how it relates to the one before it."""

    text: str
    link: str = ""

    def conditions(self) -> list[tuple[str, str, str, str]]:
        """``(kind, name, op, value)`` per simple selector."""
        found, pos = [], 0
        while pos < len(self.text):
            m = _SIMPLE.match(self.text, pos)
            if m is None:
                raise ValueError(f"unsupported selector: {self.text!r}")
            if m["tag"]:
                found.append(("tag", m["tag"].lower(), "", ""))
            elif m["cls"]:
                found.append(("class", m["cls"], "", ""))
            elif m["id"]:
                found.append(("attr", "id", "=", m["id"]))
            else:
                found.append(("attr", m["attr"].lower(), m["op"] or "", m["val"] or ""))
            pos = m.end()
        return found


def parse(selector: str) -> list[list[Compound]]:
    """A comma list as chains of compounds, ancestors first."""
    chains = []
    for part in re.split(_COMMA, selector):
        words = re.findall(r">|(?:\[[^\]]*\]|[^\s>\[])+", part.strip())
        if not words:
            raise ValueError(f"unsupported selector: {selector!r}")
        chain, link = [], ""
        for word in words:
            if word == ">":
                link = ">"
                continue
            chain.append(Compound(word, link if chain else ""))
            link = " "
        for c in chain:
            c.conditions()
        chains.append(chain)
    return chains


def split_combined(selectors: Sequence[str]) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Selectors without and with combinators; comma lists are taken apart."""
    plain, combined = [], []
    for selector in selectors:
        for part in re.split(_COMMA, selector):
            (plain if len(parse(part)[0]) == 1 else combined).append(part.strip())
    return tuple(plain), tuple(combined)


def attribute(tag_text: Column, name: str) -> Column:
    """The value of an attribute in the text of a tag, empty when absent."""
    found = F.regexp_extract(
        tag_text, rf"""(?is)[\s"'/]{re.escape(name)}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1
    )
    return F.when(
        tag_text.contains(name) | tag_text.rlike(f"(?i){re.escape(name)}"),
        F.regexp_replace(found, r"""(?s)\A["']|["']\z""", ""),
    ).otherwise("")


def _class_regex(*names: str) -> str:
    w = f"(?:{'|'.join(re.escape(n) for n in names)})"
    return (
        rf"""[\s"'/](?i:class)\s*=\s*(?:"(?:[^"]*\s)?{w}[\s"]|'(?:[^']*\s)?{w}[\s']|{w}[\s>])"""
    )


def _regex(kind: str, name: str, op: str, value: str) -> str:
    v = re.escape(value)
    attr = rf"(?i:{re.escape(name)})"
    if kind == "tag":
        return rf"<(?i:{re.escape(name)})(?=[\s/>])"
    if kind == "class":
        return _class_regex(name)
    if op == "=":
        return rf"""[\s"'/]{attr}\s*=\s*(?:"{v}"|'{v}'|{v}[\s>])"""
    if op == "*=":
        return rf"""[\s"'/]{attr}\s*=\s*(?:"[^"]*{v}|'[^']*{v}|[^\s"'>]*{v})"""
    return rf"""[\s"'/]{attr}[\s=/>]"""


def tag_matches(tag: Column, tag_text: Column, compound: Compound) -> Column:
    """The element opened by ``tag_text`` meets all conditions of the compound."""
    tests = []
    for kind, name, op, value in compound.conditions():
        if kind == "tag":
            tests.append(tag == name)
        else:
            word = name if kind == "class" else (value or name)
            tests.append(tag_text.contains(word) & tag_text.rlike(_regex(kind, name, op, value)))
    return reduce(lambda a, b: a & b, tests)


def matches_any(tag: Column, tag_text: Column, selectors: tuple[str, ...]) -> Column:
    """The element matches one of several selectors without combinators."""
    tags: list[str] = []
    classes: list[str] = []
    tests: list[Column] = []
    for selector in selectors:
        for chain in parse(selector):
            if len(chain) > 1:
                raise ValueError(f"combinators are not supported here: {selector!r}")
            conditions = chain[0].conditions()
            if len(conditions) == 1 and conditions[0][0] == "tag":
                tags.append(conditions[0][1])
            elif len(conditions) == 1 and conditions[0][0] == "class":
                classes.append(conditions[0][1])
            else:
                tests.append(tag_matches(tag, tag_text, chain[0]))
    # All plain tags are one test and so are all plain classes.
    if classes:
        tests.insert(0, (F.length(tag_text) > 9) & tag_text.rlike(_class_regex(*classes)))
    if tags:
        tests.insert(0, tag.isin(*dict.fromkeys(tags)))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


# Text between the tags of a page, as joined by operators.html.open_tags.
TAG_SEPARATOR = "\x1e"


def page_has(tags_of_page: Column, selector: str) -> Column:
    """Some element of a page matches a selector without combinators.

    ``tags_of_page`` holds all opening tags of the page, each after a separator, so one
    search over that text answers for the whole page and no tag has to become a row.
    """
    tests = []
    for chain in parse(selector):
        if len(chain) > 1:
            raise ValueError(f"combinators are not supported here: {selector!r}")
        conditions = chain[0].conditions()
        looks = "".join(rf"(?=[^\x1e]*?{_regex(*c)})" for c in conditions)
        # Names of classes and values stand in the page as they are: a cheap test goes first.
        words = [n if kind == "class" else v for kind, n, _, v in conditions]
        test = tags_of_page.rlike(rf"\x1e{looks}")
        for word in filter(None, words):
            test = tags_of_page.contains(word) & test
        tests.append(test)
    return reduce(lambda a, b: a | b, tests)
