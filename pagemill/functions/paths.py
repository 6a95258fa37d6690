"""Output path columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import rules


def local_path(path: Column, words: Sequence[str] = rules.DOC_WORDS) -> Column:
    """URL path to file path: what follows the first documentation word, plus ``.md``."""
    word = "|".join(words)
    rest = F.regexp_replace(path, rf"(?i)\A(?:/|/.*?/)(?:{word})(?:/|\z)", "/")
    name = F.regexp_replace(F.regexp_replace(rest, "/{2,}", "/"), r"\A/|/\z", "")
    return F.when(name == "", "index.md").otherwise(F.concat(name, F.lit(".md")))


def dir_path(path: Column) -> Column:
    """The directory of a path, empty when it has none."""
    return F.regexp_extract(path, r"(?s)\A(.*)/[^/]*\z", 1)


def numbered_path(path: Column, number: Column, digits: int = 2) -> Column:
    """``dir/NN-name``; the number is never cut when it needs more digits."""
    text = number.cast("string")
    padded = F.lpad(text, F.greatest(F.lit(digits), F.length(text)), F.lit("0"))
    name = F.regexp_extract(path, r"(?s)([^/]*)\z", 1)
    folder = F.regexp_extract(path, r"(?s)\A(.*/)[^/]*\z", 1)
    return F.concat(folder, padded, F.lit("-"), name)


def is_safe_path(path: Column) -> Column:
    """The path, once resolved, stays below its own first segment."""
    base = F.regexp_extract(path, r"\A([^/]*)", 1)
    # Climbing above the start leaves ".." segments at the front, as a path resolver would.
    resolved = F.aggregate(
        F.split(path, "/"),
        F.lit(""),
        lambda acc, s: F.when((s == "") | (s == "."), acc)
        .when(
            (s == "..") & (acc != "") & ~acc.rlike(r"(?:\A|/)\.\./\z"),
            F.regexp_replace(acc, r"[^/]*/\z", ""),
        )
        .otherwise(F.concat(acc, s, F.lit("/"))),
    )
    below = F.when(base == ".", resolved).otherwise(
        F.when(
            resolved.startswith(F.concat(base, F.lit("/"))),
            F.substr(resolved, F.length(base) + 2),
        )
    )
    return F.coalesce(~path.startswith("/") & ~below.startswith(".."), F.lit(False))
