"""HTML as a token table.

A token is a tag (or comment, or a whole script or style element) together with the text up
to the next tag, so a page has one row per tag. Joining the tokens gives back the page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions import selectors

_ATTRIBUTES = r"""[^>=]*+(?:=\s*+(?:"[^"]*+"|'[^']*+')?+[^>=]*+)*+"""
_SWALLOWED = (
    r"<!--.*?(?:-->|\z)"
    r"|<(?i:script)\b.*?(?:</(?i:script)[^>]*>|\z)"
    r"|<(?i:style)\b.*?(?:</(?i:style)[^>]*>|\z)"
)
_TAG = rf"</?[a-zA-Z]{_ATTRIBUTES}>"
_MARKUP = rf"(?:{_SWALLOWED}|{_TAG}|<[!?][^>]*>)"
# A "<" that opens nothing is a token of its own, made of text only.
_TOKEN = rf"(?s){_MARKUP}[^<]*|<[^<]*|[^<]+"


def open_tags(html: Column) -> Column:
    """All opening tags of a page as one text, each after a separator."""
    found = F.regexp_extract_all(
        html, F.lit(rf"(?s)(?:{_SWALLOWED})|(<[a-zA-Z]{_ATTRIBUTES}>)"), F.lit(1)
    )
    sep = selectors.TAG_SEPARATOR
    return F.concat(F.lit(sep), F.array_join(found, sep))


def html_tokens(pages: DataFrame, html: str = "html") -> DataFrame:
    """Explode pages into tokens.

    Adds ``pos``, ``tag_text`` (the markup), ``text`` (what follows it), ``tag`` (lower-case
    name, null for text and comments) and ``kind``: ``open``, ``close``, ``void`` or ``text``.
    """
    found = F.regexp_extract_all(F.col(html), F.lit(_TOKEN), F.lit(0))
    df = pages.withColumn("__toks", found)
    # Outer: a page of nothing is one empty token, so that it stays a page in all that follows. And for other generators the optimizer
    # puts a filter on the size of the array in front, which would take the page apart several times more.
    df = df.drop(html).select("*", F.posexplode_outer("__toks").alias("pos", "__tok")).drop("__toks")
    df = df.withColumns({"pos": F.coalesce("pos", F.lit(0)), "__tok": F.coalesce("__tok", F.lit(""))})
    df = df.withColumn("text", F.regexp_replace("__tok", rf"(?s)\A{_MARKUP}", ""))
    df = df.withColumn(
        "tag_text", F.expr("substring(__tok, 1, length(__tok) - length(text))")
    ).drop("__tok")
    name = F.lower(F.regexp_extract("tag_text", r"\A</?([a-zA-Z][^\s/>]*)", 1))
    df = df.withColumn("tag", F.when(name != "", name))
    return df.withColumn(
        "kind",
        F.when(F.col("tag").isNull(), "text")
        .when(F.col("tag_text").startswith("</"), "close")
        .when(F.col("tag").isin("script", "style", *rules.VOID_TAGS), "void")
        .otherwise("open"),
    )
