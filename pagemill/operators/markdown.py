"""Token table to Markdown.

Every token turns into a piece of text with the help of running counts along the page, the
pieces are joined per page, and a few linear replacements settle what depends on neighbours:
line breaks, white space and inline marks. Between these steps structure is written with
control characters, which HTML text may not hold and which are removed from the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions import content, selectors, urls
from pagemill.operators import regions

# Breaks: paragraph, line, paragraph within a quote, end of a list item.
PARA, LINE, QPARA, ITEM_END = "\x01", "\x0e", "\x13", "\x10"
# Line prefixes: list level, quote level. End of an item's bullet, forced line break, space
# that must stay.
INDENT, QUOTE, BULLET_END, BR, SPACE = "\x11", "\x12", "\x0f", "\x02", "\x17"
# Link: start, end of text, end of target.
LINK, LINK_MID, LINK_END = "\x03", "\x04", "\x05"
# Inline marks: start, end, Markdown.
INLINE = (("\x06", "\x07", "**"), ("\x08", "\x14", "_"), ("\x15", "\x16", "~"))
_CONTROL = "".join(chr(c) for c in range(1, 32) if chr(c) not in "\t\n\f\r")
_BREAKS = PARA + LINE + QPARA + ITEM_END
_PREFIX = INDENT + QUOTE

_INLINE_TAGS = ((("strong", "b"), 0), (("em", "i"), 1), (("del", "s", "strike"), 2))
_HEADINGS = tuple(f"h{i}" for i in range(1, 7))


def with_reference(tokens: DataFrame, base: str) -> DataFrame:
    """Add ``ref``, the absolute link target or image source of a tag, ``title`` and ``alt``.

    ``base`` is the prefix of the page's URL parts, which are dropped here so that they do
    not travel with every token.
    """
    text, tag, opens = F.col("tag_text"), F.col("tag"), F.col("kind").isin("open", "void")
    raw = F.when(opens & (tag == "a"), selectors.attribute(text, "href")).when(
        opens & (tag == "img"), selectors.attribute(text, "src")
    )
    df = tokens.withColumn("__raw", F.when(raw != "", raw))
    titled = opens & tag.isin("a", "img") & text.contains("title")
    df = df.withColumns(
        {
            "title": F.when(titled, selectors.attribute(text, "title")),
            "alt": F.when(opens & (tag == "img"), selectors.attribute(text, "alt")),
        }
    )
    kept = F.when(tag == "a", F.col("__raw").rlike(r"\A(?:http|mailto|#)")).otherwise(
        F.col("__raw").rlike(r"\A(?:http|data:)")
    )
    df = df.withColumn("__rel", F.when(~kept, F.col("__raw")))
    df = df.withColumn("__to_url", urls.resolved(base, F.col("__rel")))
    # One decoding for all attribute values of a tag; a value cannot hold the separator.
    values = [F.coalesce("__to_url", "__raw"), F.col("title"), F.col("alt")]
    df = df.withColumn("__values", F.concat_ws("\x1f", *[F.coalesce(v, F.lit("")) for v in values]))
    df = df.withColumn(
        "__values", F.when(F.col("kind") != "text", content.decode_entities(F.col("__values"), attribute=True))
    )
    part = lambda i: F.split_part("__values", F.lit("\x1f"), F.lit(i))
    df = df.withColumns(
        {
            "ref": F.when(F.col("__raw").isNotNull(), part(1)),
            "title": F.when(F.col("title") != "", part(2)),
            "alt": F.when(F.col("alt").isNotNull(), part(3)),
        }
    )
    parts = ("scheme", "host", "port", "path", "query", "fragment")
    return df.drop(
        "__raw", "__rel", "__to_url", "__values", *[f"{base}{n}" for n in parts]
    )


def absolutize_urls(tokens: DataFrame, base: str) -> DataFrame:
    """Add ``absolute_text``: the tag with its double-quoted href and src made absolute."""
    df = tokens.withColumn("absolute_text", F.col("tag_text"))
    for name, kept in (("href", "http|mailto|#"), ("src", "http|data:")):
        found = F.regexp_extract("absolute_text", rf'{name}="((?!{kept})[^"]+)"', 1)
        df = df.withColumn("__old", F.when(found != "", found))
        df = urls.with_resolved(df, base, "__old", "__to_")
        new = F.coalesce(F.col("__to_url"), F.col("__old"))
        df = df.withColumn(
            "absolute_text",
            F.when(
                F.col("__old").isNotNull(),
                F.replace(
                    "absolute_text",
                    F.concat(F.lit(f'{name}="'), F.col("__old"), F.lit('"')),
                    F.concat(F.lit(f'{name}="'), new, F.lit('"')),
                ),
            ).otherwise(F.col("absolute_text")),
        )
        parts = ("scheme", "host", "port", "path", "query", "fragment", "url")
        df = df.drop("__old", *[f"__to_{n}" for n in parts])
    return df


def _running(df: DataFrame, key: regions.Key) -> DataFrame:
    """Running counts and the latest list, link, code and table starts of each token."""
    tag, kind = F.col("tag"), F.col("kind")
    opens, closes = kind == "open", kind == "close"
    now = regions.up_to(key)

    nested = {"lists": ("ul", "ol", "menu"), "quotes": ("blockquote",), "pres": ("pre",), "codes": ("code",)}
    sums = {}
    for name, tags in nested.items():
        step = F.when(opens & tag.isin(*tags), 1).when(closes & tag.isin(*tags), -1).otherwise(0)
        sums[f"__sum_{name}"] = F.sum(step).over(now)
    df = df.withColumns(sums)

    def nest(name: str) -> Column:
        """Open elements, where an end tag without a start counts for nothing."""
        total = F.col(f"__sum_{name}")
        return total - F.least(F.lit(0), F.min(total).over(now))

    # A cell ends at its end tag and, where that is left out, at the next cell, row or table part.
    edge = tag.isin("tr", "thead", "tbody", "tfoot") | (closes & tag.isin("td", "th", "table"))
    cell = F.when(opens & tag.isin("td", "th"), 1).when((opens | closes) & edge, 0)
    part_ends = closes & tag.isin("table", "thead", "tbody", "tfoot")
    row = F.when(opens & (tag == "tr"), 1).when((closes & (tag == "tr")) | part_ends, 0)

    def latest(hit: Column, value: Column) -> Column:
        return F.last(F.when(hit, value), ignorenulls=True).over(now)

    def count(hit: Column) -> Column:
        return F.sum(F.when(hit, 1).otherwise(0)).over(now)

    in_order = Window.partitionBy(*regions.keys(key)).orderBy("pos")
    text = F.col("tag_text")
    blank = content.js_trim(F.col("text")) == ""
    lang = F.regexp_extract(selectors.attribute(text, "class"), r"language-([A-Za-z0-9_]+)", 1)
    df = df.withColumns(
        {
            "__next_tag": F.when(F.lead("kind").over(in_order) == "open", F.lead("tag").over(in_order)),
            "__next_end": F.when(F.lead("kind").over(in_order) == "close", F.lead("tag").over(in_order)),
            "__prev_blank": F.when(
                (F.lag("kind").over(in_order) == "open") & F.lag(blank).over(in_order),
                F.lag("tag").over(in_order),
            ),
            "__blank": blank,
            "__lang": F.when(opens & (tag == "code"), lang),
            "__lists": nest("lists"),
            "__quotes": nest("quotes"),
            "__pres": nest("pres"),
            "__codes": nest("codes"),
            "__cells": F.coalesce(F.last(cell, ignorenulls=True).over(now), F.lit(0)),
            "__row": F.coalesce(F.last(row, ignorenulls=True).over(now), F.lit(0)),
            "__rows": count(opens & (tag == "tr")),
            "__cols": count(opens & tag.isin("td", "th")),
        }
    ).drop(*sums)
    pre = opens & (tag == "pre")
    fenced = (F.col("__next_tag") == "code") & (F.col("text") == "")
    ends = lambda t: opens & (tag == t)
    tick = F.when(F.col("text").contains("`"), "``").otherwise("`")
    df = df.withColumns(
        {
            "__fenced": F.coalesce(latest(pre, F.coalesce(fenced, F.lit(False))), F.lit(False))
            & (F.col("__pres") > 0),
            "__next_lang": F.lead("__lang").over(in_order),
            "__tick": latest(ends("code"), tick),
            "__link": latest(
                ends("a"),
                F.struct("ref", "title"),
            ),
            "__list_at": latest(tag.isin("ul", "ol", "menu") & opens & (F.col("__lists") == 1), F.col("pos")),
            "__quote_at": latest(ends("blockquote") & (F.col("__quotes") == 1), F.col("pos")),
            "__row0": latest(ends("table"), F.col("__rows")),
            "__col0": latest(ends("tr"), F.col("__cols")),
        }
    )
    # What is still open where an end tag has been left out.
    before = lambda name: F.lag(name).over(in_order)
    implied = (opens & tag.isin("td", "th")) | ((opens | closes) & edge & ~tag.isin("td", "th"))
    df = df.withColumns(
        {
            "__cell_ends": F.coalesce((before("__cells") == 1) & implied, F.lit(False)),
            "__row_ends": F.coalesce((before("__row") == 1) & ((opens & (tag == "tr")) | part_ends), F.lit(False)),
            "__row_width": F.when(before("__rows") == before("__row0") + 1, before("__cols") - before("__col0")),
        }
    )
    # The innermost list of an item and its number there.
    level = (
        Window.partitionBy(*regions.keys(key), "__lists")
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    starts = opens & tag.isin("ul", "ol", "menu")
    start = F.coalesce(selectors.attribute(text, "start").try_cast("int"), F.lit(1))
    df = df.withColumns(
        {
            "__items": F.sum(F.when(opens & (tag == "li"), 1).otherwise(0)).over(level),
            "__list": F.last(
                F.when(starts, F.struct(tag.alias("tag"), start.alias("start"))), ignorenulls=True
            ).over(level),
        }
    )
    base = F.last(F.when(starts, F.col("__items")), ignorenulls=True).over(level)
    return df.withColumn("__number", F.col("__items") - base + F.col("__list.start") - 1)


def _prefixed(df: DataFrame) -> DataFrame:
    """Add the line prefix of each token and the breaks that carry it."""
    quotes, lists = F.col("__quotes"), F.col("__lists")
    quote_first = F.coalesce(F.col("__quote_at") < F.col("__list_at"), F.lit(True))

    def prefix(levels: Column) -> Column:
        q, i = F.repeat(F.lit(QUOTE), quotes), F.repeat(F.lit(INDENT), levels)
        return F.when(quote_first, F.concat(q, i)).otherwise(F.concat(i, q))

    deep = (quotes > 0) | (lists > 0)
    item = F.when(deep, prefix(F.greatest(lists - 1, F.lit(0)))).otherwise("")
    df = df.withColumns(
        {"__pre": F.when(deep, prefix(lists)).otherwise(""), "__item_pre": item}
    )
    in_cell = F.col("__cells") > 0
    para = F.when(quotes > 0, QPARA).otherwise(PARA)
    return df.withColumns(
        {
            "__block": F.when(in_cell, " ").otherwise(F.concat(para, F.col("__pre"))),
            "__outer": F.when(in_cell, " ").otherwise(F.concat(F.lit(PARA), F.col("__pre"))),
            "__line": F.when(in_cell, " ").otherwise(F.concat(F.lit(LINE), F.col("__pre"))),
        }
    )


def _markup(df: DataFrame) -> Column:
    """What the tag of a token turns into."""
    tag, kind, lists = F.col("tag"), F.col("kind"), F.col("__lists")
    opens, closes = kind == "open", kind == "close"
    lit, cat = F.lit, F.concat
    pre, block, line = F.col("__pre"), F.col("__block"), F.col("__line")
    in_cell = F.col("__cells") > 0
    nested_list = F.when(opens, lists > 1).otherwise(lists > 0)
    fenced = F.col("__fenced")
    blank_open = opens & F.col("__blank") & (F.col("__next_end") == tag)
    blank_close = closes & (F.col("__prev_blank") == tag)
    empty = F.coalesce(blank_open | blank_close, lit(False))

    def titled(title: Column) -> Column:
        text = F.replace(title, lit('"'), lit('\\"'))
        return F.coalesce(cat(lit(' "'), text, lit('"')), lit(""))

    href = F.regexp_replace(F.col("__link.ref"), r"([()])", r"\\$1")
    lang = F.coalesce(
        F.when(F.col("__next_lang") != "", F.col("__next_lang")), F.col("parent_lang"), lit("")
    )
    bullet = F.when(
        F.coalesce(F.col("__list.tag") == "ol", lit(False)),
        cat(F.col("__number").cast("string"), lit("." + SPACE * 2)),
    ).otherwise(lit("-" + SPACE * 3))
    image = cat(
        lit("!["), F.col("alt"), lit("]("), F.col("ref"), titled(F.col("title")), lit(")")
    )
    checkbox = F.col("tag_text").rlike(r"""(?i)\stype\s*=\s*["']?checkbox""") & (lists > 0)
    checked = F.col("tag_text").rlike(r"(?i)\schecked[\s=/>]")
    first_row = F.col("__rows") == F.col("__row0") + 1
    width = F.greatest(F.col("__cols") - F.col("__col0"), lit(0))

    piece = F.when(tag.isNull() | (kind == "text"), "").when(
        tag == "pre",
        F.when(opens & fenced, cat(block, lit("```"), lang, lit("\n"), pre))
        .when(closes & F.col("__was_fenced"), cat(lit("\n"), pre, lit("```"), block))
        .otherwise(block),
    )
    piece = piece.when(fenced, "").when(
        tag == "code", F.when(empty | (kind == "void"), "").otherwise(F.col("__tick"))
    )
    piece = piece.when(F.col("__codes") > 0, "")
    for tags, i in _INLINE_TAGS:
        start, end, _ = INLINE[i]
        piece = piece.when(
            tag.isin(*tags), F.when(empty, "").when(opens, start).when(closes, end).otherwise("")
        )
    piece = piece.when(
        tag == "a",
        F.when(opens & F.col("ref").isNotNull(), LINK)
        .when(
            closes & F.col("__link.ref").isNotNull(),
            cat(lit(LINK_MID + "("), href, titled(F.col("__link.title")), lit(")" + LINK_END)),
        )
        .otherwise(""),
    )
    piece = piece.when((tag == "img") & F.col("ref").isNotNull(), image)
    piece = piece.when(tag == "br", F.when(in_cell, " ").otherwise(cat(lit(BR), pre)))
    piece = piece.when((tag == "input") & checkbox, F.when(checked, "[x] ").otherwise("[ ] "))
    piece = piece.when(tag == "hr", cat(block, lit("* * *"), block))
    piece = piece.when(
        tag.isin(*_HEADINGS),
        F.when(
            opens & ~empty,
            cat(block, F.repeat(lit("#"), F.substr(tag, lit(2), lit(1)).cast("int")), lit(SPACE)),
        ).otherwise(block),
    )
    piece = piece.when(tag == "blockquote", F.col("__outer"))
    piece = piece.when(
        tag.isin("ul", "ol", "menu"), F.when(nested_list, line).otherwise(block)
    )
    piece = piece.when(
        tag == "li",
        F.when(in_cell, " ")
        .when(opens, cat(lit(LINE), F.col("__item_pre"), bullet, lit(BULLET_END)))
        .when(closes, cat(lit(ITEM_END), pre)),
    )
    piece = piece.when(
        tag == "tr",
        F.when(opens, cat(line, lit("|"))).when(
            first_row, cat(line, lit("|"), F.repeat(lit(" --- |"), width.cast("int")))
        ),
    )
    piece = piece.when(tag.isin("td", "th"), F.when(opens, " ").otherwise(" |"))
    piece = F.coalesce(piece.when(tag.isin(*rules.BLOCK_TAGS), block), lit(""))
    head = cat(line, lit("|"), F.repeat(lit(" --- |"), F.col("__row_width").cast("int")))
    ends = cat(
        F.when(F.col("__cell_ends"), " |").otherwise(""),
        F.when(F.col("__row_ends") & (F.col("__row_width") > 0), head).otherwise(""),
    )
    return cat(ends, piece)


def _with_pieces(df: DataFrame) -> DataFrame:
    """Add ``__out``: what a token adds to the page, its tag and the text behind it."""
    df = _prefixed(df).withColumn("__markup", _markup(df))
    fenced, in_pre, inside_code = F.col("__fenced"), F.col("__pres") > 0, F.col("__codes") > 0
    raw = F.translate(F.col("text"), _CONTROL, "")
    kept = F.translate(F.replace(raw, F.lit("\r\n"), F.lit("\n")), " ", SPACE)
    df = df.withColumn(
        "__text",
        F.when(F.col("text") == "", "")
        .when(in_pre, kept)
        .otherwise(F.regexp_replace(raw, r"[ \t\r\n\f]+", " ")),
    )
    df = df.withColumn("__text", content.decode_entities(F.col("__text")))
    df = df.withColumn(
        "__text",
        F.when(fenced | inside_code, F.col("__text")).otherwise(
            content.escape_markdown(F.col("__text"))
        ),
    )
    lines = F.replace("__text", F.lit("\n"), F.concat(F.lit("\n"), F.col("__pre")))
    return df.withColumn(
        "__out",
        F.concat("__markup", F.when(in_pre & (F.col("__pre") != "") , lines).otherwise(F.col("__text"))),
    )


def _settle(text: Column) -> Column:
    """Turn the joined pieces of a page into Markdown."""
    sub = lambda s, rx, to: F.regexp_replace(s, rx, to)
    brk, pre = f"[{_BREAKS}]", f"[{_PREFIX}]"
    s = sub(text, " {2,}", " ")
    s = sub(s, f" +({brk})", "$1")
    s = sub(s, f"({brk}{pre}*) +", "$1")
    s = sub(s, f"{BR}[ {BR}{_PREFIX}]*({brk}|\\z)", "$1")
    for start, end, mark in INLINE:
        inner = f"[^{start}{end}{_BREAKS}]"
        s = sub(s, f"{start}({inner}*)({brk}|\\z)", f"{start}$1{end}$2")
        s = sub(s, f"{start}( *){end}", "$1")
        s = sub(s, f"{start}( *)({inner}*?)( *){end}", f"$1{mark}$2{mark}$3")
    s = F.translate(s, "".join(m[0] + m[1] for m in INLINE), "")
    s = sub(
        s,
        f"{LINK}( *)([^{LINK}{LINK_MID}]*?)( *){LINK_MID}([^{LINK_END}]*){LINK_END}",
        "$1[$2]$4$3",
    )
    s = F.translate(sub(s, f"{LINK_MID}[^{LINK_END}]*{LINK_END}", ""), LINK, "")
    s = sub(s, f" *{BR}({pre}*) *", "  \n$1")
    s = sub(s, f"{BULLET_END}[ {PARA}{LINE}{QPARA}{_PREFIX}]*", "")
    s = sub(s, f"[ {PARA}{LINE}{QPARA}{_PREFIX}]*{ITEM_END}", LINE)
    s = sub(s, f"[{_PREFIX} ]+([{PARA}{LINE}{QPARA}])", "$1")
    s = sub(s, f"[{LINE}{QPARA}]*{PARA}[{PARA}{LINE}{QPARA}]*", "\n\n")
    s = sub(s, f"{LINE}*{QPARA}[{LINE}{QPARA}]*({pre}*)", "\n$1\n$1")
    s = sub(s, f"{LINE}+", "\n")
    s = F.translate(s, SPACE, " ")
    s = F.replace(F.replace(s, F.lit(INDENT), F.lit("    ")), F.lit(QUOTE), F.lit("> "))
    return content.js_trim(s)


def html_to_markdown(
    tokens: DataFrame, key: regions.Key, carry: Sequence[str] = (), out: str = "markdown"
) -> DataFrame:
    """One Markdown text per page from its tokens.

    The tokens need ``ref`` and ``parent_lang``; the columns in ``carry`` are the same on all
    tokens of a page, or null on all but one, and are kept. Pages without any token are not in the result.
    """
    df = _running(tokens, key)
    in_order = Window.partitionBy(*regions.keys(key)).orderBy("pos")
    df = df.withColumn(
        "__was_fenced", F.coalesce(F.lag("__fenced").over(in_order), F.lit(False))
    )
    df = _with_pieces(df)
    pieces = F.array_sort(F.collect_list(F.when(F.col("__out") != "", F.struct("pos", "__out"))))
    df = df.groupBy(*regions.keys(key)).agg(
        pieces.alias("__pieces"), *[F.first(c, ignorenulls=True).alias(c) for c in carry]
    )
    df = df.withColumn("__joined", F.array_join(F.col("__pieces.__out"), ""))
    return df.withColumn(out, _settle(F.col("__joined"))).drop("__pieces", "__joined")


def code_blocks(tokens: DataFrame, key: regions.Key, carry: Sequence[str] = ()) -> DataFrame:
    """One row per fenced code block: ``pos`` of its ``pre``, ``language`` and ``code``.

    The columns in ``carry`` are the same on all tokens of a page and are kept.
    """
    df = _running(tokens, key)
    tag, opens = F.col("tag"), F.col("kind") == "open"
    at = F.last(F.when(opens & (tag == "pre"), F.col("pos")), ignorenulls=True)
    lang = F.coalesce(
        F.when(F.col("__next_lang") != "", F.col("__next_lang")), F.col("parent_lang"), F.lit("")
    )
    df = df.withColumns({"__pre": at.over(regions.up_to(key)), "__language": lang})
    df = df.filter("__fenced")
    pieces = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return (
        df.groupBy(*regions.keys(key), F.col("__pre").alias("pos"))
        .agg(
            F.min(F.when(F.col("pos") == F.col("__pre"), F.col("__language"))).alias("language"),
            pieces.alias("__pieces"),
            *[F.first(c).alias(c) for c in carry],
        )
        .withColumn(
            "code", content.decode_entities(F.array_join(F.col("__pieces.text"), ""))
        )
        .drop("__pieces")
    )
