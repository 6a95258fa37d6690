"""Element regions on the token table, found with windows instead of a tree."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions import selectors

# The end of a region that is never closed: after every token of the page.
OPEN_END = 2147483647

#: The column, or columns, that tell the rows of one page from those of all others.
Key = str | Sequence[str]


def keys(key: Key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def with_regions(tokens: DataFrame, key: Key) -> DataFrame:
    """Add ``region_end`` of every opening tag, the ``level`` of each token and the ``depth``.

    An element ends at the next closing tag of its name at its own level among that name; a
    paragraph also ends where the next one starts. What is never closed lasts to the end. The level
    counts the closed elements around a token; the depth of a tag is the level of what is right inside its element.
    All windows are partitioned by the page key (and finer), so a table that is already
    partitioned by that key is not shuffled again.
    """
    tag, kind = F.col("tag"), F.col("kind")
    step = F.when(kind == "open", 1).when(kind == "close", -1).otherwise(0)
    by_tag = Window.partitionBy(*keys(key), "tag").orderBy("pos")
    level = F.sum(step).over(by_tag) + F.when(kind == "close", 1).otherwise(0)
    df = tokens.withColumn("__level", F.when(tag == "p", 0).otherwise(level))
    by_level = Window.partitionBy(*keys(key), "tag", "__level").orderBy("pos")
    closed = (F.lead("kind").over(by_level) == "close") & (kind == "open")
    opened = (F.lag("kind").over(by_level) == "open") & (kind == "close")
    df = df.withColumns(
        {
            "region_end": F.when(
                kind == "open", F.coalesce(F.lead("pos").over(by_level), F.lit(OPEN_END))
            ).when(kind == "void", F.col("pos")),
            "__nest": F.when(closed, 1).when(opened, -1).otherwise(0),
        }
    )
    in_page = Window.partitionBy(*keys(key)).orderBy("pos")
    inner = F.when(F.col("__nest") == -1, 1).otherwise(0)
    df = df.withColumn("depth", F.sum("__nest").over(in_page) + inner)
    return df.withColumn("level", F.col("depth") - F.abs("__nest")).drop("__level", "__nest")


def before(key: Key) -> Window:
    """All tokens of the page ahead of the current one."""
    return (
        Window.partitionBy(*keys(key)).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    )


def up_to(key: Key) -> Window:
    """All tokens of the page up to the current one."""
    return (
        Window.partitionBy(*keys(key))
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def whole(key: Key) -> Window:
    """All tokens of the page, in the same order as the other windows."""
    return (
        Window.partitionBy(*keys(key))
        .orderBy("pos")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )


def with_parent(df: DataFrame, key: Key, values: dict[str, Column]) -> DataFrame:
    """Add to every token what holds for the element right around it; null outside of all elements.

    ``df`` comes from :func:`with_regions`. An element stands for its content in the order of what is at
    that level: the last one that started there is the parent, also if it is never closed.
    """
    opens = F.col("kind") == "open"
    own = F.struct(F.col("level").alias("__slot"), F.lit(False).alias("__around"))
    around = F.struct(F.col("depth").alias("__slot"), F.lit(True).alias("__around"))
    rows = F.when(opens, F.array(own, around)).otherwise(F.array(own))
    df = df.select("*", F.inline(rows))
    at_level = Window.partitionBy(*keys(key), "__slot").orderBy("pos", "__around").rowsBetween(Window.unboundedPreceding, -1)
    found = F.struct(*[v.alias(n) for n, v in values.items()])
    df = df.withColumn("__parent", F.last(F.when(F.col("__around"), found), ignorenulls=True).over(at_level))
    df = df.filter(~F.col("__around")).drop("__slot", "__around")
    return df.withColumns({n: F.col(f"__parent.{n}") for n in values}).drop("__parent")


def with_selector_match(
    df: DataFrame, selector: str, key: Key, out: str = "matched", when: Column | None = None
) -> DataFrame:
    """Add a flag for the tags that open an element matching ``selector``.

    ``df`` comes from :func:`with_regions`. A descendant lies within the region of a matching
    ancestor; the parent of a child matches itself.
    """
    opens = F.col("kind").isin("open", "void")
    if when is not None:
        opens = opens & when
    chains, helpers = [], []
    for c, chain in enumerate(selectors.parse(selector)):
        flag = None
        for i, compound in enumerate(chain):
            hit = opens & selectors.tag_matches(F.col("tag"), F.col("tag_text"), compound)
            hit = F.coalesce(hit, F.lit(False))
            if flag is not None:
                name = f"__{out}_{c}_{i}"
                helpers.append(name)
                if compound.link == ">":
                    df = with_parent(df, key, {name: F.col(flag)})
                    inside = F.coalesce(F.col(name), F.lit(False))
                else:
                    df = df.withColumn(name, F.max(F.when(F.col(flag), F.col("region_end"))).over(before(key)))
                    inside = F.coalesce(F.col(name) > F.col("pos"), F.lit(False))
                hit = hit & inside
            flag = f"__{out}_{c}_{i}_hit"
            df = df.withColumn(flag, hit)
            helpers.append(flag)
        chains.append(F.col(flag))
    return df.withColumn(out, reduce(lambda a, b: a | b, chains)).drop(*helpers)


def removal_flag(configs: Sequence[rules.SiteConfig], config: Column) -> Column:
    """The tag opens an element that the page's configuration removes, by selectors without combinators."""
    tag, text = F.col("tag"), F.col("tag_text")
    flag = selectors.matches_any(tag, text, rules.NOISE_SELECTORS)
    for c in configs:
        plain, _ = selectors.split_combined(c.remove)
        flag = flag | ((config == c.key) & selectors.matches_any(tag, text, plain))
    return F.coalesce(F.col("kind").isin("open", "void") & flag, F.lit(False))


def with_removal(df: DataFrame, key: Key, configs: Sequence[rules.SiteConfig], config: Column) -> DataFrame:
    """Add ``remove``: the tag opens an element that the page's configuration removes.

    ``df`` comes from :func:`with_regions`. Only selectors with combinators need windows.
    """
    df = df.withColumn("remove", removal_flag(configs, config))
    for c in configs:
        for selector in selectors.split_combined(c.remove)[1]:
            df = with_selector_match(df, selector, key, "__hit", when=config == c.key)
            df = df.withColumn("remove", F.col("remove") | F.col("__hit")).drop("__hit")
    return df


def drop_regions(df: DataFrame, key: Key, flag: str = "remove") -> DataFrame:
    """Drop the elements whose opening tag is flagged.

    The closing tag goes with its element, but the text behind it stays, on a token without
    a tag. The first token of a page stays as an empty one, so that no page vanishes.
    """
    gone = F.max(F.when(F.col(flag), F.col("region_end"))).over(up_to(key))
    first = F.lag("pos").over(Window.partitionBy(*keys(key)).orderBy("pos")).isNull()
    df = df.withColumns({"__gone": F.coalesce(gone, F.lit(-1)), "__first": first})
    df = df.filter((F.col("__gone") <= F.col("pos")) | F.col("__first"))
    last = F.col("__gone") >= F.col("pos")
    df = df.withColumn("text", F.when(F.col("__gone") > F.col("pos"), "").otherwise(F.col("text")))
    return df.withColumns(
        {
            "kind": F.when(last, "text").otherwise(F.col("kind")),
            "tag": F.when(~last, F.col("tag")),
            "tag_text": F.when(last, "").otherwise(F.col("tag_text")),
        }
    ).drop("__gone", "__first", flag)


def cut_content(
    df: DataFrame, key: Key, config: Column, configs: Sequence[rules.SiteConfig],
    of_page: str | None = None, first: str | None = None,
) -> DataFrame:
    """Keep the tokens inside the main content of each page, see :func:`cut_to`.

    That is the first element, in document order, that matches the configuration's content
    selector; without one it is the body, without that everything behind the head.
    """
    opens, flags = F.col("kind").isin("open", "void"), []
    hit = F.lit(False)
    for i, c in enumerate(configs):
        if all(len(chain) == 1 for chain in selectors.parse(c.content)):
            one = selectors.matches_any(F.col("tag"), F.col("tag_text"), (c.content,))
            hit = hit | ((config == c.key) & opens & one)
        else:
            df = with_selector_match(df, c.content, key, f"__c{i}", when=config == c.key)
            flags.append(f"__c{i}")
            hit = hit | F.col(f"__c{i}")
    return cut_to(df.withColumn("__content", hit).drop(*flags), key, "__content", of_page, first)


def cut_to(df: DataFrame, key: Key, flag: str, of_page: str | None = None, first: str | None = None) -> DataFrame:
    """Keep the tokens inside the first flagged element; without one inside the body, without that behind the head.

    ``of_page`` is a column that one token of the page has; all tokens that stay get it. ``first`` names a flag for the first of these.
    """
    hit = F.col(flag)
    region = F.struct(F.col("pos"), F.col("region_end"))
    head = F.when((F.col("tag") == "head") & (F.col("kind") == "close"), region)
    found = F.coalesce(
        F.min(F.when(hit, region)).over(whole(key)),
        F.min(F.when((F.col("tag") == "body") & (F.col("kind") == "open"), region)).over(
            whole(key)
        ),
        F.min(head).over(whole(key)),
    )
    spread = {} if of_page is None else {of_page: F.first(of_page, ignorenulls=True).over(whole(key))}
    df = df.withColumns({"__found": found, **spread}).drop(flag)
    start = F.coalesce(F.col("__found.pos"), F.lit(-1))
    end = F.coalesce(F.col("__found.region_end"), F.lit(OPEN_END))
    df = df.withColumns({"__start": start, "__end": end}).drop("__found")
    df = df.filter((F.col("pos") >= F.col("__start")) & (F.col("pos") < F.col("__end")))
    edge = F.col("pos") == F.col("__start")
    if first is not None:
        df = df.withColumn(first, F.col("pos") == F.greatest(F.col("__start"), F.lit(0)))
    return df.withColumns(
        {
            "kind": F.when(edge, "text").otherwise(F.col("kind")),
            "tag": F.when(~edge, F.col("tag")),
            "tag_text": F.when(edge, "").otherwise(F.col("tag_text")),
        }
    ).drop("__start", "__end")


def with_code_language(df: DataFrame, key: Key) -> DataFrame:
    """Add ``parent_lang``: the language class of the element right around a ``pre``.

    It applies only inside a ``div`` with such a class; the element around the ``pre`` may be another one. Language
    labels next to the code are flagged in ``remove``; the columns of :func:`with_regions` are needed.
    """
    text, opens = F.col("tag_text"), F.col("kind") == "open"
    cls = F.when(text.contains("language-"), selectors.attribute(text, "class")).otherwise("")
    lang_div = opens & (F.col("tag") == "div") & cls.contains("language-")
    group = opens & selectors.tag_matches(
        F.col("tag"), text, selectors.Compound(".vp-code-group")
    )
    df = df.withColumns(
        {
            "__div": F.max(F.when(lang_div, F.col("region_end"))).over(before(key)),
            "__group": F.max(F.when(group, F.col("region_end"))).over(before(key)),
        }
    )
    lang = F.regexp_extract(cls, r"language-([A-Za-z0-9_]+)", 1)
    df = with_parent(df, key, {"__lang": lang, "__in_div": lang_div})
    label = opens & selectors.tag_matches(F.col("tag"), text, selectors.Compound("span.lang"))
    in_group = F.col("__group") > F.col("pos")
    in_div = F.col("__div") > F.col("pos")
    return df.withColumns(
        {
            "parent_lang": F.when(opens & (F.col("tag") == "pre") & in_div & (F.col("__lang") != ""), F.col("__lang")),
            "remove": F.coalesce(label & (F.col("__in_div") | in_group), F.lit(False)),
        }
    ).drop("__div", "__group", "__lang", "__in_div")
