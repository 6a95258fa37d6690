"""Site rules as a table: any number of configurations without a larger plan.

A rule table has the columns of ``frameworks.config_table``: ``config_key`` (a host, ``__framework__`` or the
default key), ``content_selector`` and ``remove_selectors``. Its selectors become an index per configuration, from one
telling condition of each (id, else class, else attribute, else tag) to the rest of its conditions. A page is
joined with the index of its configuration; each of its tags looks up what it has and tests only the selectors it
finds. Selectors are compounds without combinators; others raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.operators import frameworks
from pagemill.session import materialize

_NAME = r"[\w-]+"
_ATTRIBUTE = rf"""\[({_NAME})(?:(\*?=)["']?([^"'\]]*)["']?)?\]"""
_COMPOUND = rf"""\A(?:[a-zA-Z][\w-]*)?(?:\.{_NAME}|#{_NAME}|\[{_NAME}(?:\*?=["']?[^"'\]]*["']?)?\])*\z"""
# An attribute of a tag: its name, and its value with any quotes.
_HELD = r"""[\s"'/]([^\s"'/>=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""


def _conditions(selector: Column) -> Column:
    """The conditions of one compound: ``tag`` and ``attrs``, where ids and classes are tests of attributes."""
    bare = F.regexp_replace(selector, r"\[[^\]]*\]", "")
    all_of = lambda text, rx, i: F.regexp_extract_all(text, F.lit(rx), F.lit(i))

    def test(name: Column, op: Column, value: Column) -> Column:
        return F.struct(F.lower(name).alias("name"), op.alias("op"), value.alias("value"))

    classes = F.transform(all_of(bare, rf"\.({_NAME})", 1), lambda c: test(F.lit("class"), F.lit("~="), c))
    ids = F.transform(all_of(bare, rf"#({_NAME})", 1), lambda i: test(F.lit("id"), F.lit("="), i))
    parts = F.arrays_zip(*[all_of(selector, _ATTRIBUTE, i).alias(n) for i, n in ((1, "n"), (2, "o"), (3, "v"))])
    others = F.transform(parts, lambda a: test(a["n"], a["o"], a["v"]))
    tag = F.lower(F.regexp_extract(selector, r"\A([a-zA-Z][\w-]*)", 1))
    return F.struct(tag.alias("tag"), F.concat(ids, classes, others).alias("attrs"))


def _anchor(conditions: Column) -> Column:
    """What a tag must have for the selector to be looked at."""
    first = F.get(conditions["attrs"], F.lit(0))
    whole = (first["op"] == "~=") | ((first["op"] == "=") & (first["name"] == "id"))
    telling = F.when(whole, F.concat(first["name"], F.lit("="), first["value"]))
    return F.when(first.isNull(), F.concat(F.lit("<"), conditions["tag"])).otherwise(F.coalesce(telling, F.concat(F.lit("["), first["name"])))


def rule_index(table: DataFrame) -> DataFrame:
    """One row per configuration: ``config_key`` and ``rules``, a map from anchors to selectors with what they are for."""
    kinds = F.concat(
        F.transform(F.coalesce("remove_selectors", F.array().cast("array<string>")), lambda s: F.struct(s.alias("s"), F.lit("remove").alias("use"))),
        F.array(F.struct(F.col("content_selector").alias("s"), F.lit("content").alias("use"))),
    )
    noise = F.array(*[F.struct(F.lit(s).alias("s"), F.lit("remove").alias("use")) for s in rules.NOISE_SELECTORS])
    df = table.select("config_key", F.explode(F.concat(kinds, noise)).alias("r")).filter(F.col("r.s").isNotNull())
    df = df.select("config_key", F.col("r.use").alias("use"), F.explode(F.split("r.s", r",(?![^\[]*\])")).alias("s"))
    text = F.btrim(F.col("s"))
    bad = ~text.rlike(_COMPOUND) | (text == "")
    checked = F.when(bad, F.raise_error(F.concat(F.lit("unsupported selector: "), text)).cast("string")).otherwise(text)
    df = df.withColumn("c", _conditions(checked)).withColumn("anchor", _anchor(F.col("c")))
    # A configuration is one row of rules that people wrote, so its selectors are few.
    rule = F.struct(F.col("use"), F.col("c.tag").alias("tag"), F.col("c.attrs").alias("attrs"))
    df = df.groupBy("config_key", "anchor").agg(F.collect_set(rule).alias("rules"))
    entries = F.collect_list(F.struct("anchor", "rules"))
    return df.groupBy("config_key").agg(F.map_from_entries(entries).alias("rules"))


def with_rules(pages: DataFrame, table: DataFrame, html: str = "html", host: str = "host") -> DataFrame:
    """Add ``config_key`` and ``rules``: those of the host, else of the detected framework, else the default; and ``framework``.

    ``pages`` has ``html`` and ``host``. Spark chooses the join with the hosts by the measured size of the index; only the rules of
    frameworks and the default, a handful of rows, are broadcast by hint.
    """
    index = materialize(rule_index(table))
    names = [rules.DEFAULT_KEY, *dict.fromkeys(f"__{f.framework}__" for f in rules.FRAMEWORK_RULES)]
    general = F.broadcast(index.filter(F.col("config_key").isin(*names)))
    as_ = lambda df, name: df.select(F.col("config_key").alias(f"__{name}"), F.col("rules").alias(f"__{name}_rules"))
    df = frameworks.detect_framework(pages, html)
    sure = F.col("score") >= rules.MIN_CONFIDENCE * rules.FULL_SCORE
    detected = F.when(sure, F.concat(F.lit("__"), F.col("framework"), F.lit("__")))
    df = df.withColumns({"__fw": detected, "__default": F.lit(rules.DEFAULT_KEY)}).drop("score", "confidence")
    df = df.join(as_(index, "host"), F.col(host) == F.col("__host"), "left")
    df = df.join(as_(general, "found"), F.col("__fw") == F.col("__found"), "left")
    df = df.join(as_(general, "rest"), F.col("__default") == F.col("__rest"), "left")
    order = ("host", "found", "rest")
    out = {"config_key": F.coalesce(*[F.col(f"__{n}") for n in order]), "rules": F.coalesce(*[F.col(f"__{n}_rules") for n in order])}
    return df.withColumns(out).drop("__fw", "__default", *[f"__{n}" for n in order], *[f"__{n}_rules" for n in order])


def _test(attrs: Column, test: Column) -> Column:
    """A tag with these attributes passes one test of a selector."""

    def passes(a: Column) -> Column:
        words = F.split(a["value"], r"\s+")
        value = (
            F.when(test["op"] == "", True)
            .when(test["op"] == "=", a["value"] == test["value"])
            .when(test["op"] == "~=", F.array_contains(words, test["value"]))
            .otherwise(F.contains(a["value"], test["value"]))
        )
        return (a["name"] == test["name"]) & value

    return F.exists(attrs, passes)


def with_flags(tokens: DataFrame) -> DataFrame:
    """Add ``remove`` and ``is_content`` to tokens that carry the ``rules`` of their page, and drop the rules.

    A tag looks up its name, its attributes, its id and each of its classes; only selectors with one of them are tested.
    """
    text, opens = F.col("tag_text"), F.col("kind").isin("open", "void")
    found = lambda i: F.regexp_extract_all(text, F.lit(_HELD), F.lit(i))
    pair = F.arrays_zip(found(1).alias("n"), found(2).alias("v"))
    unquoted = lambda v: F.regexp_replace(v, r"""(?s)\A["']|["']\z""", "")
    attrs = F.transform(pair, lambda a: F.struct(F.lower(a["n"]).alias("name"), unquoted(a["v"]).alias("value")))
    none = F.array().cast("array<struct<name:string,value:string>>")
    df = tokens.withColumn("__attrs", F.when(opens & text.rlike(r"\s"), attrs).otherwise(none))

    def anchors(a: Column) -> Column:
        parts = F.when(a["name"] == "class", F.split(a["value"], r"\s+")).when(a["name"] == "id", F.array(a["value"])).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array(F.concat(F.lit("["), a["name"])), F.transform(parts, lambda p: F.concat(a["name"], F.lit("="), p)))

    own = F.concat(F.array(F.concat(F.lit("<"), F.col("tag"))), F.flatten(F.transform("__attrs", anchors)))
    df = df.withColumn("__anchors", F.when(opens, F.array_distinct(own)))
    looked = F.flatten(F.transform(F.filter("__anchors", lambda a: F.map_contains_key("rules", a)), lambda a: F.try_element_at("rules", a)))
    df = df.withColumn("__rules", looked)

    def hit(use: str) -> Column:
        def matches(r: Column) -> Column:
            return (r["use"] == use) & ((r["tag"] == "") | (r["tag"] == F.col("tag"))) & F.forall(r["attrs"], lambda t: _test(F.col("__attrs"), t))

        return F.coalesce(F.exists("__rules", matches), F.lit(False))

    return df.withColumns({"remove": hit("remove"), "is_content": hit("content")}).drop("__attrs", "__anchors", "__rules", "rules")
