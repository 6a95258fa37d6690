"""URL columns made of built-in functions.

A page URL is handled as parts: scheme, host, port and path, each cut out by one regular
expression. :func:`with_url_parts` adds them as real columns, so that later steps name a
part instead of repeating the expression that makes it. Host names are taken as ASCII;
IPv6 literals, user names and non-ASCII hosts make a URL invalid rather than wrong.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions.let import let, once

_URL = r"(?is)\A(https?):[/\\]*([^/?#\\]*)([^?#]*)(\?[^#]*)?(#.*)?\z"
_CUT = "\x1f"
_AUTHORITY = r"\A[a-z0-9_.~!$&'()*+,;=-]+(?::\d{0,5})?\z"
_CONTROLS = "".join(chr(c) for c in range(33))
# Characters that a path, a query or a fragment keeps as they are; all others are escaped.
_PATH_KEPT = r"\x21\x23-\x3B\x3D\x3F-\x5D\x5F\x61-\x7A\x7C\x7E"
_QUERY_KEPT = r"\x21\x24-\x26\x28-\x3B\x3D\x3F-\x7E"
_FRAGMENT_KEPT = r"\x21\x23-\x3B\x3D\x3F-\x5F\x61-\x7E"
# What url_encode escapes although a URL keeps it. "%" comes last.
_RESTORED = "!\"#$&'()+,/:;<=>?@[\\]^`{|}~%"
_DOTS = r"(?i)/(?:\.|%2e){1,2}(?:/|\z)"


def trimmed(u: Column) -> Column:
    """The URL text without outer blanks and without line breaks and tabs inside."""
    t = F.btrim(u, F.lit(_CONTROLS))
    broken = t.contains("\n") | t.contains("\r") | t.contains("\t")
    return F.when(broken, F.translate(t, "\t\n\r", "")).otherwise(t)


def _escape(text: Column, kept: str) -> Column:
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for ch in _RESTORED:
        if _is_kept(ch, kept):
            encoded = F.replace(encoded, F.lit(f"%{ord(ch):02X}"), F.lit(ch))
    return F.when(text.rlike(f"[^{kept}]"), encoded).otherwise(text)


def _is_kept(ch: str, kept: str) -> bool:
    return re.fullmatch(f"[{kept}]", ch) is not None


def escape_path(path: Column) -> Column:
    """Percent-encode what a path may not hold; backslashes count as slashes."""
    slashed = F.when(path.contains("\\"), F.translate(path, "\\", "/")).otherwise(path)
    return _escape(slashed, _PATH_KEPT)


def fold_dots(path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""
    dot = F.array(*[F.lit(x) for x in (".", "%2e")])
    dots = F.array(*[F.lit(x) for x in ("..", ".%2e", "%2e.", "%2e%2e")])
    segments = F.slice(F.split(path, "/"), 2, F.size(F.split(path, "/")))
    folded = F.aggregate(
        segments,
        F.lit(""),
        lambda acc, s: F.when(
            F.array_contains(dots, F.lower(s)), F.regexp_replace(acc, r"/[^/]*\z", "")
        )
        .when(F.array_contains(dot, F.lower(s)), acc)
        .otherwise(F.concat(acc, F.lit("/"), s)),
    )
    ends_in_dots = path.rlike(r"(?i)/(?:\.|%2e){1,2}\z")
    return F.when(
        (path.contains("/.") | path.contains("/%2")) & path.rlike(_DOTS),
        F.when(ends_in_dots | (folded == ""), F.concat(folded, F.lit("/"))).otherwise(folded),
    ).otherwise(path)


def with_url_parts(df: DataFrame, url: str, prefix: str = "") -> DataFrame:
    """Add ``scheme, host, port, path`` of an absolute http(s) URL, null when invalid.

    ``port`` is empty for the default port of the scheme; ``path`` is escaped and free of
    dot segments. Query and fragment are added as ``query`` and ``fragment``, unescaped.
    """
    p = prefix
    cut, authority = f"{p}__cut", f"{p}__auth"
    named = {"auth": authority}
    df = df.withColumn(cut, _cut(F.col(url)))
    df = df.withColumns({named.get(n, f"{p}{n}"): c for n, c in _pieces(F.col(cut)).items()})
    df = df.withColumns({f"{p}{n}": c for n, c in _located(F.col(authority), F.col(f"{p}path")).items()})
    scheme, port = F.col(f"{p}scheme"), F.col(f"{p}port")
    keep = lambda name: F.when(F.col(f"{p}__ok"), F.col(f"{p}{name}"))
    df = df.withColumns({f"{p}__ok": _is_valid(scheme, F.col(authority), port), f"{p}port": _own_port(scheme, port)})
    return let(df, {f"{p}{n}": keep(n) for n in PARTS}).drop(cut, authority, f"{p}__ok")


#: The parts of a URL.
PARTS = ("scheme", "host", "port", "path", "query", "fragment")


def _cut(url: Column) -> Column:
    """One match for all parts: they are put side by side with a separator and split again."""
    side_by_side = F.regexp_replace(
        F.translate(trimmed(url), _CUT, ""), _URL, _CUT.join(f"${i}" for i in range(1, 6))
    )
    return F.split(side_by_side, _CUT)


def _pieces(cut: Column) -> dict[str, Column]:
    part = lambda i: F.get(cut, F.lit(i))
    return {
        "scheme": F.when(F.size(cut) == 5, F.lower(part(0))),
        "auth": F.lower(part(1)),
        "path": escape_path(part(2)),
        "query": part(3),
        "fragment": part(4),
    }


def _located(authority: Column, path: Column) -> dict[str, Column]:
    return {
        "host": F.split_part(authority, F.lit(":"), F.lit(1)),
        "port": F.when(authority.contains(":"), F.regexp_extract(authority, r":(\d+)\z", 1)).otherwise(""),
        "path": F.when(path == "", "/").otherwise(fold_dots(path)),
    }


def _is_valid(scheme: Column, authority: Column, port: Column) -> Column:
    valid = (
        scheme.isNotNull()
        & authority.rlike(_AUTHORITY)
        & (F.when(port == "", 0).otherwise(port.try_cast("int")) <= 65535)
    )
    return F.coalesce(valid, F.lit(False))


def _own_port(scheme: Column, port: Column) -> Column:
    default_port = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    return F.when(default_port, "").otherwise(port)


def _url_parts(url: Column) -> Column:
    """What :func:`with_url_parts` adds, as one struct within an expression; null when invalid."""

    def found(p: Column) -> Column:
        located = {"scheme": p["scheme"], "auth": p["auth"], "query": p["query"], "fragment": p["fragment"], **_located(p["auth"], p["path"])}
        return once(F.struct(*[c.alias(n) for n, c in located.items()]), checked)

    def checked(p: Column) -> Column:
        out = {n: p[n] for n in PARTS} | {"port": _own_port(p["scheme"], p["port"])}
        return F.when(_is_valid(p["scheme"], p["auth"], p["port"]), F.struct(*[c.alias(n) for n, c in out.items()]))

    return once(_cut(url), lambda cut: once(F.struct(*[c.alias(n) for n, c in _pieces(cut).items()]), found))


def _origin(part: Callable[[str], Column]) -> Column:
    port = part("port")
    return F.concat(
        part("scheme"),
        F.lit("://"),
        part("host"),
        F.when(port == "", "").otherwise(F.concat(F.lit(":"), port)),
    )


def origin(prefix: str = "") -> Column:
    """Scheme, host and port of the parts made by :func:`with_url_parts`."""
    return _origin(lambda name: F.col(f"{prefix}{name}"))


def normalized(prefix: str = "") -> Column:
    """The page URL: no query, no fragment, trailing slash kept."""
    return F.concat(origin(prefix), F.col(f"{prefix}path"))


def _complete(part: Callable[[str], Column]) -> Column:
    """The whole URL, query and fragment escaped."""
    return F.concat(_origin(part), part("path"), _escape(part("query"), _QUERY_KEPT), _escape(part("fragment"), _FRAGMENT_KEPT))


def key_path(path: Column) -> Column:
    """The path without one trailing slash, unless it is the root."""
    short = F.left(path, F.length(path) - 1)
    return F.when((path != "/") & path.endswith("/"), short).otherwise(path)


def key(prefix: str = "") -> Column:
    """The key under which a page is visited once."""
    return F.concat(origin(prefix), key_path(F.col(f"{prefix}path")))


def with_url_key(df: DataFrame, url: str = "url", out: str = "url_key") -> DataFrame:
    """Add the dedup key of a URL column; null for what is no http(s) URL."""
    parts = ("scheme", "host", "port", "path", "query", "fragment")
    return (
        let(with_url_parts(df, url, "_k_"), {out: key("_k_")}).drop(*[f"_k_{n}" for n in parts])
    )


def url_error(url: Column, host: Column) -> Column:
    """The reason why a URL is refused, null when it is accepted (``host`` from the parts)."""
    scheme = F.lower(F.regexp_extract(trimmed(url), r"\A([A-Za-z][A-Za-z0-9+.-]*:)", 1))
    return F.when(
        (scheme != "") & ~scheme.isin("http:", "https:"),
        F.concat(
            F.lit("Unsupported URL scheme: "), scheme, F.lit(" (only http/https allowed)")
        ),
    ).when(host.isNull(), F.concat(F.lit("Invalid URL: "), url))


def base_path(path: Column, words: Sequence[str] = rules.DOC_WORDS) -> Column:
    """``/<segment>/`` for the first path segment that is a documentation word, else null."""
    found = F.regexp_extract(path, rf"(?i)/({'|'.join(words)})(?:/|\z)", 1)
    return F.when(found != "", F.concat(F.lit("/"), found, F.lit("/")))


def host_matches(host: Column, domains: Sequence[str]) -> Column:
    """The host is one of the domains or below one of them."""
    tests = [(host == d) | host.endswith(f".{d}") for d in domains]
    return reduce(lambda a, b: a | b, tests)


def md_path(path: Column, keep_mdx: bool = False) -> Column:
    """The path of the Markdown file next to a page."""
    done = path.endswith(".md")
    if keep_mdx:
        done = done | path.endswith(".mdx")
    return (
        F.when(done, path)
        .when(path == "/", "/.md")
        .otherwise(F.concat(F.regexp_replace(path, r"/\z", ""), F.lit(".md")))
    )


def md_url(prefix: str = "", keep_mdx: bool = False) -> Column:
    """The Markdown URL of a page; its query stays, its fragment too."""
    return F.concat(
        origin(prefix),
        md_path(F.col(f"{prefix}path"), keep_mdx),
        _escape(F.col(f"{prefix}query"), _QUERY_KEPT),
        _escape(F.col(f"{prefix}fragment"), _FRAGMENT_KEPT),
    )


def with_resolved(df: DataFrame, base: str, raw: str, prefix: str = "to_") -> DataFrame:
    """Resolve the reference ``raw`` against the parts under the prefix ``base``.

    Adds ``url`` (complete), ``scheme, host, port, path`` under ``prefix``; all null when
    the result is no URL. A reference with another scheme keeps its text as ``url`` and has
    an empty host.
    """
    p = prefix
    b = lambda n: F.col(f"{base}{n}")
    df = df.withColumn(f"{p}__r", trimmed(F.col(raw)))
    df = df.withColumn(f"{p}__abs", _absolute(b, F.col(f"{p}__r")))
    df = with_url_parts(df, f"{p}__abs", p)
    is_other = F.when(b("host").isNotNull() & F.col(f"{p}__abs").isNull(), F.col(f"{p}__r"))
    full = _complete(lambda n: F.col(f"{p}{n}"))
    return let(df, {f"{p}url": F.coalesce(full, is_other)}).drop(f"{p}__r", f"{p}__abs")


def _absolute(b: Callable[[str], Column], r: Column) -> Column:
    """A reference as an absolute URL, not yet taken apart; null where it is none."""
    absolute = r.rlike(r"(?i)\Ahttps?:")
    other = r.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:") & ~absolute
    folder = F.regexp_extract(b("path"), r"(?s)\A(.*/)", 1)
    return (
        F.when(b("host").isNull() | other, F.lit(None))
        .when(absolute, r)
        .when(r.rlike(r"\A[/\\]{2}"), F.concat(b("scheme"), F.lit(":"), r))
        .when(r.rlike(r"\A[/\\]"), F.concat(_origin(b), r))
        .when(r == "", F.concat(_origin(b), b("path"), b("query")))
        .when(r.startswith("?"), F.concat(_origin(b), b("path"), r))
        .when(r.startswith("#"), F.concat(_origin(b), b("path"), b("query"), r))
        .otherwise(F.concat(_origin(b), folder, r))
    )


def resolved(base: str, raw: Column) -> Column:
    """The ``url`` of :func:`with_resolved` as an expression, for rows of which few hold a reference: the others cost one test.

    As columns, the steps run for every row, and their code is so long that the JVM interprets it.
    """
    b = lambda n: F.col(f"{base}{n}")

    def complete(r: Column, a: Column, to: Column) -> Column:
        return F.coalesce(_complete(lambda n: to[n]), F.when(b("host").isNotNull() & a.isNull(), r))

    url = once(trimmed(raw), lambda r: once(_absolute(b, r), lambda a: once(_url_parts(a), lambda to: complete(r, a, to))))
    return F.when(raw.isNotNull(), url)
