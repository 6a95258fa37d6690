"""Text columns: content checks, Markdown clean-up, entity decoding and escaping."""

from __future__ import annotations

from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill import rules

_SPACE = f"[{rules.JS_SPACE}]"


def js_trim(text: Column) -> Column:
    """Trim every kind of white space, no-break space included."""
    return F.btrim(text, F.lit(rules.JS_SPACE_CHARS))


def _contains_any(text: Column, markers: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(m) for m in markers])


def blocked_reason(markdown: Column, strict_access_denied: bool = False) -> Column:
    """Why a page counts as blocked, null when it does not; the first hit wins."""
    short = F.length(js_trim(markdown)) < 100
    ends = [p.replace(r"\z", rf"{_SPACE}*\z") for p in rules.BOT_PATTERNS]
    bot = rf"(?i)\A{_SPACE}*(?:{'|'.join(ends)})"
    denied = _contains_any(markdown, rules.ACCESS_DENIED_MARKERS)
    if strict_access_denied:
        denied = denied & short
    return (
        F.when(~markdown.rlike(f"[^{rules.JS_SPACE}]"), "empty")
        .when(_contains_any(markdown, rules.CLOUDFLARE_MARKERS), "cloudflare")
        .when(denied, "access-denied")
        .when(F.when(short, markdown.rlike(bot)).otherwise(F.lit(False)), "bot-detection")
    )


def blocked_advice(reason: Column) -> Column:
    """What to try for a blocked page; null for a page that is not blocked."""
    known = reduce(
        lambda acc, row: acc.when(reason == row[0], row[1]),
        rules.BLOCKED_ADVICE[1:],
        F.when(reason == rules.BLOCKED_ADVICE[0][0], rules.BLOCKED_ADVICE[0][1]),
    )
    return F.when(reason.isNotNull(), known.otherwise(rules.DEFAULT_ADVICE))


def _is_ok(status: Column) -> Column:
    return F.coalesce(status.between(200, 299), F.lit(False))


def _fetch_failed(status: Column, url: Column) -> Column:
    return F.concat(F.lit("Fetch failed: "), status.cast("string"), F.lit(" "), url)


def md_endpoint_error(status: Column, content_type: Column, body: Column, url: Column) -> Column:
    """Why a response is not the Markdown of a page, null when it is."""
    body = F.coalesce(body, F.lit(""))
    kind = F.coalesce(content_type, F.lit(""))
    return (
        F.when(~_is_ok(status), _fetch_failed(status, url))
        .when(kind.contains("application/json"), "Received JSON instead of Markdown")
        .when(
            kind.contains("text/html") & ~kind.contains("text/markdown"),
            "Received HTML instead of Markdown (Content-Type)",
        )
        .when(
            body.rlike(rf"(?i)\A{_SPACE}*<(?:!doctype|html|head|body)"),
            "Received HTML instead of Markdown",
        )
        .when(body.rlike(rf"\A{_SPACE}*[{{\[]"), "Received JSON instead of Markdown")
        .when(F.length(js_trim(body)) < 10, "Response too short to be valid Markdown")
    )


def mdx_error(status: Column, body: Column, url: Column) -> Column:
    """Why a response is not the MDX source of a page, null when it is."""
    return F.when(~_is_ok(status), _fetch_failed(status, url)).when(
        js_trim(body).rlike(r"(?i)\A<!doctype"), "HTML returned, not markdown"
    )


def reader_error(status: Column, body: Column, status_text: Column | None = None) -> Column:
    """Why a reader service's response is of no use, null when it is."""
    text = F.lit("") if status_text is None else status_text
    failed = F.concat(F.lit("Jina Reader error: "), status.cast("string"), F.lit(" "), text)
    return F.when(~_is_ok(status), failed).when(
        js_trim(F.coalesce(body, F.lit(""))) == "", "Jina Reader returned empty content"
    )


def page_error(reason: Column, host: Column) -> Column:
    """The message for a blocked page, null when it is not blocked."""
    return (
        F.when(reason == "empty", F.concat(F.lit("Empty content extracted from "), host))
        .when(reason == "cloudflare", F.concat(F.lit("Cloudflare protection detected on "), host))
        .when(reason == "access-denied", F.concat(F.lit("Access denied on "), host))
        .when(
            reason == "bot-detection",
            F.concat(F.lit("Content blocked by "), host, F.lit(" (bot detection)")),
        )
    )


def clean_footer(markdown: Column) -> Column:
    """Delete the footer texts that sites repeat on every page, rule by rule."""
    cleaned = reduce(lambda md, rule: F.regexp_replace(md, rule, ""), rules.FOOTER_RULES, markdown)
    return F.when(markdown.rlike(rules.FOOTER_HINT), cleaned).otherwise(markdown)


def fix_headings(markdown: Column) -> Column:
    """Join a heading mark with the text that an anchor line split from it."""
    return F.regexp_replace(
        markdown, rf"(?m)^(#{{2,}}){_SPACE}*\n\n\[\]\(#[^)]+\)\n\n(.+)$", "$1 $2"
    )


def collapse_blank(markdown: Column) -> Column:
    """At most one empty line in a row, none at the ends."""
    return js_trim(F.regexp_replace(markdown, r"\n{3,}", "\n\n"))


def clean_markdown(markdown: Column) -> Column:
    return collapse_blank(fix_headings(clean_footer(markdown)))


#: Characters of all named references, and the names that count without a semicolon, too: HTML's own table.
_NAMED = {name[:-1]: text for name, text in html5.items() if name.endswith(";")}
_BARE = sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True)


def decode_entities(text: Column, attribute: bool = False) -> Column:
    """Decode all named and numeric references, each once: what comes out starts no second one.

    A name without its semicolon is decoded in text only, where the longest name that fits counts; in an ``attribute`` it is a part of an address.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?s)(&#[xX][0-9a-fA-F]+;|&#[0-9]+;|&[a-zA-Z][a-zA-Z0-9]*;?|&|[^&]+)"), F.lit(1))
    # One constant, folded into a map when the plan is made.
    names = F.str_to_map(F.lit("\x1e".join(f"{n}\x1f{t}" for n, t in _NAMED.items())), F.lit("\x1e"), F.lit("\x1f"))

    def named(piece: Column) -> Column:
        known = F.try_element_at(names, F.regexp_extract(piece, r"\A&([a-zA-Z][a-zA-Z0-9]*);\z", 1))
        if attribute:
            return F.coalesce(known, piece)
        bare = F.regexp_extract(piece, rf"\A&({'|'.join(_BARE)})", 1)
        rest = F.substr(piece, F.length(bare) + 2)
        return F.coalesce(known, F.when(bare != "", F.concat(F.try_element_at(names, bare), rest)), piece)

    def decoded(piece: Column) -> Column:
        return F.when(piece.startswith("&#"), _numeric(piece)).when(piece.rlike(r"\A&[a-zA-Z]"), named(piece)).otherwise(piece)

    return F.when(text.contains("&"), F.array_join(F.transform(pieces, decoded), "")).otherwise(text)


def _numeric(piece: Column) -> Column:
    hexa = F.regexp_extract(piece, r"\A&#[xX]([0-9a-fA-F]+);", 1)
    # Leading zeros mean nothing; a number too long for an int is no character.
    digits = F.regexp_extract(piece, r"\A&#0*([0-9]+);", 1)
    hexa = F.regexp_replace(hexa, r"\A0+(?=.)", "")
    code = F.when((hexa != "") & (F.length(hexa) <= 7), F.conv(hexa, 16, 10)).when(hexa == "", digits).try_cast("int")
    windows = F.array(*map(F.lit, rules.WINDOWS_1252))
    code = F.when(code.between(128, 159), F.get(windows, code - 128)).otherwise(code)
    as_hex = lambda c: F.lpad(F.hex(c), 4, "0")
    utf16 = F.when(code < 0x10000, as_hex(code)).otherwise(
        F.concat(
            as_hex(F.lit(0xD800) + F.shiftright(code - 0x10000, 10)),
            as_hex(F.lit(0xDC00) + (code - 0x10000).bitwiseAND(0x3FF)),
        )
    )
    usable = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    # Control characters mark structure in what follows; decoded ones go.
    control = (code < 32) & ~code.isin(9, 10, 13)
    return F.when(control, "").when(usable, F.decode(F.unhex(utf16), "UTF-16BE")).otherwise(piece)


def escape_markdown(text: Column) -> Column:
    """Put a backslash before what Markdown would read as markup."""
    inline = F.regexp_replace(text, r"([\\*`\[\]_])", r"\\$1")
    start = F.regexp_replace(inline, r"\A(-|\+ |=+|#{1,6} |~~~|>)", r"\\$1")
    numbered = F.regexp_replace(start, r"\A(\d+)\. ", r"$1\\. ")
    return F.when(text.rlike(r"[\\*`\[\]_]|\A(?:[-=>]|\+ |#|~~~|\d)"), numbered).otherwise(text)
