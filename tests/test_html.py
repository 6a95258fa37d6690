"""Golden pages: tokens, regions, detection, Markdown."""

import pytest
from pyspark.sql import functions as F

from pagemill import rules
from pagemill.functions import content, selectors
from pagemill.operators import frameworks, markdown, regions, tokens
from pagemill.plans import pages as plan


def pages(spark, *htmls, url="https://e.com/docs/a/b"):
    return spark.createDataFrame([(i, url, h) for i, h in enumerate(htmls)], "page_id int, url string, html string")


def to_md(spark, *htmls, **kw):
    wrapped = [f"<html><head><title>t</title></head><body><main>{h}</main></body></html>" for h in htmls]
    out = plan.pages_to_markdown(pages(spark, *wrapped, **kw)).collect()
    return [r.markdown for r in sorted(out, key=lambda r: r.page_id)]


MARKDOWN = [
    ("<h1>A</h1><h2>B</h2><h6>F</h6>", "# A\n\n## B\n\n###### F"),
    ("<p>a <b>b</b> <i>c</i> <del>d</del></p>", "a **b** _c_ ~d~"),
    ("<p>a <b>bold </b>b</p>", "a **bold** b"),
    ("<p>x<strong></strong>y</p>", "xy"),
    ("<p><b>T<br><p>u", "**T**\n\nu"),
    ("a<br>b", "a  \nb"),
    ("<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>", "-   a\n-   b\n    -   c"),
    ("<ul><li>a<li>b</ul>x", "-   a\n-   b\n\nx"),
    ("<ol><li>a</li><li>b</li></ol>", "1.  a\n2.  b"),
    ('<ol start="9"><li>a</li><li>b</li></ol>', "9.  a\n10.  b"),
    ("<ul><li><p>a</p><p>b</p></li></ul>", "-   a\n\n    b"),
    ('<a href="/x">t</a> <a href="y(1)" title="q">u</a>', "[t](https://e.com/x) [u](https://e.com/docs/a/y\\(1\\) \"q\")"),
    ('<a href="#s">t</a> <a>n</a>', "[t](#s) n"),
    ('<img src="i.png" alt="A"><img alt="no">', "![A](https://e.com/docs/a/i.png)"),
    ('<pre><code class="language-py">a_b\n  *c*</code></pre>', "```py\na_b\n  *c*\n```"),
    ("<pre><code>x &lt; y</code></pre>", "```\nx < y\n```"),
    ('<div class="language-js x"><span class="lang">js</span><pre><code>a</code></pre></div>', "```js\na\n```"),
    ("<p>use <code>a_b</code> or <code>c`d</code></p>", "use `a_b` or ``c`d``"),
    ("<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>", "| A | B |\n| --- | --- |\n| 1 | 2 |"),
    ('<ul><li><input type="checkbox" checked> x</li><li><input type="checkbox"> y</li></ul>', "-   [x] x\n-   [ ] y"),
    ("<blockquote><p>a</p><p>b</p></blockquote>", "> a\n> \n> b"),
    ("<p>a</p><hr><p>b</p>", "a\n\n* * *\n\nb"),
    ("<p>5 &lt; 6 &amp;amp; &copy; &#8364; &#x1F600;</p>", "5 < 6 &amp; © € 😀"),
    ("<p>a * b _c_ [d] `e` \\</p>", "a \\* b \\_c\\_ \\[d\\] \\`e\\` \\\\"),
    ("<p>- x</p><p>1. y</p><p># z</p>", "\\- x\n\n1\\. y\n\n\\# z"),
    ("a < b <p>c</p>", "a < b\n\nc"),
    ("<p>a<script>var x = '<p>';</script><style>p{}</style><!-- <p>c --> b</p>", "a b"),
    ("<h2><div><a href='#q'></a></div>Head</h2>", "## Head"),
]


def test_markdown(spark):
    got = to_md(spark, *[m[0] for m in MARKDOWN])
    for (html, expected), md in zip(MARKDOWN, got):
        assert md == expected, html


def test_regions(spark):
    cases = [
        ("<body><nav>a<nav>b</nav>c</nav>d</body>", "d"),
        ("<body>x<main>a<aside>b</aside>c<footer>d</footer></main>y</body>", "ac"),
        ("<body><nav><main>in</main></nav><article>out</article></body>", "out"),
        ("<body><article>one</article><main>two</main></body>", "one"),
        ("<html><head><title>t</title></head>a<p>b", "a\n\nb"),
        ("<body><main>a<nav>cut", "a"),
        ('<body><div class="x sidebar y">s<div>t</div></div>k<div class="sidebars">m</div></body>', "k\n\nm"),
        ('<body><div role="banner">s</div><div role=\'navigation\'>t</div>k</body>', "k"),
    ]
    out = plan.pages_to_markdown(pages(spark, *[c[0] for c in cases])).collect()
    got = {r.page_id: r.markdown for r in out}
    for i, (html, expected) in enumerate(cases):
        assert got[i] == expected, html


def test_long_page_is_whole(spark):
    """No text is cut and nothing recurses, however long a page is."""
    body = "<p>" + "<b>w</b> x &lt; y < z " * 30000 + "</p><pre><code>" + "a < b\n" * 20000 + "</code></pre>"
    md = to_md(spark, body)[0]
    assert md.count("**w**") == 30000 and md.count("a < b") == 20000


DETECT = [
    ('<div class="theme-doc-markdown">', "docusaurus", 10),
    ('<div class="vp-doc"><div class="VPNav">', "vitepress", 20),
    ("<div data-starlight>", "starlight", 15),
    ('<div data-md-component="x">', "mkdocs", 10),
    ('<div id="furo-main-content">', "sphinx", 10),
    ('<div data-testid="table-of-contents">', "gitbook", 10),
    ("<p>plain", "custom", 0),
    ('<div class="md-nav document">', "mkdocs", 10),
    ("<p>made with vitepress", "vitepress", 5),
    ('<p>class="vp-doc"', "custom", 0),
    ('<!-- <div class="vp-doc"> -->', "custom", 0),
    ('<a href="https://gitbook.com/"><a href="x?utm_source">', "gitbook", 5),
    ('<a href="https://gitbook.com/?utm_source=a">', "gitbook", 15),
]


def test_detection(spark):
    df = frameworks.detect_framework(pages(spark, *[d[0] for d in DETECT]))
    for r in df.collect():
        assert (r.framework, r.score) == DETECT[r.page_id][1:], DETECT[r.page_id]
        assert r.confidence == pytest.approx(min(r.score / 30, 1), abs=1e-4)


def test_effective_config(spark):
    rows = [
        (0, "docs.x.ai", '<div class="vp-doc">', "docs.x.ai"),
        (1, "e.com", '<div class="vp-doc">', "__vitepress__"),
        (2, "e.com", "vitepress", "__default__"),
    ]
    df = spark.createDataFrame(rows, "page_id int, host string, html string, expected string")
    for r in frameworks.with_effective_config(df).collect():
        assert r.config_key == r.expected


def test_signals_need_their_hints():
    """The words tried first are in every text that a pattern can match."""
    samples = {
        "docusaurus": ["Docusaurus", '<meta name=generator content="Docusaurus">', "/@docusaurus/", "docusaurus.config"],
        "vitepress": ["VitePress", '<meta generator VitePress', "vitepress.css", "__VP_"],
        "starlight": ["starlight", "<meta generator Astro", "Starlight", "@astrojs/starlight"],
        "mkdocs": ["MkDocs", "<meta generator mkdocs", "materialformkdocs", "mkdocs.yml"],
        "sphinx": ["Sphinx", "<meta generator Sphinx", "sphinx_rtd_theme", "_static/sphinx", "pradyunsg/furo", "furo.css", "Made with Sphinx"],
        "gitbook": ["GitBook", "app.gitbook.com", "gitbook-x-reason", "Powered by GitBook", "gitbook.io"],
    }
    import re

    for rule in rules.FRAMEWORK_RULES:
        for rx, text in zip(rule.html, samples[rule.framework], strict=True):
            assert re.search(rx, text), (rx, text)
            assert any(h in text.lower() for h in rule.hints)


def test_tokens_are_lossless(spark):
    html = "lead<p a='>'>x < y<b>z</b><!-- <i> --><script>if (a<b) {}</script>t<br/>u <"
    df = tokens.html_tokens(pages(spark, html)).orderBy("pos").collect()
    assert "".join(r.tag_text + r.text for r in df) == html
    assert [(r.kind, r.tag) for r in df if r.tag] == [
        ("open", "p"), ("open", "b"), ("close", "b"), ("void", "script"), ("void", "br"),
    ]


def test_selectors(spark):
    html = '<div class="a b"><p class="b" id="i" data-x="1">t<span>u</span></p></div><p>v</p>'
    df = plan.page_tokens(pages(spark, html))
    counts = {
        "p": 2, ".b": 2, "div.b": 1, "#i": 1, "[data-x]": 1, '[data-x="1"]': 1, '[data-x="2"]': 0,
        '[class*="a"]': 1, "div p": 1, "div > p": 1, "div > span": 0, "div span, .a": 2, "p.a": 0,
    }
    for s, n in counts.items():
        got = regions.with_selector_match(df, s, "page_id", "m").filter("m").count()
        assert got == n, s
    for bad in ("p:first-child", "p + p", "*", "[a^=b]"):
        with pytest.raises(ValueError):
            selectors.parse(bad)


def test_code_blocks(spark):
    html = '<body><main><pre><code class="language-py">a\n<b>b</b></code></pre><pre>no</pre></main></body>'
    rows = markdown.code_blocks(plan.main_tokens(pages(spark, html)), "page_id").collect()
    assert [(r.language, r.code) for r in rows] == [("py", "a\nb")]


def test_blocked(spark):
    long = "x" * 120
    rows = [
        ("  ", "empty"), ("\xa0\n", "empty"), ("a cf_chl_opt b", "cloudflare"), ("Cloudflare Ray ID: 1", "cloudflare"),
        (long + "403 Forbidden", "access-denied"), ("Access Denied", "access-denied"), ("access denied", "bot-detection"),
        ("Just a moment...", "bot-detection"), ("\xa0Just a moment.. ", "bot-detection"), ("Just a moment....", None),
        ("waiting for e.com to respond", "bot-detection"), ("Attention Required! x", "bot-detection"),
        ("Please complete the security check" + long, None), ("Hello", None),
    ]
    df = spark.createDataFrame(rows, "t string, r string")
    for r in df.select("*", content.blocked_reason(F.col("t")).alias("got")).collect():
        assert r.got == r.r, r.t
    strict = df.select("t", content.blocked_reason(F.col("t"), True).alias("got"))
    assert strict.filter(F.col("t").startswith("xxx")).first().got is None


def test_cleaning(spark):
    rows = [
        ("a\n-   **Resources**\n- x\n-   **Other**\n## Next", "a\n## Next"),
        ("a\n- **Support**\n- x\n- **Other**", "a\n- **Other**"),
        ("a\n- **company**\n- **TOOLS** x\n- **Community**", "a"),
        ("a\n-  © 2024 X\nb", "a\nb"),
        ("a\n- [Privacy Policy](x)\n- [Terms of Use] y\n- [Report Security Issues]\n- [Trademark]\nb", "a\nb"),
        ("a\n- ![privacy options](i) Cookie Settings\nb", "a\nb"),
        ("a\nLast updated 3 days ago\nb", "a\nb"),
        ("a\nLast updated by me\nb", "a\nLast updated by me\nb"),
        ("a\nWas this helpful?  ", "a"),
        ("## \n\n[](#a)\n\nText", "## Text"),
        ("# \n\n[](#a)\n\nText", "# \n\n[](#a)\n\nText"),
        ("\n\na\n\n\n\n\nb\n", "a\n\nb"),
    ]
    df = spark.createDataFrame(rows, "t string, o string")
    cleaned = df.select("*", content.clean_markdown(F.col("t")).alias("got"))
    for r in cleaned.collect():
        assert r.got == r.o, r.t
    again = cleaned.select("got", content.collapse_blank(F.col("got")).alias("twice"))
    assert again.filter("got <> twice").count() == 0


def test_absolutize(spark):
    html = '<a href="/x"><a href="httpfoo"><a href="#a"><a href="mailto:q"><img src="data:z"><a href=\'/s\'><img src="i">'
    from pagemill.functions import urls

    df = tokens.html_tokens(urls.with_url_parts(pages(spark, html), "url", "b_"))
    got = [r.absolute_text for r in markdown.absolutize_urls(df, "b_").orderBy("pos").collect()]
    assert got == [
        '<a href="https://e.com/x">', '<a href="httpfoo">', '<a href="#a">', '<a href="mailto:q">',
        '<img src="data:z">', "<a href='/s'>", '<img src="https://e.com/docs/a/i">',
    ]
