"""Selectors, removal and code language against a tree, on random and on nested pages."""

import random

import pytest

from pagemill import rules
from pagemill.functions import selectors
from pagemill.operators import regions
from pagemill.plans import pages as plan
from pagemill.sources import tables

TAGS, CLASSES, VOID = ("div", "span", "section", "pre", "p"), ("a", "b", "language-x", "language-js"), ("br", "img")


def random_page(rng):
    """A page as text, and its elements as (tag, class, chain of the elements around it)."""
    out, elements = [], []

    def grow(around, depth):
        for _ in range(rng.randint(0, 4 if depth < 6 else 0)):
            # Paragraphs end where the next one starts, so they hold no elements here.
            inside_p = any(elements[i][0] == "p" for i in around)
            void = rng.random() < 0.2
            tag = rng.choice(VOID if void or inside_p else TAGS)
            cls = rng.choice((None, *CLASSES))
            elements.append((tag, cls, around))
            out.append(f"<{tag}>" if cls is None else f'<{tag} class="x {cls}">')
            if tag not in VOID:
                grow((*around, len(elements) - 1), depth + 1)
                out.append(rng.choice(("", "t")) + f"</{tag}>")

    grow((), 0)
    return "".join(out), elements


def matches(elements, i, chain):
    """Whether element ``i`` matches a chain of (link, tag or None, class or None)."""
    link, tag, cls = chain[-1]
    own_tag, own_cls, around = elements[i]
    if (tag and own_tag != tag) or (cls and own_cls != cls):
        return False
    if len(chain) == 1:
        return True
    return any(matches(elements, j, chain[:-1]) for j in (around[-1:] if link == ">" else around))


def some_chains(rng, n):
    def one():
        tag = rng.choice((None, *TAGS, *VOID))
        return (rng.choice((" ", ">")), tag, rng.choice(CLASSES if tag is None else (None, *CLASSES)))

    return [[one() for _ in range(rng.randint(2, 3))] for _ in range(n)]


def text(chain):
    words = [(tag or "") + (f".{cls}" if cls else "") for _, tag, cls in chain]
    return "".join(w if i == 0 else f" {link} {w}" if link == ">" else f" {w}" for i, (w, (link, _, _)) in enumerate(zip(words, chain)))


def test_random_trees(spark):
    rng = random.Random(11)
    pages = [random_page(rng) for _ in range(120)]
    df = plan.page_tokens(spark.createDataFrame([(i, "https://e.com/", h) for i, (h, _) in enumerate(pages)], tables.PAGES)).cache()
    total = 0
    for chain in some_chains(rng, 8):
        out = regions.with_selector_match(df, text(chain), plan.ROW, "hit").filter("hit").groupBy("page_id").count()
        got = {r.page_id: r["count"] for r in out.collect()}
        want = {p: sum(matches(e, i, chain) for i in range(len(e))) for p, (_, e) in enumerate(pages)}
        assert got == {p: n for p, n in want.items() if n}, text(chain)
        total += sum(want.values())
    assert total > 50
    parents = regions.with_parent(df, plan.ROW, {"around": df.tag}).filter("kind in ('open', 'void')").orderBy("page_id", "pos")
    got = [r.around for r in parents.collect()]
    assert got == [e[a[-1]][0] if a else None for _, e in pages for _, _, a in e]


def counts(spark, selector, *htmls):
    df = plan.page_tokens(spark.createDataFrame([(i, "https://e.com/", h) for i, h in enumerate(htmls)], tables.PAGES))
    df = regions.with_selector_match(df, selector, plan.ROW, "hit").filter("hit")
    got = {r.page_id: r["count"] for r in df.groupBy("page_id").count().collect()}
    return [got.get(i, 0) for i in range(len(htmls))]


def test_child_behind_a_nested_match(spark):
    nested = '<div class="a"><div class="a">x</div><p>y</p></div>'
    unclosed = '<div class="a"><div class="a">x</div><p>y'
    assert counts(spark, "div.a > p", nested, unclosed, '<div class="a"><b><p>y</p></b></div>') == [1, 1, 0]
    assert counts(spark, "div.a > img", '<div class="a"><img><b><img></b></div>', "<img>") == [1, 0]


def test_code_language_of_the_parent(spark):
    blocks = [
        '<div class="language-js"><div class="language-x">t</div><pre><code>a</code></pre></div>',
        '<div class="language-js"><figure class="language-py"><pre><code>a</code></pre></figure></div>',
        '<div class="language-js"><figure><pre><code>a</code></pre></figure></div>',
        '<figure class="language-py"><pre><code>a</code></pre></figure>',
        '<div class="language-js"><span class="lang">js</span><b><span class="lang">kept</span></b><pre><code class="language-c">a</code></pre></div>',
    ]
    df = spark.createDataFrame([(i, "https://e.com/", f"<main>{b}</main>") for i, b in enumerate(blocks)], tables.PAGES)
    got = [r.markdown for r in plan.pages_to_markdown(df).orderBy("page_id").collect()]
    assert [m[m.index("```") :].split("\n")[0] for m in got] == ["```js", "```py", "```", "```", "```c"]
    assert "js\n" not in got[4].split("```")[0] and "kept" in got[4]


def test_removal_with_combinators(spark):
    config = rules.SiteConfig("__default__", "main", ("nav > b", ".x .y, i", "p"), "custom")
    html = '<main><nav><b>1</b><u><b>2</b></u></nav><b>3</b><div class="x"><u class="y">4</u></div><u class="y">5</u><i>6</i><p>7</p></main>'
    df = spark.createDataFrame([(0, "https://e.com/", html)], tables.PAGES)
    md = plan.pages_to_markdown(df, configs=(config,)).first().markdown
    assert [c for c in "1234567" if c in md] == ["2", "3", "5"]
    assert selectors.split_combined(config.remove) == (("i", "p"), ("nav > b", ".x .y"))


@pytest.mark.parametrize("ids", [(1, 1, 1), (None, None, None), (1, None, 2)])
def test_pages_with_repeated_and_null_ids_stay(spark, ids):
    texts = ["one", "two", "two"]
    rows = [(i, "https://e.com/x", f"<main><ul><li><pre><code>{t}</code></pre></li></ul><nav>n</nav></main>") for i, t in zip(ids, texts)]
    df = spark.createDataFrame(rows, tables.PAGES)
    got = sorted((r.page_id or 0, r.markdown.split("\n")[1].strip()) for r in plan.pages_to_markdown(df).collect())
    assert got == sorted((i or 0, t) for i, t in zip(ids, texts))
    tokens = plan.page_tokens(df)
    assert tokens.filter("tag = 'pre' and kind = 'open'").count() == 3
    assert regions.with_selector_match(tokens, "li > pre", plan.ROW, "hit").filter("hit").count() == 3
