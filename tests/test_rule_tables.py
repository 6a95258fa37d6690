"""Rule tables, domain tables and named references."""

import pytest

from pagemill import rules
from pagemill.functions import content, urls
from pagemill.operators import frameworks, hosts, rule_tables
from pagemill.plans import pages as plan
from pagemill.sources import tables

TABLE = "config_key string, content_selector string, remove_selectors array<string>, framework string, may_be_blocked boolean"

HTML = (
    '<main id="Main"><nav>n</nav><div class="x ad">1</div><p class="note big">2</p><p data-k="v w">3</p><p id="q">4</p>'
    '<i class="big">5</i><b DATA-K=z>6</b><u class="note">7</u><noscript>8</noscript><p class="NOTE">9</p></main><article>outside</article>'
)


def kept(spark, remove, content="main", host="e.com", others=0):
    rows = [("e.com", content, remove, None, False), ("__default__", "main", [], None, False)]
    rows += [(f"h{i}.org", "main", ["div", f".c{i}", f"#i{i}"], None, False) for i in range(others)]
    df = spark.createDataFrame([(1, f"https://{host}/a", HTML)], tables.PAGES)
    md = plan.pages_to_markdown(df, rule_table=spark.createDataFrame(rows, TABLE)).first().markdown
    return "".join(c for c in md if c.isdigit() or c == "n")


@pytest.mark.parametrize(
    ("remove", "left"),
    [
        (["nav", ".ad"], "2345679"),
        (["p"], "n1567"),
        (["p.note, i.big"], "n134679"),
        (['[data-k="v w"]', "[data-k*=z]"], "n1245 79".replace(" ", "")),
        (["[data-k]", "#q"], "n12579"),
        (["p.note.big", 'p[id="q"]', "#Q"], "n135679"),
        (["u.big", "b#q", ".bi"], "n12345679"),
        ([], "n12345679"),
    ],
)
def test_selectors_of_a_table(spark, remove, left):
    assert kept(spark, remove) == left


def test_tables_and_lists_agree(spark):
    pages = spark.createDataFrame([(i, f"https://{h}/docs/a", HTML.replace("main", t)) for i, (h, t) in enumerate([("e.com", "main"), ("docs.x.ai", "article"), ("ai.google.dev", "div"), ("developers.cloudflare.com", "main")])], tables.PAGES)
    plain = [c for c in rules.SITE_CONFIGS if ">" not in c.content and " " not in c.content.replace(", ", ",")]
    table = frameworks.config_table(spark, plain)
    one = {r.page_id: r.markdown for r in plan.pages_to_markdown(pages, configs=plain).collect()}
    two = {r.page_id: r.markdown for r in plan.pages_to_markdown(pages, rule_table=table).collect()}
    assert one == two


def test_plan_does_not_grow_with_the_table(spark):
    df = spark.createDataFrame([(1, "https://e.com/a", HTML)], tables.PAGES)
    size = []
    for n in (1, 3000):
        table = spark.range(n).selectExpr("concat('h', id, '.org') config_key", "'main' content_selector", "array('nav', concat('.c', id)) remove_selectors", "'' framework", "false may_be_blocked")
        size.append(len(plan.main_tokens(df, rule_table=table)._jdf.queryExecution().optimizedPlan().toString()))
    assert abs(size[0] - size[1]) < 200
    assert kept(spark, ["nav", ".ad"], others=3000) == "2345679"
    assert kept(spark, ["nav"], host="other.com") == "n12345679"


def test_unsupported_selectors_raise(spark):
    table = spark.createDataFrame([("e.com", "main", ["a > b"], None, False)], TABLE)
    with pytest.raises(Exception, match="unsupported selector: a > b"):
        rule_tables.rule_index(table).collect()


def test_domains_of_a_table(spark):
    domains = ["e.com", "b.e.com", "org", "x.y", "E.NET"]
    names = ["e.com", "a.e.com", "b.e.com", "c.b.e.com", "xe.com", "com", "q.org", "org", "x.y.z", "www.e.net", None, ""]
    df = spark.createDataFrame([(h, i) for i, h in enumerate(names)], "host string, i int")
    table = spark.createDataFrame([(d,) for d in domains + domains], "domain string")
    out = hosts.with_domain(df, table).withColumn("listed", urls.host_matches(df.host, [d.lower() for d in domains]))
    got = {r.i: (r.domain, r.listed) for r in out.collect()}
    assert [got[i][0] for i in range(len(names))] == ["e.com", "e.com", "b.e.com", "b.e.com", None, None, "org", "org", None, "e.net", None, None]
    assert all(bool(listed) == (domain is not None) for domain, listed in got.values())


@pytest.mark.parametrize(
    ("text", "out", "in_attribute"),
    [
        ("&hearts;&Aacute;&NotEqualTilde;", "♥Á≂̸", "♥Á≂̸"),
        ("&copy 2024 &copyright", "© 2024 ©right", "&copy 2024 &copyright"),
        ("AT&T &unknown; &;&", "AT&T &unknown; &;&", "AT&T &unknown; &;&"),
        ("&amp;lt; &ampamp;", "&lt; &amp;", "&lt; &ampamp;"),
        ("a?x=1&copy=2&lt;", "a?x=1©=2<", "a?x=1&copy=2<"),
        ("&notit; &notin;", "¬it; ∉", "&notit; ∉"),
    ],
)
def test_named_references(spark, text, out, in_attribute):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(content.decode_entities(df.t), content.decode_entities(df.t, attribute=True)).first()) == (out, in_attribute)
