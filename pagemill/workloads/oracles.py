"""The same queries as plain SQL for a reference database.

They are phrased apart from the Spark jobs: character lists instead of run encoding, string
cutting on known markup instead of windows, recursive queries instead of level loops.
"""

from __future__ import annotations

from pagemill.workloads import derive as d

ORACLES: dict[str, str] = {}

PAGES = "pages"


# --- building blocks: SQL text for the parts of a URL


def scheme(u):
    return f"lower(regexp_extract({u}, '(?i)^\\s*(https?)://', 1))"


def _authority(u):
    return f"lower(regexp_extract({u}, '(?i)^\\s*https?://([^/?#]*)', 1))"


def authority(u):
    return (
        f"CASE WHEN {scheme(u)} = 'https' THEN regexp_replace({_authority(u)}, ':443$', '')"
        f" ELSE regexp_replace({_authority(u)}, ':80$', '') END"
    )


def host(u):
    return f"regexp_replace({_authority(u)}, ':[0-9]*$', '')"


def encoded(p, also=""):
    return (
        f"array_to_string(list_transform(string_split({p}, ''), lambda c: CASE WHEN"
        f" regexp_matches(c, '[A-Za-z0-9!#$%&()*+,./:;=@|~_{also}\\[\\]\\x27-]') THEN c ELSE url_encode(c) END), '')"
    )


def undotted(p):
    """Fold dot segments of an absolute path."""
    return (
        f"regexp_replace(list_reduce(list_prepend('', string_split({p}, '/')[2:]), lambda a, s:"
        " CASE s WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') WHEN '.' THEN a ELSE a || '/' || s END),"
        " '^$', '/')"
    )


def path(u):
    raw = f"coalesce(nullif(regexp_extract({u}, '(?i)^\\s*https?://[^/?#]*([^?#]*)', 1), ''), '/')"
    return undotted(encoded(raw))


def valid(u):
    return f"regexp_matches({u}, '(?i)^\\s*https?://[a-z0-9.-]+(:[0-9]+)?([/?#]|$)')"


def normalized(u):
    return f"CASE WHEN {valid(u)} THEN {scheme(u)} || '://' || {authority(u)} || {path(u)} END"


def key(u):
    p = path(u)
    return (
        f"CASE WHEN {valid(u)} THEN {scheme(u)} || '://' || {authority(u)} ||"
        f" CASE WHEN {p} <> '/' AND {p} LIKE '%/' THEN left({p}, length({p}) - 1) ELSE {p} END END"
    )


WORDS = "['docs', 'documentation', 'guide', 'guides', 'api', 'reference']"


def parts(p):
    return f"list_filter(string_split({p}, '/'), lambda s: s <> '')"


def first_word(p):
    """Position of the first documentation word among the path segments, or null."""
    return (
        f"list_position(list_transform({parts(p)}, lambda s: list_contains({WORDS}, lower(s))), true)"
    )


def base_path(p):
    return f"'/' || {parts(p)}[{first_word(p)}] || '/'"


def local_path(p):
    rest = f"{parts(p)}[coalesce({first_word(p)}, 0) + 1:]"
    return f"CASE WHEN len({rest}) = 0 THEN 'index.md' ELSE array_to_string({rest}, '/') || '.md' END"


ODD = f"odd AS (SELECT page_id, {d.ODD_URL} AS url FROM pages)"
# URLs of documentation pages are plain, so their parts are simple cuts.
DOCS = f"""docs0 AS (SELECT page_id, html, {d.DOC_URL} AS url FROM pages),
docs AS (SELECT *, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS site,
  regexp_extract(url, '://([^/]+)', 1) AS host, regexp_extract(url, '://[^/]+([^?#]*)', 1) AS path FROM docs0),
keyed AS (SELECT *, site || rtrim(path, '/') AS url_key FROM docs)"""
ENTRIES = """entries AS (SELECT host AS crawl_id, arg_min(url, page_id) AS url,
  arg_min(url_key, page_id) AS url_key, min(page_id) AS page_id FROM keyed GROUP BY host)"""
EDGES = """edges AS (SELECT DISTINCT s.url_key AS src, t.url_key AS dst FROM keyed s
  JOIN keyed t ON t.page_id IN (s.page_id + 1, s.page_id * 2 + 1, s.page_id * 3))"""


def o(name, sql):
    ORACLES[name] = sql


o("pages_scan", "SELECT page_id, url, length(html) AS n_chars FROM pages")
o(
    "url_validate",
    f"""WITH {ODD} SELECT page_id, {valid('url')} AS ok,
  CASE WHEN url LIKE 'ftp%' THEN 'Unsupported URL scheme: ' || split_part(url, ':', 1) || ': (only http/https allowed)'
  WHEN NOT {valid('url')} THEN 'Invalid URL: ' || url END AS error FROM odd""",
)
o("url_normalize", f"WITH {ODD} SELECT page_id, {normalized('url')} AS normalized FROM odd")
o("url_key", f"WITH {ODD} SELECT page_id, {key('url')} AS url_key FROM odd")
o(
    "dedup_pages",
    f"""WITH k AS (SELECT page_id, url, {key('url')} AS url_key FROM pages)
SELECT url_key, page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS n FROM k)
WHERE n = 1""",
)
_REFS = " UNION ALL ".join(f"SELECT page_id, {i} AS n, {r} AS ref FROM pages" for i, r in enumerate(d.REFS))
o(
    "resolve_links",
    f"""WITH {DOCS}, refs AS ({_REFS})
SELECT page_id, n, ref, CASE n
  WHEN 0 THEN site || '/p/' || page_id
  WHEN 1 THEN site || regexp_extract(path, '^(.*/)', 1) || 'q-' || page_id
  WHEN 2 THEN site || regexp_extract(path, '^(.*/)[^/]+/[^/]*$', 1) || 'up'
  WHEN 3 THEN site || regexp_extract(path, '^(.*/)', 1) || 'same/'
  WHEN 4 THEN site || path || '?page=' || page_id
  WHEN 5 THEN split_part(url, '#', 1) || '#part'
  WHEN 6 THEN split_part(url, '/', 1) || '//cdn.example.net/x'
  WHEN 7 THEN 'https://other.example.org/' || page_id || '/b?x=1#y'
  WHEN 8 THEN site || '/f%C3%BCr%20den'
  WHEN 9 THEN 'mailto:a@example.org'
  ELSE split_part(url, '#', 1) END AS resolved
FROM docs JOIN refs USING (page_id)""",
)
o("base_path", f"WITH {DOCS} SELECT page_id, {base_path('path')} AS base_path FROM docs")
o(
    "filter_base_path",
    f"""WITH {DOCS}, {ENTRIES}, b AS (SELECT crawl_id AS host, {base_path("regexp_extract(url, '://[^/]+([^?#]*)', 1)")} AS base FROM entries)
SELECT page_id, host, base FROM docs JOIN b USING (host) WHERE base IS NULL OR starts_with(path, base)""",
)
o("local_path", f"WITH {DOCS} SELECT page_id, {local_path('path')} AS local_path FROM docs")
_LOCAL = f"{DOCS}, l AS (SELECT page_id, url, {local_path('path')} AS local_path FROM docs)"
_DIR = "CASE WHEN contains(local_path, '/') THEN regexp_replace(local_path, '/[^/]*$', '') ELSE '' END"
o("dir_path", f"WITH {_LOCAL} SELECT page_id, {_DIR} AS dir FROM l")
o(
    "numbered_paths",
    f"""WITH {_LOCAL}, n AS (SELECT page_id, local_path, {_DIR} AS dir FROM l),
m AS (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY page_id) AS number FROM n)
SELECT page_id, dir, number, CASE WHEN dir = '' THEN '' ELSE dir || '/' END
  || CASE WHEN number < 10 THEN '0' ELSE '' END || number || '-' || split_part(local_path, '/', -1) AS numbered_path FROM m""",
)
o(
    "md_url",
    f"""WITH {DOCS}, m AS (SELECT page_id, site || rtrim(path, '/') || '.md' || substr(url, length(site || path) + 1) AS md FROM docs)
SELECT page_id, md, md AS md_or_mdx FROM m""",
)
_SITES = f"sites AS (SELECT page_id, {d.SITE_HOST} AS host FROM pages)"
_MD = "regexp_matches(host, '^(.*[.])?(docs[.]anthropic|docs[.]claude|code[.]claude|developers[.]openai)[.]com$')"
_MDX = "regexp_matches(host, '^(.*[.])?(platform[.]claude[.]com|docs[.]anthropic[.]com|vercel[.]com|nextjs[.]org)$')"
o("host_match", f"WITH {_SITES} SELECT page_id, {_MD} AS md, {_MDX} AS mdx FROM sites")
o(
    "safe_path",
    """SELECT page_id, concat(CASE page_id % 7 WHEN 0 THEN 'out/' WHEN 1 THEN '../' WHEN 2 THEN 'out/../../'
  WHEN 3 THEN '/' WHEN 4 THEN './' WHEN 5 THEN 'out/a/../../out/' ELSE 'out/..' END, 'f', page_id, '.md') AS path,
  page_id % 7 IN (0, 1, 4, 5) AS safe FROM pages""",
)
o(
    "path_collisions",
    f"""WITH {_LOCAL} SELECT local_path, max(page_id) AS page_id, arg_max(url, page_id) AS url, count(*) AS writers
FROM l GROUP BY local_path""",
)

# --- links: all raw targets of a page in order, then rules on their text
_RAW = """raws AS (SELECT page_id, site, path, host, unnest(list) AS raw0, generate_subscripts(list, 1) - 1 AS pos FROM
  (SELECT page_id, site, path, host, list_concat(regexp_extract_all(html, '\\[[^\\]]+\\]\\(([^)]+)\\)', 1),
   regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1)) AS list FROM src)),
cut AS (SELECT *, trim(split_part(raw0, '#', 1)) AS raw FROM raws),
good AS (SELECT * FROM cut WHERE raw <> '' AND NOT regexp_matches(raw, '^(mailto:|javascript:|<|%3C)'))"""


def _links(url, rebase=False, external=False):
    src = f"""src0 AS (SELECT page_id, {url} AS url, {d.LINKS_HTML} AS html FROM pages),
src AS (SELECT page_id, html, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS site, regexp_extract(url, '://([^/]+)', 1) AS host,
  regexp_extract(url, '://[^/]+([^?#]*)', 1) AS path FROM src0)"""
    target = f"""CASE WHEN starts_with(raw, 'http') THEN regexp_extract(raw, '://[^/]+(.*)', 1)
  WHEN starts_with(raw, '//') THEN regexp_extract(raw, '^//[^/]+(.*)', 1)
  WHEN starts_with(raw, '/') THEN regexp_replace(raw, '[?].*', '') WHEN starts_with(raw, '?') THEN path
  ELSE {undotted("concat(regexp_extract(path, '^(.*/)', 1), regexp_replace(raw, '[?].*', ''))")} END"""
    sql = f"""{src}, {_RAW},
hit AS (SELECT page_id, pos, raw, site, path, {encoded('(' + target + ')')} AS to_path,
  CASE WHEN starts_with(raw, 'http') THEN regexp_extract(raw, '^([a-z]+://[^/]+)', 1)
  WHEN starts_with(raw, '//') THEN split_part(site, '/', 1) || regexp_extract(raw, '^(//[^/]+)', 1) ELSE site END AS to_site FROM good),
kept AS (SELECT * FROM hit WHERE {"to_site = site" if not external else "NOT contains(to_site, 'img.')"}),"""
    if rebase:
        base = base_path("path")
        sql += f"""based AS (SELECT *, {base} AS base FROM kept),
moved AS (SELECT page_id, pos, raw, to_site, CASE WHEN base IS NULL OR starts_with(to_path, base) THEN to_path
  WHEN starts_with(raw, '/') AND NOT starts_with(raw, base) THEN rtrim(base, '/') || {encoded("regexp_replace(raw, '[?].*', '')")} END AS to_path FROM based),"""
    else:
        sql += "moved AS (SELECT * FROM kept),"
    return sql + """links AS (SELECT page_id, pos, raw, to_site || to_path AS dst_url FROM moved
  WHERE to_path IS NOT NULL AND NOT regexp_matches(to_path, '(?i)[.](png|jpg|jpeg|gif|svg|pdf|zip|tar|gz)$'))"""


o("extract_links", f"WITH {_links('url')} SELECT page_id, pos, raw, dst_url FROM links")
o("links_external", f"WITH {_links('url', external=True)} SELECT page_id, pos, raw, dst_url FROM links")
o("links_rebased", f"WITH {_links(d.DOC_URL, rebase=True)} SELECT page_id, pos, raw, dst_url FROM links")
o(
    "link_edges",
    f"""WITH {_links(d.DOC_URL, rebase=True)} SELECT page_id, dst_url,
  CASE WHEN regexp_matches(dst_url, '://[^/]+/$') THEN dst_url ELSE regexp_replace(dst_url, '/$', '') END AS dst_key, min(pos) AS pos
FROM links GROUP BY page_id, dst_url""",
)
o("link_counts", f"WITH {_links('url')} SELECT page_id, count(DISTINCT dst_url) AS n_links FROM links GROUP BY page_id")
o(
    "dangling_links",
    f"""WITH hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=["'']([^"'']+)["'']', 1)) AS raw FROM pages)
SELECT DISTINCT page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) || {encoded("rtrim(raw, '/')")} AS dst_key FROM hrefs
WHERE starts_with(raw, '/') AND regexp_extract(url, '^([a-z]+://[^/]+)', 1) || {encoded("rtrim(raw, '/')")} NOT IN (SELECT {key('url')} FROM pages)""",
)


# --- crawl


def _bfs(depth, edges="edges"):
    return f"""walk AS (SELECT crawl_id, url_key, 0 AS depth FROM entries
  UNION SELECT w.crawl_id, e.dst, w.depth + 1 FROM walk w JOIN {edges} e ON e.src = w.url_key WHERE w.depth < {depth}),
reached AS (SELECT crawl_id, url_key, min(depth) AS depth FROM walk GROUP BY crawl_id, url_key)"""


o("crawl_bfs", f"WITH RECURSIVE {DOCS}, {ENTRIES}, {EDGES}, {_bfs(4)} SELECT * FROM reached")
o(
    "crawl_depths",
    f"""WITH RECURSIVE {DOCS}, {ENTRIES}, {EDGES}, {_bfs(3)}
SELECT crawl_id, depth, count(*) AS n_pages FROM reached GROUP BY crawl_id, depth""",
)
_FATE = """fate AS (SELECT url_key, CASE min(page_id) % 13 WHEN 3 THEN 'empty' WHEN 5 THEN 'cloudflare' END AS reason,
  CASE min(page_id) % 17 WHEN 4 THEN 'timeout' END AS error FROM keyed GROUP BY url_key),
live AS (SELECT e.* FROM edges e JOIN fate f ON f.url_key = e.src WHERE f.reason IS NULL AND f.error IS NULL)"""
_OUT = f"""{DOCS}, {ENTRIES}, {EDGES}, {_FATE}, {_bfs(3, 'live')},
outcome AS (SELECT crawl_id, url_key, depth, CASE WHEN depth = 0 AND (reason IS NOT NULL OR error IS NOT NULL) THEN 'entry_failed'
  WHEN error IS NOT NULL THEN 'failed' WHEN reason IS NOT NULL THEN 'blocked' ELSE 'saved' END AS status, reason, error
  FROM reached JOIN fate USING (url_key))"""
o("crawl_outcomes", f"WITH RECURSIVE {_OUT} SELECT * FROM outcome")
o(
    "crawl_report",
    f"""WITH RECURSIVE {_OUT}, kinds AS (SELECT crawl_id, CASE status WHEN 'entry_failed' THEN
  CASE WHEN reason IS NULL THEN 'failed' ELSE 'blocked' END ELSE status END AS kind FROM outcome)
SELECT crawl_id, count(*) AS visited, count(*) FILTER (kind = 'saved') AS saved,
  count(*) FILTER (kind = 'blocked') AS blocked, count(*) FILTER (kind = 'failed') AS failed FROM kinds GROUP BY crawl_id""",
)
o(
    "blocked_pages",
    f"WITH RECURSIVE {_OUT} SELECT DISTINCT url_key AS url, reason FROM outcome WHERE reason IS NOT NULL",
)
o(
    "blocked_by_host",
    f"""WITH {DOCS}, one AS (SELECT url_key, min(host) AS host, min(page_id) AS id FROM keyed GROUP BY url_key),
r AS (SELECT host, CASE id % 13 WHEN 3 THEN 'empty' WHEN 5 THEN 'cloudflare' END AS reason FROM one)
SELECT host, reason, count(*) AS n_pages FROM r WHERE reason IS NOT NULL GROUP BY host, reason""",
)

# --- sitemaps: the tree of indexes is known from the page numbers
_MAPS = "'https://maps.example.org/"
o(
    "sitemap_kind",
    f"""SELECT {_MAPS}pages-' || page_id || '.xml' AS sitemap_url, false AS is_index FROM pages
UNION ALL SELECT {_MAPS}index-' || page_id || '.xml', true FROM pages""",
)
_LOCS = f"""bodies AS (SELECT page_id, host, url, path, {d.SITEMAP_BODY.format(u='url')} AS body FROM docs),
locs0 AS (SELECT page_id, trim(unnest(regexp_extract_all(body, '<url>\\s*<loc>([^<]+)</loc>', 1))) AS loc FROM bodies),
locs AS (SELECT page_id, loc, regexp_extract(loc, '://[^/]+([^?#]*)', 1) AS path,
  regexp_extract(loc, '^([a-z]+://[^/]+)', 1) || rtrim(regexp_extract(loc, '://[^/]+([^?#]*)', 1), '/') AS url_key
  FROM locs0 WHERE contains(loc, '://'))"""
o(
    "sitemap_urls",
    f"""WITH {DOCS}, {_LOCS} SELECT {_MAPS}pages-' || page_id || '.xml' AS sitemap_url, loc, url_key FROM locs""",
)
o(
    "sitemap_files",
    f"""WITH {DOCS}, {_LOCS} SELECT {_MAPS}pages-' || page_id || '.xml' AS sitemap_url, loc, 'page' AS kind FROM locs
UNION ALL SELECT {_MAPS}index-' || page_id || '.xml', unnest([{_MAPS}pages-' || page_id || '.xml', {_MAPS}index-' || page_id * 2 + 1 || '.xml', {_MAPS}index-' || page_id || '.xml']), 'child' FROM pages""",
)
_TREE = f"""{DOCS}, {ENTRIES}, tree AS (SELECT crawl_id, page_id AS id FROM entries
  UNION SELECT t.crawl_id, t.id * 2 + 1 FROM tree t JOIN pages p ON p.page_id = t.id),
got AS (SELECT DISTINCT crawl_id, id FROM tree JOIN pages ON page_id = id)"""
o(
    "sitemap_expand",
    f"WITH RECURSIVE {_TREE} SELECT crawl_id, {_MAPS}pages-' || id || '.xml' AS sitemap_url FROM got",
)
o(
    "sitemap_choose",
    f"""WITH {DOCS}, {ENTRIES}, c AS (SELECT crawl_id, page_id, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS site FROM entries)
SELECT crawl_id, CASE WHEN page_id % 4 < 3 THEN site || CASE page_id % 3 WHEN 0 THEN '/sitemap.xml' WHEN 1 THEN '/sitemap-index.xml' ELSE '/sitemap_index.xml' END END AS sitemap_url,
  CASE WHEN page_id % 4 = 3 THEN 'No sitemap found for ' || site END AS error FROM c""",
)
_FOUND = f"""{_TREE}, {_LOCS}, base AS (SELECT crawl_id, {base_path("regexp_extract(url, '://[^/]+([^?#]*)', 1)")} AS base FROM entries),
found AS (SELECT g.crawl_id, l.*, base, base IS NULL OR starts_with(l.path, base) AS kept
  FROM got g JOIN locs l ON l.page_id = g.id JOIN base USING (crawl_id))"""
o(
    "sitemap_counts",
    f"WITH RECURSIVE {_FOUND} SELECT crawl_id, count(*) AS n_found, count(*) FILTER (kept) AS n_kept FROM found GROUP BY crawl_id",
)
o(
    "crawl_sitemap",
    f"""WITH RECURSIVE {_FOUND} SELECT crawl_id, url_key, min(loc) AS loc,
  url_key IN (SELECT url_key FROM keyed) AS captured FROM found WHERE kept GROUP BY crawl_id, url_key""",
)

# --- frameworks: tags as rows, one test per signal
_DEFAULT_CONTENT = "main, article, .content, .docs-content, #content"
o(
    "site_config",
    f"""WITH {_SITES}, c(host, content_selector, framework, may_be_blocked) AS (VALUES
 ('developers.cloudflare.com', '[data-pagefind-body], main article, main', 'starlight', false),
 ('platform.openai.com', 'main', 'custom', true), ('docs.x.ai', 'article, main, .content', 'custom', false),
 ('ai.google.dev', 'article, main', 'custom', false))
SELECT page_id, coalesce(c.host, '__default__') AS config_key, coalesce(content_selector, '{_DEFAULT_CONTENT}') AS content_selector,
  coalesce(framework, 'custom') AS framework, coalesce(may_be_blocked, false) AS may_be_blocked FROM sites LEFT JOIN c USING (host)""",
)
_TAGS = f"""rich AS (SELECT page_id, {d.RICH_HTML} AS html FROM pages),
tags AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<[a-zA-Z][^>]*>')) AS t FROM rich),
facts AS (SELECT page_id, lower(regexp_extract(t, '<([a-zA-Z0-9-]+)', 1)) AS tag, t,
  string_split(regexp_extract(t, ' class="([^"]*)"', 1), ' ') AS cls, regexp_extract(t, ' class="([^"]*)"', 1) AS class_text,
  regexp_extract(t, ' href="([^"]*)"', 1) AS href, regexp_extract(t, ' id="([^"]*)"', 1) AS id FROM tags)"""
_SEL = {
    "docusaurus": [".theme-doc-markdown", ".docusaurus-highlight-code-line", ".navbar__brand", ".menu__link", "class*docusaurus", ".pagination-nav"],
    "vitepress": [".vp-doc", ".VPNav", ".VPSidebar", ".VPContent", ".vp-code", "class*VPHome"],
    "starlight": [".sl-markdown-content", "@data-starlight", ".starlight-aside", "astro-island"],
    "mkdocs": [".md-content", ".md-header", ".md-sidebar", ".md-nav", "@data-md-component"],
    "sphinx": [".sphinxsidebar", ".document", ".bodywrapper", "class*sphinx", ".rst-content", "#furo-main-content", ".furo-main", "href*sphinx-doc.org"],
    "gitbook": [".gitbook-root", "@data-gitbook", ".space-navigation", ".page-inner", "class*page-width-default", "class*site-width-default", "@data-testid=\"table-of-contents\"", "href*gitbook.com"],
}
_RX = {
    "docusaurus": ["(?i)docusaurus", "(?i)<meta[^>]*generator[^>]*Docusaurus", "/@docusaurus/", "docusaurus[.]config"],
    "vitepress": ["(?i)vitepress", "(?i)<meta[^>]*generator[^>]*VitePress", "vitepress[.]css", "__VP_"],
    "starlight": ["(?i)starlight", "(?i)<meta[^>]*generator[^>]*Astro", "Starlight", "@astrojs/starlight"],
    "mkdocs": ["(?i)mkdocs", "(?i)<meta[^>]*generator[^>]*mkdocs", "(?i)material-?for-?mkdocs", "mkdocs[.]yml"],
    "sphinx": ["(?i)sphinx", "(?i)<meta[^>]*generator[^>]*Sphinx", "sphinx_rtd_theme", "_static/sphinx", "(?i)pradyunsg.*furo", "(?i)furo[.]css", "(?i)Made with.*Sphinx"],
    "gitbook": ["(?i)gitbook", "app[.]gitbook[.]com", "gitbook-x-reason", "(?i)Powered by GitBook", "gitbook[.]io"],
}


def _test(s):
    if s[0] == ".":
        return f"list_contains(cls, '{s[1:]}')"
    if s[0] == "#":
        return f"id = '{s[1:]}'"
    if s[0] == "@":
        return f"contains(t, ' {s[1:]}')"
    if s.startswith("class*"):
        return f"contains(class_text, '{s[6:]}')"
    if s.startswith("href*"):
        return f"contains(href, '{s[5:]}')" + (" AND contains(href, 'utm_source')" if "gitbook" in s else "")
    return f"tag = '{s}'"


_SIGNALS = (
    _TAGS
    + ", signals AS ("
    + " UNION ALL ".join(
        f"SELECT DISTINCT page_id, {r} AS rank, '{f}' AS framework, 'selector' AS kind, {i} AS ord FROM facts WHERE {_test(s)}"
        for r, (f, ss) in enumerate(_SEL.items())
        for i, s in enumerate(ss, 1)
    )
    + " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT page_id, {r}, '{f}', 'html', {i} FROM rich WHERE regexp_matches(html, '{x}')"
        for r, (f, xs) in enumerate(_RX.items())
        for i, x in enumerate(xs, 1)
    )
    + ")"
)


def _scored(sel=10, html=5):
    return f"""{_SIGNALS}, scores AS (SELECT page_id, rank, framework, sum(CASE kind WHEN 'selector' THEN {sel} ELSE {html} END) AS score
  FROM signals GROUP BY page_id, rank, framework),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, rank) = 1),
found AS (SELECT page_id, coalesce(framework, 'custom') AS framework, coalesce(score, 0)::BIGINT AS score,
  least(round(coalesce(score, 0) / 30.0, 4), 1.0)::DOUBLE AS confidence FROM rich LEFT JOIN best USING (page_id))"""


o("framework_signals", f"WITH {_SIGNALS} SELECT page_id, framework, kind, ord FROM signals")
o("framework_scores", f"WITH {_scored()} SELECT page_id, framework, score::BIGINT AS score FROM scores")
o("detect_framework", f"WITH {_scored()} SELECT page_id, framework, score, confidence FROM found")
o("detect_framework_html", f"WITH {_scored(5, 10)} SELECT page_id, framework, score, confidence FROM found")
o(
    "effective_config",
    f"""WITH {_SITES}, {_scored()} SELECT page_id, host, CASE WHEN host IN ('developers.cloudflare.com', 'platform.openai.com', 'docs.x.ai', 'ai.google.dev')
  THEN host WHEN score >= 9 AND framework <> 'custom' THEN '__' || framework || '__' ELSE '__default__' END AS config_key
FROM found JOIN sites USING (page_id)""",
)
o(
    "framework_counts",
    f"WITH {_scored()} SELECT framework, count(*) AS n_pages, round(avg(confidence), 4) AS avg_confidence FROM found GROUP BY framework",
)

# --- HTML
_RICH = f"rich AS (SELECT page_id, url, {d.RICH_HTML} AS html FROM pages)"
_VOID = "'area','base','br','col','embed','hr','img','input','link','meta','source','track','wbr','script','style'"
_TOKEN = "(?s)(?:<!--.*?-->|<script.*?</script>|<style.*?</style>|</?[a-zA-Z][^>]*>|<![^>]*>)[^<]*"
_TOKENS = f"""{_RICH}, tok AS (SELECT page_id, url, unnest(l) AS t, generate_subscripts(l, 1) - 1 AS pos FROM
  (SELECT page_id, url, regexp_extract_all(html, '{_TOKEN}') AS l FROM rich)),
tokens AS (SELECT page_id, url, pos, t, nullif(lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9-]*)', 1)), '') AS tag,
  regexp_replace(t, '(?s)^(<!--.*?-->|<script.*?</script>|<style.*?</style>|<[^>]*>)', '') AS text FROM tok)"""
o(
    "html_tokens",
    f"""WITH {_TOKENS} SELECT page_id, pos, CASE WHEN tag IS NULL THEN 'text' WHEN t LIKE '</%' THEN 'close'
  WHEN tag IN ({_VOID}) THEN 'void' ELSE 'open' END AS kind, tag, length(text) AS n_text FROM tokens""",
)
o(
    "selector_match",
    """SELECT page_id, 1 AS cls, 1 AS child, 2 AS deep,
  CASE WHEN page_id % 10 IN (3) THEN 1 WHEN page_id % 10 = 5 THEN 2 ELSE 0 END AS attr, 0 AS "none" FROM pages""",
)
_QUIET = "regexp_replace({h}, '(?s)<script.*?</script>|<style.*?</style>|<noscript>.*?</noscript>|<astro-island>.*?</astro-island>', '{to}', 'g')"
o("strip_noise", f"WITH {_RICH} SELECT page_id, {_QUIET.format(h='html', to='')} AS html FROM rich")
o(
    "remove_regions",
    f"""WITH {_RICH} SELECT page_id, regexp_replace(replace(html, '{d.SIDEBAR}', ''),
  '(?s)<nav>.*?</nav>|<footer>.*?</footer>|<footer>.*$|<div class="ad">.*?</div>', '', 'g') AS html FROM rich""",
)
_LISTS = "<ul><li>one</li><li>two <em>x</em><ul><li>deep</li></ul></li></ul>"
o(
    "rule_table_removal",
    f"""WITH {_RICH}, quiet AS (SELECT page_id, {_QUIET.format(h='html', to='')} AS h FROM rich)
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN '__default__' ELSE {d.RULED_HOST} END AS config_key,
  CASE WHEN page_id % 5 = 0 THEN h WHEN page_id % 4 = 0 THEN replace(h, '{d.SIDEBAR}', '')
  WHEN page_id % 4 = 1 THEN regexp_replace(replace(h, '{d.SIDEBAR}', ''), '(?s)<nav>.*?</nav>|<div class="language-js">.*?</div>', '', 'g')
  WHEN page_id % 4 = 2 THEN regexp_replace(replace(replace(h, '{d.SIDEBAR}', ''), '{_LISTS}', ''), '(?s)<ul>.*?</ul>|<h2>.*?</h2>', '', 'g')
  ELSE h END AS html FROM quiet""",
)
o(
    "host_domains",
    f"""WITH h AS (SELECT page_id, {d.SUBHOST} AS host FROM pages), t AS (SELECT DISTINCT {d.DOMAIN} AS domain FROM pages)
SELECT page_id, host, arg_max(domain, length(domain)) AS domain FROM h LEFT JOIN t ON host = domain OR ends_with(host, '.' || domain) GROUP BY page_id, host""",
)
o("code_language", "SELECT page_id, 3 AS n_pre, 1 AS n_lang, 'js' AS lang FROM pages")
o(
    "main_content",
    f"""WITH {_RICH}, c AS (SELECT page_id, CASE WHEN page_id % 10 = 6 THEN regexp_extract(html, '(?s)<main[^>]*>(.*)$', 1)
  ELSE regexp_extract(html, '(?s)<article[^>]*>(.*?)</article>', 1) END AS h FROM rich)
SELECT page_id, regexp_replace(h, '(?s)<!--.*?-->|<[^>]*>', '', 'g') AS html FROM c""",
)
_ABS = """CASE WHEN regexp_matches(t0, '{a}="[^"]') AND NOT regexp_matches(t0, '{a}="({k})')
  THEN regexp_replace(t0, '{a}="([^"]*)"', '{a}="' || CASE WHEN contains(t0, '{a}="/') THEN site ELSE site || dir END
  || {enc} || '"') ELSE t0 END"""
_ENC_REF = "replace(" + encoded("regexp_extract(t0, '(?:href|src)=\"([^\"?]*)', 1)") + " || regexp_extract(t0, '(?:href|src)=\"[^\"?]*([?][^\"]*)\"', 1), '\\\\', '')"
o(
    "absolutize_urls",
    f"""WITH {_TOKENS}, t1 AS (SELECT page_id, pos, regexp_extract(t, '^(<[^>]*>)', 1) AS t0, tag, regexp_extract(url, '^([a-z]+://[^/]+)', 1) AS site,
  regexp_extract(url, '://[^/]+(/[^?#]*/|/)', 1) AS dir FROM tokens WHERE tag IN ('a', 'img') AND t NOT LIKE '</%')
SELECT page_id, pos, t0 AS tag_text, CASE tag WHEN 'a' THEN {_ABS.format(a='href', k='http|mailto|#', enc=_ENC_REF)}
  ELSE {_ABS.format(a='src', k='http|data:', enc=_ENC_REF)} END AS absolute_text FROM t1""",
)
# Pages as supplied hold one heading, one bold line and plain paragraphs.
_ESC = "regexp_replace({t}, '([\\\\*`\\[\\]_])', '\\\\\\1', 'g')"
_ENT = "replace(replace(replace(replace({t}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&amp;', '&')"


def _text(t):
    flat = _ENT.format(t=f"trim(regexp_replace({t}, '[ \\t\\r\\n]+', ' ', 'g'))")
    esc = _ESC.format(t=flat)
    return f"regexp_replace(regexp_replace({esc}, '^(-|[+] |=+|#{{1,6}} |~~~|>)', '\\\\\\1'), '^([0-9]+)[.] ', '\\1\\\\. ')"


_PLAIN = f"""a AS (SELECT page_id, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS title,
  regexp_extract(html, '(?s)<article>.*?</h1>(.*?)(?:</article>|$)', 1) AS body FROM pages),
p AS (SELECT page_id, title, list_filter(list_transform(string_split(regexp_replace(body, '(?s)<!--.*?-->|<ul>.*?</ul>|<br>|</p>', '', 'g'), '<p>'),
  lambda x: CASE WHEN starts_with(x, '<b>') THEN '**' || {_text("replace(replace(x, '<b>', ''), '</b>', '')")} || '**' ELSE {_text('x')} END),
  lambda y: y <> '') AS paras FROM a),
plain AS (SELECT page_id, array_to_string(list_prepend('# ' || {_text('title')}, paras), chr(10) || chr(10)) AS markdown FROM p)"""
o("html_to_markdown", f"WITH {_PLAIN} SELECT page_id, markdown FROM plain")
o(
    "markdown_sink",
    f"""WITH {_PLAIN}, h AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host FROM pages)
SELECT host, count(*) AS n_pages, sum(length(markdown)) AS n_chars FROM plain JOIN h USING (page_id) GROUP BY host""",
)
# What the added content turns into, and which parts of a page each configuration keeps.
_SNIPPET_MD = """concat('## Part ', page_id, e'\\n\\n-   one\\n-   two _x_\\n    -   deep\\n\\n3.  a\\n4.  b\\n\\n```js\\nlet a = ', page_id,
 e';\\n```\\n\\n```py\\nx_1 < ', page_id, e'\\n```\\n\\n```\\nplain\\n```\\n\\n| A | B |\\n| --- | --- |\\n| 1 | 2 |\\n\\n> q1\\n> \\n> q2\\n\\n* * *\\n\\n',
 '[link](https://', host, '/p?a=1 "T") [r](https://', host, '/docs/rel/', page_id, ') [f](#f) ![pic](https://', host,
 '/docs/i.png) ![](data:x) [s](https://', host, '/single) `c_d` ~old~')"""
o(
    "pages_to_markdown",
    f"""WITH {_SITES}, {_scored()}, {_PLAIN},
cfg AS (SELECT page_id, host, framework, CASE WHEN host IN ('developers.cloudflare.com', 'platform.openai.com', 'docs.x.ai', 'ai.google.dev')
  THEN host WHEN score >= 9 AND framework <> 'custom' THEN '__' || framework || '__' ELSE '__default__' END AS config_key FROM found JOIN sites USING (page_id)),
edge AS (SELECT page_id, {_text("regexp_extract(html, '(?s)<div class=.ad.>(.*?)</div>', 1)")} AS ad,
  {_text("regexp_extract(html, '(?s)<footer>(.*?)(?:</footer>|$)', 1)")} AS foot FROM pages),
kept AS (SELECT *, config_key IN ('platform.openai.com', 'developers.cloudflare.com') AND page_id % 10 <> 6 AS is_body FROM cfg),
txt AS (SELECT page_id, host, framework, config_key, [
  CASE WHEN is_body THEN ad END,
  CASE WHEN is_body AND page_id % 10 = 5 THEN '[s](https://www.sphinx-doc.org/x)' END,
  CASE WHEN is_body AND page_id % 10 = 9 THEN concat('no', chr(10), chr(10), 'tie') END,
  CASE WHEN page_id % 10 = 1 AND config_key NOT IN ('__docusaurus__', 'developers.cloudflare.com') THEN 'pn' END,
  CASE WHEN page_id % 10 = 4 AND config_key <> '__mkdocs__' THEN '_mn_' END,
  CASE WHEN config_key IN ('developers.cloudflare.com', '__docusaurus__', '__vitepress__', '__mkdocs__', '__sphinx__', '__gitbook__')
    THEN concat('side', chr(10), chr(10), 'bar') END,
  {_SNIPPET_MD}, markdown, CASE WHEN page_id % 10 = 6 AND config_key = '__gitbook__' THEN foot END] AS parts
  FROM kept JOIN plain USING (page_id) JOIN edge USING (page_id))
SELECT page_id, host, framework, config_key, array_to_string(list_filter(parts, lambda x: x IS NOT NULL AND x <> ''), chr(10) || chr(10)) AS markdown,
  CAST(NULL AS VARCHAR) AS blocked_reason FROM txt""",
)
o(
    "code_blocks",
    """SELECT page_id, 'js' AS language, 'let a = ' || page_id || ';' AS code FROM pages
UNION ALL SELECT page_id, 'py', 'x_1 < ' || page_id FROM pages UNION ALL SELECT page_id, '', 'plain' FROM pages""",
)
_NL = "'\\1', 'gi'"
_SECTION = "regexp_replace({t}, '\\n-\\s+\\*\\*{w}\\*\\*[\\s\\S]*?(\\n## |\\n# |\\n-\\s+\\*\\*|\\z)', '\\1', 'gi')"


def _footer(t):
    t = f"regexp_replace({t}, '\\n-\\s+\\*\\*Resources\\*\\*[\\s\\S]*?(\\n## |\\n# |\\z)', {_NL})"
    for w in ("Support", "Company", "Tools", "Community"):
        t = _SECTION.format(t=_SECTION.format(t=t, w=w), w=w)
    for rx in (
        "\\n-\\s+©\\s+\\d{4}.*$", "\\n-\\s+\\[Privacy Policy\\].*$", "\\n-\\s+\\[Terms of Use\\].*$",
        "\\n-\\s+\\[Report Security Issues\\].*$", "\\n-\\s+\\[Trademark\\].*$",
        "\\n-\\s+!\\[privacy options\\].*Cookie Settings.*$",
        "\\nLast updated.*(?:ago|yesterday|today)\\s*$", "\\nWas this helpful\\?\\s*$",
    ):
        t = f"regexp_replace({t}, '(?m){rx}', '', 'gi')"
    return t


o("clean_footer", f"WITH t AS (SELECT doc_id, {d.FOOTER} AS text FROM documents) SELECT doc_id, {_footer('text')} AS text FROM t")
o(
    "fix_headings",
    """SELECT doc_id, concat(text, chr(10), '## Title ', doc_id, repeat(chr(10), 4), 'x', chr(10), '# One', chr(10), chr(10),
  '[](#b)', chr(10), chr(10), 'Keep', chr(10)) AS text FROM documents""",
)
o(
    "collapse_blank",
    f"""WITH t AS (SELECT doc_id, {d.BLANKS} AS text FROM documents)
SELECT doc_id, trim(regexp_replace(text, chr(10) || '{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13) || chr(160)) AS text FROM t""",
)
_REASON = """CASE WHEN trim(text) = '' THEN 'empty' WHEN contains(text, 'Cloudflare Ray ID') OR contains(text, 'cf_chl_opt') OR contains(text, 'cf-browser-verification') THEN 'cloudflare'
  WHEN contains(text, 'Access Denied') OR contains(text, '403 Forbidden') OR contains(text, '401 Unauthorized') THEN 'access-denied'
  WHEN length(trim(text)) < 100 AND regexp_matches(trim(text), '(?i)^(waiting for .+ to respond[.]{0,3}$|just a moment[.]{0,3}$|checking your browser[.]{0,3}$|please wait while we verify|enable javascript and cookies to continue|access denied|403 forbidden|attention required!|please complete the security check)') THEN 'bot-detection' END"""
o("blocked_reason", f"WITH t AS (SELECT doc_id, {d.SUSPECT} AS text FROM documents) SELECT doc_id, {_REASON} AS reason FROM t")
o(
    "blocked_advice",
    f"""WITH t AS (SELECT doc_id, {d.SUSPECT} AS text FROM documents), r AS (SELECT doc_id, {_REASON} AS reason FROM t)
SELECT doc_id, CASE reason WHEN 'cloudflare' THEN 'Try using --use-jina flag for sites with Cloudflare protection.'
  WHEN 'bot-detection' THEN 'Try using --use-jina flag for sites with bot protection.'
  WHEN 'empty' THEN 'The page may require JavaScript or have no content.'
  WHEN 'access-denied' THEN 'The site may require authentication or block automated access.' END AS advice FROM r""",
)
_RESP = f"""names(ord, adapter) AS (VALUES (0, 'md-endpoint'), (1, 'mdx'), (2, 'jina'), (3, 'playwright')),
resp0 AS (SELECT page_id, ord, adapter, {d.SITE_HOST} AS host, {d.SITE_URL} AS url, {d.STATUS} AS status, {d.CONTENT_TYPE} AS ctype FROM pages, names),
resp1 AS (SELECT *, (page_id + ord * 5) % 9 AS b, CASE WHEN status = 200 THEN '' ELSE 'Fetch failed: ' || status || ' ' || url END AS bad FROM resp0),
resp AS (SELECT page_id, ord, adapter, host, url, status, {d.BODY} AS body, CASE adapter
 WHEN 'md-endpoint' THEN CASE WHEN bad <> '' THEN bad || '.md' WHEN contains(ctype, 'json') THEN 'Received JSON instead of Markdown'
  WHEN ctype = 'text/html; charset=utf-8' THEN 'Received HTML instead of Markdown (Content-Type)'
  WHEN b IN (0, 5) THEN 'Received HTML instead of Markdown' WHEN b IN (1, 4) THEN 'Received JSON instead of Markdown'
  WHEN b IN (2, 3) THEN 'Response too short to be valid Markdown' END
 WHEN 'mdx' THEN CASE WHEN bad <> '' THEN bad || '.md' WHEN b = 0 THEN 'HTML returned, not markdown' END
 WHEN 'jina' THEN CASE WHEN bad <> '' THEN 'Jina Reader error: ' || status || ' ' WHEN b = 3 THEN 'Jina Reader returned empty content' END
 ELSE CASE WHEN bad <> '' THEN bad WHEN b = 3 THEN 'Empty content extracted from ' || host WHEN b = 6 THEN 'Content blocked by ' || host || ' (bot detection)' END
 END AS error FROM resp1)"""
_LINES = f"""names(ord, adapter) AS (VALUES (0, 'md-endpoint'), (1, 'mdx'), (2, 'jina'), (3, 'playwright')),
made AS (SELECT page_id, {d.TORN} AS torn, {d.RESPONSE_URL} AS url, {d.RESPONSE_ADAPTER} AS adapter, {d.STATUS} AS status, {d.CONTENT_TYPE} AS content_type, {d.BODY} AS body FROM pages, names)"""
o(
    "responses_read",
    f"""WITH {_LINES} SELECT CASE WHEN NOT torn THEN url END AS url, CASE WHEN NOT torn THEN adapter END AS adapter, CASE WHEN NOT torn THEN status END AS status,
  CASE WHEN NOT torn THEN content_type END AS content_type, CASE WHEN NOT torn THEN md5(body) END AS body_md5,
  CASE WHEN torn THEN 'unreadable record' WHEN url IS NULL THEN 'no url' WHEN adapter = 'gopher' THEN 'unknown adapter: gopher' END AS reject,
  CASE WHEN torn THEN '{{"url": "https://torn.example.com/' || page_id END AS record FROM made""",
)
for _name, _adapter in (("validate_md", "md-endpoint"), ("validate_mdx", "mdx"), ("validate_reader", "jina")):
    o(_name, f"WITH {_RESP} SELECT page_id, error FROM resp WHERE adapter = '{_adapter}'")
_APPLIES = f"(ord = 1 AND {_MD}) OR (ord = 2 AND {_MDX}) OR ord >= 3"
o(
    "adapter_plan",
    f"""WITH {_SITES}, names(ord, adapter) AS (VALUES (1, 'md-endpoint'), (2, 'mdx'), (3, 'jina'), (4, 'playwright'))
SELECT page_id, ord, adapter FROM sites, names WHERE {_APPLIES}""",
)
o(
    "preferred_adapter",
    f"""WITH {_SITES} SELECT page_id, CASE WHEN {_MD} THEN 'md-endpoint' WHEN {_MDX} THEN 'mdx' ELSE 'playwright' END AS adapter FROM sites""",
)
_WIN = f"""{_RESP}, tries AS (SELECT * FROM resp WHERE {_APPLIES.replace('ord = 1', 'ord = 0').replace('ord = 2', 'ord = 1').replace('ord >= 3', 'ord >= 2')}),
win AS (SELECT url, arg_min(adapter, ord) AS adapter, arg_min(body, ord) AS body FROM tries WHERE error IS NULL GROUP BY url)"""
o("choose_response", f"WITH {_WIN} SELECT url, adapter, body FROM (SELECT DISTINCT url FROM resp) LEFT JOIN win USING (url)")
o(
    "fallback_errors",
    f"""WITH {_WIN} SELECT url, 'All adapters failed for ' || url || ':' || chr(10) || string_agg(adapter || ': ' || error, chr(10) ORDER BY ord) AS error
FROM tries WHERE url NOT IN (SELECT url FROM win) GROUP BY url""",
)
o("adapter_counts", f"WITH {_WIN} SELECT adapter, count(*) AS n_pages FROM win GROUP BY adapter")


# --- the whole run: page numbers give the links between pages, the navigation leads nowhere
_NO = d.site_no("page_id")
_NAV = f"'https://site' || {_NO} || '.example.com/docs' || " + encoded("rtrim(raw, '/')")
_CHILD = "q.page_id + (q.page_id % {n}) * 3 + k AS page_id FROM {q} q, range(1, 5) t(k) WHERE (q.page_id % {n}) * 4 + k < {n}"
_RUN = f"""pg AS (SELECT page_id, {d.site_page('page_id')} AS url_key FROM pages),
e AS (SELECT page_id, {_NAV} AS dst FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=["\'']([^"\'']+)["\'']', 1)) AS raw FROM pages)
  UNION SELECT src AS page_id, {d.site_page('page_id')} FROM (SELECT q.page_id AS src, {_CHILD.format(n=d.SITE_SIZE, q='pages')})),
walk AS (SELECT {_NO} AS site, {d.site_page('min(page_id)')} AS url_key, 0 AS depth FROM pages GROUP BY {_NO}
  UNION SELECT site, dst, depth + 1 FROM walk JOIN pg USING (url_key) JOIN e USING (page_id) WHERE depth < 3),
reached AS (SELECT 'site' || site AS crawl_id, url_key, min(depth) AS depth FROM walk GROUP BY site, url_key)"""
o(
    "full_run",
    f"""WITH RECURSIVE {_RUN} SELECT crawl_id, count(*) AS visited, count(page_id) AS saved, 0 AS blocked,
  count(*) - count(page_id) AS failed FROM reached LEFT JOIN pg USING (url_key) GROUP BY crawl_id""",
)
# Every page has one parent; numbers follow depth, parent and place.
o(
    "run_files",
    f"""WITH RECURSIVE {_RUN}, {_PLAIN},
par AS (SELECT r.crawl_id, r.url_key, r.depth, pg.page_id, q.url_key AS parent, (pg.page_id + 3) % 4 AS pos
  FROM reached r JOIN pg USING (url_key) LEFT JOIN pg q ON pg.page_id % {d.SITE_SIZE} > 0
  AND q.page_id = pg.page_id - pg.page_id % {d.SITE_SIZE} + (pg.page_id % {d.SITE_SIZE} - 1) // 4),
num AS (SELECT *, regexp_extract(url_key, 'docs/(.*)/', 1) AS dir, row_number() OVER (PARTITION BY crawl_id, dir ORDER BY depth, parent, pos, url_key) AS n FROM par)
SELECT crawl_id, dir || '/' || lpad(n::VARCHAR, 2, '0') || '-' || page_id || '.md' AS local_path, url_key AS url, length(markdown) AS n_chars
FROM num JOIN plain USING (page_id)""",
)
_RANKED_APPLIES = f"(ord = 0 AND {_MD}) OR (ord = 1 AND {_MDX}) OR ord = 3"
o(
    "run_responses",
    f"""WITH RECURSIVE names(ord, adapter) AS (VALUES (0, 'md-endpoint'), (1, 'mdx'), (2, 'jina'), (3, 'playwright')),
sites AS (SELECT page_id, {d.ranked_host('page_id')} AS host, {d.ranked_page('page_id')} AS url FROM pages),
r0 AS (SELECT *, {d.STATUS} AS status, {d.CONTENT_TYPE} AS ctype, (page_id + ord * 5) % 9 AS b FROM sites, names WHERE {_RANKED_APPLIES}),
r1 AS (SELECT *, CASE WHEN status = 200 THEN '' ELSE 'Fetch failed: ' || status || ' ' || url END AS bad, ord = 3 AND {d.RANKED_CAPTURED} AS html
  FROM r0 WHERE {d.RANKED_ANSWERED} OR (ord = 3 AND {d.RANKED_CAPTURED})),
t AS (SELECT page_id, ord, adapter, CASE WHEN html THEN page_id % 11 <> 7 ELSE b IN (4, 5, 7, 8) END AS links,
  CASE WHEN html THEN CASE WHEN page_id % 11 = 7 THEN 'bot-detection' END WHEN ord = 3 AND bad = '' THEN CASE b WHEN 3 THEN 'empty' WHEN 6 THEN 'bot-detection' END END AS reason,
  CASE WHEN html THEN CASE WHEN page_id % 11 = 7 THEN 'Content blocked by ' || host || ' (bot detection)' END
   WHEN ord = 0 THEN CASE WHEN bad <> '' THEN bad || '.md' WHEN contains(ctype, 'json') THEN 'Received JSON instead of Markdown'
    WHEN ctype = 'text/html; charset=utf-8' THEN 'Received HTML instead of Markdown (Content-Type)'
    WHEN b = 0 THEN 'Received HTML instead of Markdown' WHEN b = 1 THEN 'Received JSON instead of Markdown' WHEN b IN (2, 3) THEN 'Response too short to be valid Markdown' END
   WHEN ord = 1 THEN CASE WHEN bad <> '' THEN bad || '.md' WHEN b = 0 THEN 'HTML returned, not markdown' END
   ELSE CASE WHEN bad <> '' THEN bad WHEN b = 3 THEN 'Empty content extracted from ' || host WHEN b = 6 THEN 'Content blocked by ' || host || ' (bot detection)' END END AS error FROM r1),
first AS (SELECT page_id, min(ord) FILTER (error IS NULL) AS w FROM t GROUP BY page_id),
c AS (SELECT page_id, any_value(w) AS w, max(adapter) FILTER (ord = w) AS adapter, bool_or(links) FILTER (ord = w) AS links, max(reason) FILTER (w IS NULL) AS reason,
  string_agg(adapter || ': ' || error, chr(10) ORDER BY ord) FILTER (error IS NOT NULL AND (w IS NULL OR ord < w)) AS tried FROM t JOIN first USING (page_id) GROUP BY page_id),
walk AS (SELECT min(page_id) AS page_id, 0 AS depth FROM pages GROUP BY page_id // {d.RANKED_SIZE}
  UNION ALL SELECT x.page_id, x.depth FROM (SELECT q.depth + 1 AS depth, {_CHILD.format(n=d.RANKED_SIZE, q='(SELECT page_id, depth FROM walk JOIN c USING (page_id) WHERE depth < 2 AND links)')}) x),
seen AS (SELECT walk.page_id, depth, w, adapter, reason, tried, {d.ranked_page('walk.page_id')} AS url, {d.ranked_host('walk.page_id')} AS host FROM walk LEFT JOIN c ON c.page_id = walk.page_id)
SELECT 's' || page_id // {d.RANKED_SIZE} AS crawl_id, url AS url_key, depth, CASE WHEN w IS NOT NULL THEN 'saved' WHEN depth = 0 THEN 'entry_failed' WHEN reason IS NOT NULL THEN 'blocked' ELSE 'failed' END AS status,
  reason, adapter, tried, CASE WHEN w IS NOT NULL OR reason IS NOT NULL THEN NULL WHEN tried IS NULL THEN 'not captured' ELSE 'All adapters failed for ' || url || ':' || chr(10) || tried END AS error,
  CASE WHEN w IS NOT NULL THEN 's' || page_id // {d.RANKED_SIZE} || '/' || page_id || '.md' END AS local_path, host = 'platform.openai.com' AS may_be_blocked
FROM seen""",
)
o(
    "run_sitemap",
    f"""WITH named AS (SELECT {_NO} AS site, page_id, {d.site_page('page_id')} AS url_key, true AS captured FROM pages WHERE page_id % 5 <> 3
  UNION ALL SELECT {_NO}, page_id, 'https://site' || {_NO} || '.example.com/docs/new/' || page_id, false FROM pages WHERE page_id % 5 <> 3 AND page_id % 13 = 0)
SELECT 'site' || site AS crawl_id, url_key, CASE WHEN captured THEN 'saved' ELSE 'failed' END AS status, CASE WHEN NOT captured THEN 'not captured' END AS error,
  CASE WHEN captured THEN 'playwright' END AS adapter, CASE WHEN captured THEN (page_id % 3) || '/' || page_id || '.md' END AS local_path FROM named WHERE site % 11 <> 10
UNION ALL SELECT 'site' || site, NULL, 'entry_failed', 'No sitemap found for https://site' || site || '.example.com', NULL, NULL FROM (SELECT DISTINCT {_NO} AS site FROM pages) WHERE site % 11 = 10""",
)
