"""Fixed rule values: documentation words, host lists, selectors, patterns, texts.

Everything here is small, constant data. Operators take these tables as keyword
arguments, so a caller can pass a different list without touching the operators.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# --- fixed values: path segments that mark the root of a documentation tree
DOC_WORDS = ("docs", "documentation", "guide", "guides", "api", "reference")

# --- fixed values: hosts that serve Markdown next to each page
MD_ENDPOINT_HOSTS = (
    "docs.anthropic.com",
    "docs.claude.com",
    "code.claude.com",
    "developers.openai.com",
)
MDX_HOSTS = ("platform.claude.com", "docs.anthropic.com", "vercel.com", "nextjs.org")

# --- fixed values: link targets that are never pages
SKIPPED_SUFFIXES = ("png", "jpg", "jpeg", "gif", "svg", "pdf", "zip", "tar", "gz")
BADGE_HOST_PARTS = ("shields.io", "badge", "img.")

# --- fixed values: places where a site may keep its sitemap, in order of preference
SITEMAP_PATHS = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml")

# --- fixed values: adapter names in the order they are tried
ADAPTERS = ("md-endpoint", "mdx", "jina", "playwright")

# --- fixed values: elements dropped from every page before anything else
NOISE_SELECTORS = (
    "script",
    "style",
    "noscript",
    "astro-island",
    "starlight-tabs-restore",
    "astro-breadcrumbs",
)

# --- fixed values: texts that show a blocked page
CLOUDFLARE_MARKERS = ("cf-browser-verification", "cf_chl_opt", "Cloudflare Ray ID")
ACCESS_DENIED_MARKERS = ("Access Denied", "403 Forbidden", "401 Unauthorized")
BOT_PATTERNS = (
    r"Waiting for .+ to respond\.{0,3}\z",
    r"Just a moment\.{0,3}\z",
    r"Checking your browser\.{0,3}\z",
    r"Please wait while we verify",
    r"Enable JavaScript and cookies to continue",
    r"Access denied",
    r"403 Forbidden",
    r"Attention Required!",
    r"Please complete the security check",
)
BLOCKED_ADVICE = (
    ("cloudflare", "Try using --use-jina flag for sites with Cloudflare protection."),
    ("bot-detection", "Try using --use-jina flag for sites with bot protection."),
    ("empty", "The page may require JavaScript or have no content."),
    ("access-denied", "The site may require authentication or block automated access."),
)
DEFAULT_ADVICE = "Try using --use-jina flag or check if the site is accessible."

# --- fixed values: white space as ECMAScript's \s sees it, for Java regex classes
JS_SPACE = r"\s\x0B\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_W = f"[{JS_SPACE}]"
# The same characters one by one, for trimming without a search.
JS_SPACE_CHARS = "".join(
    chr(c)
    for c in (*range(9, 14), 32, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F)
    + (0x205F, 0x3000, 0xFEFF)
)

# --- fixed values: footer text removed from Markdown, in order
_NEXT_HEADING = r"\n## |\n# "
FOOTER_RULES = (
    rf"(?i)\n-{_W}+\*\*Resources\*\*[\s\S]*?(?={_NEXT_HEADING}|\z)",
    rf"(?i)\n-{_W}+\*\*Support\*\*[\s\S]*?(?={_NEXT_HEADING}|\n-{_W}+\*\*|\z)",
    rf"(?i)\n-{_W}+\*\*Company\*\*[\s\S]*?(?={_NEXT_HEADING}|\n-{_W}+\*\*|\z)",
    rf"(?i)\n-{_W}+\*\*Tools\*\*[\s\S]*?(?={_NEXT_HEADING}|\n-{_W}+\*\*|\z)",
    rf"(?i)\n-{_W}+\*\*Community\*\*[\s\S]*?(?={_NEXT_HEADING}|\n-{_W}+\*\*|\z)",
    rf"(?im)\n-{_W}+©{_W}+\d{{4}}.*$",
    rf"(?im)\n-{_W}+\[Privacy Policy\].*$",
    rf"(?im)\n-{_W}+\[Terms of Use\].*$",
    rf"(?im)\n-{_W}+\[Report Security Issues\].*$",
    rf"(?im)\n-{_W}+\[Trademark\].*$",
    rf"(?im)\n-{_W}+!\[privacy options\].*Cookie Settings.*$",
    rf"(?im)\nLast updated.*(?:ago|yesterday|today){_W}*$",
    rf"(?im)\nWas this helpful\?{_W}*$",
)
# Every footer rule needs one of these line starts, so one search decides whether to run them.
FOOTER_HINT = (
    rf"(?i)\n(?:-{_W}+(?:\*\*(?:Resources|Support|Company|Tools|Community)\*\*|©"
    r"|\[(?:Privacy Policy|Terms of Use|Report Security Issues|Trademark)\]|!\[privacy options)"
    r"|Last updated|Was this helpful\?)"
)


@dataclass(frozen=True)
class SiteConfig:
    """How to cut the main content out of the pages of one site or framework."""

    key: str
    content: str
    remove: tuple[str, ...]
    framework: str
    may_be_blocked: bool = False


# --- fixed values: per-host and per-framework selectors
DEFAULT_KEY = "__default__"
SITE_CONFIGS = (
    SiteConfig(
        "developers.cloudflare.com",
        "[data-pagefind-body], main article, main",
        (
            "nav", "header", "footer", "script", "style", "noscript", "aside", "iframe",
            "astro-island", "starlight-tabs-restore", "astro-breadcrumbs",
            ".Breadcrumb", ".DocsSidebar", ".DocsFooter", ".PageFooter", ".feedback",
            ".DocsToc", ".copy-button", ".CopyCodeButton", '[class*="Footer"]',
            '[class*="pagination"]', '[class*="Pagination"]',
            '[href*="github.com"][href*="edit"]',
        ),
        "starlight",
    ),
    SiteConfig(
        "platform.openai.com",
        "main",
        (
            "nav", "header", "footer", '[role="navigation"]', '[role="complementary"]',
            ".sidebar", ".toc", ".breadcrumb",
        ),
        "custom",
        may_be_blocked=True,
    ),
    SiteConfig(
        "docs.x.ai",
        "article, main, .content",
        ("nav", "header", "footer", "aside", ".sidebar"),
        "custom",
    ),
    SiteConfig(
        "ai.google.dev",
        "article, main",
        ("nav", "header", "footer", "aside", ".devsite-nav"),
        "custom",
    ),
    SiteConfig(
        "__docusaurus__",
        ".theme-doc-markdown, article",
        (
            ".navbar", ".footer", ".pagination-nav", ".theme-doc-sidebar-container",
            ".theme-doc-toc-desktop", ".theme-doc-breadcrumbs",
        ),
        "docusaurus",
    ),
    SiteConfig(
        "__vitepress__",
        ".vp-doc, .content",
        (".VPNav", ".VPSidebar", ".VPFooter", ".VPDocAside", ".outline"),
        "vitepress",
    ),
    SiteConfig(
        "__starlight__",
        ".sl-markdown-content, article, [data-pagefind-body]",
        (
            "nav", "header", ".sidebar", ".right-sidebar", "script", "style",
            "astro-island", "starlight-tabs-restore", "astro-breadcrumbs",
            "[data-application-name]", ".feedback-widget", ".copy-button",
        ),
        "starlight",
    ),
    SiteConfig(
        "__mkdocs__",
        ".md-content, article",
        (".md-header", ".md-footer", ".md-sidebar", ".md-nav"),
        "mkdocs",
    ),
    SiteConfig(
        "__sphinx__",
        '#furo-main-content, .document, .body, article[role="main"], .rst-content',
        (
            ".sphinxsidebar", ".related", ".footer", ".clearer",
            ".sidebar-drawer", ".toc-drawer", ".toc-scroll", ".toc-tree-container",
            ".page-toc", ".content-icon-container", ".back-to-top", ".header-article",
            ".announcement",
            ".wy-nav-side", ".wy-nav-top", ".rst-footer-buttons", ".wy-side-nav-search",
            ".copybtn", ".copybutton", "button.copy",
        ),
        "sphinx",
    ),
    SiteConfig(
        "__gitbook__",
        "main",
        (
            "banner", "header", '[role="banner"]',
            "complementary", '[role="complementary"]',
            "contentinfo", '[role="contentinfo"]',
            'nav[aria-label="Breadcrumb"]', '[aria-label="Breadcrumb"]',
            'a[href][class*="Previous"]', 'a[href][class*="Next"]',
            'button[aria-label="Copy page"]', '[aria-label="Copy page"]',
            'button[aria-label="More"]',
            '[class*="feedback"]',
            '[data-testid="table-of-contents"]', '[data-testid="toc-scroll-container"]',
            '[class*="announcement"]',
        ),
        "gitbook",
    ),
    SiteConfig(
        DEFAULT_KEY,
        "main, article, .content, .docs-content, #content",
        (
            "nav", "header", "footer", "aside", ".sidebar", ".navigation", ".toc",
            ".breadcrumb", '[role="navigation"]', '[role="banner"]', '[role="contentinfo"]',
        ),
        "custom",
    ),
)


@dataclass(frozen=True)
class FrameworkRule:
    """Signals that a page was made by one documentation framework."""

    framework: str
    selectors: tuple[str, ...]
    html: tuple[str, ...] = field(default=())
    weight: int = 10
    # Lower-case words of which every page that matches an html pattern holds at least one; none
    # means that the patterns are always tried.
    hints: tuple[str, ...] = field(default=())


# --- fixed values: framework signals, in tie-break order
FRAMEWORK_RULES = (
    FrameworkRule(
        "docusaurus",
        (
            ".theme-doc-markdown", ".docusaurus-highlight-code-line", ".navbar__brand",
            ".menu__link", '[class*="docusaurus"]', ".pagination-nav",
        ),
        (
            r"(?i)docusaurus",
            r"(?i)<meta[^>]*generator[^>]*Docusaurus",
            r"/@docusaurus/",
            r"docusaurus\.config",
        ),
        hints=("docusaurus",),
    ),
    FrameworkRule(
        "vitepress",
        (".vp-doc", ".VPNav", ".VPSidebar", ".VPContent", ".vp-code", '[class*="VPHome"]'),
        (
            r"(?i)vitepress",
            r"(?i)<meta[^>]*generator[^>]*VitePress",
            r"vitepress\.css",
            r"__VP_",
        ),
        hints=("vitepress", "__vp_"),
    ),
    FrameworkRule(
        "starlight",
        (".sl-markdown-content", "[data-starlight]", ".starlight-aside", "astro-island"),
        (
            r"(?i)starlight",
            r"(?i)<meta[^>]*generator[^>]*Astro",
            r"Starlight",
            r"@astrojs/starlight",
        ),
        hints=("starlight", "astro"),
    ),
    FrameworkRule(
        "mkdocs",
        (".md-content", ".md-header", ".md-sidebar", ".md-nav", "[data-md-component]"),
        (
            r"(?i)mkdocs",
            r"(?i)<meta[^>]*generator[^>]*mkdocs",
            r"(?i)material-?for-?mkdocs",
            r"mkdocs\.yml",
        ),
        hints=("mkdocs",),
    ),
    FrameworkRule(
        "sphinx",
        (
            ".sphinxsidebar", ".document", ".bodywrapper", '[class*="sphinx"]',
            ".rst-content", "#furo-main-content", ".furo-main",
            '[href*="sphinx-doc.org"]',
        ),
        (
            r"(?i)sphinx",
            r"(?i)<meta[^>]*generator[^>]*Sphinx",
            r"sphinx_rtd_theme",
            r"_static/sphinx",
            r"(?i)pradyunsg.*furo",
            r"(?i)furo\.css",
            r"(?i)Made with.*Sphinx",
        ),
        hints=("sphinx", "furo"),
    ),
    FrameworkRule(
        "gitbook",
        (
            ".gitbook-root", "[data-gitbook]", ".space-navigation", ".page-inner",
            '[class*="page-width-default"]', '[class*="site-width-default"]',
            '[data-testid="table-of-contents"]',
            '[href*="gitbook.com"][href*="utm_source"]',
        ),
        (
            r"(?i)gitbook",
            r"app\.gitbook\.com",
            r"gitbook-x-reason",
            r"(?i)Powered by GitBook",
            r"gitbook\.io",
        ),
        hints=("gitbook",),
    ),
)

# --- fixed values: a framework's own configuration is used from this confidence on; full
# confidence is at this score
MIN_CONFIDENCE = 0.3
FULL_SCORE = 30

# --- fixed values: elements of HTML
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
    "source", "track", "wbr",
)
BLOCK_TAGS = (
    "address", "article", "aside", "body", "center", "dd", "details", "dialog", "dir",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "header",
    "hgroup", "html", "main", "menu", "nav", "noscript", "p", "pre", "section", "summary",
    "caption", "table",
)

# --- fixed values: characters that the numeric references 128 to 159 stand for, as in Windows-1252
WINDOWS_1252 = (
    0x20AC, 0x81, 0x201A, 0x0192, 0x201E, 0x2026, 0x2020, 0x2021, 0x02C6, 0x2030, 0x0160, 0x2039, 0x0152, 0x8D, 0x017D, 0x8F,
    0x90, 0x2018, 0x2019, 0x201C, 0x201D, 0x2022, 0x2013, 0x2014, 0x02DC, 0x2122, 0x0161, 0x203A, 0x0153, 0x9D, 0x017E, 0x0178,
)

# --- fixed values: patterns of links and sitemaps, and the message of a site without one
MARKDOWN_LINK = r"\[[^\]]+\]\(([^)]+)\)"
HREF = r"""href=["']([^"']+)["']"""
SITEMAP_PAGE = r"<url>\s*<loc>([^<]+)</loc>"
SITEMAP_CHILD = r"<sitemap>\s*<loc>([^<]+)</loc>"
NO_SITEMAP = "No sitemap found for "
