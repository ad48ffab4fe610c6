"""HTML columns: head fields, headings, links and the markdown-like text of a page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import strip
from corpusloom.functions.urls import resolve_url

# ---- fixed values -----------------------------------------------------------
TITLE = r"(?is)<title[^>]*>(.*?)</title>"
ENTITY = r"&[a-zA-Z0-9#]+;"
HTML_LANG = r"""(?i)<html[^>]*lang=["']?([^"'>\s]+)"""
CANONICAL = r"""(?i)<link[^>]*rel=["']?canonical["']?[^>]*href=["']([^"']*)["']"""
H1 = r"(?is)<h1[^>]*>(.*?)</h1>"
HREF = r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""


def meta_patterns(name: str) -> list[str]:
    return [
        rf"""(?i)<meta\s+name=["']?{name}["']?\s+content=["']([^"']*)["'][^>]*>""",
        rf"""(?i)<meta\s+content=["']([^"']*)["']?\s+name=["']?{name}["'][^>]*>""",
    ]


# Page text rules, applied in this order.
MARKDOWN_RULES = [
    (r"(?s)<!--.*?-->", ""),
    (
        r"(?is)<head\b[^>]*>.*?</head>|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>"
        r"|<nav\b[^>]*>.*?</nav>|<footer\b[^>]*>.*?</footer>",
        "",
    ),
    *[(rf"(?is)<h{n}\b[^>]*>(.*?)</h{n}>", "\n\n" + "#" * n + " $1\n\n") for n in range(1, 7)],
    (r"(?i)<li\b[^>]*>", "\n- "),
    (r"(?i)</?p\b[^>]*>", "\n\n"),
    (r"(?i)<br\b[^>]*>|</?(?:div|ul|ol|article|section|main|table|tr|body|html)\b[^>]*>", "\n"),
    (r"<[^>]+>", ""),
    (r"&nbsp;", " "), (r"&lt;", "<"), (r"&gt;", ">"), (r"&quot;", '"'), (r"&#39;", "'"),
    (r"&copy;", "©"), (r"&middot;", "·"), (r"&amp;", "&"),
    (r"[ \t\r]+", " "),
    (r" ?\n ?", "\n"),
    (r"\n{3,}", "\n\n"),
]
# ------------------------------------------------------------------------------


def _tidy(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, ENTITY, " "), r"\s+", " "))


def _null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def html_title(html: Column) -> Column:
    return _null_if_empty(_tidy(F.regexp_extract(html, TITLE, 1)))


def html_meta(html: Column, name: str) -> Column:
    """Content of the first matching meta tag in either attribute order; null when absent."""
    found = [F.when(html.rlike(p), strip(F.regexp_extract(html, p, 1))) for p in meta_patterns(name)]
    return F.coalesce(*found)


def html_lang(html: Column) -> Column:
    return F.coalesce(
        _null_if_empty(F.regexp_extract(html, HTML_LANG, 1)), _null_if_empty(html_meta(html, "language"))
    )


def html_canonical(html: Column, base: Column) -> Column:
    return F.when(html.rlike(CANONICAL), resolve_url(base, F.regexp_extract(html, CANONICAL, 1)))


def html_h1(html: Column) -> Column:
    texts = F.transform(
        F.regexp_extract_all(html, F.lit(H1), 1), lambda h: _tidy(F.regexp_replace(h, r"<[^>]+>", ""))
    )
    return F.array_remove(texts, "")


def html_to_markdown(html: Column) -> Column:
    for pattern, replacement in MARKDOWN_RULES:
        html = F.regexp_replace(html, pattern, replacement)
    return strip(html)


def html_hrefs(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(HREF), 1)
