"""URL columns: parts, validation, normalisation, routing and naming.

All parts come from regular expressions: the built-in URL parser returns null
for inputs (a space in the path, say) that a lenient parser accepts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import WS_CLASS, strip

# ---- fixed values -----------------------------------------------------------
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"
QUERY = r"^[^?#]*\?([^#]*)"
DOMAIN = r"^[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?(\.[a-zA-Z0-9]([a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?)*$"
PRIVATE_HOSTS = [r"localhost", r"127\.0\.0\.1", r"192\.168\.", r"10\.", r"172\.(1[6-9]|2[0-9]|3[0-1])\."]

MSG_EMPTY = "URL darf nicht leer sein"
MSG_NO_SCHEME = "URL muss mit http:// oder https:// beginnen"
MSG_BAD_SCHEME = "Nur HTTP und HTTPS URLs sind erlaubt"
MSG_NO_DOMAIN = "URL muss eine gültige Domain enthalten"
MSG_BAD_DOMAIN = "Ungültiges Domain-Format"
MSG_PRIVATE = "Lokale oder private IP-Adresse erkannt"

SITEMAP_PATTERNS = [
    r"sitemap\.xml$", r"sitemap_index\.xml$", r"sitemaps\.xml$", r"sitemap-index\.xml$",
    r"/sitemap\.xml$", r"/sitemap_index\.xml$", r"/sitemap/$", r"/sitemaps/$",
    r"sitemap\.xml\?", r"sitemap_index\.xml\?",
]
SINGLE_PAGE_PATTERNS = [
    r"\.html?$", r"\.php$", r"\.aspx?$", r"\.jsp$", r"\.pdf$", r"/[^/]+\.html?$", r"/[^/]+\.php$",
]
DOCUMENTATION_PATTERNS = [
    r"^https?://[^/]+/?$", r"^https?://[^/]+/[^.]*/?$",
    r"docs?\.", r"help\.", r"support\.", r"knowledge\.", r"wiki\.",
    r"/docs?/", r"/help/", r"/support/", r"/wiki/", r"/knowledge/", r"/guide/", r"/tutorial/", r"/manual/",
]

SITE_URL_PATTERNS = {
    "documentation": (0.3, [r"docs?\.", r"documentation", r"manual", r"guide", r"api\.", r"developer", r"reference"]),
    "blog": (0.3, [r"blog", r"news", r"article", r"post", r"medium\.com", r"wordpress", r"blogspot"]),
    "wiki": (0.4, [r"wiki", r"confluence", r"notion\.so"]),
    "ecommerce": (0.3, [r"shop", r"store", r"cart", r"product", r"buy", r"amazon\.", r"ebay\."]),
}
SITE_TITLE_WORDS = {
    "documentation": (0.2, ["documentation", "docs", "api", "reference", "guide"], "Title suggests documentation"),
    "blog": (0.2, ["blog", "news", "article"], "Title suggests blog/news"),
    "wiki": (0.3, ["wiki"], "Title suggests wiki"),
}
SITE_H1_WORDS = {
    "documentation": (
        0.15, ["getting started", "installation", "quickstart", "tutorial"], "H1 tags suggest documentation"
    ),
}

TITLE_SUFFIXES = [
    "| Documentation", "- Documentation", "Documentation",
    "| Docs", "- Docs", "Docs",
    "| Home", "- Home", "Home",
    "| Welcome", "- Welcome", "Welcome",
]
# ------------------------------------------------------------------------------


def any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, SCHEME, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, NETLOC, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, PATH, 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, QUERY, 1)


def urldefrag(url: Column) -> Column:
    return F.split_part(url, F.lit("#"), F.lit(1))


def validate_url(url: Column) -> Column:
    """struct(is_valid, error_message, warning_message) of the syntax check."""
    u = strip(F.coalesce(url, F.lit("")))
    host = F.split_part(netloc(u), F.lit(":"), F.lit(1))
    error = (
        F.when(u == "", MSG_EMPTY)
        .when(scheme(u) == "", MSG_NO_SCHEME)
        .when(~scheme(u).isin("http", "https"), MSG_BAD_SCHEME)
        .when(netloc(u) == "", MSG_NO_DOMAIN)
        .when(~host.rlike(DOMAIN), MSG_BAD_DOMAIN)
    )
    warning = F.when(error.isNull() & host.rlike("(?i)" + any_of(PRIVATE_HOSTS)), MSG_PRIVATE)
    return F.struct(
        error.isNull().alias("is_valid"), error.alias("error_message"), warning.alias("warning_message")
    )


def normalize_url(url: Column) -> Column:
    """Trim, lower-case scheme and host, drop the fragment; path and query stay as they are."""
    u = strip(url)
    return F.concat(
        F.when(scheme(u) != "", F.concat(scheme(u), F.lit(":"))).otherwise(""),
        F.when(netloc(u) != "", F.concat(F.lit("//"), F.lower(netloc(u)))).otherwise(""),
        path(u),
        F.when(query(u) != "", F.concat(F.lit("?"), query(u))).otherwise(""),
    )


def extract_domain(url: Column) -> Column:
    host = F.lower(netloc(url))
    return F.split_part(F.regexp_replace(host, r"^www\.", ""), F.lit(":"), F.lit(1))


def is_same_domain(a: Column, b: Column) -> Column:
    return F.coalesce(extract_domain(a) == extract_domain(b), F.lit(False))


def base_url(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def remove_dot_segments(p: Column) -> Column:
    """Resolve `.` and `..` inside an absolute path by one fold over its segments."""
    segments = F.split(p, "/")
    kept = F.aggregate(
        F.slice(segments, F.lit(2), F.size(segments)),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(s))),
    )
    tail = F.when(p.rlike(r"/\.\.?$"), F.lit("/")).otherwise("")
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"), tail)
    return F.when(p.rlike(r"/\.\.?(?:/|$)"), F.regexp_replace(resolved, "^//", "/")).otherwise(p)


def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute form of `ref` found on the page `base`."""
    root = F.concat(scheme(base), F.lit("://"), netloc(base))
    directory = F.regexp_replace(path(base), r"[^/]*$", "")
    directory = F.when(directory == "", "/").otherwise(directory)
    rest = F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)
    return (
        F.when(ref == "", base)
        .when(F.regexp_extract(ref, SCHEME, 1) != "", ref)
        .when(ref.startswith("//"), F.concat(scheme(base), F.lit(":"), ref))
        .when(ref.startswith("/"), F.concat(root, remove_dot_segments(path(ref)), rest))
        .when(ref.startswith("?"), F.concat(root, path(base), ref))
        .when(ref.startswith("#"), F.concat(urldefrag(base), ref))
        .otherwise(F.concat(root, remove_dot_segments(F.concat(directory, path(ref))), rest))
    )


def route_url(url: Column) -> Column:
    """Ingest route: text file, sitemap or site."""
    return (
        F.when(url.endswith(".txt") | url.endswith(".md"), "text")
        .when(url.endswith("sitemap.xml") | path(url).contains("sitemap"), "sitemap")
        .otherwise("site")
    )


def detect_method(url: Column) -> Column:
    u = F.lower(strip(F.coalesce(url, F.lit(""))))
    return (
        F.when(u == "", "unknown")
        .when(u.rlike(any_of(SITEMAP_PATTERNS)), "sitemap")
        .when(u.rlike(any_of(SINGLE_PAGE_PATTERNS)), "single")
        .when(u.rlike(any_of(DOCUMENTATION_PATTERNS)), "documentation")
        .otherwise("website")
    )


def _contains_any(c: Column, words: list[str]) -> Column:
    return c.rlike(any_of(words))


def site_type(url: Column, title: Column, h1: Column) -> Column:
    """struct(site_type, confidence, indicators) from URL, title and H1 evidence.

    A type's place in the tie order is the first kind of evidence that scored it:
    URL evidence counts before title evidence, that before headings.
    """
    u = F.lower(url)
    t = F.lower(F.coalesce(title, F.lit("")))
    h = F.lower(F.array_join(F.coalesce(h1, F.array().cast("array<string>")), " "))
    kinds = list(SITE_URL_PATTERNS)
    indicators, candidates = [], []
    title_hit, h1_hit = {}, {}
    for kind, (_, patterns) in SITE_URL_PATTERNS.items():
        indicators += [F.when(u.rlike(p), F.lit(f"URL contains '{p}'")) for p in patterns]
    for kind, (_, words, label) in SITE_TITLE_WORDS.items():
        title_hit[kind] = _contains_any(t, words)
        indicators.append(F.when(title_hit[kind], F.lit(label)))
    for kind, (_, words, label) in SITE_H1_WORDS.items():
        h1_hit[kind] = _contains_any(h, words)
        indicators.append(F.when(h1_hit[kind], F.lit(label)))
    for pos, kind in enumerate(kinds):
        weight, patterns = SITE_URL_PATTERNS[kind]
        hits = sum((u.rlike(p).cast("int") for p in patterns), F.lit(0))
        by_url = hits * F.lit(weight)
        by_title = (
            F.when(title_hit[kind], SITE_TITLE_WORDS[kind][0]).otherwise(0.0) if kind in title_hit else F.lit(0.0)
        )
        by_h1 = F.when(h1_hit[kind], SITE_H1_WORDS[kind][0]).otherwise(0.0) if kind in h1_hit else F.lit(0.0)
        place = F.when(by_url > 0, pos).when(by_title > 0, len(kinds) + pos).otherwise(2 * len(kinds) + pos)
        candidates.append(
            F.struct(
                F.round(by_url + by_title + by_h1, 6).alias("score"), (-place).alias("place"), F.lit(kind).alias("kind")
            )
        )
    best = F.array_max(F.array(*candidates))
    found = F.array_compact(F.array(*indicators))
    return F.struct(
        F.when(best.score > 0, best.kind).otherwise("unknown").alias("site_type"),
        F.least(best.score, F.lit(1.0)).alias("confidence"),
        F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("No clear indicators found"))).alias("indicators"),
    )


def sanitize_name(name: Column) -> Column:
    """Collection name: lower case, hyphens for separators, 60 characters, no outer hyphens.

    A longer name ends in a hash of the whole, so that two of them stay apart.
    """
    n = F.regexp_replace(F.lower(name), r"[\s_.]+", "-")
    n = F.regexp_replace(n, r"[^a-z0-9-]", "")
    short = F.concat(F.substring(n, 1, 51), F.lit("-"), F.substring(F.md5(n), 1, 8))
    n = F.btrim(F.when(F.length(n) > 60, short).otherwise(n), F.lit("-"))
    n = F.when(F.length(n) < 3, F.concat(n, F.lit("-kb"))).otherwise(n)
    return F.when(F.coalesce(name, F.lit("")) == "", "default-collection").otherwise(n)


def name_from_url(url: Column) -> Column:
    p = path(url)
    stem = F.regexp_replace(F.regexp_extract(url, r"([^/]*)$", 1), r"([^.])\.[^.]*$", "$1")
    site = F.concat(
        netloc(url),
        F.when(p.isin("", "/"), "").otherwise(F.rtrim(F.translate(p, "/", "-"), F.lit("-"))),
    )
    blank = strip(F.coalesce(url, F.lit(""))) == ""
    return F.when(blank, "default-collection").otherwise(
        sanitize_name(F.when(netloc(url) == "", stem).otherwise(site))
    )


def suffix_pattern(suffix: str) -> str:
    return WS_CLASS + "*" + suffix.replace("|", r"\|") + r"\z"


def clean_name(title: Column, url: Column) -> Column:
    """Display name from a page title, else from the first host label."""
    t = F.coalesce(title, F.lit(""))
    for suffix in TITLE_SUFFIXES:  # a chain of replacements, one pass each: the expression stays linear
        t = F.regexp_replace(t, suffix_pattern(suffix), "")
    t = strip(F.replace(F.translate(t, "|", "-"), F.lit("  "), F.lit(" ")))
    label = F.lower(F.split_part(F.replace(netloc(url), F.lit("www.")), F.lit("."), F.lit(1)))
    titled = F.array_join(
        F.transform(F.regexp_extract_all(label, F.lit(r"([a-z]+|[^a-z]+)"), 1), F.initcap), ""
    )
    return F.when(F.length(t) > 3, t).otherwise(titled)


def classify_probe(status: Column, seconds: Column, error: Column) -> Column:
    """struct(is_valid, error_message, warning_message) for one reachability probe."""
    shown = F.call_function("format_number", seconds, F.lit("0.0"))
    code = status.cast("string")
    message = (
        F.when(error == "timeout", "Timeout nach 10 Sekunden")
        .when(error == "connection", "Verbindung zur URL fehlgeschlagen")
        .when(error == "redirects", "Zu viele Weiterleitungen")
        .when(error.isNotNull(), F.concat(F.lit("Netzwerk-Fehler: "), error))
        .when((status == 200) | status.between(300, 399), F.lit(None))
        .when(status == 403, "Zugriff verweigert (403 Forbidden)")
        .when(status == 404, "Seite nicht gefunden (404 Not Found)")
        .when(status == 429, "Zu viele Anfragen (429 Rate Limited)")
        .when(status.between(500, 599), F.concat(F.lit("Server-Fehler (HTTP "), code, F.lit(")")))
        .otherwise(F.concat(F.lit("Unerwarteter HTTP Status: "), code))
    )
    warning = (
        F.when(message.isNotNull(), F.lit(None))
        .when(status.between(300, 399), F.concat(F.lit("URL leitet weiter (Status "), code, F.lit(")")))
        .when(seconds > 5.0, F.concat(F.lit("Langsame Antwortzeit ("), shown, F.lit("s)")))
        .when(seconds > 3.0, F.concat(F.lit("Mäßige Antwortzeit ("), shown, F.lit("s)")))
    )
    return F.struct(
        message.isNull().alias("is_valid"), message.alias("error_message"), warning.alias("warning_message")
    )
