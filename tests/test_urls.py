import pytest

from corpusloom.functions import urls as U


@pytest.mark.parametrize("url, error, warning", [
    ("", U.MSG_EMPTY, None),
    ("  ", U.MSG_EMPTY, None),
    ("example.org/x", U.MSG_NO_SCHEME, None),
    ("ftp://example.org", U.MSG_BAD_SCHEME, None),
    ("http:///path", U.MSG_NO_DOMAIN, None),
    ("https://bad_host/", U.MSG_BAD_DOMAIN, None),
    ("https://user@example.org/", U.MSG_BAD_DOMAIN, None),
    ("https://www.example.org:8443/a b", None, None),
    ("HTTPS://Example.org", None, None),
    ("http://localhost:80", None, U.MSG_PRIVATE),
    ("http://172.20.1.1/", None, U.MSG_PRIVATE),
    ("http://172.32.1.1/", None, None),
    ("http://110.1.1.1/", None, U.MSG_PRIVATE),
])
def test_validate(one, url, error, warning):
    r = one(U.validate_url, url=url)
    assert (r.is_valid, r.error_message, r.warning_message) == (error is None, error, warning)


@pytest.mark.parametrize("url, expected", [
    (" HTTP://Ex.ORG/Path?Q=1#f ", "http://ex.org/Path?Q=1"),
    ("http://a.b/c?", "http://a.b/c"),
    ("/only/path", "/only/path"),
])
def test_normalize(one, url, expected):
    assert one(U.normalize_url, url=url) == expected


@pytest.mark.parametrize("ref, expected", [
    ("/x", "https://a.b/x"), ("y", "https://a.b/d/y"), ("../z", "https://a.b/z"), ("./q?r=1", "https://a.b/d/q?r=1"),
    ("//c.d/e", "https://c.d/e"), ("?n=2", "https://a.b/d/p?n=2"), ("#s", "https://a.b/d/p?k=1#s"),
    ("http://o/", "http://o/"), ("", "https://a.b/d/p?k=1"), ("/m/../n/./o", "https://a.b/n/o"), ("../../../u", "https://a.b/u"),
])
def test_resolve(one, ref, expected):
    from urllib.parse import urljoin

    base = "https://a.b/d/p?k=1"
    assert one(lambda r: U.resolve_url(one_base(base), r), ref=ref) == expected
    if ref:
        assert urljoin(base, ref) == expected


def one_base(url):
    from pyspark.sql import functions as F

    return F.lit(url)


@pytest.mark.parametrize("url, method", [
    ("https://docs.example.org", "documentation"), ("https://example.org/sitemap.xml", "sitemap"),
    ("https://example.org/sitemap_index.xml?x", "sitemap"), ("https://example.org/page.html", "single"),
    ("https://example.org/document.PDF", "single"), ("https://example.org", "documentation"),
    ("https://example.org/v1.2/x", "website"), ("", "unknown"),
])
def test_method(one, url, method):
    assert one(U.detect_method, url=url) == method


@pytest.mark.parametrize("name, expected", [
    ("My Site_v1.0!", "my-site-v1-0"), ("a", "a-kb"), ("", "default-collection"), ("--x--", "x-kb"), ("é", "-kb"),
    ("n" * 80, "n" * 51 + "-1b82bdea"),
])
def test_sanitize(one, name, expected):
    assert one(U.sanitize_name, name=name) == expected


def test_long_names_that_differ_late_stay_different(one):
    names = {one(U.sanitize_name, name="n" * 70 + end) for end in ("", "a", "b", "a-b")}
    assert len(names) == 4 and all(len(name) == 60 for name in names)


@pytest.mark.parametrize("url, expected", [
    ("https://docs.example.org/a/b/", "docs-example-org-a-b"), ("https://example.org/", "example-org"),
    ("/data/my.notes.txt", "my-notes"), (" ", "default-collection"),
])
def test_name_from_url(one, url, expected):
    assert one(U.name_from_url, url=url) == expected


@pytest.mark.parametrize("title, expected", [
    ("Guide | Docs", "Guide"), ("A | B - Home", "A - B"), ("Docs", "My-Site"), ("", "My-Site"), ("Intro Documentation", "Intro"),
])
def test_clean_name(one, title, expected):
    assert one(U.clean_name, title=title, url="https://www.my-site.example.org/") == expected


def test_site_type_order_of_ties(one):
    def of(url, title=None, h1=None):
        from pyspark.sql import functions as F

        h = F.array(F.lit(h1)) if h1 else F.lit(None).cast("array<string>")
        return one(lambda u: U.site_type(u, F.lit(title), h), url=url)

    assert of("https://x.org")["site_type"] == "unknown"
    assert of("https://x.org")["indicators"] == ["No clear indicators found"]
    # shop by url (0.3) was scored before wiki by title (0.3)
    r = of("https://shop.x.org", "Our Wiki")
    assert (r.site_type, r.confidence) == ("ecommerce", 0.3)
    r = of("https://docs.x.org/api.v1/reference/guide/manual", "API docs", "Installation")
    assert (r.site_type, r.confidence) == ("documentation", 1.0)


def test_probe(one):
    r = one(U.classify_probe, status=200, seconds=6.25, error=None)
    assert (r.is_valid, r.warning_message) == (True, "Langsame Antwortzeit (6.2s)")
    assert one(U.classify_probe, status=418, seconds=0.1, error=None).error_message == "Unerwarteter HTTP Status: 418"
