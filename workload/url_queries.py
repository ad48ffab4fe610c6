"""URL columns (and the dimension lookups keyed by them) over the page table."""

from pyspark.sql import functions as F

from corpusloom.functions import urls as U
from corpusloom.functions.html import html_h1, html_title
from corpusloom.operators.dims import method_settings, model_info, site_settings
from workload.base import query, strip_sql, table

# ---- derived inputs: several forms of every page url --------------------------


def url_variants(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    tail = F.regexp_extract("url", r"^https?://[^/]+(.*)$", 1)
    forms = [
        F.col("url"),
        F.concat(F.lit("  "), F.upper("url"), F.lit("\n")),
        F.concat(F.lit("https://www."), host, F.lit(":8443"), tail),
        F.concat(F.lit("ftp://"), host, tail),
        F.concat(host, tail),
        F.concat(F.lit("http://192.168.0."), F.col("page_id").cast("string"), F.lit("/a b")),
        F.concat(F.lit("http://110.0.0."), F.col("page_id").cast("string")),
        F.concat(F.lit("https://"), host, F.lit("/docs/sitemap.xml?x="), F.col("page_id").cast("string")),
        F.concat(F.lit("https://"), host, F.lit("/a/"), F.col("page_id").cast("string"), F.lit(".php")),
        F.concat(F.lit("https://"), host, F.lit("/notes_"), F.col("page_id").cast("string"), F.lit(".txt")),
        F.concat(F.lit("https://shop.wiki."), host, F.lit("/v1.2/x?#f")),
        F.lit(""),
        F.concat(F.lit("https://-bad-/"), tail),
    ]
    return p.select("page_id", F.posexplode(F.array(*forms)).alias("form", "url"))


V = r"""
    b_ AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS h,
             regexp_extract(url, '^https?://[^/]+(.*)$', 1) AS t FROM pages),
    l_ AS (SELECT page_id, [url, '  ' || upper(url) || chr(10), 'https://www.' || h || ':8443' || t,
             'ftp://' || h || t, h || t, 'http://192.168.0.' || page_id || '/a b', 'http://110.0.0.' || page_id,
             'https://' || h || '/docs/sitemap.xml?x=' || page_id, 'https://' || h || '/a/' || page_id || '.php',
             'https://' || h || '/notes_' || page_id || '.txt', 'https://shop.wiki.' || h || '/v1.2/x?#f', '',
             'https://-bad-/' || t] AS f FROM b_),
    v AS (SELECT page_id, (i - 1)::BIGINT AS form, f[i] AS url FROM l_, range(1, 14) AS r(i))"""


def scheme_sql(u):
    return rf"lower(regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1))"


def netloc_sql(u):
    return rf"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1)"


def path_sql(u):
    return rf"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def query_sql(u):
    return rf"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


TRIMMED = f"t AS (SELECT page_id, form, {strip_sql('url')} AS u FROM v)"


@query("url_validate", f"""
WITH {V}, {TRIMMED},
p AS (SELECT *, {scheme_sql('u')} AS s, {netloc_sql('u')} AS n, split_part({netloc_sql('u')}, ':', 1) AS h FROM t),
e AS (SELECT *, CASE WHEN u = '' THEN '{U.MSG_EMPTY}' WHEN s = '' THEN '{U.MSG_NO_SCHEME}'
  WHEN s NOT IN ('http', 'https') THEN '{U.MSG_BAD_SCHEME}' WHEN n = '' THEN '{U.MSG_NO_DOMAIN}'
  WHEN NOT regexp_matches(h, '{U.DOMAIN}') THEN '{U.MSG_BAD_DOMAIN}' END AS error_message FROM p)
SELECT page_id, form, error_message IS NULL AS is_valid, error_message,
  CASE WHEN error_message IS NULL AND regexp_matches(h, '(?i){U.any_of(U.PRIVATE_HOSTS)}') THEN '{U.MSG_PRIVATE}' END
    AS warning_message FROM e""")
def url_validate(spark, sf_dir):
    return url_variants(spark, sf_dir).select("page_id", "form", U.validate_url(F.col("url")).alias("r")).select(
        "page_id", "form", "r.*")


@query("url_normalize", f"""
WITH {V}, {TRIMMED}
SELECT page_id, form,
  CASE WHEN {scheme_sql('u')} <> '' THEN {scheme_sql('u')} || ':' ELSE '' END ||
  CASE WHEN {netloc_sql('u')} <> '' THEN '//' || lower({netloc_sql('u')}) ELSE '' END || {path_sql('u')} ||
  CASE WHEN {query_sql('u')} <> '' THEN '?' || {query_sql('u')} ELSE '' END AS normalized FROM t""")
def url_normalize(spark, sf_dir):
    return url_variants(spark, sf_dir).select("page_id", "form", U.normalize_url(F.col("url")).alias("normalized"))


@query("url_parts", f"""
WITH {V}
SELECT page_id, form, split_part(regexp_replace(lower({netloc_sql('url')}), '^www\\.', ''), ':', 1) AS domain,
  {scheme_sql('url')} || '://' || {netloc_sql('url')} AS base, split_part(url, '#', 1) AS defragged FROM v""")
def url_parts(spark, sf_dir):
    u = F.col("url")
    return url_variants(spark, sf_dir).select(
        "page_id", "form", U.extract_domain(u).alias("domain"), U.base_url(u).alias("base"),
        U.urldefrag(u).alias("defragged"))


@query("url_same_domain", f"""
WITH {V}, d AS (SELECT page_id, form, split_part(regexp_replace(lower({netloc_sql('url')}), '^www\\.', ''), ':', 1) AS dom
  FROM v)
SELECT a.page_id, a.form, a.dom = b.dom AS same FROM d a JOIN d b ON a.page_id = b.page_id AND b.form = 0""")
def url_same_domain(spark, sf_dir):
    v = url_variants(spark, sf_dir)
    first = v.filter("form = 0").select("page_id", F.col("url").alias("page_url"))
    return v.join(first, "page_id").select(
        "page_id", "form", U.is_same_domain(F.col("url"), F.col("page_url")).alias("same"))


@query("url_route", f"""
WITH {V}
SELECT page_id, form, CASE WHEN url LIKE '%.txt' OR url LIKE '%.md' THEN 'text'
  WHEN url LIKE '%sitemap.xml' OR contains({path_sql('url')}, 'sitemap') THEN 'sitemap' ELSE 'site' END AS route FROM v""")
def url_route(spark, sf_dir):
    return url_variants(spark, sf_dir).select("page_id", "form", U.route_url(F.col("url")).alias("route"))


METHOD = f"""
    m AS (SELECT page_id, form, lower({strip_sql('url')}) AS u FROM v),
    mm AS (SELECT page_id, form, CASE WHEN u = '' THEN 'unknown'
      WHEN regexp_matches(u, '{U.any_of(U.SITEMAP_PATTERNS)}') THEN 'sitemap'
      WHEN regexp_matches(u, '{U.any_of(U.SINGLE_PAGE_PATTERNS)}') THEN 'single'
      WHEN regexp_matches(u, '{U.any_of(U.DOCUMENTATION_PATTERNS)}') THEN 'documentation'
      ELSE 'website' END AS method FROM m)"""


@query("crawl_method", f"WITH {V}, {METHOD} SELECT page_id, form, method FROM mm")
def crawl_method(spark, sf_dir):
    return url_variants(spark, sf_dir).select("page_id", "form", U.detect_method(F.col("url")).alias("method"))


@query("crawl_method_settings", f"""
WITH {V}, {METHOD}, dim(method, backend, max_depth, max_concurrent, page_limit) AS (VALUES
  ('sitemap', 'sitemap', NULL::BIGINT, 10::BIGINT, NULL::BIGINT), ('single', 'single', NULL, NULL, NULL),
  ('documentation', 'recursive', 3, 4, 50), ('website', 'recursive', 2, 5, 20), ('unknown', 'single', NULL, NULL, NULL))
SELECT page_id, form, mm.method, backend, max_depth, max_concurrent, page_limit FROM mm LEFT JOIN dim USING (method)""")
def crawl_method_settings(spark, sf_dir):
    return method_settings(crawl_method(spark, sf_dir))


def _score_sql(kind):
    weight, patterns = U.SITE_URL_PATTERNS[kind]
    hits = " + ".join(f"regexp_matches(u, '{p}')::INT" for p in patterns)
    out = f"({hits}) * {weight}::DOUBLE"
    places = [f"WHEN ({hits}) > 0 THEN {list(U.SITE_URL_PATTERNS).index(kind)}"]
    if kind in U.SITE_TITLE_WORDS:
        w, words, _ = U.SITE_TITLE_WORDS[kind]
        hit = f"regexp_matches(t, '{U.any_of(words)}')"
        out += f" + CASE WHEN {hit} THEN {w}::DOUBLE ELSE 0 END"
        places.append(f"WHEN {hit} THEN {4 + list(U.SITE_URL_PATTERNS).index(kind)}")
    if kind in U.SITE_H1_WORDS:
        w, words, _ = U.SITE_H1_WORDS[kind]
        out += f" + CASE WHEN regexp_matches(h, '{U.any_of(words)}') THEN {w}::DOUBLE ELSE 0 END"
    place = "CASE " + " ".join(places) + f" ELSE {8 + list(U.SITE_URL_PATTERNS).index(kind)} END"
    return (f"SELECT page_id, form, '{kind}' AS site_type, round({out}, 6) AS score, {place} AS place FROM s")


SITE = rf"""
    s AS (SELECT v.page_id, form, lower(v.url) AS u,
      CASE WHEN form % 2 = 0 THEN 'api guide of wiki' ELSE 'news' END AS t,
      CASE WHEN form % 3 = 0 THEN 'quickstart' ELSE '' END AS h FROM v),
    c AS ({' UNION ALL '.join(_score_sql(k) for k in U.SITE_URL_PATTERNS)}),
    r AS (SELECT *, row_number() OVER (PARTITION BY page_id, form ORDER BY score DESC, place) AS rn FROM c),
    st AS (SELECT page_id, form, CASE WHEN score > 0 THEN site_type ELSE 'unknown' END AS site_type,
      least(score, 1.0) AS confidence FROM r WHERE rn = 1)"""


@query("site_type", f"WITH {V}, {SITE} SELECT * FROM st")
def site_type(spark, sf_dir):
    v = url_variants(spark, sf_dir)
    title = F.when(F.col("form") % 2 == 0, "API guide of Wiki").otherwise("News")
    h1 = F.when(F.col("form") % 3 == 0, F.array(F.lit("Quickstart"))).otherwise(F.array().cast("array<string>"))
    return v.select("page_id", "form", U.site_type(F.col("url"), title, h1).alias("r")).select(
        "page_id", "form", "r.site_type", "r.confidence")


@query("site_type_settings", f"""
WITH {V}, {SITE}, dim(site_type, max_depth, max_pages, chunk_size, max_concurrent) AS (VALUES
  ('documentation', 3::BIGINT, 50::BIGINT, 1500::BIGINT, 3::BIGINT), ('blog', 2, 20, 1200, 5), ('news', 2, 15, 1000, 5),
  ('wiki', 3, 40, 1400, 4), ('corporate', 2, 10, 1200, 5), ('ecommerce', 1, 5, 800, 3), ('forum', 2, 25, 1000, 4),
  ('unknown', 2, 10, 1200, 5))
SELECT site_type, count(*) AS pages, max(max_depth) AS max_depth, max(max_pages) AS max_pages,
  max(chunk_size) AS chunk_size, max(max_concurrent) AS max_concurrent
FROM st LEFT JOIN dim USING (site_type) GROUP BY site_type""")
def site_type_settings(spark, sf_dir):
    return site_settings(site_type(spark, sf_dir)).groupBy("site_type").agg(
        F.count("*").alias("pages"), *[F.max(c).alias(c) for c in ("max_depth", "max_pages", "chunk_size", "max_concurrent")])


def sanitize_sql(x):
    n = rf"regexp_replace(regexp_replace(lower({x}), '[\s_.]+', '-', 'g'), '[^a-z0-9-]', '', 'g')"
    n = f"trim(CASE WHEN length({n}) > 60 THEN substr({n}, 1, 51) || '-' || substr(md5({n}), 1, 8) ELSE {n} END, '-')"
    return (f"CASE WHEN coalesce({x}, '') = '' THEN 'default-collection' WHEN length({n}) < 3 THEN {n} || '-kb' "
            f"ELSE {n} END")


@query("collection_name", rf"""
WITH {V}, n AS (SELECT page_id, form, url, CASE WHEN {netloc_sql('url')} = ''
    THEN regexp_replace(regexp_extract(url, '([^/]*)$', 1), '([^.])\.[^.]*$', '\1')
    ELSE {netloc_sql('url')} || CASE WHEN {path_sql('url')} IN ('', '/') THEN ''
      ELSE rtrim(replace({path_sql('url')}, '/', '-'), '-') END END AS raw FROM v)
SELECT page_id, form, {sanitize_sql('url')} AS sanitized,
  CASE WHEN {strip_sql('url')} = '' THEN 'default-collection' ELSE {sanitize_sql('raw')} END AS from_url FROM n""")
def collection_name(spark, sf_dir):
    u = F.col("url")
    return url_variants(spark, sf_dir).select(
        "page_id", "form", U.sanitize_name(u).alias("sanitized"), U.name_from_url(u).alias("from_url"))


def _clean_sql(x):
    for s in U.TITLE_SUFFIXES:
        x = f"regexp_replace({x}, '{U.suffix_pattern(s)}', '')"
    return strip_sql(f"replace(replace({x}, '|', '-'), '  ', ' ')")


@query("display_name", rf"""
WITH x AS (SELECT page_id, url, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS t FROM pages),
y AS (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN t || ' | Docs' WHEN 1 THEN t || ' - Home | Welcome'
   WHEN 2 THEN 'Docs' WHEN 3 THEN '' ELSE 'A|B  ' || t || ' Documentation' END AS t FROM x),
z AS (SELECT page_id, {_clean_sql('t')} AS c,
   lower(split_part(replace({netloc_sql('url')}, 'www.', ''), '.', 1)) AS l FROM y)
SELECT page_id, CASE WHEN length(c) > 3 THEN c ELSE list_aggregate(list_transform(
  regexp_extract_all(l, '([a-z]+|[^a-z]+)', 1), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', '') END
  AS name FROM z""")
def display_name(spark, sf_dir):
    t = F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)
    m = F.col("page_id") % 5
    title = (
        F.when(m == 0, F.concat(t, F.lit(" | Docs"))).when(m == 1, F.concat(t, F.lit(" - Home | Welcome")))
        .when(m == 2, "Docs").when(m == 3, "").otherwise(F.concat(F.lit("A|B  "), t, F.lit(" Documentation")))
    )
    return table(spark, sf_dir, "pages").select("page_id", U.clean_name(title, F.col("url")).alias("name"))


@query("probe_classify", """
WITH x AS (SELECT event_id, value / 10 AS s, CASE event_type WHEN 'view' THEN 200 WHEN 'click' THEN 301
    WHEN 'signup' THEN [403, 404, 429, 503, 418][1 + event_id % 5] WHEN 'purchase' THEN 200 END AS status,
    CASE WHEN event_type = 'error' THEN ['timeout', 'connection', 'redirects', 'tls'][1 + event_id % 4] END AS e FROM events),
y AS (SELECT *, CASE WHEN e = 'timeout' THEN 'Timeout nach 10 Sekunden'
    WHEN e = 'connection' THEN 'Verbindung zur URL fehlgeschlagen' WHEN e = 'redirects' THEN 'Zu viele Weiterleitungen'
    WHEN e IS NOT NULL THEN 'Netzwerk-Fehler: ' || e WHEN status = 200 OR status BETWEEN 300 AND 399 THEN NULL
    WHEN status = 403 THEN 'Zugriff verweigert (403 Forbidden)' WHEN status = 404 THEN 'Seite nicht gefunden (404 Not Found)'
    WHEN status = 429 THEN 'Zu viele Anfragen (429 Rate Limited)'
    WHEN status BETWEEN 500 AND 599 THEN 'Server-Fehler (HTTP ' || status || ')'
    ELSE 'Unerwarteter HTTP Status: ' || status END AS error_message FROM x)
SELECT event_id, error_message IS NULL AS is_valid, error_message, CASE WHEN error_message IS NOT NULL THEN NULL
    WHEN status BETWEEN 300 AND 399 THEN 'URL leitet weiter (Status ' || status || ')'
    WHEN s > 5 THEN 'Langsame Antwortzeit (' || printf('%.1f', s) || 's)'
    WHEN s > 3 THEN 'Mäßige Antwortzeit (' || printf('%.1f', s) || 's)' END AS warning_message FROM y""")
def probe_classify(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    kind, n = F.col("event_type"), F.col("event_id")
    pick = lambda values, m: F.element_at(F.array(*[F.lit(v) for v in values]), (n % m + 1).cast("int"))
    status = (
        F.when(kind == "view", 200).when(kind == "click", 301).when(kind == "purchase", 200)
        .when(kind == "signup", pick([403, 404, 429, 503, 418], 5))
    )
    error = F.when(kind == "error", pick(["timeout", "connection", "redirects", "tls"], 4))
    return e.select(
        "event_id", U.classify_probe(status, F.col("value") / 10, error).alias("r")
    ).select("event_id", "r.*")


@query("model_attributes", """
WITH x AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'text-multilingual-embedding-002'
    WHEN 'click' THEN 'gemini-embedding-001' WHEN 'signup' THEN 'text-embedding-005' ELSE event_type END AS model FROM events),
dim(model, d, l, m) AS (VALUES ('text-multilingual-embedding-002', 768, 'Mehrsprachig', 2048),
    ('gemini-embedding-001', 3072, 'Mehrsprachig + Code', 2048), ('text-embedding-005', 768, 'Englisch + Code', 2048))
SELECT event_id, x.model, coalesce(d, 768)::BIGINT AS dimensions, coalesce(l, 'Unknown') AS languages,
    coalesce(m, 2048)::BIGINT AS max_tokens FROM x LEFT JOIN dim ON x.model = dim.model""")
def model_attributes(spark, sf_dir):
    kind = F.col("event_type")
    model = (
        F.when(kind == "view", "text-multilingual-embedding-002").when(kind == "click", "gemini-embedding-001")
        .when(kind == "signup", "text-embedding-005").otherwise(kind)
    )
    return model_info(table(spark, sf_dir, "events").select("event_id", model.alias("model")))
