"""Page HTML: head fields, markdown, links, sitemaps, crawls."""

from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions.text import parse_sitemap_date
from corpusloom.operators import crawl as C
from corpusloom.operators import metrics as M
from corpusloom.operators.ingest import crawl_stats, ok_pages, page_info, page_links
from corpusloom.sources.pages import pages_to_docs, read_pages
from corpusloom.sources.sitemaps import parse_sitemaps, read_large_sitemaps, robots_sitemaps, sitemap_locs
from workload.base import SQL, query, scratch, strip_sql, table
from workload.url_queries import netloc_sql, path_sql, scheme_sql


def pages(spark, sf_dir):
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def markdown_sql(x):
    for pattern, replacement in H.MARKDOWN_RULES:
        r = replacement.replace("$1", "\\1").replace("'", "''").replace("\n", "' || chr(10) || '")
        x = f"regexp_replace({x}, '{pattern}', '{r}', 'g')"
    return strip_sql(x)


DOCS = f"docs AS (SELECT page_id, url, {markdown_sql('html')} AS markdown FROM pages)"


@query("page_scan", f"WITH {DOCS} SELECT page_id, url, markdown FROM docs WHERE markdown <> ''")
def page_scan(spark, sf_dir):
    return pages_to_docs(pages(spark, sf_dir))


# Pages whose head also has the optional fields: both attribute orders, relative and absolute canonicals.
HEAD = [
    '<meta charset="utf-8"><meta name="description" content=" Page %s &amp; more "><meta content="index,follow" name="robots">'
    '<link rel="canonical" href="/c/%s?x=1">',
    "<meta charset='utf-8'><meta name='keywords' content='k%s'><link href='x' rel='y'>"
    "<link rel=canonical href='https://other.example.org/%s'>",
]


def pages_with_head(spark, sf_dir):
    n = F.col("page_id").cast("string")
    extra = F.when(F.col("page_id") % 2 == 0, F.format_string(HEAD[0], n, n)).otherwise(F.format_string(HEAD[1], n, n))
    return pages(spark, sf_dir).withColumn("html", F.replace("html", F.lit('<meta charset="utf-8">'), extra))


def _head_sql(i):
    a, b, c = HEAD[i].replace("'", "''").split("%s")
    return f"'{a}' || page_id || '{b}' || page_id || '{c}'"


HEADS = (f"p AS (SELECT page_id, url, replace(html, '<meta charset=\"utf-8\">', CASE WHEN page_id % 2 = 0 "
         f"THEN {_head_sql(0)} ELSE {_head_sql(1)} END) AS html FROM pages)")


def meta_sql(name):
    a, b = (p.replace("'", "''") for p in H.meta_patterns(name))
    return (f"CASE WHEN regexp_matches(html, '{a}') THEN {strip_sql(f'regexp_extract(html, $${a}$$, 1)')} "
            f"WHEN regexp_matches(html, '{b}') THEN {strip_sql(f'regexp_extract(html, $${b}$$, 1)')} END"
            ).replace("$$", "'")


def tidy_sql(x):
    return strip_sql(rf"regexp_replace(regexp_replace({x}, '{H.ENTITY}', ' ', 'g'), '\s+', ' ', 'g')")


LANG = H.HTML_LANG.replace("'", "''")
CANON = H.CANONICAL.replace("'", "''")


@query("page_info", f"""
WITH {HEADS}, c AS (SELECT *, regexp_extract(html, '{CANON}', 1) AS href FROM p)
SELECT page_id, url, nullif({tidy_sql(f"regexp_extract(html, '{H.TITLE}', 1)")}, '') AS title,
  {meta_sql('description')} AS description, nullif(regexp_extract(html, '{LANG}', 1), '') AS language,
  CASE WHEN href = '' THEN NULL WHEN href LIKE '/%' THEN {scheme_sql('url')} || '://' || {netloc_sql('url')} || href
    ELSE href END AS canonical_url,
  {meta_sql('robots')} AS robots_meta, {meta_sql('keywords')} AS meta_keywords,
  array_to_string(list_filter(list_transform(regexp_extract_all(html, '{H.H1}', 1),
    lambda h: {tidy_sql("regexp_replace(h, '<[^>]+>', '', 'g')")}), lambda h: h <> ''), '|') AS h1_tags FROM c""")
def page_info_(spark, sf_dir):
    return page_info(pages_with_head(spark, sf_dir))


HREF = H.HREF.replace("'", "''")
LINKS = rf"""l0 AS (SELECT url, unnest(regexp_extract_all(html, '{HREF}', 1)) AS href FROM pages),
    links AS (SELECT DISTINCT url, split_part(CASE WHEN href LIKE '/%' THEN {scheme_sql('url')} || '://' || {netloc_sql('url')} || href
      ELSE href END, '#', 1) AS link FROM l0)"""


@query("page_links", f"""WITH {LINKS} SELECT url, link,
  CASE WHEN {netloc_sql('link')} = {netloc_sql('url')} THEN 'internal' ELSE 'external' END AS kind FROM links""")
def page_links_(spark, sf_dir):
    return page_links(pages(spark, sf_dir))


def crawled(spark, sf_dir):
    """The page table as crawl results; every seventh page stands for a failed fetch."""
    docs = pages(spark, sf_dir).withColumn("internal_links", F.size(F.array_distinct(H.html_hrefs(F.col("html")))))
    docs = docs.withColumn("markdown", H.html_to_markdown(F.col("html"))).drop("html")
    return docs.withColumn("success", F.col("page_id") % 7 != 3)


@query("crawl_ok", f"WITH {DOCS} SELECT page_id, markdown FROM docs WHERE page_id % 7 <> 3 AND markdown <> ''")
def crawl_ok(spark, sf_dir):
    return ok_pages(crawled(spark, sf_dir)).select("page_id", "markdown")


@query("crawl_stats", f"""WITH {DOCS}, h AS (SELECT page_id, len(list_distinct(regexp_extract_all(html, '{HREF}', 1))) AS n FROM pages)
SELECT count(*) AS total, count(*) FILTER (page_id % 7 <> 3) AS successful,
  coalesce(sum(length(markdown)) FILTER (page_id % 7 <> 3), 0)::BIGINT AS total_chars,
  coalesce(max(length(markdown)) FILTER (page_id % 7 <> 3), 0) AS max_chars,
  coalesce(sum(n) FILTER (page_id % 7 <> 3), 0)::BIGINT AS internal_links FROM docs JOIN h USING (page_id)""")
def crawl_stats_(spark, sf_dir):
    return crawl_stats(crawled(spark, sf_dir))


# ---- sitemaps: files written from the page table -------------------------------

def sitemap_files(spark, sf_dir):
    """One sitemap text per host and thousand page ids (a sitemap file is bounded), each form of root and field."""
    p = pages(spark, sf_dir).select("page_id", "url", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))
    n = F.col("page_id").cast("string")
    xml_url = F.replace("url", F.lit("&"), F.lit("&amp;"))
    entry = F.concat(
        F.lit("<url><loc> "), xml_url, F.lit("</loc>"),
        F.when(F.col("page_id") % 3 == 0, "<lastmod>2024-02-03</lastmod>")
        .when(F.col("page_id") % 3 == 1, "<lastmod>2024-02-03T04:05:06+02:00</lastmod>").otherwise(""),
        F.when(F.col("page_id") % 2 == 0, "<changefreq>weekly</changefreq>").otherwise(""),
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("<priority>0."), F.col("page_id") % 10, F.lit("</priority>"))).otherwise(""),
        F.lit("</url>"),
    )
    grouped = p.withColumn("entry", entry).groupBy("host", F.floor(F.col("page_id") / 1000).alias("no")).agg(
        F.array_join(F.sort_array(F.collect_list("entry")), "\n").alias("body"), F.min("page_id").alias("m")
    )
    body = (
        F.when(F.col("m") % 5 == 0, F.concat(F.lit("<urlset><url><loc>broken</loc>"), "body"))
        .when(F.col("m") % 5 == 1, F.concat(F.lit("<feed>"), "body", F.lit("</feed>")))
        .when(F.col("m") % 5 == 2, F.concat(
            F.lit("<sitemapindex xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">"),
            F.replace(F.replace("body", F.lit("<url>"), F.lit("<sitemap>")), F.lit("</url>"), F.lit("</sitemap>")),
            F.lit("</sitemapindex>")))
        .otherwise(F.concat(
            F.lit("<?xml version=\"1.0\" encoding=\"UTF-8\"?>\n<urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">\n"),
            "body", F.lit("\n</urlset>")))
    )
    return grouped.select(F.concat("host", F.lit("/"), F.col("no").cast("string")).alias("file"), body.alias("content"))


SITEMAPS = r"""
    s0 AS (SELECT page_id, url, regexp_extract(url, '^https?://([^/]+)', 1) AS host, page_id // 1000 AS no FROM pages),
    s1 AS (SELECT *, min(page_id) OVER (PARTITION BY host, no) % 5 AS m FROM s0),
    sm AS (SELECT host || '/' || no AS file, page_id, url, m,
      CASE WHEN page_id % 3 = 0 THEN '2024-02-03 00:00:00' WHEN page_id % 3 = 1 THEN '2024-02-03 02:05:06' END AS lastmod,
      CASE WHEN page_id % 2 = 0 AND m <> 2 THEN 'weekly' END AS changefreq,
      CASE WHEN page_id % 4 = 0 AND m <> 2 THEN (page_id % 10) / 10 END AS priority FROM s1)"""


@query("sitemap_scan", f"""WITH {SITEMAPS}
SELECT file, true AS is_valid, NULL::VARCHAR AS error, CASE WHEN m = 2 THEN 'sitemapindex' ELSE 'urlset' END AS sitemap_type,
  url, lastmod, changefreq, priority FROM sm WHERE m >= 2
UNION ALL SELECT DISTINCT file, false, CASE WHEN m = 0 THEN 'XML parsing error' ELSE 'Unknown sitemap format: feed' END,
  'urlset', NULL, NULL, NULL, NULL FROM sm WHERE m < 2""")
def sitemap_scan(spark, sf_dir):
    return parse_sitemaps(sitemap_files(spark, sf_dir)).drop("file_size")


@query("sitemap_scan_large", SQL["sitemap_scan"])
def sitemap_scan_large(spark, sf_dir):
    """The sitemap files of all hosts written as text, a folder each, and read in splits."""
    out = scratch(spark)
    sitemap_files(spark, sf_dir).select("content", F.hex("file").alias("name")).repartition("name").write.partitionBy(
        "name").text(out)
    read = read_large_sitemaps(spark, f"{out}/*")
    name = F.decode(F.unhex(F.regexp_extract("file", "name=([^/]+)", 1)), "UTF-8")
    return read.withColumn("file", name).drop("file_size")


@query("sitemap_locs", f"""WITH {SITEMAPS}
SELECT file, ' ' || replace(url, '&', '&amp;') AS loc FROM sm
UNION ALL SELECT DISTINCT file, 'broken' FROM sm WHERE m = 0""")
def sitemap_locs_(spark, sf_dir):
    return sitemap_files(spark, sf_dir).select("file", F.explode(sitemap_locs(F.col("content"))).alias("loc"))


@query("sitemap_dates", r"""
WITH e AS (SELECT event_id, date_trunc('second', ts) AS t FROM events)
SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(date_trunc('day', t), '%Y-%m-%d %H:%M:%S')
  WHEN 1 THEN strftime(t - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') WHEN 5 THEN NULL
  ELSE strftime(t, '%Y-%m-%d %H:%M:%S') END AS parsed FROM e""")
def sitemap_dates(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = F.col("event_id") % 6
    day, second = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    raw = (
        F.when(m == 0, day).when(m == 1, F.concat(day, F.lit("T"), second, F.lit("+0200")))
        .when(m == 2, F.concat(day, F.lit("T"), second, F.lit("Z"))).when(m == 3, F.concat(day, F.lit("T"), second))
        .when(m == 4, F.concat(day, F.lit(" "), second)).otherwise(F.concat(F.lit("~"), day))
    )
    return e.select("event_id", parse_sitemap_date(raw).alias("parsed"))


def robots_files(spark, sf_dir):
    """robots.txt text of each site with a relative and an absolute entry."""
    sites = pages(spark, sf_dir).select(F.regexp_extract("url", r"^(https?://[^/]+)", 1).alias("site")).distinct()
    text = F.concat(
        F.lit("User-agent: *\nDisallow: /x\nSitemap: /maps/../sitemap.xml \n# sitemap: no\nSITEMAP:\t"), "site", F.lit("/s-2.xml\n")
    )
    return sites.select("site", text.alias("content"))


ROBOTS = r"""si AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/]+)', 1) AS site FROM pages),
    ro AS (SELECT site, site || unnest(['/sitemap.xml', '/s-2.xml']) AS sitemap_url FROM si)"""


@query("robots_scan", f"WITH {ROBOTS} SELECT * FROM ro")
def robots_scan(spark, sf_dir):
    return robots_files(spark, sf_dir).select(
        "site", F.explode(robots_sitemaps(F.col("content"), F.col("site"))).alias("sitemap_url"))


@query("sitemap_candidates", f"""WITH {ROBOTS}
SELECT site, site || unnest({C.SITEMAP_PATHS}) AS sitemap_url FROM si UNION SELECT * FROM ro""")
def sitemap_candidates(spark, sf_dir):
    return C.sitemap_candidates(pages(spark, sf_dir), robots_scan(spark, sf_dir))


def sitemap_urls(spark, sf_dir):
    """Page urls as the entries of one sitemap per parent domain, every fifth entry twice."""
    p = pages(spark, sf_dir)
    n = F.col("page_id")
    rows = p.select(
        F.regexp_extract("url", r"^https?://[^/]*?([^./]+\.[a-z]+)/", 1).alias("sitemap"), "url",
        F.when(n % 3 == 0, F.lit("2024-01-01").cast("timestamp")).alias("lastmod"),
        F.when(n % 2 == 0, "daily").alias("changefreq"),
        F.when(n % 4 == 0, (n % 8) / 8).alias("priority"),
        (F.length("html") * 100).alias("file_size"),
        F.explode(F.when(n % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    )
    return rows.drop("_copy")


@query("sitemap_quality", rf"""
WITH u AS (SELECT page_id AS n, regexp_extract(url, '^https?://[^/]*?([^./]+\.[a-z]+)/', 1) AS sitemap, url, length(html) * 100 AS fs,
    unnest(CASE WHEN page_id % 5 = 0 THEN [0, 1] ELSE [0] END) AS cp FROM pages),
a AS (SELECT sitemap, count(*) AS total_urls, count(DISTINCT url) AS unique_urls, count(*) FILTER (n % 3 = 0) AS urls_with_lastmod,
    count(*) FILTER (n % 4 = 0 AND n % 8 <> 0) AS urls_with_priority, count(*) FILTER (n % 2 = 0) AS urls_with_changefreq,
    round(max(fs) / 1024, 6) AS file_size_kb, list_sort(list_distinct(list({netloc_sql('url')}))) AS d,
    list_sort(list_distinct(list({scheme_sql('url')}))) AS p FROM u GROUP BY sitemap),
i AS (SELECT *, list_filter([CASE WHEN total_urls <> unique_urls THEN 'Duplicate URLs found (' || (total_urls - unique_urls) || ' duplicates)' END,
    CASE WHEN total_urls > 50000 THEN 'Sitemap contains more than 50,000 URLs (consider splitting)' END,
    CASE WHEN file_size_kb > 10240 THEN 'Sitemap file is larger than 10MB (consider compression)' END,
    CASE WHEN len(d) > 1 THEN 'Multiple domains found in sitemap: ' || array_to_string(d, ', ') END], lambda x: x IS NOT NULL) AS iss FROM a)
SELECT sitemap, total_urls, unique_urls, urls_with_lastmod, urls_with_priority, urls_with_changefreq, file_size_kb,
  len(d)::BIGINT AS host_count, array_to_string(d, '|') AS domains, array_to_string(p, '|') AS protocols, array_to_string(iss, '|') AS issues,
  round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - len(iss) * 0.1::DOUBLE +
    (urls_with_lastmod + urls_with_priority + urls_with_changefreq) / total_urls / 3 * 0.2::DOUBLE)), 6) AS quality_score FROM i""")
def sitemap_quality(spark, sf_dir):
    return M.sitemap_quality(sitemap_urls(spark, sf_dir))


@query("best_sitemap", rf"""
WITH u AS (SELECT regexp_extract(url, '^https?://[^/]*?([^./]+\.[a-z]+)/', 1) AS site, regexp_extract(url, '^(https?://[^/]+)', 1) AS h FROM pages),
s AS (SELECT site, h || CASE WHEN length(h) % 2 = 0 THEN '/sitemap.xml' ELSE '/maps.xml' END AS u, length(h) % 7 <> 0 AS ok, count(*) AS n,
    length(h) % 3 = 0 AS r FROM u GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY ok DESC, n DESC, u) AS rn FROM s)
SELECT site, max(CASE WHEN rn = 1 AND ok THEN u END) AS best_sitemap, coalesce(sum(n) FILTER (ok), 0)::BIGINT AS total_urls,
  CASE WHEN bool_or(contains(u, '/sitemap.xml')) THEN 'standard_location' WHEN bool_or(r) THEN 'robots_txt' ELSE 'inferred' END
    AS discovery_method FROM b GROUP BY site""")
def best_sitemap(spark, sf_dir):
    host = F.col("h")
    found = pages(spark, sf_dir).select(
        F.regexp_extract("url", r"^https?://[^/]*?([^./]+\.[a-z]+)/", 1).alias("site"),
        F.regexp_extract("url", r"^(https?://[^/]+)", 1).alias("h"),
    ).groupBy("site", "h").agg(F.count("*").alias("url_count"))
    return M.best_sitemap(found.select(
        "site", "url_count",
        F.concat(host, F.when(F.length(host) % 2 == 0, "/sitemap.xml").otherwise("/maps.xml")).alias("sitemap_url"),
        (F.length(host) % 7 != 0).alias("is_valid"), (F.length(host) % 3 == 0).alias("from_robots"),
    ))


# ---- crawls over the page table --------------------------------------------------

def page_graph(spark, sf_dir):
    """Links: those of the pages, and from each page to those of its host within the next 60 ids."""
    p = pages(spark, sf_dir).select("page_id", "url", F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("host"))
    # Blocks of 60 ids keep the pairs per (host, block) bounded, however large a host is.
    block = F.floor(F.col("page_id") / 60)
    a = p.withColumn("block", F.explode(F.array(block, block + 1))).alias("a")
    b = p.withColumn("block", block).alias("b")
    near = a.join(b, (F.col("a.host") == F.col("b.host")) & (F.col("a.block") == F.col("b.block"))).filter(
        (F.col("b.page_id") > F.col("a.page_id")) & (F.col("b.page_id") <= F.col("a.page_id") + 60)
    ).select(F.col("a.url").alias("url"), F.split_part(F.col("b.url"), F.lit("#"), F.lit(1)).alias("link"))
    return page_links(pages(spark, sf_dir)).select("url", "link").unionByName(near)


GRAPH = rf"""{LINKS}, pg AS (SELECT page_id, url, {netloc_sql('url')} AS host FROM pages),
    edges AS (SELECT DISTINCT split_part(url, '#', 1) AS url, link FROM (SELECT url, link FROM links UNION ALL
      SELECT a.url, split_part(b.url, '#', 1) FROM pg a JOIN pg b ON a.host = b.host AND b.page_id > a.page_id
        AND b.page_id <= a.page_id + 60) WHERE {netloc_sql('url')} = {netloc_sql('link')}),
    known AS (SELECT DISTINCT split_part(url, '#', 1) AS url FROM pages),
    seeds AS (SELECT min(page_id) AS crawl_id, arg_min(split_part(url, '#', 1), page_id) AS url FROM pg GROUP BY host)"""


def seeds(spark, sf_dir):
    p = pages(spark, sf_dir)
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return p.groupBy(host.alias("host")).agg(
        F.min("page_id").alias("crawl_id"), F.min_by("url", "page_id").alias("url")).select("crawl_id", "url")


@query("crawl_breadth_first", f"""
WITH RECURSIVE {GRAPH},
v AS (SELECT crawl_id, url, 0 AS depth FROM seeds UNION
  SELECT v.crawl_id, e.link, v.depth + 1 FROM v JOIN edges e ON v.url = e.url WHERE v.depth < 3 AND v.url IN (SELECT url FROM known))
SELECT crawl_id, url, min(depth)::BIGINT AS depth, url IN (SELECT url FROM known) AS success FROM v GROUP BY crawl_id, url""")
def crawl_breadth_first(spark, sf_dir):
    return C.crawl_bfs(seeds(spark, sf_dir), page_graph(spark, sf_dir), pages(spark, sf_dir), 4)


def _level_sql(d, limit):
    prev = " UNION ALL ".join(f"SELECT * FROM v{i}" for i in range(d))
    return f"""f{d} AS (SELECT DISTINCT crawl_id, link AS url FROM v{d - 1} JOIN edges USING (url) WHERE url IN (SELECT url FROM known)),
    p{d} AS ({prev}), n{d} AS (SELECT crawl_id, url, row_number() OVER (PARTITION BY crawl_id ORDER BY url) AS rn FROM f{d}
      WHERE (crawl_id, url) NOT IN (SELECT crawl_id, url FROM p{d})),
    v{d} AS (SELECT crawl_id, url, {d} AS depth FROM n{d} JOIN (SELECT crawl_id, count(*) AS used FROM p{d} GROUP BY crawl_id) USING (crawl_id)
      WHERE rn + used <= {limit})"""


@query("crawl_page_limit", f"""
WITH {GRAPH}, v0 AS (SELECT crawl_id, url, 0 AS depth FROM seeds), {_level_sql(1, 12)}, {_level_sql(2, 12)}, {_level_sql(3, 12)}
SELECT crawl_id, url, depth::BIGINT AS depth, url IN (SELECT url FROM known) AS success
FROM (SELECT * FROM p3 UNION ALL SELECT * FROM v3)""")
def crawl_page_limit(spark, sf_dir):
    return C.crawl_bfs(seeds(spark, sf_dir), page_graph(spark, sf_dir), pages(spark, sf_dir), 4, limit=12)


@query("frontier_unvisited", f"""WITH {LINKS} SELECT DISTINCT link AS url FROM links
WHERE link NOT IN (SELECT link FROM links JOIN pages USING (url) WHERE page_id % 2 = 0)""")
def frontier_unvisited(spark, sf_dir):
    p = pages(spark, sf_dir)
    frontier = page_links(p).select(F.col("link").alias("url")).distinct()
    seen = page_links(p.filter("page_id % 2 = 0")).select(F.col("link").alias("url"))
    return C.unvisited(frontier, seen, ["url"])


@query("crawl_sitemap", rf"""
WITH {DOCS}, u AS (SELECT page_id % 10 AS sitemap, url || CASE WHEN page_id % 4 = 0 THEN 'x' ELSE '' END AS url FROM pages
  UNION ALL SELECT 100 + max(page_id), NULL FROM pages)
SELECT sitemap, u.url, markdown IS NOT NULL AS success, markdown, CASE WHEN u.url IS NULL THEN 'No URLs found in sitemap'
  WHEN markdown IS NULL THEN 'Page could not be crawled' END AS error FROM u LEFT JOIN docs ON u.url = docs.url""")
def crawl_sitemap(spark, sf_dir):
    p = pages(spark, sf_dir)
    n = F.col("page_id")
    urls = p.select((n % 10).alias("sitemap"), F.concat("url", F.when(n % 4 == 0, "x").otherwise("")).alias("url"))
    empty = p.agg((F.max("page_id") + 100).alias("sitemap")).select("sitemap", F.lit(None).cast("string").alias("url"))
    return C.crawl_sitemap(urls.unionByName(empty), pages_to_docs(p))
