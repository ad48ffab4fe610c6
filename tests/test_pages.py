import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.operators import crawl
from corpusloom.operators.ingest import gate_embeddings, page_links, reduce_chunks
from corpusloom.sources.pages import read_text_docs
from corpusloom.sources.sitemaps import large_files, read_large_sitemaps, read_robots, read_sitemap_locs, read_sitemaps

PAGE = """<!DOCTYPE html><HTML class=x lang='de-AT'><head><title a=b> Ein &amp; <
 Titel </title><meta name="description" content=" Text "><meta content='noindex' name='robots'>
<link rel="canonical" href="../kanon"></head><body><nav><a href="/nav">n</a></nav><h1>Erste <b>Zeile</b></h1><h1> </h1>
<h2>Zweite</h2><p>Absatz <i>eins</i> &lt;x&gt;</p><ul><li>Punkt</li></ul><script>var p = "<p>";</script><!-- <h1>no</h1> -->
<a href="https://ex.org/a#f">in</a><a href='//other.org/b'>out</a><footer>f</footer></body></html>"""


def test_head_fields(one):
    assert one(H.html_title, h=PAGE) == "Ein < Titel"
    assert one(lambda h: H.html_meta(h, "description"), h=PAGE) == "Text"
    assert one(lambda h: H.html_meta(h, "robots"), h=PAGE) == "noindex"
    assert one(lambda h: H.html_meta(h, "keywords"), h=PAGE) is None
    assert one(H.html_lang, h=PAGE) == "de-AT"
    assert one(H.html_lang, h='<html><meta name="language" content="fr">') == "fr"
    assert one(lambda h: H.html_canonical(h, F.lit("https://ex.org/a/b/c")), h=PAGE) == "https://ex.org/a/kanon"
    assert one(H.html_title, h="<title> &nbsp; </title>") is None


def test_markdown(one):
    md = one(H.html_to_markdown, h=PAGE)
    assert md == "# Erste Zeile\n\n#\n\n## Zweite\n\nAbsatz eins <x>\n\n- Punkt\n\ninout"


def test_links(spark):
    df = spark.createDataFrame([("https://ex.org/d/", PAGE)], "url string, html string")
    assert {(r.link, r.kind) for r in page_links(df).collect()} == {
        ("https://ex.org/nav", "internal"), ("https://ex.org/a", "internal"), ("https://other.org/b", "external")}


def write(folder, name, text):
    path = f"{folder}/{name}"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def test_a_large_sitemap_is_read_by_many_tasks(spark, folder):
    entry = lambda k: (
        f"<x:url a='1'>\n<x:loc>https://a.org/ü{k}?a&amp;b</x:loc>" + (f"<x:priority>0.{k % 10}</x:priority>" if k % 3 else "") + "</x:url>"
        + ("<x:url><x:loc/></x:url>" if k % 50 == 0 else "") + ("\n" if k % 2 else ""))
    body = "".join(map(entry, range(3000)))
    head = "<?xml version='1.0'?><!-- <url> --><x:urlset xmlns:x='http://x'>".replace("<url>", "url")
    write(folder, "big.xml", f"{head}{body}</x:urlset>")
    write(folder, "cut.xml", f"{head}{body}")
    write(folder, "bad.xml", f"{head}{body}<x:url><x:loc>a & b</x:loc></x:url></x:urlset>")
    write(folder, "none.xml", "<urlset></urlset>")
    write(folder, "a b%20[c].xml", "<urlset><url><loc>https://a/1</loc></url></urlset>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = sorted(map(repr, read_sitemaps(spark, folder).collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        assert large_files(spark, f"{folder}/big.xml").count() == 1
        splits = spark.read.option("lineSep", ">").text(f"{folder}/big.xml").rdd.getNumPartitions()
        got = sorted(map(repr, read_large_sitemaps(spark, folder).collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert splits > 8 and got == want and len(got) == 3004


def test_sitemaps(spark, folder):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    write(folder, "a.xml", f'<?xml version="1.0" encoding="UTF-8"?><!-- c --><urlset {ns}><url><loc> https://a/1 </loc>'
          "<lastmod>2024-05-06</lastmod><changefreq>daily</changefreq><priority>0.0</priority></url><url><loc/></url></urlset>")
    write(folder, "b.xml", "<sitemapindex><sitemap><loc>https://a/s.xml</loc><lastmod>bad</lastmod></sitemap></sitemapindex>")
    write(folder, "c.xml", "<urlset><url><loc>https://a/2</loc>")
    write(folder, "d.xml", "<rss><channel/></rss>")
    write(folder, "e.xml", f"<s:urlset xmlns:s='http://x'><s:url><s:loc>https://a/3</s:loc></s:url></s:urlset>")
    rows = {r.file[-5:]: r for r in read_sitemaps(spark, folder).collect()}
    assert (rows["a.xml"].url, str(rows["a.xml"].lastmod)[:10], rows["a.xml"].changefreq, rows["a.xml"].priority) == (
        "https://a/1", "2024-05-06", "daily", 0.0)
    assert (rows["b.xml"].sitemap_type, rows["b.xml"].url, rows["b.xml"].lastmod) == ("sitemapindex", "https://a/s.xml", None)
    assert (rows["c.xml"].is_valid, rows["c.xml"].error) == (False, "XML parsing error")
    assert rows["d.xml"].error == "Unknown sitemap format: rss"
    assert rows["e.xml"].url == "https://a/3"
    order = lambda df: sorted(map(repr, df.collect()))
    assert order(read_large_sitemaps(spark, folder)) == order(read_sitemaps(spark, folder))
    locs = {r.url for r in read_sitemap_locs(spark, folder).collect()}
    assert {"https://a/2", "https://a/3", "https://a/s.xml"} <= locs


def test_robots_and_text(spark, folder):
    write(folder, "robots.txt", "User-agent: *\nSitemap: /s.xml\n sitemap: no\nSITEMAP:https://b/t.xml  \n")
    out = [r.sitemap_url for r in read_robots(spark, folder, F.lit("https://a.org/x")).collect()]
    assert out == ["https://a.org/s.xml", "https://b/t.xml"]
    doc = read_text_docs(spark, folder).first()
    assert doc.url.endswith("robots.txt") and doc.markdown.startswith("User-agent: *\nSitemap")


def test_breadth_first_crawl(spark):
    links = spark.createDataFrame([
        ("http://a/0", "http://a/2"), ("http://a/0#x", "http://a/1"), ("http://a/0", "http://b/9"), ("http://a/1", "http://a/3"),
        ("http://a/2", "http://a/0"), ("http://a/3", "http://a/4"), ("http://a/9", "http://a/5"),
    ], "url string, link string")
    pages = spark.createDataFrame([(f"http://a/{i}#f",) for i in (0, 1, 3, 4)], "url string")
    seeds = spark.createDataFrame([(7, "http://a/0#top")], "crawl_id int, url string")

    def crawl_(depth, limit=None):
        return {(r.url[-1], r.depth, r.success) for r in crawl.crawl_bfs(seeds, links, pages, depth, limit).collect()}

    assert crawl_(1) == {("0", 0, True)}
    assert crawl_(9) == {("0", 0, True), ("1", 1, True), ("2", 1, False), ("3", 2, True), ("4", 3, True)}
    assert crawl_(9, 2) == {("0", 0, True), ("1", 1, True)}
    assert crawl_(9, 4) == {("0", 0, True), ("1", 1, True), ("2", 1, False), ("3", 2, True)}


def test_gate(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, None)], "id int, embedding array<float>")
    assert gate_embeddings(df).count() == 1  # exactly half is accepted
    with pytest.raises(ValueError):
        gate_embeddings(df.unionByName(df.filter("id = 2")))


def test_reduction_keeps_later_of_ties(spark):
    df = spark.createDataFrame([(i, "same text.") for i in range(6)] + [(9, "## a longer text. more.")], "i int, content string")
    assert sorted(r.i for r in reduce_chunks(df, "i", max_chunks=3).collect()) == [4, 5, 9]
    assert reduce_chunks(df, "i").count() == 7
    many = spark.range(6000).select(F.col("id").alias("i"), F.lit("text.").alias("content"))
    assert reduce_chunks(many, "i").count() == 6000


def test_crawl_without_seeds_or_depth(spark):
    seeds = spark.createDataFrame([(1, "https://a.b/")], "crawl_id long, url string")
    links = spark.createDataFrame([("https://a.b/", "https://a.b/x")], "url string, link string")
    for s, depth in ((seeds.limit(0), 3), (seeds, 0)):
        out = crawl.crawl_bfs(s, links, seeds, depth)
        assert out.columns == ["crawl_id", "url", "depth", "success"] and out.count() == 0
