"""Sitemap and robots.txt scans.

A sitemap file is bounded by its protocol (50 MB), so one file is one row in `read_sitemaps`;
the urls of all files are exploded and processed as one distributed table. Files of any size, which some generators write,
are read by `read_large_sitemaps`: Spark cuts them into splits, an entry is a record, and no task sees a whole file.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import parse_sitemap_date, strip
from corpusloom.functions.urls import resolve_url
from corpusloom.session import materialize

# ---- fixed values -----------------------------------------------------------
ROOT_TAG = r"(?s)^\s*(?:<\?.*?\?>\s*)?(?:<!--.*?-->\s*)*<(?:\w+:)?(\w+)"
LOC = r"(?s)<(?:\w+:)?loc>(.*?)</(?:\w+:)?loc>"
ROBOTS_ENTRY = r"(?imd)^sitemap:\s*(.+)$"
ENTRY_XML = (
    "url array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>,"
    "sitemap array<struct<loc:string,lastmod:string>>, _corrupt_record string"
)
LARGE_ENTRY = "loc string, lastmod string, changefreq string, priority string, _corrupt_record string"
TAG = r"(?s)<(/?)([\w:.-]+)[^<]*$"
ENTRY_END = r"</(?:[\w.-]+:)?$"
# ------------------------------------------------------------------------------


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: file, content."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")
    )


def parse_sitemaps(files: DataFrame) -> DataFrame:
    """One row per sitemap entry, or one invalid row per unreadable file.

    Columns: file, is_valid, error, sitemap_type, file_size, url, lastmod, changefreq, priority.
    """
    root = F.regexp_extract("content", ROOT_TAG, 1)
    doc = files.select(
        "file",
        F.octet_length("content").alias("file_size"),
        root.alias("root"),
        F.from_xml("content", ENTRY_XML, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("doc"),
    )
    broken = F.col("doc").isNull() | F.col("doc._corrupt_record").isNotNull()
    doc = doc.select(
        "file", "file_size",
        F.when(broken, "XML parsing error")
        .when(~F.col("root").isin("urlset", "sitemapindex"), F.concat(F.lit("Unknown sitemap format: "), "root"))
        .alias("error"),
        F.col("root").alias("sitemap_type"),
        F.when(F.col("root") == "urlset", F.col("doc.url")).otherwise(
            F.transform(
                F.col("doc.sitemap"),
                lambda s: F.struct(
                    s["loc"].alias("loc"), s["lastmod"].alias("lastmod"),
                    F.lit(None).cast("string").alias("changefreq"), F.lit(None).cast("string").alias("priority"),
                ),
            )
        ).alias("entries"),
    )
    entries = F.filter(
        F.when(F.col("error").isNull(), F.col("entries")), lambda e: strip(F.coalesce(e["loc"], F.lit(""))) != ""
    )
    rows = doc.select(
        "file", "file_size", "error", "sitemap_type", F.explode_outer(entries).alias("e")
    )
    return rows.select(
        "file",
        F.col("error").isNull().alias("is_valid"),
        "error",
        F.when(F.col("error").isNull(), F.col("sitemap_type")).otherwise("urlset").alias("sitemap_type"),
        "file_size",
        strip(F.col("e.loc")).alias("url"),
        parse_sitemap_date(strip(F.col("e.lastmod"))).alias("lastmod"),
        strip(F.col("e.changefreq")).alias("changefreq"),
        strip(F.col("e.priority")).try_cast("double").alias("priority"),
    )


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    return parse_sitemaps(read_files(spark, path))


def _literal(file: str) -> str:
    """The path that a reader takes for a file as its metadata names it: decoded, and without wildcards."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(file))


def _records(spark: SparkSession, paths: list[str], separator: str) -> DataFrame:
    """Records of splittable text that end with a separator (which they don't hold): file, size of the file, record."""
    lines = spark.read.option("lineSep", separator).text(paths)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("file_size"),
                        F.col("_metadata.file_block_start").alias("_at"), "value")


def large_files(spark: SparkSession, path: str) -> DataFrame:
    """Per file what its tags tell: file, file_size, root (null: none), balanced (every tag that opens is closed, one root).

    One pass over the splits; tags are counted by name where they are read, and a file's row is combined before the shuffle.
    """
    tags = _records(spark, [path], ">").select(
        "file", "file_size", "_at", F.monotonically_increasing_id().alias("_no"), F.regexp_extract("value", TAG, 1).alias("close"),
        F.regexp_extract("value", TAG, 2).alias("name"), F.col("value").endswith("/").alias("empty"))
    named = tags.where("name <> ''")
    sign = F.when(F.col("close") == "/", -1).when(F.col("empty"), 0).otherwise(1)
    by_name = named.groupBy("file", "file_size", "name").agg(
        F.sum(sign).alias("open"), F.count("*").alias("n"), F.min(F.struct("_at", "_no")).alias("first"))
    whole = by_name.groupBy("file", "file_size").agg(
        F.min_by("name", "first").alias("_root"), F.min_by("n", "first").alias("_n"), F.max(F.abs("open")).alias("_open"))
    root = F.regexp_extract("_root", r"([\w.-]+)$", 1)
    return whole.select("file", "file_size", root.alias("root"), ((F.col("_open") == 0) & (F.col("_n") <= 2)).alias("balanced"))


def _entries(spark: SparkSession, paths: list[str], tag: str) -> DataFrame:
    """file and entry (a struct, null if it can't be read) of each element of that name, in any prefix."""
    inner = F.regexp_replace("value", rf"(?s)^.*<(?:[\w.-]+:)?{tag}(?:\s[^>]*)?>", "")
    parts = _records(spark, paths, f"{tag}>").select("file", inner.alias("inner")).where(F.col("inner").rlike(ENTRY_END))
    xml = F.concat(F.lit("<e>"), F.regexp_replace("inner", ENTRY_END, ""), F.lit("</e>"))
    read = parts.select("file", F.from_xml(xml, LARGE_ENTRY, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}).alias("e"))
    return read.select("file", F.when(F.col("e._corrupt_record").isNull(), F.col("e")).alias("e"))


def read_large_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """The rows of `read_sitemaps` without holding a file in memory.

    The root and the balance of tags are judged over all splits of a file, its entries one by one. A file with an entry
    that can't be read, or tags that don't match up, is invalid as a whole. A bare `url>` (`sitemap>`) inside of a text makes
    its file invalid too. The paths of the files, which Spark's driver lists anyway, are sorted out by root on the driver.
    """
    files = materialize(large_files(spark, path))
    found = None
    for root, tag in (("urlset", "url"), ("sitemapindex", "sitemap")):
        paths = [_literal(r.file) for r in files.where((F.col("root") == root) & F.col("balanced")).select("file").collect()]
        if paths:
            rows = _entries(spark, paths, tag)
            found = rows if found is None else found.unionByName(rows)
    if found is None:
        found = spark.createDataFrame([], f"file string, e struct<{LARGE_ENTRY}>")
    found = materialize(found)
    broken = found.where("e is null").select("file", F.lit(True).alias("_broken")).distinct()
    known = F.col("root").isin("urlset", "sitemapindex")
    judged = files.join(broken, "file", "left").select(
        "file", "file_size", "root",
        F.when(~F.col("balanced") | F.col("_broken"), "XML parsing error")
        .when(~known, F.concat(F.lit("Unknown sitemap format: "), "root")).alias("error"))
    index = F.col("root") == "sitemapindex"
    kept = found.where(strip(F.coalesce("e.loc", F.lit(""))) != "").join(broken, "file", "left_anti")
    return judged.join(kept, "file", "left").select(
        "file", F.col("error").isNull().alias("is_valid"), "error",
        F.when(F.col("error").isNull(), F.col("root")).otherwise("urlset").alias("sitemap_type"), "file_size",
        strip(F.col("e.loc")).alias("url"), parse_sitemap_date(strip(F.col("e.lastmod"))).alias("lastmod"),
        F.when(~index, strip(F.col("e.changefreq"))).alias("changefreq"),
        F.when(~index, strip(F.col("e.priority")).try_cast("double")).alias("priority"),
    )


def sitemap_locs(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(LOC), 1)


def read_sitemap_locs(spark: SparkSession, path: str) -> DataFrame:
    """Every loc of every file, in any namespace: file, url."""
    return read_files(spark, path).select("file", F.explode(sitemap_locs(F.col("content"))).alias("url"))


def robots_sitemaps(content: Column, base: Column) -> Column:
    """Sitemap entries of a robots.txt, relative ones resolved on the host."""
    return F.transform(
        F.regexp_extract_all(content, F.lit(ROBOTS_ENTRY), 1),
        lambda m: F.when(strip(m).startswith("http"), strip(m)).otherwise(resolve_url(base, strip(m))),
    )


def read_robots(spark: SparkSession, path: str, base: Column) -> DataFrame:
    """file, sitemap_url for every robots.txt under the path; `base` gives the site of a file."""
    return read_files(spark, path).select(
        "file", F.explode(robots_sitemaps(F.col("content"), base)).alias("sitemap_url")
    )
