"""Crawls over page and link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.urls import base_url, netloc, urldefrag
from corpusloom.session import materialize, top_k

# ---- fixed values -----------------------------------------------------------
SITEMAP_PATHS = [
    "/sitemap.xml", "/sitemap_index.xml", "/sitemaps.xml", "/sitemap/sitemap.xml",
    "/sitemap/index.xml", "/wp-sitemap.xml", "/sitemap-index.xml",
]
# ------------------------------------------------------------------------------


def unvisited(frontier: DataFrame, visited: DataFrame, keys: list[str]) -> DataFrame:
    return frontier.join(visited.select(*keys), keys, "left_anti")


def crawl_bfs(
    seeds: DataFrame, links: DataFrame, pages: DataFrame, max_depth: int, limit: int | None = None
) -> DataFrame:
    """Breadth-first crawls, one per seed row: crawl_id, url, depth, success.

    seeds: crawl_id, url. links: url, link. pages: url (what a fetch of it would find).
    Only links of the seed's host are followed; a level is cut at the page limit in
    url order. One join per level, materialised so that the plan does not grow.
    """
    known = materialize(pages.select(urldefrag(F.col("url")).alias("url")).distinct()).withColumn("success", F.lit(True))
    edges = materialize(
        links.select(urldefrag(F.col("url")).alias("url"), "link")
        .filter(netloc(F.col("url")) == netloc(F.col("link")))
        .distinct()
    )
    frontier = seeds.select("crawl_id", urldefrag(F.col("url")).alias("url"))
    visited = None
    for depth in range(max_depth):
        level = frontier.distinct()
        if visited is not None:
            level = unvisited(level, visited, ["crawl_id", "url"])
        if limit is not None:
            level = top_k(level, ["crawl_id"], [F.col("url")], limit, "_n")
            if visited is not None:
                used = visited.groupBy("crawl_id").agg(F.count("*").alias("_used"))
                level = level.join(used, "crawl_id").filter(F.col("_n") + F.col("_used") <= limit).drop("_used")
            level = level.drop("_n")
        level = materialize(
            level.join(known, "url", "left").select(
                "crawl_id", "url", F.lit(depth).alias("depth"), F.coalesce("success", F.lit(False)).alias("success")
            )
        )
        if level.isEmpty():
            break
        visited = level if visited is None else visited.unionByName(level)
        frontier = level.filter("success").join(edges, "url").select("crawl_id", F.col("link").alias("url"))
    if visited is None:
        return frontier.limit(0).select("crawl_id", "url", F.lit(0).alias("depth"), F.lit(False).alias("success"))
    return visited


def crawl_sitemap(urls: DataFrame, pages: DataFrame) -> DataFrame:
    """Sitemap urls with their markdown; a missing page is a failed row.

    urls: sitemap, url (null for a sitemap without entries). pages: url, markdown.
    """
    out = urls.join(pages.select("url", "markdown"), "url", "left")
    error = F.when(F.col("url").isNull(), "No URLs found in sitemap").when(
        F.coalesce("markdown", F.lit("")) == "", "Page could not be crawled"
    )
    return out.select("sitemap", "url", error.isNull().alias("success"), "markdown", error.alias("error"))


def sitemap_candidates(pages: DataFrame, robots: DataFrame | None = None) -> DataFrame:
    """Where the sitemaps of each site may be: seven well-known paths and the robots.txt entries."""
    sites = pages.select(base_url(F.col("url")).alias("site")).distinct()
    found = sites.select(
        "site",
        F.explode(F.array(*[F.concat("site", F.lit(p)) for p in SITEMAP_PATHS])).alias("sitemap_url"),
    )
    if robots is not None:
        found = found.unionByName(robots.select("site", "sitemap_url")).distinct()
    return found
