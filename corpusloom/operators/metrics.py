"""Aggregates over collections, sitemaps, caches, batches, providers and chats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.urls import netloc, scheme
from corpusloom.session import top_k

# ---- fixed values -----------------------------------------------------------
MAX_SITEMAP_URLS = 50000
MAX_SITEMAP_KB = 10240
ACCEPTED_SHARE = 0.95
# ------------------------------------------------------------------------------


def ratio(part, whole):
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def collection_stats(chunks: DataFrame, by: list[str] | None = None) -> DataFrame:
    return chunks.groupBy(*(by or [])).agg(
        F.count("*").alias("chunks"), F.countDistinct("url").alias("urls")
    )


def check_integrity(expected: DataFrame, actual: DataFrame, key: str = "collection") -> DataFrame:
    """Expected and actual row counts per collection; accepted only when equal (and so at least 95 %).

    A collection that received rows nobody expected is listed with 0 expected ones.
    """
    e = expected.groupBy(key).agg(F.count("*").alias("expected"))
    a = actual.groupBy(key).agg(F.count("*").alias("actual"))
    zero = F.lit(0).cast("long")
    out = e.join(a, key, "full").select(key, F.coalesce("expected", zero).alias("expected"), F.coalesce("actual", zero).alias("actual"))
    share = ratio(F.col("actual"), F.col("expected"))
    return out.select(
        key, "expected", "actual",
        (F.col("expected") == F.col("actual")).alias("intact"),
        ((F.col("expected") == F.col("actual")) & (share >= ACCEPTED_SHARE)).alias("accepted"),
        F.concat(F.col("actual").cast("string"), F.lit("/"), F.col("expected").cast("string")).alias("summary"),
    )


def mismatch_samples(expected: DataFrame, actual: DataFrame, id_col: str, key: str = "collection", rows: int = 5) -> DataFrame:
    """Up to `rows` ids per collection that only one side has: collection, id, side (missing or unexpected)."""
    e, a = expected.select(key, id_col), actual.select(key, id_col)
    missing = e.join(a, [key, id_col], "left_anti").withColumn("side", F.lit("missing"))
    found = missing.unionByName(a.join(e, [key, id_col], "left_anti").withColumn("side", F.lit("unexpected")))
    return top_k(found, [key, "side"], [F.col(id_col)], rows, "_n").drop("_n")


def check_dims(chunks: DataFrame, batch: DataFrame, key: str = "collection") -> DataFrame:
    """Vector-width compatibility of each collection with the new vectors meant for it."""
    width = F.size("embedding")
    have = chunks.groupBy(key).agg(
        F.count("*").alias("collection_count"), F.max(width).alias("expected_dimension"), F.min(width).alias("_least")
    )
    new = batch.groupBy(key).agg(F.max(width).alias("test_dimension"), F.min(width).alias("_new_least"))
    out = new.join(have, key, "left").withColumn("collection_count", F.coalesce("collection_count", F.lit(0)))
    want, got = F.col("expected_dimension"), F.col("test_dimension")
    mixed = (F.col("_least") != want) | (F.col("_new_least") != got)
    reason = (
        F.when(F.coalesce(mixed, F.lit(False)), "Vectors of several widths")
        .when(F.col("collection_count") == 0, "Empty collection, no dimension constraints")
        .when(want.isNull(), "No embeddings in collection")
        .when(got.isNull(), "No test embedding provided")
        .otherwise(F.concat(F.lit("Existing: "), want.cast("string"), F.lit("D, Test: "), got.cast("string"), F.lit("D")))
    )
    return out.select(
        key, "collection_count", "expected_dimension", "test_dimension",
        (F.coalesce(want == got, F.lit(True)) & ~F.coalesce(mixed, F.lit(False))).alias("compatible"), reason.alias("reason"),
    )


def sitemap_quality(urls: DataFrame, key: str = "sitemap", listed: int = 100) -> DataFrame:
    """Quality of each sitemap. urls: sitemap, url, lastmod, changefreq, priority, file_size.

    `host_count` counts all hosts; the first `listed` of them by name are in `domains` (each row of the sums holds one host at most).
    """
    host, proto = netloc(F.col("url")), scheme(F.col("url"))
    per = urls.groupBy(key).agg(
        F.count("*").alias("total_urls"),
        F.countDistinct("url").alias("unique_urls"),
        F.countDistinct(host).alias("host_count"),
        F.count("lastmod").alias("urls_with_lastmod"),
        F.count_if(F.coalesce(F.col("priority"), F.lit(0.0)) != 0).alias("urls_with_priority"),
        F.count_if(F.coalesce(F.col("changefreq"), F.lit("")) != "").alias("urls_with_changefreq"),
        F.round(F.max("file_size") / 1024, 6).alias("file_size_kb"),
        F.array_sort(F.collect_set(proto)).alias("protocols"),
    )
    hosts = top_k(urls.select(key, host.alias("_host")).where("_host is not null").distinct(), [key], [F.col("_host")], listed + 1, "_n")
    hosts = hosts.groupBy(key).agg(F.array_sort(F.collect_list("_host")).alias("_hosts"))
    hosts = hosts.withColumnRenamed(key, "_key")
    per = per.join(hosts, F.col(key).eqNullSafe(F.col("_key")), "left").withColumn(
        "domains", F.slice(F.coalesce("_hosts", F.array().cast("array<string>")), 1, listed)).drop("_hosts", "_key")
    total, unique = F.col("total_urls"), F.col("unique_urls")
    issues = F.array_compact(F.array(
        F.when(total != unique, F.concat(
            F.lit("Duplicate URLs found ("), (total - unique).cast("string"), F.lit(" duplicates)"))),
        F.when(total > MAX_SITEMAP_URLS, "Sitemap contains more than 50,000 URLs (consider splitting)"),
        F.when(F.col("file_size_kb") > MAX_SITEMAP_KB, "Sitemap file is larger than 10MB (consider compression)"),
        F.when(F.col("host_count") > 1, F.concat(
            F.lit("Multiple domains found in sitemap: "), F.array_join("domains", ", "),
            F.when(F.col("host_count") > listed, F.lit(", ...")).otherwise(""))),
    ))
    complete = (F.col("urls_with_lastmod") + F.col("urls_with_priority") + F.col("urls_with_changefreq")) / total / 3
    score = 1.0 - F.size("issues") * 0.1 + complete * 0.2
    return per.withColumn("issues", issues).withColumn(
        "quality_score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6)
    )


def best_sitemap(sitemaps: DataFrame, key: str = "site") -> DataFrame:
    """Per site the valid sitemap with most urls (ties: least url), the total, and how it was discovered.

    sitemaps: site, sitemap_url, is_valid, url_count, from_robots.
    """
    ok = F.col("is_valid")
    out = sitemaps.groupBy(key).agg(
        F.min_by(F.when(ok, F.col("sitemap_url")), F.when(ok, F.struct(-F.col("url_count"), F.col("sitemap_url"))))
        .alias("best_sitemap"),
        F.coalesce(F.sum(F.when(ok, F.col("url_count"))), F.lit(0)).alias("total_urls"),
        F.bool_or(F.col("sitemap_url").contains("/sitemap.xml")).alias("_standard"),
        F.bool_or("from_robots").alias("_robots"),
        F.count("sitemap_url").alias("_found"),
    )
    method = (
        F.when(F.col("_found") == 0, "none_found").when(F.col("_standard"), "standard_location")
        .when(F.col("_robots"), "robots_txt").otherwise("inferred")
    )
    return out.select(key, "best_sitemap", "total_urls", method.alias("discovery_method"))


def cache_stats(log: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Hits, misses, hit percentage and combined rate. log: key, hit (boolean)."""
    hits, misses = F.count_if("hit"), F.count_if(~F.col("hit"))
    return log.groupBy(*(by or [])).agg(
        F.countDistinct("key").alias("cache_size"),
        hits.alias("hit_count"),
        misses.alias("miss_count"),
        F.round(ratio(hits, hits + misses) * 100, 1).alias("hit_rate_percent"),
        F.round(ratio(hits, hits + misses), 6).alias("hit_rate"),
    )


def batch_metrics(log: DataFrame) -> DataFrame:
    """Per batch: size, mean time, success share and flags. log: batch, success, seconds."""
    ok, n = F.count_if("success"), F.count("*")
    return log.groupBy("batch").agg(
        n.alias("batch_size"),
        F.round(F.avg("seconds"), 6).alias("avg_processing_time"),
        ok.alias("successes"),
        F.round(ratio(ok, n), 6).alias("success_rate"),
        (ok > 0).alias("any_successful"),
        (ok < n).alias("any_failed"),
    )


def provider_metrics(log: DataFrame) -> DataFrame:
    """Requests, successes and rate per provider. log: provider, success."""
    ok, n = F.count_if("success"), F.count("*")
    return log.groupBy("provider").agg(
        n.alias("total_requests"), ok.alias("successful_requests"), F.round(ratio(ok, n), 6).alias("success_rate")
    )


def chat_stats(messages: DataFrame) -> DataFrame:
    return messages.agg(
        F.count("*").alias("messages"),
        F.count_if(F.col("role") == "user").alias("user_questions"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("total_chars"),
    )


def progress_summary(log: DataFrame) -> DataFrame:
    """Counters per minute of a log (ts, level)."""
    per = log.groupBy(F.date_trunc("minute", "ts").alias("minute"))
    return per.agg(
        F.count_if(F.col("level") == "ERROR").alias("errors"),
        F.count_if(F.col("level") != "ERROR").alias("ok"),
        F.count("*").alias("processed"),
    )
