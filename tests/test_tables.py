import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cache, metrics, validate
from corpusloom.operators.embed import map_items
from corpusloom.plans.ingestion import collection_for, ingest_pages
from corpusloom.session import with_position
from corpusloom.sources import collections as S
from corpusloom.streaming import jobs

CHUNK = "chunk_id string, url string, content string"


def test_collections(spark, folder):
    a = spark.createDataFrame([("1", "u", "a"), ("2", "u", "b")], CHUNK)
    S.write_collection(a, folder, "one", model="m", distance="cosine")
    S.append_collection(spark.createDataFrame([("2", "u", "B"), ("3", "u", "c"), ("3", "u", "c")], CHUNK), folder, "one")
    rows = lambda n: sorted((r.chunk_id, r.content) for r in S.read_collection(spark, folder, n).collect())
    assert rows("one") == [("1", "a"), ("2", "b"), ("3", "c")]
    S.append_collection(spark.createDataFrame([("2", "u", "B")], CHUNK), folder, "one", mode="replace")
    assert rows("one") == [("1", "a"), ("2", "B"), ("3", "c")]
    assert [r.chunk_id for r in S.get_collection(spark, folder, "one", 2, ["content"]).collect()] == ["1", "2"]
    S.create_collection(spark, folder, "two")
    with pytest.raises(ValueError):
        S.rename_collection(spark, folder, "one", "two")
    S.rename_collection(spark, folder, "one", "three")
    assert sorted((r.collection, r.embedding_model, r.chunks) for r in S.list_collections(spark, folder).collect()) == [
        ("three", "m", 3), ("two", "default", 0)]
    S.delete_collection(spark, folder, "three")
    assert [r.collection for r in S.list_collections(spark, folder).collect()] == ["two"]


def test_collections_outlive_lost_jobs(spark, folder):
    rows = spark.createDataFrame([("1", "u", "a"), ("2", "u", "b")], CHUNK)
    S.create_collection(spark, folder, "007")
    os.makedirs(f"{folder}/chunks/collection=007/version=1/_temporary")  # a first write that died
    assert S.read_collection(spark, folder, "007").count() == 0
    S.append_collection(rows, folder, "007")
    assert S.read_collection(spark, folder, "007").count() == 2
    assert [(r.collection, r.chunks) for r in S.list_collections(spark, folder).collect()] == [("007", 2)]
    bad = rows.withColumn("content", F.when(F.col("chunk_id") == "2", F.raise_error(F.lit("lost"))).otherwise("new"))
    with pytest.raises(Exception):
        S.write_collection(bad, folder, "007")  # a replacement that dies
    assert sorted(r.content for r in S.read_collection(spark, folder, "007").collect()) == ["a", "b"]
    S.append_collection(rows.withColumn("content", F.lit("new")), folder, "007", mode="replace")
    assert sorted(r.content for r in S.read_collection(spark, folder, "007").collect()) == ["new", "new"]
    S.rename_collection(spark, folder, "007", "1e3")
    assert [(r.collection, r.chunks) for r in S.list_collections(spark, folder).collect()] == [("1e3", 2)]


def test_rows_must_be_complete(spark, folder):
    with pytest.raises(Exception, match="collection row without content"):
        S.write_collection(spark.createDataFrame([("1", "u", None)], CHUNK), folder, "x")


def test_ingest_pages(spark, folder):
    pages = spark.createDataFrame([(1, "https://a.org/x", "<h1>T</h1><p>text</p>"), (2, "https://a.org/y", "<p></p>")], "page_id long, url string, html string")
    name = collection_for(spark, "https://a.org/x")
    assert name == "a-org-x"
    assert ingest_pages(pages, folder, name).count() == 1
    ingest_pages(pages, folder, name)
    r = S.read_collection(spark, folder, name).collect()
    assert len(r) == 1 and r[0].content == "# T\n\ntext" and len(r[0].embedding) == 64


def test_positions_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("v"))
    got = [(r.v, r.position) for r in with_position(df.repartition(9), [F.col("v")]).collect()]
    assert sorted(got) == [(v, i) for i, v in enumerate(sorted(r.v for r in df.collect()))]


def test_eviction(spark):
    rows = [(f"k{i}", i % 3, dt.datetime(2024, 1, 1, 0, i)) for i in range(20)]
    df = spark.createDataFrame(rows, "key string, access_count int, ts timestamp")
    left = {r.key for r in cache.evict(df, 20).collect()}
    assert {k for k, _, _ in rows} - left == {"k0", "k3", "k6", "k9"}
    assert cache.evict(df, 21).count() == 20


def test_cache_tables(spark):
    c = spark.createDataFrame([("a", 1), ("b", 2)], "key string, value int")
    q = spark.createDataFrame([("a",), ("c",), ("c",)], "key string")
    assert sorted((r.key, r.value, r.hit) for r in cache.cache_lookup(q, c).collect()) == [("a", 1, True), ("c", None, False), ("c", None, False)]
    assert [r.key for r in cache.cache_misses(q, c).collect()] == ["c"]
    assert sorted(tuple(r) for r in cache.cache_put(c, spark.createDataFrame([("b", 9)], "key string, value int")).collect()) == [("a", 1), ("b", 9)]


def test_chat(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"m{t}") for c, n in ((1, 100), (2, 101), (3, 500)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    got = {r.conv_id: (r.n, r.first) for r in cache.trim_chat(df).groupBy("conv_id").agg(F.count("*").alias("n"), F.min("turn").alias("first")).collect()}
    assert got == {1: (100, 0), 2: (50, 51), 3: (50, 450)}
    parts = cache.export_transcripts(df.filter("conv_id = 1"), part_size=60).orderBy("part").collect()
    assert len(parts) == 2 and parts[0].transcript.startswith("**Du**:\nm0\n\n---\n\n**Assistant**:\nm1\n\n---\n\n")


def test_rules(spark):
    df = spark.createDataFrame([("1", " https://a ", "abc", 0, None), ("", "ftp://a", " x ", -1, 0)],
                               "chunk_id string, url string, content string, chunk_index int, total_chunks int")
    out = validate.check_chunks(df)
    assert validate.ok_rows(out).count() == 1
    assert validate.quarantined(out).first().violations == ["url", "content", "chunk_id", "chunk_index", "total_chunks"]
    hits = spark.createDataFrame([(1, 1, 0.5, "https://a", "x" * 10), (1, 3, 1.5, "https://a", "x")], "query_id int, rank int, score double, url string, excerpt string")
    assert [r.violations for r in validate.check_hits(hits).orderBy("rank").collect()] == [[], ["rank", "score", "excerpt"]]


def test_metrics(spark):
    urls = spark.createDataFrame([("s", "https://a/1", None, None, 0.0, 2048), ("s", "https://a/1", None, "daily", 0.5, 2048), ("s", "http://b/2", None, None, None, 2048)],
                                 "sitemap string, url string, lastmod timestamp, changefreq string, priority double, file_size long")
    r = metrics.sitemap_quality(urls).first()
    assert (r.total_urls, r.unique_urls, r.urls_with_priority, r.domains, r.protocols) == (3, 2, 1, ["a", "b"], ["http", "https"])
    assert r.issues == ["Duplicate URLs found (1 duplicates)", "Multiple domains found in sitemap: a, b"]
    short = metrics.sitemap_quality(urls, listed=1).first()
    assert (short.host_count, short.domains, short.issues[1]) == (2, ["a"], "Multiple domains found in sitemap: a, ...")
    assert r.quality_score == pytest.approx(0.8 + 0.2 * (2 / 3) / 3, abs=1e-6)
    widths = lambda *ws: spark.createDataFrame([(c, [0.1] * w if w else None) for c, w in ws], "collection string, embedding array<float>")
    out = {r.collection: (r.compatible, r.reason) for r in metrics.check_dims(
        widths(("a", 384), ("b", 768), ("d", None)), widths(("a", 384), ("b", 3072), ("c", 768), ("d", 768))).collect()}
    assert out == {"a": (True, "Existing: 384D, Test: 384D"), "b": (False, "Existing: 768D, Test: 3072D"),
                   "c": (True, "Empty collection, no dimension constraints"), "d": (True, "No embeddings in collection")}


def test_map_items(spark):
    def half(v):
        if v == "bad":
            raise ValueError("no number")
        return str(int(v) / 2)

    out = {r.item: (r.success, r.result, r.error) for r in map_items(spark.createDataFrame([("4",), ("bad",)], "item string"), "item", half).collect()}
    assert out == {"4": (True, "2.0", None), "bad": (False, None, "no number")}


def run_stream(spark, folder, rows, schema, make, cuts=None):
    """Feed the rows in some files (two halves, say), one micro-batch each."""
    src, cuts = f"{folder}/in", cuts or [len(rows) // 2]
    for part in (rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    df = spark.createDataFrame([], schema)
    stream = make(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src))
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_ttl_cache_stream(spark, folder):
    rows = [("k", i, at(s)) for i, s in enumerate([0, 100, 300, 301, 600, 602])]
    out = run_stream(spark, folder, rows, "key string, id long, ts timestamp", lambda s: jobs.ttl_cache(s, 300))
    # 300 is still a hit and does not renew; 301 is a miss and stored; 601 later would be one too
    assert [r.hit for r in out.orderBy("id").collect()] == [False, True, True, False, True, False]


def test_breaker_stream(spark, folder):
    steps = [(0, False), (10, True), (20, False), (30, False), (100, True), (329, False), (330, False), (331, False), (340, True), (350, False), (360, False), (370, True)]
    rows = [("p", i, at(s), ok) for i, (s, ok) in enumerate(steps)]
    out = run_stream(spark, folder, rows, "key string, id long, ts timestamp, success boolean", jobs.circuit_breaker).orderBy("id").collect()
    assert [r.provider[0] for r in out] == list("pppp") + list("fff") + list("pppp") + ["f"]
    assert [r.open_after for r in out] == [False, False, False, True, True, True, True, False, False, False, True, True]


def test_late_rows_are_dropped(spark, folder):
    # the watermark that drops rows is the one of the batch before
    rows = [(at(0), "INFO"), (at(200), "ERROR"), (at(210), "INFO"), (at(10), "INFO"), (at(400), "INFO")]
    out = run_stream(spark, folder, rows, "ts timestamp, level string", lambda s: jobs.stream_progress(s, "60 seconds"), [2, 3])
    assert sorted((r.minute.minute, r.errors, r.ok) for r in out.collect()) == [(0, 0, 1), (3, 1, 1)]


def test_stream_dedup(spark, folder):
    rows = [("a", at(0)), ("a", at(5)), ("b", at(6)), ("a", at(7))]
    out = run_stream(spark, folder, rows, "k string, ts timestamp", lambda s: jobs.stream_dedup(s, ["k"], "ts", "1 hour"))
    assert sorted(r.k for r in out.collect()) == ["a", "b"]
