import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import embed, rank, search
from corpusloom.operators import context as ctx
from corpusloom.plans.retrieval import answer_all, cited_contexts


def vectors(spark, n, dim, seed, key):
    rnd = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rnd.integers(-3, 4, dim)]) for i in range(n)]
    return spark.createDataFrame(rows, f"{key} int, embedding array<float>"), rows


def exact(queries, chunks, k):
    def unit(v):
        v = np.array(v, dtype=float)
        n = np.linalg.norm(v)
        return v / (n if n else 1)

    out = {}
    for q, qv in queries:
        scored = sorted((-round(float(unit(qv) @ unit(cv)), 6), c) for c, cv in chunks)
        out[q] = [c for _, c in scored[:k]]
    return out


def ranked(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.chunk_id)
    return out


@pytest.mark.parametrize("max_broadcast", [4096, 3])
def test_knn_is_exact_with_ties(spark, max_broadcast):
    q, qs = vectors(spark, 10, 3, 1, "query_id")
    c, cs = vectors(spark, 300, 3, 2, "chunk_id")  # few distinct directions: many ties
    got = ranked(search.knn(q, c.repartition(7), 5, max_broadcast=max_broadcast))
    assert got == exact(qs, cs, 5)


def test_knn_edges(spark):
    q, _ = vectors(spark, 2, 3, 1, "query_id")
    c, _ = vectors(spark, 2, 3, 2, "chunk_id")
    assert search.knn(q.filter("false"), c, 5).count() == 0
    assert search.knn(q, c.filter("false"), 5).count() == 0
    assert search.knn(q, c, 5).count() == 4
    with pytest.raises(Exception, match="one width"):
        search.knn(q, c.unionByName(c.select("chunk_id", F.array(F.lit(1.0).cast("float")).alias("embedding"))).coalesce(1), 5).count()


def test_lsh_recall(spark):
    rnd = np.random.default_rng(3)
    base = rnd.standard_normal((40, 16))
    chunks = [(i * 40 + j, [float(x) for x in base[j] + 0.1 * rnd.standard_normal(16)]) for i in range(20) for j in range(40)]
    c = spark.createDataFrame(chunks, "chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(j, [float(x) for x in base[j]]) for j in range(40)], "query_id int, embedding array<float>")
    want, got = ranked(search.knn(q, c, 10)), ranked(search.knn_lsh(q, c, 10, dim=16))
    recall = sum(len(set(want[i]) & set(got.get(i, []))) for i in want) / 400
    assert recall > 0.9


def test_lsh_splits_a_hot_bucket(spark, monkeypatch):
    monkeypatch.setattr(search, "SLICE_ROWS", 40)
    monkeypatch.setattr(search, "BROADCAST_ROWS", 7)
    same = [1.0, 2.0, 3.0]
    c = spark.createDataFrame([(i, same) for i in range(300)] + [(1000 + i, [-1.0, 0.5, float(i)]) for i in range(20)], "chunk_id int, embedding array<float>")
    q = spark.createDataFrame([(i, same) for i in range(30)], "query_id int, embedding array<float>")
    got = ranked(search.knn_lsh(q, c, 10, dim=3, tables=2, bits=2))
    assert got == {i: list(range(10)) for i in range(30)}  # every copy ties: least ids, no row lost


def brute_bm25(queries, docs, k):
    import re

    tok = {d: [t for t in re.split(r"[^\w]+", text.lower()) if t] for d, text in docs}
    n, avg = len(docs), sum(map(len, tok.values())) / len(docs)
    df = {}
    for ts in tok.values():
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = {}
    for q, text in queries:
        terms = {t for t in re.split(r"[^\w]+", text.lower()) if t}
        scored = []
        for d, ts in tok.items():
            s = sum(
                math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * ts.count(t) * 2.2 / (ts.count(t) + 1.2 * (0.25 + 0.75 * len(ts) / avg))
                for t in terms if t in ts)
            if s:
                scored.append((-round(s, 6), d))
        if scored:
            out[q] = [d for _, d in sorted(scored)[:k]]
    return out


@pytest.mark.parametrize("max_terms", [200_000, 20])
def test_bm25_equals_brute_force(spark, max_terms):
    rnd = random.Random(4)
    vocab = ["the"] * 8 + [f"w{i}" for i in range(30)]
    docs = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 40)))) for i in range(120)]
    queries = [(i, " ".join(rnd.choice(vocab) for _ in range(4))) for i in range(24)] + [(99, "nothing here")]
    q = spark.createDataFrame(queries, "query_id int, text string")
    d = spark.createDataFrame(docs, "chunk_id int, text string").repartition(5)
    assert ranked(search.bm25(q, d, 7, max_terms=max_terms)) == brute_bm25(queries, docs, 7)


def test_bm25_without_matches(spark):
    q = spark.createDataFrame([(1, "x")], "query_id int, text string")
    d = spark.createDataFrame([(1, "y z")], "chunk_id int, text string")
    assert search.bm25(q, d, 3).count() == 0
    assert search.bm25(q.filter("false"), d, 3).count() == 0
    assert search.bm25(q, d.filter("false"), 3).count() == 0


def test_merge_and_fallback(spark):
    rows = [(1, 0, 1, 10, "a", "u", 0.5), (1, 0, 2, 11, "b", "u", 0.4), (1, 1, 1, 12, "b", "u", 0.9), (1, 1, 2, 13, "b", "v", 0.3)]
    hits = spark.createDataFrame(rows, "query_id int, variation_no int, rank int, chunk_id int, content string, url string, score double")
    out = [(r.chunk_id, r.copies, r.merged_rank) for r in search.merge_variations(hits).orderBy("merged_rank").collect()]
    assert out == [(10, 1, 1), (11, 2, 2), (13, 1, 3)]
    assert {r.chunk_id for r in search.dedup_prefix(hits).collect()} == {10, 11}
    long = hits.withColumn("content", F.concat(F.lit("p" * 100), "content"))
    assert {r.chunk_id for r in search.dedup_prefix(long).collect()} == {10, 11}
    assert {r.chunk_id for r in search.dedup_prefix(long, 100).collect()} == {10}


def test_a_task_emits_k_rows_a_query_whatever_its_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        rows = [(i, [float(i % 17), 1.0, float(i % 5)]) for i in range(400)]
        chunks = spark.createDataFrame(rows, "chunk_id long, embedding array<double>").coalesce(1)
        queries = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 1.0])], "query_id long, embedding array<double>")
        found = search.knn(queries, chunks, 3)
        plan = found.collect()
        assert len(plan) == 6
        # every id twice, and more rows of one id than a block holds
        many = queries.unionAll(queries.selectExpr("query_id", "transform(embedding, x -> x * 2)")).unionAll(queries)
        key = lambda df: sorted((r.query_id, r.chunk_id, r.score) for r in df.dropDuplicates(["query_id", "chunk_id"]).collect())
        assert set(key(search.knn(many, chunks, 3, max_broadcast=2))) <= set(key(found))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_hybrid_sides(spark):
    cols = "query_id int, chunk_id int, content string, score double, rank int"
    sem = spark.createDataFrame([(1, 1, "a", 0.9, 1), (1, 2, "b", 0.8, 2), (1, 3, "c", 0.7, 3), (2, 5, "x", 0.9, 1), (2, 6, "x", 0.8, 2)], cols)
    lex = spark.createDataFrame([(1, 9, "b", 3.0, 1), (1, 8, "d", 2.0, 2), (3, 7, "y", 1.0, 1)], cols)
    out = [(r.query_id, r.chunk_id, r.source) for r in search.hybrid(sem, lex, 4).orderBy("query_id", "rank").collect()]
    assert out == [
        (1, 1, "semantic"), (1, 2, "semantic"), (1, 8, "lexical"),
        (2, 5, "semantic"), (2, 6, "semantic"), (3, 7, "lexical")]  # one side only: kept as it is


def test_documents_are_scored_in_slices_of_bounded_words(spark, monkeypatch):
    monkeypatch.setattr(search, "TOKENS", 40)
    lists = [["a"] * n for n in (0, 100, 5, 30, 6, 0, 41, 3, 40)] + [None, ["b"]]
    batch = pa.RecordBatch.from_pydict({"_terms": pa.array(lists, pa.list_(pa.string()))})
    parts = [p.column("_terms").to_pylist() for p in search._parts(batch, 3)]
    assert sum(parts, []) == lists and all(len(p) <= 3 for p in parts)
    assert all(len(p) == 1 or sum(len(x or ()) for x in p) <= 40 for p in parts)
    docs = spark.createDataFrame([(k, f"w{k % 7} w{k % 5} " * (k % 9)) for k in range(90)], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "w1 w2"), (2, "w3"), (3, "none")], "query_id int, text string")
    small = sorted(map(tuple, search.bm25(asked, docs, 4).collect()))
    monkeypatch.setattr(search, "TOKENS", 10**9)
    assert small == sorted(map(tuple, search.bm25(asked, docs, 4).collect())) and len(small) == 8


def test_hybrid_shuffles_no_text_that_is_dropped(spark):
    cols = "query_id int, chunk_id int, content string, score double, rank int"
    sem, lex = (spark.createDataFrame([(1, k, "a", 0.9, 1)], cols) for k in (1, 2))
    plan, carried = search.hybrid(sem, lex, 4).drop("content")._jdf.queryExecution().optimizedPlan(), []
    while plan.children().size():
        if plan.nodeName() == "Window":
            carried.append(plan.children().head().output().toString())
        plan = plan.children().head()
    assert carried and not any("content#" in c for c in carried)


def test_selection_rules(spark):
    rows = [(1, i, 0.9 - i * 0.01, i + 1, i * 0.1) for i in range(40)] + [(2, i, 0.3 - i * 0.01, i + 1, 0.0) for i in range(40)]
    hits = spark.createDataFrame(rows, "query_id int, chunk_id int, score double, rank int, distance double")
    got = {r["query_id"]: r["count"] for r in rank.adaptive_select(hits, 10).groupBy("query_id").count().collect()}
    assert got == {1: 20, 2: 20}
    assert rank.adaptive_select(hits, 3).groupBy("query_id").count().filter("count = 15").count() == 2
    d = {(r.query_id, r.rank): r.score for r in rank.distance_to_score(hits, 5).collect()}
    assert d[(1, 1)] == 1.0 and d[(2, 1)] == 0.5 and len(d) == 30


def test_relevance_scores(one):
    score = lambda q, c: one(rank.relevance_unified_score, q=q, c=c)
    # 20 * 1/2 + 5 * (5/3) + 2 * (-2)
    assert score("Apfel Birne", "ein apfel") == pytest.approx(10 + 25 / 3 - 4, abs=1e-6)
    assert score("was ist Apfel", "x" * 250 + " ist ein apfel") == pytest.approx(20 + 25 / 3 + 6 + 3, abs=1e-6)
    assert one(rank.relevance_extended_score, q="was ist ein Apfel", c="apfel ist") == 10 + 2 + 2 - 2
    assert one(rank.enhanced_score, b=0.5, q="Apfel", c="apfel" + " x" * 100, u="https://docs.a.org") == pytest.approx(0.95)


def test_rerank_fallback(spark):
    rows = [(1, 1, 0.2, 1, "apfel", "u", 0.1), (1, 2, 0.3, 2, "x", "u", 0.9), (2, 3, 0.2, 1, "apfel " * 50, "u", None), (2, 4, 0.3, 2, "x", "u", 0.9)]
    hits = spark.createDataFrame(rows, "query_id int, chunk_id int, score double, rank int, content string, url string, rerank_score double")
    out = [(r.query_id, r.chunk_id, r.degraded) for r in
           rank.rerank_fallback(hits.withColumn("question", F.lit("Apfel")), 5).orderBy("query_id", "rank").collect()]
    assert out == [(1, 2, False), (1, 1, False), (2, 3, True), (2, 4, True)]


def test_high_recall(spark):
    good = "eins zwei drei vier fünf sechs sieben"
    rows = [(1, good), (2, f"  {good}\n"), (3, "zu kurz"), (4, "bla " * 20), (5, "© 2024 a all rights reserved powered by b c d")]
    df = spark.createDataFrame(rows, "chunk_id int, content string")
    assert [r.chunk_id for r in rank.high_recall(df, [], [F.col("chunk_id")]).collect()] == [1]


def test_citations_and_context(spark):
    rows = [(1, 1, "A", "u1", 0.9), (1, 2, "B", "u2", 0.8), (1, 3, "C", "u1", 0.7)] + [(2, i, "t", f"v{i:02}", 0.5) for i in range(1, 23)]
    hits = spark.createDataFrame(rows, "query_id int, rank int, content string, url string, score double")
    marks = {(r.query_id, r.rank): r.marker for r in ctx.citation_numbers(hits).collect()}
    assert [marks[(1, i)] for i in (1, 2, 3)] == ["¹", "²", "¹"]
    assert (marks[(2, 10)], marks[(2, 20)], marks[(2, 21)]) == ("¹⁰", "²⁰", "^21")
    queries = spark.createDataFrame([(1,), (3,)], "query_id int")
    out = {r.query_id: r.context for r in ctx.build_context(hits.filter("query_id = 1"), queries).collect()}
    assert out[3] == ctx.NO_CONTEXT
    assert out[1].startswith("[Quelle ¹] A\n\n---\n\n[Quelle ²] B\n\n---\n\n[Quelle ¹] C\n\n--- QUELLENVERZEICHNIS ---\n[¹](u1) u1\n[²](u2) u2\n\n--- ZITATIONS-MAPPING ---\n")
    assert "[¹](u1) für u1\n[²](u2) für u2\n" in out[1]


def test_confidence(spark):
    hits = spark.createDataFrame([(1, "u", 0.8), (1, "u", 0.6)], "query_id int, url string, score double")
    value = ctx.confidence(hits, external=True, cache_hit_rate=0.5).first().confidence
    assert value == pytest.approx(0.4 * 0.7 + 0.2 * 0.5 + 0.15 * 0.5 + 0.15 + 0.05)
    assert ctx.confidence(hits, True, 0.5, failed=True).first().confidence == pytest.approx(value / 2)


def test_extractive_answer(spark):
    long = "Satz eins ist hier lang genug. " * 30
    rows = [(1, 1, long.strip(), "https://b"), (1, 2, "w" * 60 + " Weblinks x", "https://a"), (1, 3, "kurz", "https://c"), (1, 4, "z" * 80, "https://d"), (2, 1, "kurz", "u")]
    out = {r.query_id: r.answer for r in ctx.extractive_answer(
        spark.createDataFrame(rows, "query_id int, rank int, content string, url string"), "wissen").collect()}
    text = out[1]
    assert text.startswith("**Antwort basierend auf 'wissen':**\n\nSatz eins")
    assert "\n\n**Weitere relevante Informationen:**\n• " + "w" * 60 + "\n\n**Quellen:**\n1. https://a\n2. https://b\n" in text
    assert text.endswith("\n*Gefunden: 4 Chunks, verwendet: 2 nach Bereinigung*")
    assert out[2] == ctx.NO_USABLE


def test_embedder_and_generator(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, " "), (3, None)], "id int, text string")
    out = {r.id: r.embedding for r in embed.with_embedding(df, "text").collect()}
    assert out[2] is None and out[3] is None and sum(x * x for x in out[1]) == pytest.approx(1, abs=1e-6)
    gen = embed.with_generated(df, "text", "out", "text", lambda s: s.str.upper())
    assert [r.out for r in gen.orderBy("id").collect()] == ["A B A", " ", None]

    def broken(_):
        raise RuntimeError("model down")

    assert [r.out for r in embed.with_generated(df, "text", "out", "text", broken).orderBy("id").collect()] == ["a b a", " ", None]
    told = embed.with_generated(df, "text", "out", "text", broken, error="why")
    assert {r.why for r in told.collect()} == {"RuntimeError: model down"}
    with pytest.raises(ValueError, match="model down"):
        embed.gate_errors(told, "why")
    assert embed.gate_errors(embed.with_generated(df, "text", "out", "text", lambda s: s, error="why"), "why").count() == 3


def test_whole_job(spark):
    docs = [(i, f"Spark Dokument Nummer {i} über Verteilung und Daten. Es enthält Wort{i} und mehr Text hier.", f"https://d.org/{i % 4}") for i in range(40)]
    chunks = embed.with_embedding(spark.createDataFrame(docs, "chunk_id int, content string, url string"), "content")
    questions = spark.createDataFrame([(1, "Was ist Wort7"), (2, "Unterschied Verteilung Daten")], "query_id int, text string")

    def vary(prompts):
        return prompts.map(lambda p: "andere Frage nach Wort7\nnoch eine")

    out = {r.query_id: r.response for r in answer_all(questions, chunks, "markdown", 5, vary=vary).collect()}
    assert set(out) == {1, 2} and all(t.startswith("# Antwort\n\n") and "## Quellen" in t for t in out.values())
    assert "Wort7" in out[1]
    for fmt in ("text", "json", "structured"):
        assert answer_all(questions, chunks, fmt, 5).filter("response is null").count() == 0
    small = spark.createDataFrame([(f"https://d.org/{i}", i, t) for i, t, _ in docs], "url string, doc_key int, text string")
    assert cited_contexts(questions, small, 3).filter("context like '[Quelle%'").count() == 2


def test_contexts_look_past_copies(spark):
    from corpusloom.plans.retrieval import distinct_hits

    rows = [(f"c{i}", "u", "alpha beta" if i < 40 else f"alpha beta gamma{i}") for i in range(44)]
    chunks = spark.createDataFrame(rows, "chunk_id string, url string, content string")
    questions = spark.createDataFrame([(1, "alpha beta"), (2, "gamma41"), (3, "none")], "query_id long, text string")
    found = {r.query_id: r["count"] for r in distinct_hits(questions, chunks, 4).groupBy("query_id").count().collect()}
    assert found[1] >= 4 and found[2] == 1 and 3 not in found
