import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import cells, inverted, search
from corpusloom.plans.retrieval import cited_contexts, index_passages


def corpus(seed, n):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    return [(f"c{seed}-{k}", " ".join(rnd.choice(words[: rnd.choice([15, 120, 400])]) for _ in range(rnd.choice([0, 3, 20, 90])))) for k in range(n)]


def rows(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"]) for r in df.collect())


@pytest.fixture()
def texts(spark):
    made = corpus(1, 700) + [("null", None), ("empty", ""), ("punctuation", "?! ..."), ("Long", "w1 w2, W3 ÄÖ " * 5000), ("tie1", "w7 w8"), ("tie2", "w7 w8")]
    return spark.createDataFrame(made, "chunk_id string, text string").repartition(4)


def test_index_equals_a_scan(spark, folder, texts):
    more = spark.createDataFrame(corpus(2, 300), "chunk_id string, text string")
    asked = spark.createDataFrame(
        [(k, t[:80]) for k, (_, t) in enumerate(corpus(3, 60))] + [(90, "w1 w1 W2 äö"), (91, "nowhere"), (92, None), (93, "w7 w8")], "query_id int, text string").repartition(3)
    path = f"{folder}/index"
    assert inverted.extend(texts, path, buckets=8, range_docs=50) == 1
    assert rows(inverted.search(asked, path, 5)) == rows(search.bm25(asked, texts, 5))
    # a segment more changes frequencies and the average length of all
    assert inverted.extend(more, path, range_docs=50) == 2
    both = texts.unionAll(more)
    for k in (1, 10):
        assert rows(inverted.search(asked, path, k)) == rows(search.bm25(asked, both, k))
    assert rows(search.bm25(asked, both, 5, max_terms=10)) == rows(search.bm25(asked, both, 5))
    # a segment whose job died is not read, and its number not taken again
    os.makedirs(f"{path}/postings/segment=3/bucket=1")
    assert rows(inverted.search(asked, path, 5)) == rows(search.bm25(asked, both, 5))
    assert inverted.extend(more.limit(0), path) == 4
    assert rows(inverted.search(asked, path, 5)) == rows(search.bm25(asked, both, 5))
    plain = both.select("chunk_id", F.explode(search.terms(F.col("text"))).alias("term")).groupBy("term").agg(
        F.countDistinct("chunk_id").alias("df"), F.count("*").alias("occurrences"))
    assert sorted(map(tuple, inverted.dictionary(spark, path).collect())) == sorted(map(tuple, plain.collect()))


def test_a_search_reads_the_buckets_of_its_terms_and_few_ranges(spark, folder, monkeypatch):
    # topics: a range of its own would be needed to tell them apart, so a term is rare
    docs = spark.createDataFrame([(k, f"common rare{k % 97} topic{k % 400}") for k in range(4000)], "chunk_id long, text string")
    path = f"{folder}/index"
    inverted.extend(docs, path, buckets=16, range_docs=40)
    asked = spark.createDataFrame([(1, "topic17 rare17")], "query_id int, text string")
    seen, scored = [], []
    plain, pairs = inverted.materialize, inverted._scored

    def watched(df):
        seen.append(df._jdf.queryExecution().toString())
        return plain(df)

    monkeypatch.setattr(inverted, "materialize", watched)
    monkeypatch.setattr(inverted, "_scored", lambda p, *more: scored.append(p.count()) or pairs(p, *more))
    hits = rows(inverted.search(asked, path, 3))
    assert hits == rows(search.bm25(asked, docs, 3))
    bounds = next(plan for plan in seen if "max_tf" in plan and "PartitionFilters" in plan)
    physical = bounds[bounds.index("== Physical Plan"):]
    assert "PartitionFilters: [bucket" in physical.replace("isnotnull(bucket", "bucket") and " IN (" in physical
    assert "at:array" not in physical[physical.index("ReadSchema"):].split("\n")[0]
    assert sum(scored) < 60  # ranges of the 100 that exist


def test_contexts_from_an_index(spark, folder):
    docs = spark.createDataFrame([(k, f"https://h{k % 3}.org/", " ".join(f"w{(k * 7 + j) % 50}." for j in range(60))) for k in range(40)], "doc_key long, url string, text string")
    asked = spark.createDataFrame([(1, "w3 w4 w5"), (2, "nothing here")], "query_id int, text string")
    index_passages(docs, f"{folder}/p")
    result = lambda df: sorted(map(tuple, df.collect()))
    assert result(cited_contexts(asked, docs, 3, index=f"{folder}/p")) == result(cited_contexts(asked, docs, 3))


def test_texts_not_terms_are_shuffled_and_sorted(spark, folder, texts, monkeypatch):
    frames, group = [], type(texts).groupBy
    monkeypatch.setattr(type(texts), "groupBy", lambda df, *by: frames.append((df, by)) or group(df, *by))
    inverted.extend(texts, f"{folder}/x")
    dealt = next(df for df, by in frames if by == ("_range",))
    grouped = group(dealt, "_range").applyInArrow(lambda t: t, dealt.schema)
    plan = grouped._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 1 and "hashpartitioning(_range" in plan
    assert "_terms" in plan and "_terms" not in plan[plan.index("Sort ["):]


# ---- cells ---------------------------------------------------------------------


def clustered(spark, n, clusters, seed, key, dim=16, spread=0.08):
    rng = np.random.default_rng(11)
    middle = rng.standard_normal((clusters, dim))
    rng = np.random.default_rng(seed)
    made = middle[rng.integers(0, clusters, n)] + spread * rng.standard_normal((n, dim))
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(made)], f"{key} long, embedding array<float>")


def hits(df):
    return sorted((r["query_id"], r["rank"], r["chunk_id"], r["score"], r["distance"]) for r in df.collect())


def test_cells_are_exact_and_leave_out_most_of_clustered_vectors(spark, folder, monkeypatch):
    chunks, asked = clustered(spark, 3000, 40, 1, "chunk_id"), clustered(spark, 300, 40, 2, "query_id")
    odd = spark.createDataFrame([(9000, [0.0] * 16), (9001, None), (9002, [1.0] + [0.0] * 15), (9003, [1.0] + [0.0] * 15)], "chunk_id long, embedding array<float>")
    chunks = chunks.unionAll(odd)
    asked = asked.unionAll(odd.select((F.col("chunk_id") + 1).alias("query_id"), "embedding")).repartition(3)
    monkeypatch.setattr(cells, "SLICE_ROWS", 100)  # several slices a cell
    cells.build(chunks, f"{folder}/v", cells=40)
    scored = spark.sparkContext.accumulator(0)
    exact = search.knn(asked, chunks, 5)
    assert hits(cells.search(asked, f"{folder}/v", 5, counter=scored)) == hits(exact)
    assert 0 < scored.value < 0.2 * 303 * 3003  # each question and vector at once would be all of them
    assert hits(search.knn(asked, chunks, 5, max_broadcast=10)) == hits(exact)
    assert hits(cells.search_codes(asked, f"{folder}/v", 5, probes=None, depth=4000)) == hits(exact)
    few = cells.fit_probes(asked, f"{folder}/v", 5)
    assert few < 12
    share = cells.recall(cells.search_codes(asked, f"{folder}/v", 5, probes=few), exact).first()
    assert share["queries"] == 303 and share["recall"] >= 0.95


def test_hits_leave_a_task_as_k_a_question(spark, folder, monkeypatch):
    rng = np.random.default_rng(3)  # no clusters: every question meets every cell
    made = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((2000, 16)))]
    chunks = spark.createDataFrame(made, "chunk_id long, embedding array<float>")
    asked = chunks.where("chunk_id % 4 = 0").select(F.col("chunk_id").alias("query_id"), "embedding")
    cells.build(chunks, f"{folder}/v", cells=40)
    left, met = [], cells._met
    monkeypatch.setattr(cells, "_met", lambda *a: left.append(met(*a)) or left[-1])
    exact = hits(search.knn(asked, chunks, 5))
    assert hits(cells.search(asked, f"{folder}/v", 5)) == exact
    assert hits(cells.search_codes(asked, f"{folder}/v", 5, probes=None, depth=2000)) == exact
    assert [df.count() <= n * 5 * 500 for df, n in zip(left, (cells.SEED_CELLS, 1, 1))] == [True] * 3
    few = cells.search_codes(asked, f"{folder}/v", 5, probes=30, depth=100)
    assert left[-1].count() == 5 * 500 and few.groupBy("query_id").count().where("count = 5").count() == 500


def test_null_ids_and_hits_sorted_in_often(spark, folder, monkeypatch):
    chunks, asked = clustered(spark, 300, 1, 1, "chunk_id"), clustered(spark, 40, 1, 2, "query_id")
    null = spark.createDataFrame([(None, [1.0] * 16)], chunks.schema)
    exact = hits(search.knn(asked, chunks.unionAll(null), 5))
    monkeypatch.setattr(cells, "LOOSE", 50)
    cells.build(chunks.unionAll(null), f"{folder}/v", cells=4)
    assert hits(cells.search(asked, f"{folder}/v", 5)) == exact


def test_few_vectors_none_and_mixed_widths(spark, folder):
    one = spark.createDataFrame([(1, [3.0, 4.0])], "chunk_id int, embedding array<float>")
    asked = spark.createDataFrame([("a", [4.0, 3.0]), ("b", None)], "query_id string, embedding array<float>")
    cells.build(one, f"{folder}/one")
    assert hits(cells.search(asked, f"{folder}/one", 3)) == [("a", 1, 1, 0.96, 0.04)] == hits(cells.search_codes(asked, f"{folder}/one", 3))
    cells.build(one.limit(0), f"{folder}/none")
    assert cells.search(asked, f"{folder}/none", 3).collect() == []
    with pytest.raises(ValueError, match="no vector index"):
        cells.search(asked, f"{folder}/missing", 3)
    mixed = one.unionAll(spark.createDataFrame([(2, [1.0])], one.schema)).coalesce(1)
    with pytest.raises(Exception, match="one width"):
        cells.build(mixed, f"{folder}/mixed")


def test_only_the_cells_asked_for_are_read(spark, folder):
    cells.build(clustered(spark, 500, 10, 1, "chunk_id"), f"{folder}/v", cells=10)
    asked = cells._questions(clustered(spark, 1, 10, 2, "query_id"))
    pairs = cells._asked(asked, cells._centres(spark, f"{folder}/v"), lambda off, bound, floor: off == off.min())
    plan = cells._rows(spark, f"{folder}/v", pairs)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan and "= " in plan[plan.index("PartitionFilters"):].split("]")[0]
