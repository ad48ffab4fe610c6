import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import embed, memo
from corpusloom.plans import ingestion
from corpusloom.plans.ingestion import ingest_pages
from corpusloom.plans.retrieval import answer_all
from corpusloom.sources import collections as S


def counted(spark, model):
    calls = spark.sparkContext.accumulator(0)

    def run(texts: pd.Series) -> pd.Series:
        calls.add(len(texts))
        return model(texts)

    return calls, run


def test_a_text_is_computed_once(spark, folder):
    calls, upper = counted(spark, lambda t: t.str.upper())
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "")], "id int, prompt string").withColumn("f", F.lit("none")).repartition(3)
    ask = lambda df, kind="k": {r["id"]: r["out"] for r in memo.remembered_text(df, "prompt", "out", "f", folder, kind, upper).collect()}
    assert ask(rows) == {1: "A", 2: "B", 3: "A", 4: "none", 5: "none"} and calls.value == 3
    assert ask(rows.where("id < 5")) == {1: "A", 2: "B", 3: "A", 4: "none"} and calls.value == 3
    more = rows.unionAll(spark.createDataFrame([(6, "c", "none")], rows.schema))
    assert ask(more)[6] == "C" and calls.value == 5  # the new one, and the empty answer again
    assert ask(rows.limit(0)) == {}
    assert ask(rows.where("id = 1"), "other") == {1: "A"} and calls.value == 6


def test_failed_calls_are_not_kept(spark, folder):
    state = {"bad": True}
    rows = spark.createDataFrame([(1, "a")], "id int, prompt string").withColumn("f", F.lit("none"))

    def broken(texts):
        raise RuntimeError("down")

    assert memo.remembered_text(rows, "prompt", "out", "f", folder, "k", broken).first()["out"] == "none"
    assert memo.remembered_text(rows, "prompt", "out", "f", folder, "k", lambda t: t + "!").first()["out"] == "a!"
    assert state["bad"]


def test_embeddings_are_the_same_by_way_of_the_store(spark, folder):
    rows = spark.createDataFrame([(1, "one two"), (2, " "), (3, None), (4, "one two")], "id int, content string")
    plain = {r["id"]: r["embedding"] for r in embed.with_embedding(rows, "content").collect()}
    for _ in range(2):
        assert {r["id"]: r["embedding"] for r in memo.remembered_embedding(rows, "content", folder).collect()} == plain


def test_plans_ask_no_model_twice(spark, folder):
    seen = spark.sparkContext.accumulator(0)

    def embedder():
        plain = embed.hashing_embedder()()

        def predict(texts):
            seen.add(len(texts))
            return plain(texts)

        return predict

    pages = spark.createDataFrame([(k, f"https://a.org/{k}", f"<p>{'word%d ' % k * 30}</p>") for k in range(6)], "page_id long, url string, html string")
    ingest_pages(pages, f"{folder}/r", "one", embedder, memo=f"{folder}/m")
    first = seen.value
    assert first >= 6
    ingest_pages(pages, f"{folder}/r", "two", embedder, memo=f"{folder}/m")
    assert seen.value == first
    same = lambda name: sorted((r["chunk_id"], r["embedding"]) for r in S.read_collection(spark, f"{folder}/r", name).collect())
    assert same("one") == same("two")
    questions = spark.createDataFrame([(1, "word1 word2?"), (2, "word3")], "query_id int, text string")
    calls, model = counted(spark, lambda t: "made of " + t.str.slice(0, 40))
    ask = lambda: sorted(map(tuple, answer_all(
        questions, S.read_collection(spark, f"{folder}/r", "one"), vary=model, hypothesise=model, respond=model, embedder=embedder, memo=f"{folder}/m").collect()))
    answers = ask()
    before = calls.value, seen.value
    assert before[0] > 0 and ask() == answers and (calls.value, seen.value) == before


def errors_of(spark, path):
    return sorted((r.source, r.key, r.violations) for r in spark.read.parquet(path).collect())


def test_bad_chunks_go_to_the_errors_table(spark, folder, monkeypatch):
    pages = spark.createDataFrame(
        [(1, "https://a.org/x", "<p>some text</p>"), (2, "ftp://a.org/y", "<p>other text</p>"), (3, "https://a.org/z", "<p>no</p>")],
        "page_id long, url string, html string")
    kept = ingest_pages(pages, f"{folder}/r", "one", errors=f"{folder}/e")
    assert [r.url for r in kept.collect()] == ["https://a.org/x"] and "violations" not in kept.columns
    assert [r.url for r in S.read_collection(spark, f"{folder}/r", "one").collect()] == ["https://a.org/x"]
    assert errors_of(spark, f"{folder}/e") == [
        ("one", "doc_ftp://a.org/y_0", ["url"]), ("one", "doc_https://a.org/z_0", ["content"])]
    assert spark.read.parquet(f"{folder}/e").where("get_json_object(row, '$.content') = 'other text'").count() == 1
    assert ingest_pages(pages.limit(0), f"{folder}/r", "none", errors=f"{folder}/e").count() == 0

    def half(df, text, model=None):  # no vectors for texts with the word "text"
        return embed.with_embedding(df, text).withColumn("embedding", F.when(~F.col(text).contains("text"), F.col("embedding")))

    monkeypatch.setattr(ingestion, "with_embedding", half)
    with pytest.raises(ValueError, match="2 of 3 embeddings failed"):
        ingest_pages(pages, f"{folder}/r", "two", errors=f"{folder}/f")
    assert ("two", "doc_ftp://a.org/y_0", ["url", "embedding"]) in errors_of(spark, f"{folder}/f")


def test_the_gate_counts_in_the_job_that_writes(spark):
    from corpusloom.operators import validate as V

    df = spark.createDataFrame([(k, "https://a" if k % 3 else "x") for k in range(90)], "id long, url string").repartition(7)
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def costly(url):
        runs.add(1)
        return url

    checked = V.with_violations(df.withColumn("url", costly.asNondeterministic()("url")), {"url": F.col("url").rlike(V.URL_SCHEMES)})
    rows, seen = V.judge(checked, odd=F.count_if(F.col("id") % 2 == 1))
    assert seen == {"rows": 90, "rejected": 30, "odd": 45} and runs.value == 90
    assert V.ok_rows(rows).count() == 60 and V.quarantined(rows).count() == 30 and runs.value == 90
    none = V.judge(checked.where("id < 0"))[1]
    assert none == {"rows": 0, "rejected": 0}
    extra = V.add_rule(V.add_rule(checked, "even", F.col("id") % 2 == 0), "null", F.lit(None).cast("boolean"))
    assert {tuple(r.violations) for r in extra.where("id in (3, 4)").collect()} == {("url", "even", "null"), ("null",)}


def test_a_rerank_model_orders_the_answers(spark, folder):
    docs = [(f"c{i}", f"Spark Dokument über Verteilung mit Wort{i} und mehr Text, der lang genug ist.", f"https://d.org/{i}") for i in range(12)]
    chunks = embed.with_embedding(spark.createDataFrame(docs, "chunk_id string, content string, url string"), "content")
    questions = spark.createDataFrame([(1, "Was ist Verteilung"), (2, "Dokument Text")], "query_id int, text string")
    calls = spark.sparkContext.accumulator(0)

    def last_first(question, content):
        calls.add(len(content))
        return content.str.extract(r"Wort(\d+)")[0].astype(float) / 20

    def sources(**how):
        return {r.query_id: json.loads(r.response) for r in answer_all(questions, chunks, "json", 4, **how).collect()}

    found = sources(rerank=last_first, memo=folder)
    scores = [s["relevance_score"] for s in found[1]["sources"]]
    assert scores == sorted(scores, reverse=True) and scores[0] == 0.55 and calls.value > 0
    before = calls.value
    assert sources(rerank=last_first, memo=folder) == found and calls.value == before

    def down(question, content):
        raise RuntimeError("down")

    plain, degraded = sources(), sources(rerank=down)
    assert {q: a["sources"] for q, a in plain.items()} == {q: a["sources"] for q, a in degraded.items()}


def test_bad_variations_and_answers_go_to_the_errors_table(spark, folder):
    docs = [(f"c{i}", f"Spark Dokument über Verteilung mit Wort{i} und mehr Text, der lang genug ist.", f"https://d.org/{i}") for i in range(12)]
    chunks = embed.with_embedding(spark.createDataFrame(docs, "chunk_id string, content string, url string"), "content")
    questions = spark.createDataFrame([(1, "Was ist Verteilung"), (2, "Dokument Text")], "query_id int, text string")
    vary = lambda prompts: prompts.map(lambda p: "was ist verteilung")  # noqa: E731  the question itself again
    out = {r.query_id: r.response for r in answer_all(
        questions, chunks, "json", 4, vary=vary, respond=lambda c: c.str.slice(0, 0) + "zu kurz", errors=folder).collect()}
    bad = errors_of(spark, folder)
    assert ("variations", "1", ["same"]) in bad and not any(s == "variations" and k == "2" and "same" in v for s, k, v in bad)
    assert {k for s, k, v in bad if s == "answers" and "summary" in v} == {"1", "2"}
    assert set(out) == {1, 2} and not any(json.loads(t)["success"] for t in out.values())
    fine = answer_all(questions, chunks, "json", 4, errors=f"{folder}/none")
    assert all("summary" in json.loads(r.response) for r in fine.collect())


@pytest.mark.parametrize("value", [None])
def test_nothing_known_nothing_asked(spark, folder, value):
    rows = spark.createDataFrame([(1, value)], "id int, content string")
    assert memo.remembered_embedding(rows, "content", folder).first()["embedding"] is None
