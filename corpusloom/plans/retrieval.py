"""End-to-end retrieval: many questions over many passages as one job."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.chunks import chunk_fixed
from corpusloom.functions.text import complexity, hyde_prompt, strip, truncate_sentences, variation_prompt
from corpusloom.operators import context as ctx
from corpusloom.operators import inverted, rank, search
from corpusloom.operators.embed import with_embedding, with_generated, with_rerank
from corpusloom.operators.memo import remembered_embedding, remembered_score, remembered_text
from corpusloom.operators.validate import accepted, check_answers, check_variations
from corpusloom.session import BROADCAST_ROWS, broadcast_if_small, materialize

RANKING_METHOD = "enhanced_score_based_fallback"
MODEL_RANKING_METHOD = "rerank_model"
RETRIEVAL_METHOD = "high_recall_candidate_generation"


def passages(docs: DataFrame, max_len: int = 1500, overlap: int = 150) -> DataFrame:
    """Windows of documents (url, text): chunk_id, url, content."""
    parts = docs.select("url", "doc_key", F.posexplode(chunk_fixed(F.col("text"), max_len, overlap)))
    return parts.select(
        F.concat_ws("_", F.lit("doc"), "doc_key", F.col("pos").cast("string")).alias("chunk_id"), "url",
        F.col("col").alias("content"),
    )


def cited_contexts(questions: DataFrame, docs: DataFrame, n: int = 5, index: str | None = None) -> DataFrame:
    """For every question the n best passages as context text with numbered, deduplicated sources.

    With an inverted index over the same passages (see `index_passages`) a search reads the terms of the questions only.
    """
    best = rank.rank_top(distinct_hits(questions, passages(docs), n, index), n, prior="merged_rank")
    return ctx.build_context(best, questions)


def index_passages(docs: DataFrame, path: str) -> None:
    """Add the passages of documents (url, doc_key, text) to the index in a folder."""
    inverted.extend(passages(docs).select("chunk_id", F.col("content").alias("text")), path)


def distinct_hits(questions: DataFrame, chunks: DataFrame, n: int, index: str | None = None) -> DataFrame:
    """Lexical hits of every question without copies: n of them wherever the passages have n different ones.

    Questions whose first hits are mostly copies are searched again, four times as deep, until they have enough.
    """
    searchable = chunks.withColumnRenamed("content", "text")
    left, depth, out = questions, 3 * n, None
    while True:
        hits = inverted.search(left, index, depth) if index else search.bm25(left, searchable, depth)
        texts = search.with_texts(hits, chunks, max_hits=left.count() * depth).withColumn("variation_no", F.lit(0))
        found = materialize(search.merge_variations(texts))
        short = found.groupBy("query_id").agg(F.count("*").alias("_n"), F.sum("copies").alias("_all"))
        short = materialize(short.where((F.col("_n") < n) & (F.col("_all") == depth)).select("query_id"))
        kept = found.join(short, "query_id", "left_anti")
        out = kept if out is None else out.unionByName(kept)
        if short.isEmpty():
            return out
        left, depth = materialize(left.join(short, "query_id", "left_semi")), 4 * depth


def _generated(df: DataFrame, prompt: str, out: str, fallback: str, generate: Callable | None, memo: str | None, kind: str) -> DataFrame:
    if memo is None:
        return with_generated(df, prompt, out, fallback, generate)
    return remembered_text(df, prompt, out, fallback, memo, kind, generate)


def retrieve(
    fanout: DataFrame, chunks: DataFrame, n: int, generate: Callable | None = None, embedder: Callable | None = None,
    memo: str | None = None,
) -> DataFrame:
    """Hybrid candidates of every query: fan-out, hypothetical answers, vectors and text, union, filter, pool.

    fanout: from expand_queries. chunks: chunk_id, url, content, embedding (or null).
    """
    prompts = fanout.withColumn("_prompt", hyde_prompt(F.col("text")))
    searched = _generated(prompts, "_prompt", "_answer", "text", generate, memo, "hypothesis").select(
        F.struct("query_id", "variation_no").alias("key"), F.col("_answer").alias("text"), "strategy"
    ).withColumn("query_id", F.to_json("key"))
    searched = materialize(searched)  # generated text must be the same wherever it is used
    pool = max(30, 2 * n)
    asked = searched.select("query_id", "text")
    vectors = remembered_embedding(asked, "text", memo, embedder) if memo else with_embedding(asked, "text", embedder)
    semantic = search.knn(vectors, chunks, pool // 2)
    lexical = search.bm25(
        searched.select("query_id", "text"), chunks.select("chunk_id", F.col("content").alias("text")), pool // 2
    )
    cols = ["query_id", "chunk_id", "score", "rank"]
    found = materialize(
        semantic.select(*cols, F.lit(0).alias("side")).unionByName(lexical.select(*cols, F.lit(1).alias("side")))
    )
    # the one look at the chunk table after the search: at most `pool` hits a query
    texts = materialize(search.with_texts(found, chunks.select("chunk_id", "url", "content"), max_hits=searched.count() * pool))
    semantic, lexical = texts.filter("side = 0"), texts.filter("side = 1")
    both = search.hybrid(semantic, lexical, pool)
    both = both.join(
        searched.select("query_id", F.col("key.query_id").alias("_q"), "key.variation_no", "strategy"), "query_id"
    ).drop("query_id").withColumnRenamed("_q", "query_id")
    merged = search.merge_variations(both)
    merged = merged.withColumn("total_candidates", F.count("*").over(Window.partitionBy("query_id")))
    kept = rank.high_recall(merged.drop("rank", "score"), ["query_id"], [F.col("merged_rank")])
    return rank.progressive_k(kept.withColumnRenamed("merged_rank", "rank"), n)


def _kept_variations(generated: DataFrame, errors: str) -> DataFrame:
    """Questions whose variations break a rule are asked as they are; what was generated for them goes to the errors table."""
    lines = F.array_remove(F.transform(F.split(F.coalesce("variations_text", F.lit("")), "\n"), strip), "")
    read = generated.withColumn("variations", lines).withColumn("score", complexity(F.col("text"))["score"])
    kept, _ = accepted(check_variations(read), errors, "variations", "query_id")
    return generated.drop("variations_text").join(kept.select("query_id", "variations_text"), "query_id", "left")


def _ranked(hits: DataFrame, n: int, rerank: Callable | None, memo: str | None) -> DataFrame:
    """The n best hits of every question and the method that ranked them."""
    if rerank is None:
        return rank.rerank_score(hits, n)
    scored = remembered_score(hits, memo, rerank) if memo else with_rerank(hits, rerank)
    method = F.when(F.col("degraded"), RANKING_METHOD).otherwise(MODEL_RANKING_METHOD)
    return rank.rerank_fallback(materialize(scored), n).withColumn("ranking_method", method).drop("degraded")


def answer_all(
    questions: DataFrame, chunks: DataFrame, fmt: str = "text", n: int = 15,
    vary: Callable | None = None, hypothesise: Callable | None = None, respond: Callable | None = None,
    embedder: Callable | None = None, memo: str | None = None, rerank: Callable | None = None, errors: str | None = None,
) -> DataFrame:
    """query_id, response for every question: fan-out, retrieval, rerank, context, answer, rendering.

    Without a text generator there are no variations, the question is its own
    hypothetical answer, and the answer is taken from the best passage. A question
    that ends without an answer gets an error text in the format asked for. memo: a folder
    that keeps what models have answered (see `operators.memo`), so that a question asked
    again calls none of them. rerank: a model that scores (question, content); questions it fails for are
    ranked by the built-in scores. errors: a folder for an errors table; with it, variations and answers
    must keep their rules (`check_variations`, `check_answers`), and what doesn't goes there: such a question is
    asked without variations, or gets the error text.
    """
    asked = questions.withColumn("strategy", complexity(F.col("text"))["strategy"])
    prompted = asked.withColumn("_prompt", variation_prompt(F.col("text"), F.col("strategy"))).withColumn(
        "_none", F.lit("")
    )
    generated = _generated(prompted, "_prompt", "variations_text", "_none", vary, memo, "variations")
    fanout = materialize(search.expand_queries(_kept_variations(materialize(generated), errors) if errors else generated))
    candidates = retrieve(fanout, chunks, 2 * n, hypothesise, embedder, memo)
    asked_small = broadcast_if_small(questions.select("query_id", F.col("text").alias("question")), 10 * BROADCAST_ROWS)
    ranked = materialize(_ranked(candidates.join(asked_small, "query_id"), n, rerank, memo))
    contexts = ctx.build_context_full(ranked, RANKING_METHOD if rerank is None else MODEL_RANKING_METHOD, queries=questions)
    best = ranked.filter("rank = 1").select("query_id", truncate_sentences(F.col("content")).alias("_best"))
    texts = _generated(
        contexts.join(best, "query_id").withColumnRenamed("context", "_context"), "_context", "answer_text", "_best", respond, memo, "answer"
    )
    metadata = ctx.retrieval_metadata(ranked, fanout, RETRIEVAL_METHOD, RANKING_METHOD)
    if rerank is not None:
        used = ranked.groupBy("query_id").agg(F.max("ranking_method").alias("reranking_method"))
        metadata = metadata.drop("reranking_method").join(used, "query_id", "left")
    answers = ctx.structured_answer(questions, ranked, texts, metadata)
    if errors:
        answers, _ = accepted(check_answers(answers), errors, "answers", "query_id")
    rendered = ctx.render_answer(answers, fmt)
    failed = ctx.error_response(F.lit("no answer could be built"), fmt)
    if errors:
        rendered = questions.select("query_id").join(rendered, "query_id", "left")
    return rendered.withColumn("response", F.coalesce("response", failed))
