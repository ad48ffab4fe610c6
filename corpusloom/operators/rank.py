"""Ranking operators over hits (query_id, chunk_id, ..., score, rank).

Every window here is per query over candidates that a top-k has already bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import contains_any, entropy, is_boilerplate, let, strip, words
from corpusloom.functions.vectors import cosine
from corpusloom.session import keep_first, top_k

# ---- fixed values -----------------------------------------------------------
STOP_WORDS = [
    "der", "die", "das", "und", "oder", "aber", "ist", "sind", "was", "wie", "wo", "wann", "warum",
]
STOP_WORDS_EXTENDED = STOP_WORDS + ["ein", "eine", "einen"]
UNIFIED_QUESTION_WORDS = ["definition", "was ist", "bedeutung", "erklärung", "beschreibung"]
UNIFIED_DOCUMENT_WORDS = ["definition", "bedeutet", "bezeichnet", "versteht man", "ist ein", "sind"]
EXTENDED_QUESTION_WORDS = ["was ist", "was bedeutet", "definition", "erkläre"]
EXTENDED_DOCUMENT_WORDS = ["ist", "bedeutet", "bezeichnet", "definition", "erklärung"]
DOCS_URLS = ["docs.", "documentation", "help.", "support."]
POOL_MULTIPLIER = {"simple": 3, "moderate": 5, "complex": 8}
# ------------------------------------------------------------------------------


def rank_top(hits: DataFrame, n: int, score: str = "score", prior: str = "rank") -> DataFrame:
    """Best n per query with sequential ranks; ties keep the earlier rank."""
    ranked = hits.withColumnRenamed(prior, "_prior")
    return top_k(ranked, ["query_id"], [F.col(score).desc(), F.col("_prior")], n).drop("_prior")


def distance_to_score(hits: DataFrame, n: int) -> DataFrame:
    """Distances as similarities relative to the farthest hit of the query; best max(15, n) kept."""
    far = F.max("distance").over(Window.partitionBy("query_id"))
    value = F.when(far > 0, F.greatest(F.lit(0.0), 1 - F.col("distance") / far)).otherwise(0.5)
    return rank_top(hits.withColumn("score", F.round(value, 6)), max(15, n))


def adaptive_select(hits: DataFrame, n: int) -> DataFrame:
    """All good hits when there are n of them (at most max(15, 2n)), else the best max(15, 2n)."""
    q = Window.partitionBy("query_id")
    best = hits.withColumn(
        "threshold",
        F.round(F.greatest(F.lit(0.5), F.least(F.lit(0.7), F.max("score").over(q) * 0.85)), 6),
    )
    best = best.withColumn("good", F.sum((F.col("score") >= F.col("threshold")).cast("int")).over(q))
    pool = rank_top(best, max(15, 2 * n))
    return pool.filter((F.col("good") < n) | (F.col("score") >= F.col("threshold")))


def progressive_k(hits: DataFrame, n: int, most: int = 200) -> DataFrame:
    """Candidate pool by strategy: max(50, n * 3/5/8) per query, at most `most` but never fewer than n."""
    most = max(most, n)
    factor = F
    for strategy, m in POOL_MULTIPLIER.items():
        factor = factor.when(F.col("strategy") == strategy, m)
    size = F.least(F.greatest(F.lit(50), factor.otherwise(5) * n), F.lit(most))
    ranked = top_k(hits.withColumnRenamed("rank", "_prior"), ["query_id"], [F.col("_prior")], most)
    return ranked.filter(F.col("rank") <= size).drop("_prior")


def content_words(text: Column, stop: list[str]) -> Column:
    return F.array_except(words(F.lower(text)), F.array(*[F.lit(w) for w in stop]))


def overlap_ratio(question: Column, content: Column, stop: list[str]) -> Column:
    """Share of the question's words that the document has; 0 when the question has none."""
    return let(
        content_words(question, stop),
        lambda q: F.coalesce(
            F.try_divide(F.size(F.array_intersect(q, content_words(content, stop))), F.size(q)), F.lit(0.0)
        ),
    )


def token_overlap(hits: DataFrame, stop: list[str] = STOP_WORDS) -> DataFrame:
    """Shared words of question and document, per hit."""
    q, d = content_words(F.col("question"), stop), content_words(F.col("content"), stop)
    return hits.withColumn("overlap", F.size(F.array_intersect(q, d))).withColumn(
        "overlap_ratio", overlap_ratio(F.col("question"), F.col("content"), stop)
    )


def _found(question: Column, content: Column, stop: list[str]) -> Column:
    """Question words that occur anywhere in the document text."""
    return let(F.lower(content), lambda low: F.filter(content_words(question, stop), lambda w: low.contains(w)))


def relevance_unified_score(question: Column, content: Column) -> Column:
    low = F.lower(content)
    n = F.length(low)
    phrase = F.aggregate(
        _found(question, content, STOP_WORDS), F.lit(0.0),
        lambda acc, w: acc + F.greatest(F.lit(1.0), F.length(w) / 3),
    )
    defined = sum((low.contains(w).cast("int") for w in UNIFIED_DOCUMENT_WORDS), F.lit(0)) * 2
    keyword = F.when(contains_any(F.lower(question), UNIFIED_QUESTION_WORDS), defined).otherwise(0)
    length = F.when(n.between(200, 2000), 1.5).when(n < 50, -2.0).otherwise(F.least(n / 1000, F.lit(1.5)))
    ratio = overlap_ratio(question, content, STOP_WORDS)
    return F.round(ratio * 20 + phrase * 5 + keyword * 3 + length * 2, 6)


def relevance_extended_score(question: Column, content: Column) -> Column:
    low = F.lower(content)
    n = F.length(low)
    bonus = contains_any(F.lower(question), EXTENDED_QUESTION_WORDS) & contains_any(low, EXTENDED_DOCUMENT_WORDS)
    quality = F.when(n.between(200, 2000), 1).when(n < 50, -2).otherwise(0)
    return F.round(
        overlap_ratio(question, content, STOP_WORDS_EXTENDED) * 10
        + F.size(_found(question, content, STOP_WORDS_EXTENDED)) * 2
        + F.when(bonus, 2).otherwise(0)
        + quality,
        6,
    )


def relevance_unified(hits: DataFrame, n: int = 15) -> DataFrame:
    """Relevance filter (> 2.0) and top n. hits carry question and content."""
    scored = hits.withColumn("score", relevance_unified_score(F.col("question"), F.col("content")))
    return rank_top(scored, n).filter("score > 2.0")  # the best come first, so the order of the two is free


def relevance_extended(hits: DataFrame, n: int = 15) -> DataFrame:
    scored = hits.withColumn("score", relevance_extended_score(F.col("question"), F.col("content")))
    return rank_top(scored, n).filter("score > 1.0")


def score_bonus(question: Column, content: Column, url: Column) -> Column:
    """What word overlap, length and a documentation host add to a base score."""
    n = F.length(content)
    quality = F.when(n.between(200, 2000), 0.1).when(n < 50, -0.2).otherwise(F.least(n / 2000, F.lit(0.1)))
    docs = F.when(contains_any(F.lower(url), DOCS_URLS), 0.05).otherwise(0.0)
    return overlap_ratio(question, content, STOP_WORDS) * 0.3 + quality + docs


def enhanced_score(base: Column, question: Column, content: Column, url: Column) -> Column:
    return F.round(F.least(base + score_bonus(question, content, url), F.lit(1.0)), 6)


def rerank_score(hits: DataFrame, n: int) -> DataFrame:
    """Score-based rerank. hits carry question, content, url."""
    value = enhanced_score(F.col("score"), F.col("question"), F.col("content"), F.col("url"))
    return rank_top(hits.withColumn("score", value), n).withColumn(
        "ranking_method", F.lit("enhanced_score_based_fallback")
    )


def rerank_semantic(hits: DataFrame, n: int) -> DataFrame:
    """Cosine to the question's vector; the prior score where a vector is missing.

    hits carry query_embedding and embedding (null when missing).
    """
    value = F.when(
        F.col("embedding").isNotNull() & F.col("query_embedding").isNotNull(),
        F.round(cosine(F.col("query_embedding"), F.col("embedding")), 6),
    ).otherwise(F.col("score"))
    return rank_top(hits.withColumn("score", value), n).withColumn(
        "ranking_method", F.lit("domain_agnostic_semantic_similarity")
    )


def rerank_fallback(hits: DataFrame, n: int, external: str = "rerank_score") -> DataFrame:
    """External score when a query has one for every hit; else the score-based rerank, marked degraded."""
    q = Window.partitionBy("query_id")
    complete = F.min(F.col(external).isNotNull()).over(q)
    value = enhanced_score(F.col("score"), F.col("question"), F.col("content"), F.col("url"))
    flagged = hits.withColumn("degraded", ~complete)
    chosen = F.when(~F.col("degraded"), F.col(external)).otherwise(F.coalesce(value, F.col("score")))
    return rank_top(flagged.withColumn("score", chosen), n).drop(external)


def high_recall(chunks: DataFrame, by: list[str], order: list[Column], text: str = "content") -> DataFrame:
    """Distinct texts of 30 or more characters that are neither repetitive nor boilerplate; neutral score."""
    content = strip(F.col(text))
    keyed = chunks.withColumn("_md5", F.md5(content)).withColumn("_len", F.length(content)).filter("_len >= 30")
    first = keep_first(keyed, [*by, "_md5", "_len"], order)
    # The costly tests run after the dedup, once per distinct text.
    good = first.filter((entropy(content) >= 1.0) & ~is_boilerplate(content))
    return good.drop("_md5", "_len", "_copies").withColumn("score", F.lit(0.5))


def usable(hits: DataFrame, cleaned: str, n: int = 3) -> DataFrame:
    """Among the first n hits, cleaned texts of more than 50 characters that are no back references."""
    return hits.filter((F.col("rank") <= n) & (F.length(cleaned) > 50) & ~F.col(cleaned).startswith("↑"))
