"""Citations, context text, confidence and answers, one row per question.

All grouping is per query over hits that a top-k has bounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import (
    answer_type, clean_wiki, excerpt, parse_answer, quality_score, strip,
    truncate_sentences, truncate_words,
)
from corpusloom.operators.rank import usable
from corpusloom.session import where_computed

# ---- fixed values -----------------------------------------------------------
NO_CONTEXT = "No relevant context found."
NO_VALID_CONTEXT = "No valid context documents found after validation."
PART_RULE = "\n\n---\n\n"
SOURCES_HEADING = "\n\n--- QUELLENVERZEICHNIS ---\n"
MAPPING_HEADING = "\n\n--- ZITATIONS-MAPPING ---\n"
MAPPING_INTRO = (
    "ANWEISUNG FÜR ZITATIONEN: Verwende diese hochgestellten Zahlen als KLICKBARE LINKS im Text:\n"
)
MAPPING_OUTRO = (
    "\nWICHTIG: Verwende im Fließtext IMMER das Format [{superscript}](URL) für klickbare Quellenverweise!"
    " NIEMALS nur hochgestellte Zahlen ohne Links verwenden.\n"
    "KONSISTENZ: Halte die gleiche Detailtiefe und Formatierung wie in vorherigen Antworten bei."
    " Jede Antwort soll vollständig und umfassend sein."
)
METADATA_HEADING = "\n\n--- KONTEXT-METADATEN ---\n"
NO_INFORMATION = "❌ Keine relevanten Informationen gefunden."
NO_USABLE = "❌ Keine verwertbaren Informationen nach der Bereinigung gefunden."
ERROR_TEXT = "Es tut mir leid, aber ich konnte Ihre Anfrage nicht verarbeiten: "
CONFIDENCE_WEIGHTS = {"relevance": 0.4, "quality": 0.2, "diversity": 0.15, "method": 0.15, "cache": 0.1}
SOURCES_SHOWN = 5
LOW_CONFIDENCE = 0.25
# ------------------------------------------------------------------------------


def superscript(number: Column) -> Column:
    """Raised digits up to 20, `^n` beyond."""
    digits = number.cast("string")
    return F.when(number <= 20, F.translate(digits, "0123456789", "⁰¹²³⁴⁵⁶⁷⁸⁹")).otherwise(
        F.concat(F.lit("^"), digits)
    )


def fixed(number: Column, pattern: str) -> Column:
    return F.call_function("format_number", number, F.lit(pattern))


def percent(number: Column) -> Column:
    return F.concat(fixed(number * 100, "0.0"), F.lit("%"))


def citation_numbers(hits: DataFrame) -> DataFrame:
    """Urls numbered by first appearance per query: citation_number, marker, first_use."""
    per_url = Window.partitionBy("query_id", "url")
    first = hits.withColumn("_first", F.min("rank").over(per_url))
    by_first = Window.partitionBy("query_id").orderBy("_first")
    return first.select(
        *hits.columns,
        F.dense_rank().over(by_first).alias("citation_number"),
        (F.col("rank") == F.col("_first")).alias("first_use"),
    ).withColumn("marker", superscript(F.col("citation_number")))


def _lines(parts: Column, render, glue: str) -> Column:
    return F.array_join(F.transform(parts, render), glue)


def _context(parts: Column, body) -> Column:
    """Context text of the ordered hit structs of one query."""
    sources = F.filter(parts, lambda p: p["first_use"])
    link = lambda p: F.concat(F.lit("["), p["marker"], F.lit("]("), p["url"], F.lit(")"))
    return F.concat(
        _lines(parts, body, PART_RULE),
        F.lit(SOURCES_HEADING),
        _lines(sources, lambda p: F.concat(link(p), F.lit(" "), p["url"]), "\n"),
        F.lit(MAPPING_HEADING), F.lit(MAPPING_INTRO),
        _lines(sources, lambda p: F.concat(link(p), F.lit(" für "), p["url"], F.lit("\n")), ""),
        F.lit(MAPPING_OUTRO),
    )


def _ordered(hits: DataFrame, *columns: str) -> Column:
    return F.sort_array(F.collect_list(F.struct("rank", "marker", "url", "first_use", *columns)))


def _label(p: Column) -> Column:
    return F.concat(F.lit("[Quelle "), p["marker"], F.lit("] "))


def _every_query(result: DataFrame, queries: DataFrame | None, column: str, text: str) -> DataFrame:
    """One row for each query; those without hits get the fixed text."""
    if queries is None:
        return result
    joined = queries.select("query_id").join(result, "query_id", "left")
    return joined.withColumn(column, F.coalesce(column, F.lit(text)))


def build_context(hits: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """query_id, context. hits carry url and content."""
    numbered = citation_numbers(hits)
    grouped = numbered.groupBy("query_id").agg(_ordered(numbered, "content").alias("_parts"))
    context = _context(F.col("_parts"), lambda p: F.concat(_label(p), p["content"]))
    return _every_query(grouped.select("query_id", context.alias("context")), queries, "context", NO_CONTEXT)


def valid_context(hits: DataFrame) -> DataFrame:
    """Hits that pass the context check: valid text and url, quality above 0.1."""
    quality = quality_score(F.col("content"), F.col("url"), F.col("score"))
    # An invalid text has quality 0, so the threshold covers validity too.
    return where_computed(hits, "quality", quality, lambda q: q > 0.1)


def context_metrics(hits: DataFrame) -> DataFrame:
    """Average relevance and length and number of sources of the context of each query."""
    return hits.groupBy("query_id").agg(
        F.avg("score").alias("avg_relevance"),
        F.avg(F.length("content")).alias("avg_length"),
        F.countDistinct("url").alias("unique_sources"),
        F.count("*").alias("documents"),
    )


def build_context_full(
    hits: DataFrame, ranking_method: str, include_metadata: bool = True, queries: DataFrame | None = None
) -> DataFrame:
    """Context of validated hits with relevance notes and a metadata block.

    hits carry content, url, score, rank and total_candidates.
    """
    numbered = citation_numbers(valid_context(hits))
    grouped = numbered.groupBy("query_id").agg(
        _ordered(numbered, "content", "score").alias("_parts"),
        F.avg("score").alias("_avg"), F.max("total_candidates").alias("_candidates"), F.count("*").alias("_used"),
    )

    def body(p: Column) -> Column:
        note = F.concat(
            F.lit(" [Relevanz: "), fixed(p["score"], "0.000"), F.lit(", Rang: "), p["rank"].cast("string"), F.lit("]")
        )
        return F.concat(_label(p), strip(p["content"]), note if include_metadata else F.lit(""))

    context = _context(F.col("_parts"), body)
    if include_metadata:
        context = F.concat(
            context, F.lit(METADATA_HEADING),
            F.lit(f"Ranking-Methode: {ranking_method}\nDurchschnittliche Relevanz: "), fixed(F.col("_avg"), "0.000"),
            F.lit("\nGesamte Kandidaten: "), F.col("_candidates").cast("string"),
            F.lit("\nVerwendete Dokumente: "), F.col("_used").cast("string"), F.lit("\n"),
        )
    return _every_query(
        grouped.select("query_id", context.alias("context")), queries, "context", NO_VALID_CONTEXT
    )


def confidence(hits: DataFrame, external: bool = False, cache_hit_rate: float = 0.0, failed: bool = False) -> DataFrame:
    """Weighted confidence per query, clamped to 0..1, halved after a generation error."""
    w = CONFIDENCE_WEIGHTS
    n = F.count("*")
    value = (
        F.avg("score") * w["relevance"]
        + F.count_if(F.col("score") > 0.7) / n * w["quality"]
        + F.least(F.countDistinct("url") / n, F.lit(1.0)) * w["diversity"]
        + F.lit((1.0 if external else 0.7) * w["method"] + cache_hit_rate * w["cache"])
    )
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)) * (0.5 if failed else 1.0)
    return hits.groupBy("query_id").agg(F.round(value, 6).alias("confidence"))


def retrieval_metadata(hits: DataFrame, queries: DataFrame, method: str, rerank_method: str) -> DataFrame:
    """One row per query. hits carry total_candidates; queries is the fan-out (query_id, variation_no)."""
    used = queries.groupBy("query_id").agg(F.count("*").alias("queries_used"))
    per_query = hits.groupBy("query_id").agg(
        F.max("total_candidates").alias("total_documents_searched"),
        F.count("*").alias("documents_retrieved"),
        F.avg("score").alias("average_relevance_score"),
    )
    low = F.col("average_relevance_score") < LOW_CONFIDENCE
    return used.join(per_query, "query_id", "left").select(
        "query_id", "queries_used",
        F.coalesce("total_documents_searched", F.lit(0)).alias("total_documents_searched"),
        F.coalesce("documents_retrieved", F.lit(0)).alias("documents_retrieved"),
        F.coalesce("average_relevance_score", F.lit(0.0)).alias("average_relevance_score"),
        F.when(low, method + "_low_confidence").otherwise(method).alias("retrieval_method"),
        F.lit(rerank_method).alias("reranking_method"),
    )


def score_bands(hits: DataFrame) -> DataFrame:
    """Quality distribution of the scores of each query."""
    s = F.col("score")
    return hits.groupBy("query_id").agg(
        F.count_if(s >= 0.8).alias("excellent"),
        F.count_if((s >= 0.6) & (s < 0.8)).alias("good"),
        F.count_if(s < 0.6).alias("fair"),
        F.avg(s).alias("avg_score"),
        F.min(s).alias("min_score"),
        F.max(s).alias("max_score"),
        F.countDistinct("url").alias("unique_sources"),
    )


def source_refs(hits: DataFrame, most: int | None = None) -> DataFrame:
    """The hits of each query (the first `most`, if given) as an array of sources in rank order."""
    refs = F.struct(
        F.col("rank").alias("citation_number"), "url", F.col("score").alias("relevance_score"),
        excerpt(F.col("content")).alias("excerpt"),
    )
    cited = hits if most is None else hits.filter(F.col("rank") <= most)
    return cited.groupBy("query_id").agg(
        F.sort_array(F.collect_list(refs)).alias("sources")
    )


def extractive_answer(hits: DataFrame, collection: str) -> DataFrame:
    """Answer text from the cleaned best hits. hits carry content, url, rank."""
    cleaned = hits.withColumn("cleaned", clean_wiki(F.col("content")))
    totals = hits.groupBy("query_id").agg(F.count("*").alias("_found"))
    used = usable(cleaned, "cleaned").groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("rank", "cleaned"))).alias("_used"),
        F.array_sort(F.array_remove(F.collect_set(F.coalesce("url", F.lit(""))), "")).alias("_urls"),
    )
    n = F.size("_used")
    main = truncate_sentences(F.get("_used", F.lit(0))["cleaned"])
    more = F.concat(
        F.lit("\n**Weitere relevante Informationen:**\n• "), truncate_words(F.get("_used", F.lit(1))["cleaned"])
    )
    numbered = F.transform(
        F.col("_urls"), lambda u, i: F.concat((i + 1).cast("string"), F.lit(". "), u)
    )
    text = F.concat_ws(
        "\n",
        F.lit(f"**Antwort basierend auf '{collection}':**\n"),
        main,
        F.when(n > 1, more),
        F.when(F.size("_urls") > 0, F.concat(F.lit("\n**Quellen:**\n"), F.array_join(numbered, "\n"))),
        F.concat(
            F.lit("\n*Gefunden: "), F.col("_found").cast("string"), F.lit(" Chunks, verwendet: "),
            n.cast("string"), F.lit(" nach Bereinigung*"),
        ),
    )
    joined = totals.join(used, "query_id", "left")
    return joined.select("query_id", F.when(F.col("_used").isNull(), NO_USABLE).otherwise(text).alias("answer"))


def structured_answer(
    questions: DataFrame, hits: DataFrame, texts: DataFrame, metadata: DataFrame,
    external: bool = False, cache_hit_rate: float = 0.0,
) -> DataFrame:
    """One structured row per question.

    questions: query_id, text. texts: query_id, answer_text (generated). metadata: from retrieval_metadata.
    """
    parsed = texts.select("query_id", parse_answer(F.col("answer_text")).alias("_p"))
    out = (
        questions.select("query_id", F.col("text").alias("question"))
        .join(parsed, "query_id", "left")
        .join(confidence(hits, external, cache_hit_rate), "query_id", "left")
        .join(source_refs(hits), "query_id", "left")
        .join(metadata, "query_id", "left")
    )
    return out.select(
        "query_id", "question",
        F.col("_p.summary").alias("summary"), F.col("_p.key_details").alias("key_details"),
        F.col("_p.contact_info").alias("contact_info"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce(F.col("sources"), F.array()).alias("sources"),
        answer_type(F.col("question")).alias("answer_type"),
        *[c for c in metadata.columns if c != "query_id"],
    )


def render_answer(
    answers: DataFrame, fmt: str = "text", show_confidence: bool = True, show_metadata: bool = False,
    max_sources: int = SOURCES_SHOWN,
) -> DataFrame:
    """query_id, response in one of: structured, text, markdown, json."""
    details = F.col("key_details")
    contact = F.col("contact_info")
    shown = F.slice("sources", 1, max_sources)
    sure = percent(F.col("confidence"))
    none = F.lit("")
    bullets = _lines(details, lambda d: F.concat(F.lit("- "), d, F.lit("\n")), "")
    no = lambda s: s["citation_number"].cast("string")

    if fmt == "structured":
        response = F.concat(
            F.lit("**Zusammenfassung:**\n"), F.col("summary"), F.lit("\n\n**Wichtige Details:**\n"), bullets,
            F.when(contact.isNotNull(), F.concat(F.lit("\n**Kontakt:**\n"), contact, F.lit("\n"))).otherwise(none),
            F.lit("\n**Konfidenz:** "), sure, F.lit("\n\n**Quellen:**\n"),
            _lines(F.col("sources"), lambda s: F.concat(F.lit("("), no(s), F.lit("): "), s["url"], F.lit("\n")), ""),
        )
    elif fmt == "markdown":
        item = lambda s: F.concat(
            no(s), F.lit(". [Quelle]("), s["url"], F.lit(")\n   > "), s["excerpt"], F.lit("\n\n")
        )
        response = F.concat(
            F.lit("# Antwort\n\n"), F.col("summary"), F.lit("\n\n"),
            F.when(F.size(details) > 0, F.concat(F.lit("## Wichtige Details\n\n"), bullets, F.lit("\n"))).otherwise(none),
            F.when(contact.isNotNull(), F.concat(F.lit("## Kontakt\n\n"), contact, F.lit("\n\n"))).otherwise(none),
            F.concat(F.lit("## Qualitätsbewertung\n\n**Konfidenz:** "), sure, F.lit("\n\n"))
            if show_confidence else none,
            F.when(F.size("sources") > 0, F.concat(F.lit("## Quellen\n\n"), _lines(shown, item, ""))).otherwise(none),
            F.concat(
                F.lit("## Retrieval-Informationen\n\n- **Durchsuchte Dokumente:** "),
                F.col("total_documents_searched").cast("string"),
                F.lit("\n- **Verwendete Queries:** "), F.col("queries_used").cast("string"),
                F.lit("\n- **Retrieval-Methode:** "), F.col("retrieval_method"),
                F.lit("\n- **Re-Ranking-Methode:** "), F.coalesce("reranking_method", F.lit("Keine")),
                F.lit("\n- **Durchschnittliche Relevanz:** "), fixed(F.col("average_relevance_score"), "0.000"),
                F.lit("\n"),
            ) if show_metadata else none,
        )
    elif fmt == "json":
        fields = [
            "summary", "key_details", "contact_info", F.col("confidence").alias("confidence_score"), "answer_type",
            shown.alias("sources"),
        ]
        if show_metadata:
            fields.append(
                F.struct(
                    "total_documents_searched", "documents_retrieved", "queries_used", "retrieval_method",
                    "reranking_method", "average_relevance_score",
                ).alias("retrieval_metadata")
            )
        response = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    else:
        item = lambda s: F.concat(F.lit("["), no(s), F.lit("]("), s["url"], F.lit(")\n"))
        response = F.concat(
            F.col("summary"),
            F.when(F.size(details) > 0, F.concat(F.lit("\n\n**Wichtige Details:**\n"), bullets)).otherwise(none),
            F.when(contact.isNotNull(), F.concat(F.lit("\n**Kontakt:**\n"), contact, F.lit("\n"))).otherwise(none),
            F.concat(F.lit("\n**Konfidenz:** "), sure, F.lit("\n")) if show_confidence else none,
            F.when(F.size("sources") > 0, F.concat(F.lit("\n**Quellen:**\n"), _lines(shown, item, ""))).otherwise(none),
            F.concat(
                F.lit("\n**Retrieval-Informationen:**\n- Durchsuchte Dokumente: "),
                F.col("total_documents_searched").cast("string"),
                F.lit("\n- Verwendete Queries: "), F.col("queries_used").cast("string"),
                F.lit("\n- Durchschnittliche Relevanz: "), fixed(F.col("average_relevance_score"), "0.000"),
                F.lit("\n"),
            ) if show_metadata else none,
        )
    return answers.select("query_id", response.alias("response"))


def error_response(message: Column, fmt: str) -> Column:
    """What a failed question returns, in the format asked for."""
    text = F.concat(F.lit(ERROR_TEXT), message)
    if fmt == "json":
        return F.to_json(F.struct(text.alias("error"), F.lit(False).alias("success")))
    return F.concat(F.lit("# Fehler\n\n"), text) if fmt == "markdown" else text
