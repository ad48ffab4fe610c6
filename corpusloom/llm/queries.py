"""Registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import (
    decontaminate, extract, lexical, licenses, lines, mixing, ngram_join, spelling, substrings, tokens, toxicity, twins, url_filter, vectors,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query("op1_main_text")
def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract.extract(pages).select("page_id", "url", "text", "n_chars")


@query("op2_near_vectors")
def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


@query("op3_repeated_words")
def op3_repeated_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without windows of 20 words that start earlier."""
    return substrings.remove_repeats(read(spark, sf_dir, "documents"))


@query("op4_toxicity")
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op6_line_dedup")
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that every document loses, and a digest of the text that it keeps."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op7_ngram_join")
def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document."""
    return ngram_join.ngram_join(read(spark, sf_dir, "documents"))


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of license notices in all documents."""
    return licenses.scan(read(spark, sf_dir, "documents"))


@query("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and its coverage."""
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# The smallest of 3 x size by source and level x weight; the level is where the sources below their cap share the rest.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size,
        [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS w
      FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap,
        coalesce(sum(3 * source_size) OVER before, 0) AS capped, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_w,
        sum(source_size) OVER () AS all_size
      FROM s WINDOW before AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((all_size - capped)::DOUBLE / open_w, cap / w) FILTER (WHERE cap > (all_size - capped)::DOUBLE / open_w * w) AS level FROM c),
t AS (SELECT source, source_size, least(cap::DOUBLE, level * w) AS target FROM c, l),
r AS (SELECT doc_id, size, source_size, target,
        CASE WHEN source_size > 0 THEN least(3.0::DOUBLE, target / source_size) ELSE 0.0::DOUBLE END AS rate,
        ('0x' || substr(md5('mix' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  ((floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM r"""


@query("op8_mix_sources", MIX_SQL)
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    # of the text a hash stays, for rows without an id
    hashed = F.when(F.col("doc_id").isNull(), F.md5("text")).alias("text")
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("n"), hashed)
    mixed = mixing.mix(mixing.saved(docs), size="n")
    return mixed.select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.round("_target", 6).alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))


@query("op11_url_filter", twins.URL_SQL)
def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page, and the rule that fits it."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return url_filter.judge(pages).select("page_id", "host", "path", "rule", "verdict", "decided_by")


@query("op12_lexical_ranking", twins.RANK_SQL)
def op12_lexical_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of highest score of every benchmark item."""
    return lexical.rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op13_spelling_variants", twins.SPELLING_SQL)
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the vocabulary with the more frequent form it is a variant of."""
    return spelling.variant_groups(read(spark, sf_dir, "documents"))
