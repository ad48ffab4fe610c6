"""Row rules of chunks, hits, variations and answers: violations per row, then ok / quarantined."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import max_variations, strip
from corpusloom.session import materialize
from corpusloom.sources.files import children

# ---- fixed values -----------------------------------------------------------
URL_SCHEMES = r"^(?:http://|https://|file://)"
STRATEGY_RANGES = {"simple": (0.0, 0.33), "moderate": (0.33, 0.66), "complex": (0.66, 1.0)}
MAX_RETRIEVAL_SECONDS = 300
# ------------------------------------------------------------------------------

ERRORS = "run string, source string, key string, violations array<string>, row string"


def with_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """`violations`: names of the rules a row breaks (a null condition counts as broken)."""
    broken = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("violations", F.array_compact(F.array(*broken).cast("array<string>")))


def ok_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.size("violations") == 0).drop("violations")


def quarantined(df: DataFrame) -> DataFrame:
    return df.filter(F.size("violations") > 0)


def add_rule(checked: DataFrame, name: str, ok: Column) -> DataFrame:
    """One more rule for rows that have been checked; a null condition counts as broken."""
    broken = ~F.coalesce(ok, F.lit(False))
    return checked.withColumn("violations", F.when(broken, F.array_append("violations", F.lit(name))).otherwise(F.col("violations")))


def judge(checked: DataFrame, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """Checked rows, computed and written once, and what that same job counted: rows, rejected and further aggregates."""
    seen = Observation()
    more = [value.alias(name) for name, value in counts.items()]
    watched = checked.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.size("violations") > 0).alias("rejected"), *more)
    return materialize(watched), seen.get


def quarantine(checked: DataFrame, path: str, source: str, key: str) -> None:
    """Append the rows that break a rule to an errors table.

    run, source (what was checked), key (of the row), violations, row (the whole of it as JSON). Every call is a run of its own.
    """
    rest = [F.col(f"`{c}`") for c in checked.columns if c != "violations"]
    quarantined(checked).select(
        F.lit(uuid.uuid4().hex).alias("run"), F.lit(source).alias("source"), F.col(key).cast("string").alias("key"), "violations",
        F.to_json(F.struct(*rest)).alias("row"),
    ).write.mode("append").parquet(path)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """The errors table in a folder; no rows where nothing has been rejected."""
    if not children(spark, path):
        return spark.createDataFrame([], ERRORS)
    return spark.read.schema(ERRORS).parquet(path)


def accepted(checked: DataFrame, path: str | None, source: str, key: str, **counts: Column) -> tuple[DataFrame, dict[str, int]]:
    """The rows that break no rule, and the counts of `judge`; the others go to the errors table, if there is one to go to."""
    rows, seen = judge(checked, **counts)
    if path and seen["rejected"]:
        quarantine(rows, path, source, key)
    return ok_rows(rows), seen


def check_chunks(chunks: DataFrame) -> DataFrame:
    return with_violations(chunks, {
        "url": strip(F.col("url")).rlike(URL_SCHEMES),
        "content": F.length(strip(F.col("content"))) >= 3,
        "chunk_id": strip(F.col("chunk_id")) != "",
        "chunk_index": F.col("chunk_index") >= 0,
        "total_chunks": F.col("total_chunks").isNull() | (F.col("total_chunks") >= 1),
    })


def check_hits(hits: DataFrame) -> DataFrame:
    """Ranks of a query must be 1..n without gaps, excerpts 10 to 200 characters, scores within 0..1."""
    w = Window.partitionBy("query_id").orderBy("rank")
    numbered = hits.withColumn("_n", F.row_number().over(w))
    return with_violations(numbered, {
        "rank": F.col("rank") == F.col("_n"),
        "score": F.col("score").between(0, 1),
        "excerpt": F.col("excerpt").isNull() | F.length(strip(F.col("excerpt"))).between(10, 200),
        "url": strip(F.col("url")).rlike(URL_SCHEMES),
    }).drop("_n")


def check_variations(queries: DataFrame) -> DataFrame:
    """queries: text, strategy, score, variations array<string>."""
    original = strip(F.lower(F.col("text")))
    in_range = F
    for name, (low, high) in STRATEGY_RANGES.items():
        in_range = in_range.when(F.col("strategy") == name, F.col("score").between(low, high))
    return with_violations(queries, {
        "count": F.size("variations") <= max_variations(F.col("strategy")),
        "empty": ~F.exists("variations", lambda v: strip(v) == ""),
        "same": ~F.exists("variations", lambda v: strip(F.lower(v)) == original),
        "score": in_range.otherwise(False),
    })


def check_answers(answers: DataFrame) -> DataFrame:
    """answers: summary, key_details, confidence, documents_retrieved, total_documents_searched."""
    return with_violations(answers, {
        "summary": F.length(strip(F.col("summary"))).between(20, 500),
        "key_details": (F.size("key_details") > 0)
        & ~F.exists("key_details", lambda d: F.length(strip(d)) < 5),
        "confidence": F.col("confidence").between(0, 1),
        "retrieved": F.col("documents_retrieved") <= F.col("total_documents_searched"),
        "queries_used": F.col("queries_used") >= 1,
    })
