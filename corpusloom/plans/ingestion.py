"""End-to-end ingestion: pages -> markdown -> chunks -> vectors -> collection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.urls import name_from_url
from corpusloom.operators.embed import with_embedding
from corpusloom.operators.memo import remembered_embedding
from corpusloom.operators.ingest import build_chunks, gate_counts, reduce_chunks
from corpusloom.operators.validate import accepted, add_rule, check_chunks, with_violations
from corpusloom.sources.collections import append_collection
from corpusloom.sources.pages import pages_to_docs


def collection_for(spark: SparkSession, url: str) -> str:
    """Collection name that a start url stands for."""
    return spark.range(1).select(name_from_url(F.lit(url))).first()[0]


def ingest_pages(
    pages: DataFrame, root: str, name: str, embedder: Callable | None = None,
    max_len: int = 1500, overlap: int = 150, max_chunks: int | None = None, memo: str | None = None,
    errors: str | None = None,
) -> DataFrame:
    """Load pages into a collection and return the chunks that were offered to it.

    The vectors are written once (checkpoint) by a job that also counts them, so neither the gate nor the
    write runs the model again. memo: a folder that keeps the vector of every text (see
    `operators.memo`); texts that it knows are not sent to the model. errors: a folder for an errors table; with it,
    chunks must keep the rules of `check_chunks`, and those that don't, or have no vector, go there (also when the
    gate then ends the job) and not into the collection.
    """
    chunks = build_chunks(pages_to_docs(pages), max_len, overlap)
    if max_chunks is not None:
        chunks = reduce_chunks(chunks, "chunk_id", max_chunks)
    vectors = remembered_embedding(chunks, "content", memo, embedder) if memo else with_embedding(chunks, "content", embedder)
    vectors = vectors.select(*chunks.columns, "embedding")
    ruled = check_chunks(vectors) if errors else with_violations(vectors, {})
    checked = add_rule(ruled, "embedding", F.col("embedding").isNotNull())
    embedded, seen = accepted(checked, errors, name, "chunk_id", failed=F.count_if(F.col("embedding").isNull()))
    gate_counts(seen["rows"], seen["failed"])
    append_collection(embedded, root, name)
    return embedded
