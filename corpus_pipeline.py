"""A corpus pipeline over `documents`: toxicity, lines, near duplicates, benchmark passages, mixture.

Each stage reads all rows that the one before kept. All but the last return the columns of documents; the last one
returns the mixed corpus, a document as often as the mix takes it, numbered by `copy`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, lines, mixing, ngram_join, toxicity
from corpusloom.llm.common import pack
from corpusloom.session import ensure_checkpoint_dir, fits_broadcast

#: No SQL: the learned grammar, patience alignment and string tiling are tested against brute force instead.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar doesn't predict to be toxic; empty texts and rows without an id stay."""
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    whole = docs.select(F.col("text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    return toxicity.score(whole, model).where("predicted = 0").select("_row.*")


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document has; a document that loses all of its lines goes."""
    cut = lines.dedup_lines(pack(docs, "doc_id", "text"))
    touched = F.col("n_removed") > 0
    kept = cut.where(~touched | (F.btrim("text", F.lit(" \n\t\r\x0b\x0c")) != ""))

    def column(c):
        own = F.col(f"`{c}`") if c in ("doc_id", "text") else F.col("_rest").getField(c)
        size = F.when(touched, F.length("text").cast(docs.schema[c].dataType)).otherwise(own) if c == "n_chars" else own
        return size.alias(c)

    return kept.select(*[column(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id; rows without an id stay."""
    found = ngram_join.ngram_join(docs)
    copies = found.where("doc_id <> component_id").select("doc_id").distinct()
    copies = F.broadcast(copies) if fits_broadcast(copies, ngram_join.ID_ROWS) else copies
    return docs.join(copies, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't hold a benchmark item."""
    return decontaminate.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus."""
    return mixing.emit(mixing.mix(docs))


STAGES = [
    ("toxicity", drop_toxic), ("lines", cut_lines), ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark), ("mixture", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents, each written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
