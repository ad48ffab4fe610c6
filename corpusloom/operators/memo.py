"""Results of model calls kept by text: what has been computed for a text is not computed again.

    <path>/<kind>/...   key, value: key is the sha256 of kind, model name and text

A call looks its texts up, runs the model over the distinct missing ones, a batch at a time, adds those to the store and
joins the values to the rows. Null results (failed calls) don't count as known. Two jobs that add the same key at once keep one
value for all readers, the least.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.embed import with_embedding, with_generated, with_rerank
from corpusloom.session import materialize
from corpusloom.sources.files import children


def _key(kind: str, name: str, text: str):
    return F.sha2(F.concat_ws("\u0000", F.lit(kind), F.lit(name), F.col(text)), 256)


def _stored(df: DataFrame, path: str) -> DataFrame | None:
    if "_SUCCESS" not in children(df.sparkSession, path):
        return None
    # one value a key: combined before the shuffle
    return df.sparkSession.read.parquet(path).where("value is not null").groupBy("key").agg(F.min("value").alias("value"))


def remembered(
    df: DataFrame, text: str, out: str, path: str, kind: str, name: str, compute: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """df with `out`: the stored value of each text, computed and stored first where it is missing.

    compute: texts (a column `text`) -> the same rows with a column `value`. A null text has a null value.
    """
    where = f"{path.rstrip('/')}/{kind}"
    keyed = df.withColumn("_key", F.when(F.col(text).isNotNull(), _key(kind, name, text)))
    texts = keyed.where("_key is not null").groupBy(F.col("_key").alias("key")).agg(F.min(text).alias("text"))
    known = _stored(df, where)
    missing = materialize(texts if known is None else texts.join(known.select("key"), "key", "left_anti"))
    if not missing.isEmpty():
        # all are written: a filter on what a model returns would be pushed below it and run it twice
        compute(missing).select("key", "value").write.mode("append").parquet(where)
        known = _stored(df, where)
    if known is None:
        sample = compute(missing).schema["value"].dataType
        return keyed.drop("_key").withColumn(out, F.lit(None).cast(sample))
    return keyed.join(known.select(F.col("key").alias("_key"), F.col("value").alias(out)), "_key", "left").drop("_key")


def remembered_embedding(df: DataFrame, text: str, path: str, model: Callable | None = None, name: str = "default") -> DataFrame:
    """As `with_embedding`, by way of the store; rows with no text get null."""

    def compute(texts: DataFrame) -> DataFrame:
        return with_embedding(texts, "text", model).withColumnRenamed("embedding", "value")

    return remembered(df, text, "embedding", path, "embedding", name, compute)


def remembered_text(
    df: DataFrame, prompt: str, out: str, fallback: str, path: str, kind: str,
    generate: Callable[[pd.Series], pd.Series] | None = None, name: str = "default",
) -> DataFrame:
    """As `with_generated`, by way of the store; failed calls and empty answers fall back and are asked again next time."""
    if generate is None:
        return with_generated(df, prompt, out, fallback)

    def compute(texts: DataFrame) -> DataFrame:
        none = texts.withColumn("_none", F.lit(None).cast("string"))
        return with_generated(none, "text", "value", "_none", generate).drop("_none")

    found = remembered(df, prompt, "_made", path, kind, name, compute)
    return found.withColumn(out, F.coalesce("_made", F.col(fallback))).drop("_made")


def remembered_score(
    hits: DataFrame, path: str, model: Callable[[pd.Series, pd.Series], pd.Series], out: str = "rerank_score", name: str = "default",
) -> DataFrame:
    """As `with_rerank`, by way of the store: a question is scored once against a content."""
    pair = "question string, content string"

    def compute(texts: DataFrame) -> DataFrame:
        read = texts.withColumn("_pair", F.from_json("text", pair)).select("key", "_pair.*")
        return with_rerank(read, model, "value")

    keyed = hits.withColumn("_text", F.to_json(F.struct("question", "content")))
    return remembered(keyed, "_text", out, path, "rerank", name, compute).drop("_text")
