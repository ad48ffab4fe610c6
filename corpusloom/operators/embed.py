"""Plug-in columns: embedders, text generators and item processors.

A model is any function over a batch; Spark partitions the rows, Arrow moves them.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EMBED_DIM = 64
TOKENS_KEPT = 100_000  # tokens whose bucket a task remembers, at most


def hashing_embedder(dim: int = EMBED_DIM) -> Callable:
    """Offline embedder: lower-case tokens hashed into `dim` counts, L2-normalised."""

    def make():
        buckets: dict[str, int] = {}  # grows with the distinct tokens of one task, emptied when large

        def bucket(token: str) -> int:
            found = buckets.get(token)
            if found is None:
                if len(buckets) > TOKENS_KEPT:
                    buckets.clear()
                found = buckets[token] = int(hashlib.md5(token.encode()).hexdigest()[:8], 16) % dim
            return found

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), dim), dtype=np.float64)
            for i, text in enumerate(texts):
                ids = [bucket(t) for t in (text or "").lower().split()]
                if ids:
                    out[i] = np.bincount(ids, minlength=dim)
            norms = np.linalg.norm(out, axis=1, keepdims=True)
            return (out / np.where(norms == 0, 1, norms)).astype(np.float32)

        return predict

    return make


def with_embedding(df: DataFrame, text: str, model: Callable | None = None, batch_size: int = 256) -> DataFrame:
    """Add `embedding`; rows with no text get null (a failed embedding)."""
    embed = predict_batch_udf(
        model or hashing_embedder(), return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    usable = F.coalesce(F.length(F.trim(F.col(text))), F.lit(0)) > 0
    return df.withColumn("embedding", F.when(usable, embed(F.coalesce(F.col(text), F.lit("")))))


def with_generated(
    df: DataFrame, prompt: str, out: str, fallback: str, generate: Callable[[pd.Series], pd.Series] | None = None,
    error: str | None = None,
) -> DataFrame:
    """Add generated text; a missing generator, a failed call or an empty answer falls back to another column.

    `error` names a column for the message of a failed call (see `gate_errors`).
    """
    if generate is None:
        plain = df.withColumn(out, F.col(fallback))
        return plain if error is None else plain.withColumn(error, F.lit(None).cast("string"))

    @F.pandas_udf("text string, error string")
    def run(prompts: pd.Series) -> pd.DataFrame:
        try:
            return pd.DataFrame({"text": list(generate(prompts)), "error": None}, dtype=object)
        except Exception as e:  # the model failed for the batch: every row takes its fallback and keeps the message
            return pd.DataFrame({"text": None, "error": f"{type(e).__name__}: {e}"}, index=range(len(prompts)), dtype=object)

    done = df.withColumn("_run", run(F.col(prompt)))
    done = done.withColumn(out, F.coalesce(F.nullif(F.col("_run.text"), F.lit("")), F.col(fallback)))
    return (done if error is None else done.withColumn(error, F.col("_run.error"))).drop("_run")


def gate_errors(df: DataFrame, error: str, max_failed: float = 0.5) -> DataFrame:
    """The rows as they are, or a failed job when more than the given share of them has an error."""
    total, failed, first = df.agg(F.count("*"), F.count(error), F.first(error, ignorenulls=True)).first()
    if total and failed / total > max_failed:
        raise ValueError(f"{failed} of {total} calls failed, one with {first}")
    return df


def with_rerank(hits: DataFrame, model: Callable[[pd.Series, pd.Series], pd.Series], out: str = "rerank_score") -> DataFrame:
    """Add the score that a rerank model gives to (question, content), a batch at a time; null where the call fails."""

    @F.pandas_udf("double")
    def score(question: pd.Series, content: pd.Series) -> pd.Series:
        try:
            return pd.Series(model(question, content), dtype="float64")
        except Exception:  # `rank.rerank_fallback` marks the question as degraded
            return pd.Series([None] * len(question), dtype="float64")

    return hits.withColumn(out, score(F.col("question"), F.col("content")))


def map_items(df: DataFrame, item: str, fn: Callable[[str], str]) -> DataFrame:
    """Apply fn to each item; a failing item becomes a row with its error instead of failing the task."""
    schema = T.StructType(
        [f for f in df.schema.fields]
        + [
            T.StructField("success", T.BooleanType()), T.StructField("result", T.StringType()),
            T.StructField("error", T.StringType()), T.StructField("processing_time", T.DoubleType()),
        ]
    )

    def run(batches):
        for pdf in batches:
            rows = []
            for value in pdf[item]:
                start = time.monotonic()
                try:
                    rows.append((True, fn(value), None, time.monotonic() - start))
                except Exception as e:
                    rows.append((False, None, str(e), time.monotonic() - start))
            extra = pd.DataFrame(rows, columns=["success", "result", "error", "processing_time"], index=pdf.index)
            yield pd.concat([pdf, extra], axis=1)

    return df.mapInPandas(run, schema)
