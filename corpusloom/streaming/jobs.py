"""Structured Streaming jobs: ingestion, duplicate suppression, progress, ttl cache, circuit breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ingest import build_chunks
from corpusloom.sources.collections import append_collection
from corpusloom.sources.pages import pages_to_docs

# ---- fixed values -----------------------------------------------------------
BREAKER_THRESHOLD, BREAKER_RESET_SECONDS = 3, 300
# ------------------------------------------------------------------------------


def stream_ingest(pages: DataFrame, root: str, name: str, checkpoint: str, max_len: int = 1500, overlap: int = 150):
    """Arriving pages -> chunks -> collection, once per id.

    The checkpoint folder names the stream: a batch that is replayed after a lost job is known from the log of commits.
    """

    def load(batch: DataFrame, number: int) -> None:
        append_collection(build_chunks(pages_to_docs(batch), max_len, overlap), root, name, batch=(checkpoint, number))

    return pages.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)


def stream_dedup(events: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """First row of each key within the watermark; state is bounded by the delay."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark(key)


def stream_progress(log: DataFrame, delay: str, size: str = "1 minute") -> DataFrame:
    """Error and success totals per window; rows later than the watermark are dropped."""
    per = log.withWatermark("ts", delay).groupBy(F.window("ts", size))
    return per.agg(
        F.count_if(F.col("level") == "ERROR").alias("errors"),
        F.count_if(F.col("level") != "ERROR").alias("ok"),
        F.count("*").alias("processed"),
    ).select(F.col("window.start").alias("minute"), "errors", "ok", "processed")


def write_updates(stream: DataFrame, path: str, checkpoint: str):
    """Every update of an aggregate, marked with its batch: open windows are written too (see `latest`)."""

    def keep(batch: DataFrame, number: int) -> None:  # a replayed batch writes its own folder again
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)


def latest(updates: DataFrame, keys: list[str]) -> DataFrame:
    """The last update of each key from what `write_updates` has written."""
    rest = [c for c in updates.columns if c not in (*keys, "batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def _in_order(rows: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The rows of one key of one micro-batch (bounded by the source's trigger limits), by time."""
    return pd.concat(rows).sort_values(["ts", "id"])


def _stateful(stream: DataFrame, step, schema: str, state: str) -> DataFrame:
    return stream.groupBy("key").applyInPandasWithState(step, schema, state, "append", "NoTimeout")


def ttl_cache(lookups: DataFrame, ttl_seconds: int) -> DataFrame:
    """Hit or miss of every lookup (key, id, ts) of a stream.

    An entry not older than the ttl is a hit and is not renewed by it; an older one
    is a miss and stored anew. The state of a key is the time of its entry.
    """
    ttl = pd.Timedelta(seconds=ttl_seconds)

    def step(key, rows, state) -> Iterator[pd.DataFrame]:
        stored = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        pdf, hits = _in_order(rows), []
        for ts in pdf["ts"]:
            hit = stored is not None and ts - stored <= ttl
            stored = stored if hit else ts
            hits.append(hit)
        state.update((stored.value // 1000,))
        yield pd.DataFrame({"key": key[0], "id": pdf["id"], "ts": pdf["ts"], "hit": hits})

    return _stateful(lookups, step, "key string, id long, ts timestamp, hit boolean", "stored_us long")


def circuit_breaker(
    requests: DataFrame, threshold: int = BREAKER_THRESHOLD, reset_seconds: int = BREAKER_RESET_SECONDS
) -> DataFrame:
    """Provider that serves each request (key, id, ts, success) of a stream, and the breaker after it.

    `threshold` primary failures open it; requests then go to the fallback until the
    reset time is over, which also clears the counter. Successes do not.
    """
    reset = pd.Timedelta(seconds=reset_seconds)

    def step(key, rows, state) -> Iterator[pd.DataFrame]:
        failures, opened_us = state.get if state.exists else (0, None)
        opened = None if opened_us is None else pd.Timestamp(opened_us, unit="us")
        pdf, used, is_open = _in_order(rows), [], []
        for ts, ok in zip(pdf["ts"], pdf["success"]):
            if opened is not None and ts - opened > reset:
                failures, opened = 0, None
            used.append("primary" if opened is None else "fallback")
            if opened is None and not ok:
                failures += 1
                opened = ts if failures >= threshold else None
            is_open.append(opened is not None)
        state.update((failures, None if opened is None else opened.value // 1000))
        yield pd.DataFrame(
            {"key": key[0], "id": pdf["id"], "ts": pdf["ts"], "provider": used, "open_after": is_open}
        )

    return _stateful(
        requests, step, "key string, id long, ts timestamp, provider string, open_after boolean",
        "failures int, opened_us long",
    )
