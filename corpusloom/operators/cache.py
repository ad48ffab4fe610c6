"""Cache tables, chat history and log retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import top_k, with_position


def cache_lookup(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Every query with its cached value, or a miss. queries: key, ...; cache: key, value."""
    return queries.join(cache.select("key", "value", F.lit(True).alias("hit")), "key", "left").withColumn(
        "hit", F.coalesce("hit", F.lit(False))
    )


def cache_misses(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct keys that still have to be computed."""
    return queries.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])


def cache_put(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """Cache with new entries; a stored entry of the same key is replaced."""
    return cache.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def evict(cache: DataFrame, max_size: int) -> DataFrame:
    """Drop the fifth of the entries with the lowest (access_count, ts) once the cache is full."""
    n = cache.count()
    if n < max_size:
        return cache
    placed = with_position(
        cache.select("key", "access_count", "ts"), [F.col("access_count"), F.col("ts"), F.col("key")]
    )
    gone = placed.filter(F.col("position") < max(1, n // 5)).select("key")
    return cache.join(gone, "key", "left_anti")


def expire(cache: DataFrame, now, ttl_seconds: int) -> DataFrame:
    """Entries not older than the ttl."""
    return cache.filter(F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("ts") <= ttl_seconds * 1_000_000)


def trim_chat(messages: DataFrame, max_messages: int = 100, keep: int = 50) -> DataFrame:
    """Conversations beyond max_messages keep their last `keep` messages.

    A conversation is too long exactly when it has a message number max_messages + 1
    from the end, so ranking stops there: longer ones are pruned before the shuffle.
    """
    last = top_k(messages, ["conv_id"], [F.col("turn").desc()], max_messages + 1, "_n")
    seen = F.max("_n").over(Window.partitionBy("conv_id"))
    return last.withColumn("_seen", seen).filter(
        (F.col("_seen") <= max_messages) | (F.col("_n") <= keep)
    ).drop("_n", "_seen")


def retain(log: DataFrame, now, hours: int = 24) -> DataFrame:
    """Rows of the last hours; the cut-off is a constant, so it reaches the scan."""
    cutoff = F.lit(now).cast(log.schema["ts"].dataType) - F.expr(f"INTERVAL {int(hours)} HOURS")
    return log.filter(F.col("ts") > cutoff)


def export_transcripts(messages: DataFrame, part_size: int = 10_000) -> DataFrame:
    """Markdown text of each conversation: conv_id, part, transcript.

    A conversation of more than part_size messages continues in further parts, by
    the number of the message in turn order, so no row has to hold it whole.
    """
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    who = F.when(F.col("role") == "user", "**Du**").otherwise("**Assistant**")
    entry = F.concat(who, F.lit(":\n"), F.col("text"), F.lit("\n\n---\n\n"))
    parts = messages.withColumn("part", F.floor(number / part_size))
    return parts.groupBy("conv_id", "part").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("turn", entry.alias("e")))), lambda s: s["e"]), ""
        ).alias("transcript")
    )
