"""Shared helpers: tables saved in the shared folder, connected components, Arrow plumbing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.session import ensure_checkpoint_dir


def saved(df: DataFrame, partition_by: str | None = None) -> DataFrame:
    """Write the rows as Parquet in the shared checkpoint folder and read them back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/saved-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    return back


def pack(df: DataFrame, *keep: str) -> DataFrame:
    """The columns named, and all others in the struct `_rest`, so that no name of theirs meets one of an operator."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keep] or [F.lit(0).alias("none")]
    return df.select(*[F.col(f"`{c}`") for c in keep], F.struct(*rest).alias("_rest"))


def unpacked(columns: list[str], *keep: str) -> list[Column]:
    """The given columns of a packed frame, in their order."""
    return [F.col(f"`{c}`") if c in keep else F.col("_rest").getField(c).alias(c) for c in columns]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for undirected edges (a, b): the smallest node reachable.

    Large-star and small-star steps over saved edge tables until nothing changes, so the depth is logarithmic in
    practice and a hub of any size is only ever one key of a combined aggregate or one side of a splittable join.
    """
    e = saved(edges.where("a <> b").select(F.least("a", "b").alias("b"), F.greatest("a", "b").alias("a")).distinct())

    def links(frame: DataFrame) -> DataFrame:
        return frame.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(frame.select("b", "a"))

    def mark(frame: DataFrame) -> tuple:
        """Count and fingerprint of the edges: one row, where comparing two tables takes four shuffles."""
        return tuple(frame.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    before = mark(e)
    while True:
        both = links(e)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = saved(large.where("a <> b").distinct())
        # small star: a's smaller neighbours and a itself all point to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = saved(
            joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        )
        after = mark(small)
        if after == before:
            return small.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionAll(
                small.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        e, before = small, after


