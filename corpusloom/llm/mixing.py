"""Mixing sources to target weights, with DataFrame functions only.

Tokens are aggregated per source, each source gets a target share of all tokens and from it a repetition rate;
a document is emitted floor(rate) times plus one copy drawn with probability equal to the rate's fraction. The
draw is a hash of (seed, document), so reruns and retried tasks agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import pack, saved, unpacked
from corpusloom.session import broadcast_if_small, with_position

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size, target) from (source, size): shares by weight of all tokens, at most `most` x the source.

    Sources are ranked by code point, null last, and weighed by `weights` in turn. What a capped source can't take is
    shared again by weight among the others: the level (target per weight) rises until no source is above its cap.
    Each turn is one sum over the sources, of which the driver gets a single row.
    """
    totals = saved(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    ranked = with_position(totals, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = saved(ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most))
    level = -1.0
    while True:
        capped = F.col("_cap") <= F.lit(level) * F.col("_w")
        row = ranked.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, F.col("_cap")).otherwise(0)).alias("taken"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("_w"))).alias("w"),
        ).first()
        new = (row["all"] - row["taken"]) / row["w"] if row["w"] else level
        if new <= level:
            break
        level = new
    target = F.least(F.col("_cap").cast("double"), F.lit(max(level, 0.0)) * F.col("_w"))
    return ranked.select("source", "source_size", target.alias("target"))


def draw(seed: str, key: Column) -> Column:
    """A number in [0, 1) that depends on seed and key only: 52 bits of an md5."""
    digest = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")))), 1, 13)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = 3, seed: str = "mix",
        size: str | None = None) -> DataFrame:
    """docs with `_size`, `_source_size`, `_target` and `_copies` (how often the mix emits the row).

    Null texts have size 0, as have empty ones: they are given the same copies and take no words. A null source is a
    source of its own, the last. `size` names a column that has the sizes already. Rows with the same key share their draw (rows with a null key are told apart by a
    hash of their text). An empty table gives an empty table; other columns pass through.
    """
    names = [c for c in docs.columns if c not in ("_size", "_source_size", "_target", "_copies")]
    measured = word_count(F.col("text")) if size is None else F.col(size).cast("long")
    sized = pack(docs.select("*", measured.alias("_measured")), "_measured").select(
        "_rest", F.col("_measured").alias("_size"), F.col(f"_rest.{key}").alias("_key"), F.col("_rest.source").alias("source"),
        (F.col("_rest.text") if "text" in docs.columns else F.col("_measured").cast("string")).alias("_text"))
    targets = source_targets(sized.select("source", F.col("_size").alias("size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    t = targets.select(
        F.col("source").alias("_of"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), rate.alias("_rate"))
    whole = F.floor("_rate").cast("long")
    who = F.coalesce(F.col("_key").cast("string"), F.concat(F.lit("no key "), F.md5(F.coalesce("_text", F.lit("")))))
    extra = (draw(seed, who) < F.col("_rate") - whole).cast("long")
    out = sized.join(broadcast_if_small(t), F.col("source").eqNullSafe(F.col("_of")))
    return out.select(*unpacked(names), "_size", "_source_size", "_target", (whole + extra).alias("_copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each row of a mix as often as it is taken, with the number of the copy in `copy` (from 1)."""
    names = [c for c in mixed.columns if c not in ("_size", "_source_size", "_target", "_copies", "copy")]
    return mixed.where("_copies > 0").select(*[f"`{c}`" for c in names], F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy"))
