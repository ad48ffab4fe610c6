"""Session-level helpers: checkpoint folder, checked broadcasts, bounded top-k."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Largest number of rows that an operator may ship whole to every executor.
BROADCAST_ROWS = 4096


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by the cluster; make one up only in local mode where none is set."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="corpusloom-ckpt-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows to the checkpoint folder and cut the lineage there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when the frame has at most `rows` rows; stops counting just beyond the bound."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only behind a check of the size; larger sides join by shuffle under AQE."""
    return F.broadcast(df) if fits_broadcast(df, rows) else df


def broadcast_if_bounded(df: DataFrame, max_rows: int | None, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when a bound on the rows is already known (queries x k, say); nothing is run."""
    return F.broadcast(df) if max_rows is not None and max_rows <= rows else df


def where_computed(df: DataFrame, name: str, value: Column, keep) -> DataFrame:
    """Add a costly column and keep the rows whose value passes, computing it once per row.

    A filter on a projected expression is pushed below the projection and evaluates
    it a second time; a filter inside the generator is not.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.filter(F.array(value), keep)).alias(name))


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the least in `order`.

    `min_by` combines on the map side, so a key that holds a third of all rows
    reaches its reducer as one row per map task (a row_number window would not).
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(
        F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"), F.count("*").alias("_copies")
    )
    return best.select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest], "_copies")


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group with a sequential rank.

    The constant bound on row_number lets Spark prune to k rows per group and
    task before the shuffle (WindowGroupLimit), which is what keeps hot groups small.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def with_position(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """Global 0-based row number by `order`, without a single-task window.

    Range partitions are sorted in parallel and materialised; the number of rows
    before each partition is a running sum over one small row per partition.
    """
    placed = materialize(
        materialize(df)  # range partitioning samples its input first: do not compute it twice
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mono", F.monotonically_increasing_id())
    )
    part = F.shiftright("_mono", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")  # one row per partition
        .withColumn(name, F.col("_offset") + F.col("_mono").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mono", "_part", "_offset")
    )
