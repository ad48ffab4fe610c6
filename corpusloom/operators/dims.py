"""Small fixed dimension tables, joined by broadcast (5 to 10 rows each)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.text import (
    APPROPRIATE_STRATEGIES, ERROR_STRATEGIES, appropriate_strategies, error_severity, error_type,
)

# ---- fixed values -----------------------------------------------------------
METHOD_SETTINGS = [  # method, backend, max_depth, max_concurrent, page_limit
    ("sitemap", "sitemap", None, 10, None),
    ("single", "single", None, None, None),
    ("documentation", "recursive", 3, 4, 50),
    ("website", "recursive", 2, 5, 20),
    ("unknown", "single", None, None, None),
]
SITE_SETTINGS = [  # site_type, max_depth, max_pages, chunk_size, max_concurrent
    ("documentation", 3, 50, 1500, 3),
    ("blog", 2, 20, 1200, 5),
    ("news", 2, 15, 1000, 5),
    ("wiki", 3, 40, 1400, 4),
    ("corporate", 2, 10, 1200, 5),
    ("ecommerce", 1, 5, 800, 3),
    ("forum", 2, 25, 1000, 4),
    ("unknown", 2, 10, 1200, 5),
]
MODELS = [  # model, dimensions, languages, max_tokens
    ("text-multilingual-embedding-002", 768, "Mehrsprachig", 2048),
    ("gemini-embedding-001", 3072, "Mehrsprachig + Code", 2048),
    ("text-embedding-005", 768, "Englisch + Code", 2048),
]
DEFAULT_DIMENSIONS, DEFAULT_LANGUAGES, DEFAULT_MAX_TOKENS = 768, "Unknown", 2048
# ------------------------------------------------------------------------------


def method_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        METHOD_SETTINGS, "method string, backend string, max_depth int, max_concurrent int, page_limit int"
    )


def site_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SITE_SETTINGS, "site_type string, max_depth int, max_pages int, chunk_size int, max_concurrent int"
    )


def with_dim(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Left lookup of a fixed dimension; rows without a match keep nulls."""
    return df.join(F.broadcast(dim), key, "left")


def method_settings(df: DataFrame) -> DataFrame:
    return with_dim(df, method_dim(df.sparkSession), "method")


def site_settings(df: DataFrame) -> DataFrame:
    return with_dim(df, site_dim(df.sparkSession), "site_type")


def model_info(df: DataFrame) -> DataFrame:
    """Embedding-model attributes; unknown models get the defaults."""
    dim = df.sparkSession.createDataFrame(MODELS, "model string, dimensions int, languages string, max_tokens int")
    return with_dim(df, dim, "model").select(
        *df.columns,
        F.coalesce("dimensions", F.lit(DEFAULT_DIMENSIONS)).alias("dimensions"),
        F.coalesce("languages", F.lit(DEFAULT_LANGUAGES)).alias("languages"),
        F.coalesce("max_tokens", F.lit(DEFAULT_MAX_TOKENS)).alias("max_tokens"),
    )


def classify_errors(log: DataFrame) -> DataFrame:
    """Error type, severity and strategies of a log (kind, message, wanted array<string>)."""
    spark = log.sparkSession
    dim = spark.createDataFrame(
        [(k, ERROR_STRATEGIES[k], APPROPRIATE_STRATEGIES[k]) for k in ERROR_STRATEGIES],
        "error_type string, default_strategies array<string>, allowed array<string>",
    )
    typed = log.withColumn("error_type", error_type(F.col("kind"), F.col("message")))
    typed = with_dim(typed.withColumn("severity", error_severity(F.col("error_type"))), dim, "error_type")
    wanted = F.coalesce(F.col("wanted"), F.col("default_strategies"))
    return typed.withColumn("strategies", appropriate_strategies(wanted, F.col("allowed"))).drop("allowed")
