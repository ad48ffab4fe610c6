"""Page and text-document scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions.html import html_to_markdown
from corpusloom.session import where_computed


def spread(df: DataFrame) -> DataFrame:
    """Spread a scan over all cores when its files have fewer splits than that.

    A large table has more splits than cores and passes through without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw page table: page_id, url, html."""
    return spread(spark.read.schema(schemas.PAGES).parquet(path))


def pages_to_docs(pages: DataFrame) -> DataFrame:
    """Crawled pages as documents with markdown; pages without any text are dropped."""
    docs = where_computed(pages, "markdown", html_to_markdown(F.col("html")), lambda m: m != "")
    return docs.drop("html")


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """Text and markdown files, one document per file: url, markdown."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("url"), F.col("value").alias("markdown")
    ).filter("markdown <> ''")
