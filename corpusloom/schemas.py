"""Explicit schemas of the working tables (nothing is inferred)."""

from pyspark.sql import types as T

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

CRAWL_RESULT = T.StructType([
    T.StructField("success", T.BooleanType()),
    T.StructField("url", T.StringType()),
    T.StructField("markdown", T.StringType()),
    T.StructField("links", T.ArrayType(T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("href", T.StringType()),
    ]))),
    T.StructField("error", T.StringType()),
])

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("chunk_index", T.IntegerType()),
    T.StructField("total_chunks", T.IntegerType()),
    T.StructField("content", T.StringType()),
    T.StructField("headers", T.StringType()),
    T.StructField("char_count", T.IntegerType()),
    T.StructField("word_count", T.IntegerType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

COLLECTION_META = T.StructType([
    T.StructField("embedding_model", T.StringType()),
    T.StructField("distance_function", T.StringType()),
])
