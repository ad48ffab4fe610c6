"""Registry, table loaders and the SQL fragments shared by the twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import WS_CLASS
from corpusloom.session import ensure_checkpoint_dir
from corpusloom.sources.pages import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a query; its output columns get comparable types (see `comparable`).

    A mean of six-digit scores may end exactly between two six-digit values, so
    queries with such means are compared at nine digits.
    """

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: comparable(fn(spark, sf_dir), digits)
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as bigint, doubles rounded, string arrays as one string, timestamps as text."""

    def column(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            c = F.array_join(c, "|")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        return c.alias(f.name)

    return df.select(*[column(f) for f in df.schema.fields])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scratch(spark: SparkSession) -> str:
    """A new folder under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, name: str, build: Callable[[str], None]) -> str:
    """The folder of something that is built once a session and then read by every query that asks for it."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _STORED:
        path = scratch(spark)
        build(path)
        _STORED[key] = path
    return _STORED[key]


# ---- derived inputs (the same derivation on both sides) -----------------------

def doc_url():
    return F.concat(F.lit("https://"), "source", F.lit(".example.org/"), F.col("lang"))


DOC_URL_SQL = "'https://' || source || '.example.org/' || lang"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chunk_id, text, content, url, lang, source."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("chunk_id"), "text", F.col("text").alias("content"), doc_url().alias("url"), "lang", "source"
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")


# ---- SQL fragments ------------------------------------------------------------

WS_CHARS_SQL = (
    "(" + " || ".join(
        f"chr({c})" for c in
        [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    ) + ")"
)


def strip_sql(x: str) -> str:
    return f"trim({x}, {WS_CHARS_SQL})"


def words_sql(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS_CLASS}+'), lambda w_: w_ <> '')"


def terms_sql(x: str) -> str:
    return rf"list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}_]+'), lambda w_: w_ <> '')"


def list_sql(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def contains_any_sql(x: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, '{n}')" for n in needles) + ")"


def text_sql(value: str) -> str:
    """A Python string as a SQL literal; line breaks as chr(10)."""
    return "(" + " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in value.split("\n")) + ")"


def bm25_sql(k: int, questions: str = "SELECT item_id AS query_id, text FROM benchmark",
             docs: str = "SELECT doc_id AS chunk_id, text FROM documents") -> str:
    """CTEs up to hits(query_id, chunk_id, score, rank)."""
    return f"""
    q_ AS ({questions}), d_ AS ({docs}),
    qt_ AS (SELECT DISTINCT query_id, unnest({terms_sql('text')}) AS term FROM q_),
    dt_ AS (SELECT chunk_id, {terms_sql('text')} AS ts FROM d_),
    st_ AS (SELECT count(*) AS n, avg(len(ts)) AS al FROM dt_),
    tk_ AS (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM dt_),
    tf_ AS (SELECT chunk_id, dl, term, count(*) AS tf FROM tk_
            WHERE term IN (SELECT term FROM qt_) GROUP BY ALL),
    df_ AS (SELECT term, count(*) AS df FROM tf_ GROUP BY term),
    w_ AS (SELECT query_id, qt_.term, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf
           FROM qt_ JOIN df_ ON qt_.term = df_.term, st_),
    sc_ AS (SELECT query_id, chunk_id,
              round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / al))), 6) AS score
            FROM tf_ JOIN w_ ON tf_.term = w_.term, st_ GROUP BY query_id, chunk_id),
    hits AS (SELECT * FROM (SELECT query_id, chunk_id, score,
               row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM sc_)
             WHERE rank <= {k})"""
