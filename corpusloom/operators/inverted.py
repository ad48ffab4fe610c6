"""A stored inverted index: built once, extended by segments, searched by the buckets of the questions' terms.

    <path>/postings/segment=<k>/bucket=<b>/   term, range, n, max_tf, min_len, at, tf
    <path>/postings/segment=<k>/bucket=-1/    range, ids, lens: the documents of a range
    <path>/meta/segment=<k>/                  docs, terms: written last, a segment without it doesn't count

Documents are dealt to ranges of about RANGE_DOCS; a posting block holds a term's documents of one range, as places in
the range's row of documents, with the most occurrences and the least length among them. From these two follows the
most that the term can add to a score there, whatever later segments do to frequencies and to the average length.

A search reads bounds first, without the lists. Each question's best ranges are scored, which gives a score that its
k-th hit reaches at least; of the other ranges only those whose bound reaches it are scored. Every step treats all
questions at once, however many there are, and scores are those of `search.bm25`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.text import lexical_terms as terms
from corpusloom.session import broadcast_if_small, materialize, top_k
from corpusloom.sources.files import children

# ---- fixed values -----------------------------------------------------------
BM25_K1, BM25_B = 1.2, 0.75
SCORE_DIGITS = 6
# ------------------------------------------------------------------------------

RANGE_DOCS = 1024
BUCKETS = 64
SEED_RANGES = 2  # of each question are scored before the others are judged by their bounds


def _id_type(docs: DataFrame) -> T.DataType:
    return docs.schema["chunk_id"].dataType


def _row_schema(id_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("term", T.StringType()), T.StructField("range", T.IntegerType()), T.StructField("n", T.IntegerType()),
        T.StructField("max_tf", T.IntegerType()), T.StructField("min_len", T.IntegerType()),
        T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("tf", T.ArrayType(T.IntegerType())),
        T.StructField("ids", T.ArrayType(id_type)), T.StructField("lens", T.ArrayType(T.IntegerType())),
    ])


def _invert(schema: pa.Schema):
    """The posting blocks of one range of documents, and its row of documents."""

    def inverted(part: pa.Table) -> pa.Table:
        part = part.sort_by("chunk_id").combine_chunks()
        lists = part.column("_terms").combine_chunks()
        lens = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int32)
        coded = lists.flatten().dictionary_encode()
        doc = np.repeat(np.arange(len(lens)), lens)
        cells, tf = np.unique(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(lens) + doc, return_counts=True)
        term, at = cells // max(1, len(lens)), cells % max(1, len(lens))
        size = len(coded.dictionary)
        starts = np.searchsorted(term, np.arange(size))
        offsets = pa.array(np.append(starts, len(cells)), pa.int32())
        n = np.diff(np.append(starts, len(cells)))
        most = np.maximum.reduceat(tf, starts) if size else np.empty(0)
        least = np.minimum.reduceat(lens[at], starts) if size else np.empty(0)
        number = part.column("_range")[0].as_py()
        blocks = pa.Table.from_arrays([
            coded.dictionary.cast(pa.string()), pa.array(np.full(size, number), pa.int32()), pa.array(n, pa.int32()), pa.array(most, pa.int32()),
            pa.array(least, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())),
            pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32())), pa.nulls(size, schema.field("ids").type), pa.nulls(size, pa.list_(pa.int32())),
        ], schema=schema)
        one = pa.array([0, len(lens)], pa.int32())
        ids = pa.ListArray.from_arrays(one, part.column("chunk_id").combine_chunks())
        documents = pa.Table.from_arrays([
            pa.nulls(1, pa.string()), pa.array([number], pa.int32()), *[pa.nulls(1, pa.int32())] * 3, *[pa.nulls(1, pa.list_(pa.int32()))] * 2,
            ids.cast(schema.field("ids").type), pa.ListArray.from_arrays(one, pa.array(lens, pa.int32())),
        ], schema=schema)
        return pa.concat_tables([blocks, documents])

    return inverted


def segments(spark: SparkSession, path: str) -> list[int]:
    """The finished segments: those whose meta row has been written."""
    begun = [int(c.partition("=")[2]) for c in children(spark, f"{path}/meta") if c.startswith("segment=")]
    return sorted(k for k in begun if "_SUCCESS" in children(spark, f"{path}/meta/segment={k}"))


def extend(docs: DataFrame, path: str, buckets: int = BUCKETS, range_docs: int = RANGE_DOCS) -> int:
    """Add docs(chunk_id, text) as a new segment; the number of the segment.

    Only the new documents are read and shuffled. Ids are taken as they come: rows that share one are documents of
    their own. A job that dies leaves a folder that no search reads; the next one writes a segment of its own.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    old = segments(spark, path)
    buckets = spark.read.parquet(f"{path}/meta/segment={old[0]}").first()["buckets"] if old else buckets
    begun = [int(c.partition("=")[2]) for c in children(spark, f"{path}/postings") if c.startswith("segment=")]
    number = max([0, *old, *begun]) + 1
    docs = docs.select("chunk_id", "text")
    ranges = max(1, -(-docs.count() // range_docs))
    dealt = docs.withColumn("_range", F.pmod(F.xxhash64("chunk_id", "text"), F.lit(ranges)).cast("int"))
    # texts are shuffled and sorted, their terms (several times as long in a row) made afterwards
    dealt = dealt.repartition("_range").sortWithinPartitions("_range").select("chunk_id", "_range", terms(F.col("text")).alias("_terms"))
    schema = _row_schema(_id_type(docs))
    rows = dealt.groupBy("_range").applyInArrow(_invert(to_arrow_schema(schema)), schema)
    rows = rows.withColumn("bucket", F.when(F.col("term").isNull(), -1).otherwise(bucket_of(F.col("term"), buckets)))
    target = f"{path}/postings/segment={number}"
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(target)
    written = spark.read.schema(rows.schema).parquet(target).where("bucket = -1").select(F.explode_outer("lens").alias("len"))
    written.agg(F.count("len").alias("docs"), F.coalesce(F.sum("len"), F.lit(0)).cast("long").alias("terms"), F.lit(buckets).alias("buckets")).coalesce(
        1).write.parquet(f"{path}/meta/segment={number}")
    return number


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def postings(spark: SparkSession, path: str) -> DataFrame:
    """All posting blocks and rows of documents of the finished segments."""
    done = segments(spark, path)
    if not done:
        raise ValueError(f"no index in {path}")
    return spark.read.option("basePath", f"{path}/postings").parquet(*[f"{path}/postings/segment={k}" for k in done])


def totals(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """(documents, terms, buckets) of the index."""
    meta = spark.read.parquet(*[f"{path}/meta/segment={k}" for k in segments(spark, path)])
    row = meta.agg(F.sum("docs"), F.sum("terms"), F.max("buckets")).first()
    return int(row[0]), int(row[1]), int(row[2])


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """term, df, occurrences of the whole index; no list is read for df."""
    blocks = postings(spark, path).where("bucket >= 0")
    return blocks.groupBy("term").agg(
        F.sum("n").alias("df"), F.sum(F.aggregate("tf", F.lit(0).cast("long"), lambda a, x: a + x)).alias("occurrences"))


def search(queries: DataFrame, path: str, k: int, k1: float = BM25_K1, b: float = BM25_B) -> DataFrame:
    """BM25 top-k of every query (query_id, text) over the index: query_id, chunk_id, score, rank, method."""
    spark = queries.sparkSession
    n_docs, n_terms, buckets = totals(spark, path)
    average = n_terms / n_docs if n_docs and n_terms else 1.0
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    asked = materialize(asked.distinct().withColumn("bucket", bucket_of(F.col("term"), buckets)))
    wanted = sorted(r[0] for r in asked.select("bucket").distinct().collect())  # as many as there are buckets, at most
    stored = postings(spark, path)
    blocks = stored.where(F.col("bucket").isin(wanted)).join(broadcast_if_small(asked.select("term").distinct(), 200_000), "term", "left_semi")
    bounds = materialize(blocks.select("segment", "range", "term", "n", "max_tf", "min_len"))  # the lists are not read
    df = bounds.groupBy("term").agg(F.sum("n").alias("_df"))
    idf = F.log((n_docs - F.col("_df") + 0.5) / (F.col("_df") + 0.5) + 1)
    weighted = asked.join(df, "term").select("query_id", "term", idf.alias("idf"))
    part = F.col("idf") * F.col("max_tf") * (k1 + 1) / (F.col("max_tf") + k1 * (1 - b + b * F.col("min_len") / average))
    # one row a question and range: what it can score there at most, and the terms that it finds there
    pairs = materialize(bounds.join(weighted, "term").groupBy("segment", "range", "query_id").agg(
        (F.sum(part) * (1 + 1e-9) + 10.0**-SCORE_DIGITS).alias("bound"), F.collect_list(F.struct("term", "idf")).alias("terms")))
    order = [F.col("bound").desc(), F.col("segment"), F.col("range")]
    first = materialize(top_k(pairs, ["query_id"], order, SEED_RANGES, "_place"))
    documents = stored.where("bucket = -1")
    hits = materialize(_scored(first.drop("_place"), blocks, documents, k, k1, b, average))
    floor = top_k(hits, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k).where(f"rank = {k}").select("query_id", F.col("score").alias("_floor"))
    rest = pairs.join(first.select("segment", "range", "query_id"), ["segment", "range", "query_id"], "left_anti").join(
        broadcast_if_small(floor, 200_000), "query_id", "left").where("_floor is null or bound >= _floor").drop("_floor")
    rest = materialize(rest)
    if not rest.isEmpty():
        hits = hits.unionByName(_scored(rest, blocks, documents, k, k1, b, average))
    ranked = top_k(hits, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)
    return ranked.select("query_id", "chunk_id", "score", "rank", F.lit("bm25").alias("method"))


def _scored(pairs: DataFrame, blocks: DataFrame, documents: DataFrame, k: int, k1: float, b: float, average: float) -> DataFrame:
    """(query_id, chunk_id, score): the best k of every (question, range) of `pairs`.

    A range's documents and blocks come first, then its questions, one after the other: a task holds one range of
    bounded size, and no block is copied, however many questions want it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ids = documents.schema["ids"].dataType.elementType
    key = ["segment", "range"]
    ranges = broadcast_if_small(pairs.select(*key).distinct(), 200_000)
    nothing = {
        "query_id": pairs.schema["query_id"].dataType, "terms": pairs.schema["terms"].dataType, "term": T.StringType(), "at": T.ArrayType(T.IntegerType()),
        "tf": T.ArrayType(T.IntegerType()), "ids": documents.schema["ids"].dataType, "lens": T.ArrayType(T.IntegerType())}

    def lined(df: DataFrame, kind: int) -> DataFrame:
        return df.select(*key, F.lit(kind).alias("kind"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in nothing.items()])

    rows = lined(documents.join(ranges, key, "left_semi").select(*key, "ids", "lens"), 0)
    rows = rows.unionByName(lined(blocks.join(ranges, key, "left_semi").select(*key, "term", "at", "tf"), 1))
    rows = rows.unionByName(lined(pairs.select(*key, "query_id", "terms"), 2))
    schema = T.StructType([T.StructField("query_id", pairs.schema["query_id"].dataType), T.StructField("chunk_id", ids), T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, own_ids, base, lists = None, None, None, {}
        for batch in batches:
            col = {c: batch.column(c) for c in batch.schema.names}
            kinds = col["kind"].to_numpy()
            places = list(zip(col["segment"].to_pylist(), col["range"].to_pylist()))
            names = col["term"].to_pylist()
            spans = {c: (col[c].offsets.to_numpy(), col[c].values) for c in ("at", "tf", "ids", "lens", "terms")}
            flat = {c: spans[c][1].to_numpy(zero_copy_only=False) for c in ("at", "tf", "lens")}
            struct_terms, struct_idf = spans["terms"][1].field("term"), spans["terms"][1].field("idf").to_numpy(zero_copy_only=False)
            out: list[tuple[int, np.ndarray, np.ndarray]] = []
            for i, kind in enumerate(kinds.tolist()):
                if places[i] != here:
                    here, own_ids, base, lists = places[i], None, None, {}
                if kind == 0:
                    lo, hi = spans["ids"][0][i:i + 2]
                    own_ids = spans["ids"][1].slice(lo, hi - lo)
                    lo, hi = spans["lens"][0][i:i + 2]
                    base = k1 * (1 - b + b * flat["lens"][lo:hi].astype(np.float64) / average)
                elif kind == 1:
                    lo, hi = spans["at"][0][i:i + 2]
                    at, tf = flat["at"][lo:hi], flat["tf"][lo:hi].astype(np.float64)
                    lists[names[i]] = at.copy(), tf * (k1 + 1) / (tf + base[at])
                else:
                    lo, hi = spans["terms"][0][i:i + 2]
                    total = np.zeros(len(base))
                    for term, idf in zip(struct_terms.slice(lo, hi - lo).to_pylist(), struct_idf[lo:hi].tolist()):
                        at, value = lists[term]
                        total[at] += idf * value
                    score = np.rint(total * 10**SCORE_DIGITS) / 10**SCORE_DIGITS
                    found = np.flatnonzero(total > 0)
                    if len(found) > k:  # ties with the k-th are kept and settled by id later
                        found = found[score[found] >= np.partition(score[found], -k)[-k]]
                    out.append((i, own_ids.take(pa.array(found)), score[found]))
            if out:
                sizes = [len(s) for _, _, s in out]
                asked = col["query_id"].take(pa.array(np.repeat([i for i, _, _ in out], sizes)))
                yield pa.RecordBatch.from_arrays([
                    asked.cast(arrow.field(0).type), pa.concat_arrays([x for _, x, _ in out]).cast(arrow.field(1).type), pa.array(np.concatenate([s for _, _, s in out]))],
                    schema=arrow)

    return rows.repartition(*key).sortWithinPartitions(*key, "kind").mapInArrow(met, schema)
