"""Retrieval operators: vector and lexical top-k, unions, fallbacks, query fan-out."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.functions.text import (
    complexity, lexical_terms as terms, max_variations, prefix_key, strip, text_key, text_url_key,
)
from corpusloom.operators import cells, inverted
from corpusloom.session import (
    BROADCAST_ROWS, broadcast_if_bounded, broadcast_if_small, ensure_checkpoint_dir, keep_first, top_k,
)

# ---- fixed values -----------------------------------------------------------
BM25_K1, BM25_B = 1.2, 0.75
SCORE_DIGITS = 6  # scores are compared at this precision, ties by id
# ------------------------------------------------------------------------------

CELLS = 4_000_000  # scores computed at a time inside a task
TOKENS = 200_000  # of documents that are scored together
TERM_ROWS = 2_000_000  # (query, term) pairs that may be broadcast (about 30 MB): questions beyond them search an index
HIT_ROWS = 50_000  # hits (ids and scores) that may be broadcast
BUCKET_ROWS = 1_000  # chunks that a hashed bucket holds on average
SLICE_ROWS = 50_000  # rows of one block of a block-by-block join


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if rows == 0 or len(flat) % rows or any(w != len(flat) // rows for w in column.value_lengths().unique().to_pylist()):
        raise ValueError("vectors of a collection must all have one width")
    return flat.reshape(rows, -1)


class _Best:
    """Exact running top-k (rounded score descending, id ascending) of every query inside one task."""

    def __init__(self, q_ids: list, k: int):
        self.q_ids, self.k = q_ids, k
        self.floor = np.full(len(q_ids), -np.inf)
        self.rows = pd.DataFrame({"q": np.empty(0, int), "chunk_id": np.empty(0, object), "score": np.empty(0)})

    def add(self, ids: np.ndarray, raw: np.ndarray) -> None:
        """Scores of some rows, one line per query; minus infinity stands for "no candidate"."""
        scores = np.rint(raw * 10**SCORE_DIGITS) / 10**SCORE_DIGITS
        if scores.shape[1] > self.k:  # keep whatever reaches the block's own k-th score, ties included
            self.floor = np.maximum(self.floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        qi, ci = np.nonzero((scores >= self.floor[:, None]) & (scores > -np.inf))
        found = pd.DataFrame({"q": qi, "chunk_id": ids[ci], "score": scores[qi, ci]})
        best = pd.concat([self.rows, found]) if len(self.rows) else found
        best = best.sort_values(["q", "score", "chunk_id"], ascending=[True, False, True])
        self.rows = best = best[best.groupby("q").cumcount() < self.k]
        kth = best.groupby("q")["score"].agg(["size", "min"])
        full = kth.index[kth["size"] == self.k]
        self.floor[full] = np.maximum(self.floor[full], kth.loc[full, "min"])

    def frame(self) -> pd.DataFrame:
        out = self.rows.assign(query_id=[self.q_ids[int(i)] for i in self.rows["q"]])
        return out[["query_id", "chunk_id", "score"]]


def _best_cosine(q_ids: list, q_unit: np.ndarray, ids: np.ndarray, unit: np.ndarray, k: int) -> pd.DataFrame:
    best = _Best(q_ids, k)
    step = max(1, CELLS // max(1, len(q_ids)))
    for at in range(0, len(ids), step):
        best.add(ids[at : at + step], q_unit @ unit[at : at + step].T)
    return best.frame()


def _emit(found: pd.DataFrame, schema: pa.Schema) -> pa.RecordBatch:
    table = pa.Table.from_pandas(found, schema=schema, preserve_index=False).combine_chunks()  # string columns may be in chunks
    return table.to_batches()[0] if table.num_rows else pa.RecordBatch.from_pylist([], schema=schema)


def _hit_schema(queries: DataFrame, chunks: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("chunk_id", chunks.schema["chunk_id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])


def _block_best(queries: DataFrame, chunks: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Top-k of every (query block, chunk block) pair that shares the keys."""
    schema = _hit_schema(queries, chunks)

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        return _best_cosine(
            left["query_id"].tolist(), _unit(np.stack(left["q_vec"].to_numpy()).astype(np.float64)),
            right["chunk_id"].to_numpy(), _unit(np.stack(right["c_vec"].to_numpy()).astype(np.float64)), k,
        )

    left = queries.select("query_id", F.col("embedding").alias("q_vec"), *[F.col(c).alias(c) for c in keys])
    right = chunks.select("chunk_id", F.col("embedding").alias("c_vec"), *[F.col(c).alias(c) for c in keys])
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(score, schema)


def _rank_hits(candidates: DataFrame, k: int, method: str) -> DataFrame:
    hits = top_k(candidates, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)
    return hits.withColumn("distance", F.round(1 - F.col("score"), SCORE_DIGITS)).withColumn("method", F.lit(method))


def knn(
    queries: DataFrame, chunks: DataFrame, k: int, max_broadcast: int = BROADCAST_ROWS
) -> DataFrame:
    """Exact cosine top-k of every query: query_id, chunk_id, score, rank, distance, method.

    The query vectors (a set of checked size) go to every task; each task scores its
    own chunks against all of them as one matrix product and emits k rows per query.
    The chunk table is never shuffled and no (query, chunk) pair leaves its task. For a
    larger query set the chunks are put into cells first, and a query meets the cells that
    can hold one of its k best (see `cells`).
    """
    queries = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull())
    chunks = chunks.select("chunk_id", "embedding").filter(F.col("embedding").isNotNull())
    small = queries.limit(max_broadcast + 1).toArrow()
    if small.num_rows > max_broadcast:
        path = f"{ensure_checkpoint_dir(queries.sparkSession)}/cells-{uuid.uuid4().hex}"
        cells.build(chunks, path, codes=False)
        return cells.search(queries, path, k).withColumn("method", F.lit("knn"))
    if small.num_rows == 0:
        return _rank_hits(queries.sparkSession.createDataFrame([], _hit_schema(queries, chunks)), k, "knn")
    q = queries.sparkSession.sparkContext.broadcast(
        (small["query_id"].to_pylist(), _unit(_matrix(small["embedding"], small.num_rows)))
    )
    schema = _hit_schema(queries, chunks)
    arrow_schema = to_arrow_schema(schema)

    def score(batches):
        q_ids, q_unit = q.value
        best = _Best(q_ids, k)  # of the whole task: k rows a query leave it, however many batches it reads
        step = max(1, CELLS // 4 // len(q_ids))
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column("embedding"), batch.num_rows))
                ids = batch.column("chunk_id").to_numpy(zero_copy_only=False)
                for at in range(0, len(ids), step):
                    best.add(ids[at : at + step], q_unit @ unit[at : at + step].T)
        yield _emit(best.frame(), arrow_schema)

    return _rank_hits(chunks.mapInArrow(score, schema), k, "knn")


def knn_lsh(
    queries: DataFrame, chunks: DataFrame, k: int, dim: int, tables: int = 8, bits: int | None = None, seed: int = 7
) -> DataFrame:
    """Approximate cosine top-k: random-hyperplane buckets, exact scores inside a bucket.

    A bucket of any size is cut into slices of bounded size on both sides, and each
    task meets one pair of slices, so a bucket that holds a third of all rows is
    spread over many tasks. Unless given, the bits follow the number of chunks, so that
    a bucket holds about BUCKET_ROWS of them at any size.
    """
    if bits is None:
        bits = max(6, min(24, int(np.ceil(np.log2(max(1, chunks.count()) / BUCKET_ROWS)))))
    planes = np.random.default_rng(seed).standard_normal((dim, tables * bits))

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def signature(vectors: pd.Series) -> pd.Series:
        signs = (np.stack(vectors.to_numpy()).astype(np.float64) @ planes > 0).reshape(-1, tables, bits)
        return pd.Series(list((signs @ (1 << np.arange(bits))).astype(np.int32)))

    def bucketed(df: DataFrame, key: str) -> DataFrame:
        vector = F.col("embedding").alias("embedding")  # fresh columns: both sides may be one table
        own = df.filter(F.col("embedding").isNotNull()).select(F.col(key).alias(key), vector)
        return own.select(key, "embedding", F.posexplode(signature("embedding")).alias("_t", "_b"))

    left, right = bucketed(queries, "query_id"), bucketed(chunks, "chunk_id")


    def slices(df: DataFrame, rows: int, name: str) -> DataFrame:
        return df.groupBy("_t", "_b").agg(F.ceil(F.count("*") / rows).cast("int").alias(name))

    def own(key: str, n: str) -> Column:
        return F.pmod(F.xxhash64(key), F.col(n)).cast("int")

    def each(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    sizes = slices(right, SLICE_ROWS, "_n").join(slices(left, BROADCAST_ROWS, "_m"), ["_t", "_b"])
    sizes = F.broadcast(sizes)  # tables * 2**bits rows at most
    right = right.join(sizes, ["_t", "_b"]).withColumn("_s", own("chunk_id", "_n")).withColumn("_q", each("_m"))
    left = left.join(sizes, ["_t", "_b"]).withColumn("_q", own("query_id", "_m")).withColumn("_s", each("_n"))
    found = _block_best(left, right, ["_t", "_b", "_s", "_q"], k)
    return _rank_hits(found.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k, "knn_lsh")


def _query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


def bm25(
    queries: DataFrame, docs: DataFrame, k: int, k1: float = BM25_K1, b: float = BM25_B,
    max_terms: int = TERM_ROWS,
) -> DataFrame:
    """BM25 top-k of every query (query_id, text) over docs (chunk_id, text).

    Two passes over the corpus and no shuffle of it. The first counts the documents
    of each query term (combined on the map side, one row per term and task). The
    second scores each task's documents against all queries and emits k rows per
    query: neither tokens nor (query, document) pairs ever leave their task. For a query
    set with more terms than may be broadcast the documents are put into an inverted index
    first, which all queries then search in one pass.
    """
    q_terms = _query_terms(queries)
    small = q_terms.limit(max_terms + 1).toArrow()
    tokens = docs.select("chunk_id", terms(F.col("text")).alias("_terms"))
    if small.num_rows > max_terms:
        path = f"{ensure_checkpoint_dir(queries.sparkSession)}/index-{uuid.uuid4().hex}"
        inverted.extend(docs, path)
        return inverted.search(queries, path, k, k1, b)

    # Pass 1: document frequencies; the empty term stands for "every document" and carries the lengths.
    vocabulary = q_terms.select("term").distinct().unionByName(
        q_terms.sparkSession.createDataFrame([("",)], "term string")
    )
    counted = (
        tokens.select(
            F.size("_terms").alias("_len"),
            F.explode(F.concat(F.array(F.lit("")), F.array_distinct("_terms"))).alias("term"),
        )
        .join(F.broadcast(vocabulary), "term", "left_semi")
        .groupBy("term")
        .agg(F.count("*").alias("df"), F.sum("_len").alias("total"))
        .toArrow()
        .to_pandas()
        .set_index("term")
    )
    n, total = (int(counted.at["", c]) for c in ("df", "total")) if "" in counted.index else (0, 0)
    pairs = small.to_pandas().drop_duplicates()
    pairs = pairs[pairs["term"].isin(counted.index)]
    q_ids = sorted(pairs["query_id"].unique().tolist())
    vocab = sorted(pairs["term"].unique().tolist())
    df = counted.loc[vocab, "df"].to_numpy(dtype=np.float64)
    # Postings of the queries: which queries hold a term, term by term.
    t_of = pd.Index(vocab).get_indexer(pairs["term"])
    q_of = pd.Index(q_ids).get_indexer(pairs["query_id"])[np.argsort(t_of, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(t_of, minlength=len(vocab)))]).astype(np.int64)
    shared = queries.sparkSession.sparkContext.broadcast((
        q_ids, pa.array(vocab, pa.string()), np.log((n - df + 0.5) / (df + 0.5) + 1), total / n if n else 1.0,
        q_of, starts, *_common_terms(q_of, starts, len(q_ids)),
    ))
    schema = _hit_schema(queries, docs)
    arrow_schema = to_arrow_schema(schema)

    def score(batches):
        q_ids, *index = shared.value
        best = _Best(q_ids, k)  # of the whole task
        step = max(1, CELLS // 4 // max(1, len(q_ids), index[-1].shape[1]))
        for batch in batches:
            if not batch.num_rows or not q_ids:
                continue
            for part in _parts(batch, step):
                raw = _lexical_scores(part.column("_terms"), len(q_ids), k1, b, *index)
                best.add(part.column("chunk_id").to_numpy(zero_copy_only=False), raw)
        yield _emit(best.frame(), arrow_schema)

    return _ranked_lexical(tokens.mapInArrow(score, schema), k)


def _parts(batch: pa.RecordBatch, step: int):
    """Slices of `step` documents and TOKENS words at most; a longer document is one of its own."""
    words = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("_terms")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, min(at + step, int(np.searchsorted(words, before + TOKENS, "right"))))
        yield batch.slice(at, end - at)
        at, before = end, int(words[end - 1])


def _common_terms(q_of: np.ndarray, starts: np.ndarray, n_queries: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms that many queries hold: their column (-1 for the others) and the query x column membership matrix."""
    fan = np.diff(starts)
    order = np.argsort(-fan, kind="stable")[: max(1, min(1024, CELLS // max(1, n_queries)))]
    order = order[fan[order] >= 8]
    column = np.full(len(fan), -1)
    column[order] = np.arange(len(order))
    member = np.zeros((n_queries, len(order)))
    for c, t in enumerate(order):
        member[q_of[starts[t] : starts[t + 1]], c] = 1.0
    return column, member


def _lexical_scores(
    lists, n_queries: int, k1: float, b: float, vocab, idf, avg_len: float, q_of, starts, column, member
) -> np.ndarray:
    """Scores of some documents, one line per query; minus infinity where no term is shared.

    Common terms are one matrix product; rare ones are spread over the few queries that hold them.
    """
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    term = pc.fill_null(pc.index_in(lists.flatten(), value_set=vocab), -1).to_numpy(zero_copy_only=False)
    known = term >= 0
    cells, tf = np.unique(doc[known] * len(vocab) + term[known], return_counts=True)
    doc, term = cells // len(vocab), cells % len(vocab)
    weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * lengths[doc] / avg_len))
    common = column[term] >= 0
    dense = np.zeros((len(lengths), member.shape[1]))
    dense[doc[common], column[term[common]]] = weight[common]
    doc, term, weight = doc[~common], term[~common], weight[~common]
    fan = starts[term + 1] - starts[term]  # queries that hold the term
    within = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
    query = q_of[np.repeat(starts[term], fan) + within]
    flat = np.bincount(
        query * len(lengths) + np.repeat(doc, fan), weights=np.repeat(weight, fan), minlength=n_queries * len(lengths)
    ).reshape(n_queries, len(lengths))
    flat = flat + member @ dense.T
    return np.where(flat > 0, flat, -np.inf)


def _ranked_lexical(scores: DataFrame, k: int) -> DataFrame:
    hits = top_k(scores, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)
    return hits.select("query_id", "chunk_id", "score", "rank", F.lit("bm25").alias("method"))


def with_texts(
    hits: DataFrame, docs: DataFrame, queries: DataFrame | None = None, max_hits: int | None = None
) -> DataFrame:
    """Attach document columns (and the question) to hits.

    With a known bound on the hits (questions x k) they are broadcast, and the
    documents are filtered where they are scanned.
    """
    out = docs.join(broadcast_if_bounded(hits, max_hits, HIT_ROWS), "chunk_id")
    if queries is not None:
        asked = queries.select("query_id", F.col("text").alias("question"))
        out = out.join(broadcast_if_small(asked), "query_id")
    return out


def expand_queries(queries: DataFrame, variations: str = "variations_text") -> DataFrame:
    """Original (number 0) and up to 1/2/3 variations: query_id, variation_no, text, strategy, complexity."""
    lines = F.array_remove(
        F.transform(F.split(F.coalesce(F.col(variations), F.lit("")), "\n"), strip), ""
    )
    q = queries.select("query_id", "text", lines.alias("_lines"), complexity(F.col("text")).alias("_c")).select(
        "query_id", "text", "_lines", F.col("_c.strategy").alias("strategy"), F.col("_c.score").alias("complexity")
    )
    texts = F.concat(F.array("text"), F.slice("_lines", F.lit(1), max_variations(F.col("strategy"))))
    return q.select("query_id", "strategy", "complexity", texts.alias("_texts")).select(
        "query_id", F.posexplode("_texts").alias("variation_no", "text"), "strategy", "complexity"
    )


def hybrid(semantic: DataFrame, lexical: DataFrame, k: int) -> DataFrame:
    """Semantic top k/2 then lexical top k/2, first copy of a text kept, cut at k.

    A query with hits on one side only keeps that side as it is.
    Both inputs: query_id, chunk_id, content, score, rank, and further columns that both have (kept).
    """
    cols = ["query_id", "chunk_id", "content", "score", "rank"]
    more = [c for c in semantic.columns if c in lexical.columns and c not in cols and c != "source"]
    cols += more
    half = k // 2
    both = semantic.select(*cols, F.lit(0).alias("_side")).unionByName(
        lexical.select(*cols, F.lit(1).alias("_side"))
    ).filter(F.col("rank") <= half)
    both = both.withColumn("_text", text_key(F.col("content")))  # a key shuffles for the windows, no text that is dropped later
    per_query = Window.partitionBy("query_id")  # at most k rows per query from here on
    both = both.withColumn("_mixed", F.min("_side").over(per_query) != F.max("_side").over(per_query))
    order = [F.col("_side"), F.col("rank")]
    copies = Window.partitionBy("query_id", F.when(F.col("_mixed"), F.col("_text")).otherwise(
        F.concat_ws("_", F.col("_side"), F.col("rank"))))
    first = both.withColumn("_copy", F.row_number().over(copies.orderBy(*order))).filter("_copy = 1")
    first = first.withColumnRenamed("rank", "_rank")
    final = top_k(first, ["query_id"], [F.col("_side"), F.col("_rank")], k)
    return final.select(
        *cols, F.when(F.col("_side") == 0, "semantic").otherwise("lexical").alias("source"),
    )


def merge_variations(hits: DataFrame) -> DataFrame:
    """Union of the hits of all variations of a query, first copy kept by (variation, rank).

    hits: query_id, variation_no, rank, chunk_id, content, url, score. `copies` counts what was merged.
    """
    keyed = hits.withColumn("dedup_key", text_url_key(F.col("content"), F.col("url")))
    first = keep_first(keyed, ["query_id", "dedup_key"], [F.col("variation_no"), F.col("rank")])
    w = Window.partitionBy("query_id").orderBy("variation_no", "rank")
    return first.withColumn("merged_rank", F.row_number().over(w)).withColumnRenamed("_copies", "copies")


def dedup_prefix(hits: DataFrame, length: int | None = None) -> DataFrame:
    """First copy, by (variation, rank), of the texts of a query that are equal (or share `length` first characters)."""
    keyed = hits.withColumn("prefix", F.col("content") if length is None else prefix_key(F.col("content"), length))
    return keep_first(keyed, ["query_id", "prefix"], [F.col("variation_no"), F.col("rank")])


def fallback_text(queries: DataFrame, hits: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Hits, plus a text search with the original question for every query that has none."""
    empty = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti")
    cols = ["query_id", "chunk_id", "score", "rank"]
    found = bm25(empty, docs, k).select(*cols, F.lit("text_fallback").alias("method"))
    return hits.select(*cols, "method").unionByName(found)


def attach_embeddings(
    hits: DataFrame, embeddings: DataFrame, missing: float | None = None, max_hits: int | None = None
) -> DataFrame:
    """Add each hit's vector and `semantic_fallback`: the prior score, or a fixed one, where it is missing."""
    ids = broadcast_if_bounded(hits.select("chunk_id").distinct(), max_hits, HIT_ROWS)
    needed = embeddings.select("chunk_id", "embedding").join(ids, "chunk_id", "left_semi")
    out = hits.join(needed, "chunk_id", "left")
    fallback = F.col("score") if missing is None else F.lit(missing)
    return out.withColumn("semantic_fallback", F.when(F.col("embedding").isNull(), fallback))


def apply_rerank(hits: DataFrame, scores: DataFrame, top_n: int) -> DataFrame:
    """External scores (query_id, record_id, rerank_score, position) mapped back to hits by record id."""
    joined = hits.drop("score", "rank").join(scores, ["query_id", "record_id"])
    ranked = top_k(joined, ["query_id"], [F.col("position")], top_n)
    return ranked.withColumnRenamed("rerank_score", "score").drop("position")
