"""Search, ranking, context and answers: benchmark passages as questions over the documents."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators import context as X
from corpusloom.operators import cells, inverted
from corpusloom.operators import rank as R
from corpusloom.operators import search as S
from corpusloom.plans.retrieval import answer_all, cited_contexts, index_passages
from corpusloom.operators.embed import with_embedding, with_rerank
from corpusloom.operators.validate import check_hits
from corpusloom.session import materialize, top_k
from workload.base import (
    DOC_URL_SQL, SQL, bm25_sql, contains_any_sql, documents, list_sql, query, questions, stored, strip_sql, table, terms_sql, text_sql, words_sql,
)
from workload.chunk_queries import windows_sql
from corpusloom.functions.text import ANSWER_TYPES
from workload.text_queries import clean_wiki_sql, parse_sql

K = 30


def hits(spark, sf_dir):
    """Lexical top 30 of every question with texts and a score relative to the question's best."""
    docs, q = documents(spark, sf_dir), questions(spark, sf_dir)
    found = S.bm25(q, docs, K)
    best = F.max("score").over(Window.partitionBy("query_id"))
    found = found.withColumn("score", F.round(F.col("score") / best, 6))
    return S.with_texts(found, docs.select("chunk_id", "content", "url"), q, max_hits=q.count() * K)


HITS = f"""{bm25_sql(K)},
    h AS (SELECT query_id, chunk_id, round(score / max(score) OVER (PARTITION BY query_id), 6) AS score, rank, d.text AS content,
      {DOC_URL_SQL} AS url, b.text AS question FROM hits JOIN documents d ON d.doc_id = chunk_id JOIN benchmark b ON b.item_id = query_id)"""


@query("lexical_topk", f"WITH {bm25_sql(10)} SELECT * FROM hits")
def lexical_topk(spark, sf_dir):
    return S.bm25(questions(spark, sf_dir), documents(spark, sf_dir), 10).drop("method")


@query("lexical_topk_blocks", f"WITH {bm25_sql(10)} SELECT * FROM hits")
def lexical_topk_blocks(spark, sf_dir):
    """The way taken when the questions have too many terms for one broadcast."""
    return S.bm25(questions(spark, sf_dir), documents(spark, sf_dir), 10, max_terms=1000).drop("method")


def stored_index(spark, sf_dir):
    """An inverted index of the documents, written once a session: those in English, extended by all others."""

    def build(path):
        english = F.coalesce(F.col("lang") == "en", F.lit(False))
        for part in (english, ~english):
            inverted.extend(documents(spark, sf_dir).where(part), path)

    return stored(spark, f"index of {sf_dir}", build)


@query("index_topk", f"WITH {bm25_sql(10)} SELECT * FROM hits")
def index_topk(spark, sf_dir):
    """Search in an index of two segments."""
    return inverted.search(questions(spark, sf_dir), stored_index(spark, sf_dir), 10).drop("method")


@query("index_terms", f"""WITH t AS (SELECT doc_id, unnest({terms_sql('text')}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM t GROUP BY term""")
def index_terms(spark, sf_dir):
    """Frequencies of all terms as the index has them."""
    return inverted.dictionary(spark, stored_index(spark, sf_dir))


# ---- flagship -------------------------------------------------------------------

SUP = "translate(n::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹')"


def cite_sql(source):
    """CTE ci: source plus citation_number, first_use, marker."""
    return f"""c1 AS (SELECT *, min(rank) OVER (PARTITION BY query_id, url) AS f FROM {source}),
    c2 AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY f) AS n FROM c1),
    ci AS (SELECT * EXCLUDE (f, n), n AS citation_number, rank = f AS first_use,
      CASE WHEN n <= 20 THEN {SUP} ELSE '^' || n END AS marker FROM c2)"""


def context_sql(body):
    """Context text aggregate over ci, per query."""
    return (f"string_agg('[Quelle ' || marker || '] ' || {body}, {text_sql(X.PART_RULE)} ORDER BY rank) || {text_sql(X.SOURCES_HEADING)} || "
            f"string_agg('[' || marker || '](' || url || ') ' || url, chr(10) ORDER BY rank) FILTER (first_use) || {text_sql(X.MAPPING_HEADING)} || "
            f"{text_sql(X.MAPPING_INTRO)} || string_agg('[' || marker || '](' || url || ') für ' || url || chr(10), '' ORDER BY rank) FILTER (first_use) || "
            f"{text_sql(X.MAPPING_OUTRO)}")


PASSAGES = f"""pw AS (SELECT doc_id, {DOC_URL_SQL} AS url, {windows_sql('text', 1500, 150)} AS cs FROM documents),
    ps AS (SELECT 'doc_' || doc_id || '_' || (i - 1) AS chunk_id, url, cs[i] AS text FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS i FROM pw))"""


@query("cited_context", f"""
WITH {PASSAGES}, {bm25_sql(15, docs='SELECT chunk_id, text FROM ps')},
x AS (SELECT query_id, hits.chunk_id, score, hits.rank AS r, text AS content, url FROM hits JOIN ps USING (chunk_id)),
dd AS (SELECT *, row_number() OVER (PARTITION BY query_id, md5(content), length(content), url ORDER BY r) AS cp FROM x),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) AS rank FROM dd WHERE cp = 1),
{cite_sql('(SELECT * FROM rk WHERE rank <= 5)')}, ct AS (SELECT query_id, {context_sql('content')} AS context FROM ci GROUP BY query_id)
SELECT item_id AS query_id, coalesce(context, '{X.NO_CONTEXT}') AS context FROM benchmark LEFT JOIN ct ON item_id = query_id""")
def cited_context(spark, sf_dir):
    docs = documents(spark, sf_dir).withColumnRenamed("chunk_id", "doc_key")
    return cited_contexts(questions(spark, sf_dir), docs.select("doc_key", "url", "text"))


@query("cited_context_index", SQL["cited_context"])
def cited_context_index(spark, sf_dir):
    """The same contexts from a stored index of the passages."""
    docs = documents(spark, sf_dir).withColumnRenamed("chunk_id", "doc_key").select("doc_key", "url", "text")
    path = stored(spark, f"passages of {sf_dir}", lambda path: index_passages(docs, path))
    return cited_contexts(questions(spark, sf_dir), docs, index=path)


# ---- vectors ----------------------------------------------------------------------

def vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("chunk_id"), "embedding")


KNN = """e_ AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
    u_ AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM e_),
    pr_ AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, round(list_dot_product(a.e, b.e), 6) AS score FROM u_ a, u_ b),
    kn AS (SELECT *, round(1 - score, 6) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM pr_)"""


@query("vector_topk", f"WITH {KNN} SELECT query_id, chunk_id, score, distance, rank FROM kn WHERE rank <= 10")
def vector_topk(spark, sf_dir):
    return S.knn(*vectors(spark, sf_dir), 10).drop("method")


@query("vector_topk_blocks", f"WITH {KNN} SELECT query_id, chunk_id, score, distance, rank FROM kn WHERE rank <= 5")
def vector_topk_blocks(spark, sf_dir):
    """The way taken when the question set is too large to broadcast."""
    return S.knn(*vectors(spark, sf_dir), 5, max_broadcast=300).drop("method")


def vector_cells(spark, sf_dir):
    return stored(spark, f"cells of {sf_dir}", lambda path: cells.build(vectors(spark, sf_dir)[1], path))


@query("vector_cells_topk", f"WITH {KNN} SELECT query_id, chunk_id, score, distance, rank FROM kn WHERE rank <= 10")
def vector_cells_topk(spark, sf_dir):
    """Exact search in the stored cells."""
    return cells.search(vectors(spark, sf_dir)[0], vector_cells(spark, sf_dir), 10).drop("method")


@query("vector_codes_topk", f"WITH {KNN} SELECT query_id, chunk_id, score, distance, rank FROM kn WHERE rank <= 10")
def vector_codes_topk(spark, sf_dir):
    """The approximate search with all cells probed and all codes rescored."""
    asked, chunks = vectors(spark, sf_dir)
    return cells.search_codes(asked, vector_cells(spark, sf_dir), 10, probes=None, depth=chunks.count()).drop("method")


@query("vector_codes_recall", "SELECT count(*) AS queries, 10 * count(*) AS wanted, true AS enough FROM embeddings")
def vector_codes_recall(spark, sf_dir):
    """Whether the approximate search, over as many cells as a sample asks for, finds 95 in 100 of the exact hits."""
    asked, chunks = vectors(spark, sf_dir)
    path = vector_cells(spark, sf_dir)
    found = cells.search_codes(asked, path, 10, probes=cells.fit_probes(asked, path, 10))
    return cells.recall(found, S.knn(asked, chunks, 10)).select("queries", "wanted", (F.col("recall") >= 0.95).alias("enough"))


@query("vector_topk_lsh")
def vector_topk_lsh(spark, sf_dir):
    return S.knn_lsh(*vectors(spark, sf_dir), 10, dim=64)


@query("distance_scores", f"""WITH {KNN}, t AS (SELECT query_id, chunk_id, distance, rank AS r,
    max(distance) OVER (PARTITION BY query_id) AS m FROM kn WHERE rank <= 30),
s AS (SELECT query_id, chunk_id, distance, r, CASE WHEN m > 0 THEN round(greatest(0, 1 - distance / m), 6) ELSE 0.5 END AS score FROM t)
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) AS rank FROM s) WHERE rank <= 15""")
def distance_scores(spark, sf_dir):
    found = S.knn(*vectors(spark, sf_dir), 30)
    return R.distance_to_score(found, 10).drop("method")


ADAPTIVE = """t AS (SELECT query_id, chunk_id, score, round(greatest(0.5::DOUBLE, least(0.7::DOUBLE, max(score) OVER (PARTITION BY query_id) * 0.85::DOUBLE)), 6) AS threshold, rank FROM kn WHERE rank <= 60),
    g AS (SELECT *, count(*) FILTER (score >= threshold) OVER (PARTITION BY query_id) AS good FROM t)"""


@query("adaptive_selection", f"""WITH {KNN}, {ADAPTIVE}
SELECT query_id, chunk_id, score, threshold, good, rank FROM g WHERE rank <= 20 AND (good < 10 OR score >= threshold)""")
def adaptive_selection(spark, sf_dir):
    return R.adaptive_select(S.knn(*vectors(spark, sf_dir), 60), 10).drop("method", "distance")


@query("hybrid_union", f"""
WITH {KNN}, {bm25_sql(20)}, tx AS (SELECT doc_id AS chunk_id, text AS content FROM documents),
a AS (SELECT query_id, chunk_id, content, score, rank, 0 AS side FROM kn JOIN tx USING (chunk_id) WHERE rank <= 10
  UNION ALL SELECT query_id, chunk_id, content, score, rank, 1 FROM hits JOIN tx USING (chunk_id) WHERE rank <= 10),
b AS (SELECT *, min(side) OVER (PARTITION BY query_id) <> max(side) OVER (PARTITION BY query_id) AS mixed FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id, CASE WHEN mixed THEN md5(content) || '_' || length(content) ELSE side || '_' || rank END ORDER BY side, rank) AS cp FROM b)
SELECT query_id, chunk_id, score, CASE side WHEN 0 THEN 'semantic' ELSE 'lexical' END AS source,
  row_number() OVER (PARTITION BY query_id ORDER BY side, rank) AS rank FROM c WHERE cp = 1""")
def hybrid_union(spark, sf_dir):
    """Vector neighbours of all vectors and lexical hits of all questions: the numbers of questions have both."""
    docs = documents(spark, sf_dir).select("chunk_id", "content")
    (q, v), asked = vectors(spark, sf_dir), questions(spark, sf_dir)
    semantic = S.with_texts(S.knn(q, v, 20), docs, max_hits=q.count() * 20)
    lexical = S.with_texts(S.bm25(asked, documents(spark, sf_dir), 20), docs, max_hits=asked.count() * 20)
    return S.hybrid(semantic, lexical, 20).drop("content", "method")


@query("semantic_rerank", f"""
WITH {HITS}, v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT query_id, chunk_id, h.rank AS r, c.e IS NULL AS missing, CASE WHEN c.e IS NULL THEN score
    ELSE round(list_dot_product(q.e, c.e) / sqrt(list_dot_product(q.e, q.e)) / sqrt(list_dot_product(c.e, c.e)), 6) END AS score
  FROM h JOIN v q ON q.vec_id = query_id LEFT JOIN v c ON c.vec_id = chunk_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) AS rank FROM s)
SELECT query_id, chunk_id, score, missing, rank FROM k WHERE rank <= 12""")
def semantic_rerank(spark, sf_dir):
    q, c = vectors(spark, sf_dir)
    found = S.attach_embeddings(hits(spark, sf_dir), c, max_hits=questions(spark, sf_dir).count() * K).join(q.withColumnRenamed("embedding", "query_embedding"), "query_id")
    ranked = R.rerank_semantic(found, 12)
    return ranked.select("query_id", "chunk_id", "score", F.col("embedding").isNull().alias("missing"), "rank")


@query("reattached_embeddings", f"""WITH {HITS},
a AS (SELECT query_id, chunk_id, rank, CASE WHEN vec_id IS NULL THEN 0.1::DOUBLE END AS semantic_fallback, embedding,
  unnest(CASE WHEN embedding IS NULL THEN [NULL::BIGINT] ELSE range(len(embedding)::BIGINT) END) AS place FROM h LEFT JOIN embeddings ON vec_id = chunk_id)
SELECT query_id, chunk_id, rank, semantic_fallback, place, round(embedding[place + 1]::DOUBLE, 5) AS value FROM a""")
def reattached_embeddings(spark, sf_dir):
    _, c = vectors(spark, sf_dir)
    out = S.attach_embeddings(hits(spark, sf_dir), c, 0.1, questions(spark, sf_dir).count() * K)
    each = out.select("query_id", "chunk_id", "rank", "semantic_fallback", F.posexplode_outer("embedding").alias("place", "value"))
    return each.withColumn("value", F.round(F.col("value").cast("double"), 5))


# ---- lexical scores ------------------------------------------------------------------

def cw_sql(x, stop):
    return f"list_filter(list_distinct({words_sql(f'lower({x})')}), lambda c_: NOT list_contains({list_sql(stop)}, c_))"


def rel_sql(stop):
    return f"""w1 AS (SELECT *, lower(content) AS low, {cw_sql('question', stop)} AS qw, {cw_sql('content', stop)} AS dw FROM h),
    w2 AS (SELECT *, len(list_intersect(qw, dw)) AS overlap, coalesce(len(list_intersect(qw, dw)) / nullif(len(qw), 0), 0) AS ratio,
      list_filter(qw, lambda f_: contains(low, f_)) AS found, length(low) AS n FROM w1)"""


def ranked_sql(source, n, extra=""):
    return (f"SELECT query_id, chunk_id, score, rank{extra} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) AS rank "
            f"FROM {source}) WHERE rank <= {n}")


@query("token_overlap", f"WITH {HITS}, {rel_sql(R.STOP_WORDS)} SELECT query_id, chunk_id, rank, overlap, round(ratio, 6) AS overlap_ratio FROM w2")
def token_overlap(spark, sf_dir):
    return R.token_overlap(hits(spark, sf_dir)).select("query_id", "chunk_id", "rank", "overlap", "overlap_ratio")


@query("relevance_unified", f"""
WITH {HITS}, {rel_sql(R.STOP_WORDS)},
s AS (SELECT query_id, chunk_id, rank AS r, round(ratio * 20 + coalesce(list_sum(list_transform(found, lambda x: greatest(1.0::DOUBLE, length(x) / 3))), 0) * 5
  + CASE WHEN {contains_any_sql('lower(question)', R.UNIFIED_QUESTION_WORDS)} THEN ({' + '.join(f"contains(low, '{w}')::INT" for w in R.UNIFIED_DOCUMENT_WORDS)}) * 2 ELSE 0 END * 3
  + CASE WHEN n BETWEEN 200 AND 2000 THEN 1.5::DOUBLE WHEN n < 50 THEN -2 ELSE least(n / 1000, 1.5::DOUBLE) END * 2, 6) AS score FROM w2)
{ranked_sql('s WHERE score > 2.0', 15)}""")
def relevance_unified(spark, sf_dir):
    return R.relevance_unified(hits(spark, sf_dir)).select("query_id", "chunk_id", "score", "rank")


@query("relevance_extended", f"""
WITH {HITS}, {rel_sql(R.STOP_WORDS_EXTENDED)},
s AS (SELECT query_id, chunk_id, rank AS r, round(ratio * 10 + len(found) * 2
  + CASE WHEN {contains_any_sql('lower(question)', R.EXTENDED_QUESTION_WORDS)} AND {contains_any_sql('low', R.EXTENDED_DOCUMENT_WORDS)} THEN 2 ELSE 0 END
  + CASE WHEN n BETWEEN 200 AND 2000 THEN 1 WHEN n < 50 THEN -2 ELSE 0 END, 6) AS score FROM w2)
{ranked_sql('s WHERE score > 1.0', 15)}""")
def relevance_extended(spark, sf_dir):
    return R.relevance_extended(hits(spark, sf_dir)).select("query_id", "chunk_id", "score", "rank")


BONUS = f"""{rel_sql(R.STOP_WORDS)},
    bo AS (SELECT *, rank AS r, round(least(score + (ratio * 0.3::DOUBLE + CASE WHEN length(content) BETWEEN 200 AND 2000 THEN 0.1::DOUBLE WHEN length(content) < 50 THEN -0.2::DOUBLE
      ELSE least(length(content) / 2000, 0.1::DOUBLE) END + CASE WHEN {contains_any_sql('lower(url)', R.DOCS_URLS)} THEN 0.05::DOUBLE ELSE 0 END), 1.0::DOUBLE), 6) AS es FROM w2)"""


@query("score_rerank", f"WITH {HITS}, {BONUS}, s AS (SELECT query_id, chunk_id, r, es AS score FROM bo) {ranked_sql('s', 10)}")
def score_rerank(spark, sf_dir):
    return R.rerank_score(hits(spark, sf_dir), 10).select("query_id", "chunk_id", "score", "rank")


@query("rerank_with_fallback", f"""WITH {HITS}, {BONUS},
e AS (SELECT *, CASE WHEN query_id % 3 = 0 THEN round((chunk_id % 17) / 17, 6) WHEN query_id % 3 = 1 AND chunk_id % 2 = 0 THEN 0.9::DOUBLE END AS x FROM bo),
f AS (SELECT *, count(x) OVER (PARTITION BY query_id) < count(*) OVER (PARTITION BY query_id) AS degraded FROM e),
s AS (SELECT query_id, chunk_id, r, degraded, CASE WHEN degraded THEN es ELSE x END AS score FROM f) {ranked_sql('s', 10, ', degraded')}""")
def rerank_with_fallback(spark, sf_dir):
    q, c = F.col("query_id"), F.col("chunk_id")
    external = F.when(q % 3 == 0, F.round((c % 17) / 17, 6)).when((q % 3 == 1) & (c % 2 == 0), 0.9)
    out = R.rerank_fallback(hits(spark, sf_dir).withColumn("rerank_score", external), 10)
    return out.select("query_id", "chunk_id", "score", "degraded", "rank")


@query("external_rerank", f"""WITH {HITS}, p AS (SELECT query_id, rank - 1 AS record_id, round((chunk_id % 23) / 23, 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY chunk_id % 23 DESC, chunk_id) AS pos FROM h)
SELECT query_id, record_id, chunk_id, p.score, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS rank
FROM p JOIN (SELECT query_id, chunk_id, rank - 1 AS record_id FROM h) USING (query_id, record_id) WHERE pos <= 8""")
def external_rerank(spark, sf_dir):
    h = hits(spark, sf_dir).withColumn("record_id", F.col("rank") - 1)
    w = Window.partitionBy("query_id").orderBy((F.col("chunk_id") % 23).desc(), "chunk_id")
    response = h.select("query_id", "record_id", F.round((F.col("chunk_id") % 23) / 23, 6).alias("rerank_score"),
                        F.row_number().over(w).alias("position")).filter("position <= 8")
    return S.apply_rerank(h, response, 8).select("query_id", "record_id", "chunk_id", "score", "rank")


@query("model_rerank", f"""WITH {HITS}, p AS (SELECT h.query_id, chunk_id, round(length(content) / (length(content) + length(q.text)), 6) AS score
  FROM h JOIN (SELECT item_id AS query_id, text FROM benchmark) q ON q.query_id = h.query_id)
SELECT query_id, chunk_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM p) WHERE rank <= 5""")
def model_rerank(spark, sf_dir):
    """A rerank model over (question, content), batch by batch; any function of two columns will do."""
    def model(question, content):
        return content.str.len() / (content.str.len() + question.str.len())

    h = hits(spark, sf_dir).drop("question").join(questions(spark, sf_dir).withColumnRenamed("text", "question"), "query_id")
    scored = with_rerank(h, model).withColumn("score", F.round("rerank_score", 6))
    return top_k(scored.drop("rank"), ["query_id"], [F.col("score").desc(), F.col("chunk_id")], 5).select("query_id", "chunk_id", "score", "rank")


@query("hit_rules", f"""WITH {HITS}, x AS (SELECT query_id, chunk_id, rank + CASE WHEN rank > query_id % 6 + 2 THEN 1 ELSE 0 END AS r, rank,
    length({strip_sql("substr(content, 1, 5 + (chunk_id % 300)::INT)")}) AS n FROM h)
SELECT query_id, chunk_id, array_to_string(list_filter([CASE WHEN r <> rank THEN 'rank' END, CASE WHEN chunk_id % 5 = 0 THEN 'score' END,
  CASE WHEN chunk_id % 3 <> 0 AND n NOT BETWEEN 10 AND 200 THEN 'excerpt' END, CASE WHEN chunk_id % 4 = 0 THEN 'url' END], lambda v: v IS NOT NULL), '|') AS violations FROM x""")
def hit_rules(spark, sf_dir):
    """Hits some of which break a rule: a gap in the ranks, a score beyond 1, an excerpt too long, no scheme."""
    n = F.col("chunk_id")
    h = hits(spark, sf_dir).select(
        "query_id", "chunk_id", (F.col("rank") + (F.col("rank") > F.col("query_id") % 6 + 2).cast("int")).alias("rank"),
        F.when(n % 5 == 0, 1.5).otherwise(0.5).alias("score"),
        F.when(n % 3 != 0, F.substring("content", F.lit(1), (n % 300 + 5).cast("int"))).alias("excerpt"),
        F.when(n % 4 == 0, "example.org").otherwise(F.col("url")).alias("url"))
    return check_hits(h).select("query_id", "chunk_id", "violations")


@query("rank_top", f"WITH {HITS}, s AS (SELECT query_id, chunk_id, rank AS r, round(score, 1) AS score FROM h) {ranked_sql('s', 5)}")
def rank_top(spark, sf_dir):
    h = hits(spark, sf_dir).withColumn("score", F.round("score", 1))
    return R.rank_top(h, 5).select("query_id", "chunk_id", "score", "rank")


# ---- unions over variations --------------------------------------------------------

def varied(spark, sf_dir):
    """Hits of each question and of two variations: its first and its second half."""
    q = questions(spark, sf_dir)
    half = F.floor(F.length("text") / 2).cast("int")
    texts = F.array(F.col("text"), F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text")))
    fan = q.select("query_id", F.posexplode(texts).alias("variation_no", "text"))
    key = (F.col("query_id") * 10 + F.col("variation_no")).alias("query_id")
    docs = documents(spark, sf_dir)
    found = S.bm25(fan.select(key, "text"), docs, 20)
    found = S.with_texts(found, docs.select("chunk_id", "content", "url"), max_hits=fan.count() * 20)
    return found.withColumn("variation_no", F.col("query_id") % 10).withColumn("query_id", F.floor(F.col("query_id") / 10))


_VQ = """SELECT item_id * 10 + v AS query_id, CASE v WHEN 0 THEN text WHEN 1 THEN substr(text, 1, length(text) // 2)
    ELSE substr(text, length(text) // 2 + 1) END AS text FROM benchmark, range(0, 3) AS r(v)"""
VARIED = f"""{bm25_sql(20, questions=_VQ)},
    vh AS (SELECT query_id // 10 AS query_id, query_id % 10 AS variation_no, chunk_id, rank, score, d.text AS content, {DOC_URL_SQL} AS url
      FROM hits JOIN documents d ON d.doc_id = chunk_id)"""


@query("variation_merge", f"""WITH {VARIED},
c AS (SELECT *, row_number() OVER w AS cp, count(*) OVER (PARTITION BY query_id, md5(content), length(content), url) AS copies FROM vh
  WINDOW w AS (PARTITION BY query_id, md5(content), length(content), url ORDER BY variation_no, rank))
SELECT query_id, chunk_id, variation_no, copies, row_number() OVER (PARTITION BY query_id ORDER BY variation_no, rank) AS merged_rank FROM c WHERE cp = 1""")
def variation_merge(spark, sf_dir):
    return S.merge_variations(varied(spark, sf_dir)).select("query_id", "chunk_id", "variation_no", "copies", "merged_rank")


@query("prefix_dedup", f"""WITH {VARIED}, c AS (SELECT *, row_number() OVER (PARTITION BY query_id, substr(content, 1, 100) ORDER BY variation_no, rank) AS cp FROM vh)
SELECT query_id, chunk_id, variation_no, rank FROM c WHERE cp = 1""")
def prefix_dedup(spark, sf_dir):
    return S.dedup_prefix(varied(spark, sf_dir), 100).select("query_id", "chunk_id", "variation_no", "rank")


@query("candidate_pool", f"""
WITH {bm25_sql(250)}, s AS (SELECT *, CASE query_id % 3 WHEN 0 THEN 60 WHEN 1 THEN 100 ELSE 160 END AS want FROM hits)
SELECT query_id, chunk_id, rank FROM s WHERE rank <= least(want, 200)""")
def candidate_pool(spark, sf_dir):
    found = S.bm25(questions(spark, sf_dir), documents(spark, sf_dir), 250)
    kind = F.when(F.col("query_id") % 3 == 0, "simple").when(F.col("query_id") % 3 == 1, "moderate").otherwise("complex")
    return R.progressive_k(found.withColumn("strategy", kind), 20).select("query_id", "chunk_id", "rank")


@query("text_fallback", f"""
WITH {bm25_sql(8)} SELECT query_id, chunk_id, score, rank, CASE WHEN query_id % 2 = 0 THEN 'bm25' ELSE 'text_fallback' END AS method
FROM hits WHERE query_id % 2 = 1 OR rank <= 3""")
def text_fallback(spark, sf_dir):
    q, docs = questions(spark, sf_dir), documents(spark, sf_dir)
    some = S.bm25(q, docs, 3).filter("query_id % 2 = 0")
    return S.fallback_text(q, some, docs, 8)


# ---- context and answers --------------------------------------------------------------

@query("citations", f"WITH {HITS}, {cite_sql('h')} SELECT query_id, chunk_id, rank, url, citation_number, first_use, marker FROM ci")
def citations(spark, sf_dir):
    h = hits(spark, sf_dir).select("query_id", "chunk_id", "rank", "url")
    return X.citation_numbers(h)


@query("context_text", f"""WITH {HITS}, {cite_sql('h')}, ct AS (SELECT query_id, {context_sql('content')} AS context FROM ci GROUP BY query_id)
SELECT item_id AS query_id, coalesce(context, '{X.NO_CONTEXT}') AS context FROM benchmark LEFT JOIN ct ON item_id = query_id""")
def context_text(spark, sf_dir):
    return X.build_context(hits(spark, sf_dir), questions(spark, sf_dir))


VALID = rf"""va AS (SELECT *, {strip_sql('content')} AS c, {words_sql(f"lower({strip_sql('content')})")} AS ws FROM h),
    vq AS (SELECT *, least(length(c) / 1000, 1.0::DOUBLE) * 0.3::DOUBLE + coalesce(len(list_distinct(ws)) / nullif(len(ws), 0), 0) * 0.3::DOUBLE
      + (regexp_matches(c, '[.!?;:]')::INT + regexp_matches(c, '\p{{Lu}}')::INT) / 2 * 0.2::DOUBLE
      + CASE WHEN score > 0 THEN least(score, 1.0::DOUBLE) ELSE 0.5::DOUBLE END * 0.2::DOUBLE AS quality FROM va),
    vd AS (SELECT * EXCLUDE (ws) FROM vq WHERE length(c) >= 10 AND quality > 0.1)"""


@query("context_valid", f"WITH {HITS}, {VALID} SELECT query_id, chunk_id, rank, round(quality, 6) AS quality FROM vd")
def context_valid(spark, sf_dir):
    return X.valid_context(hits(spark, sf_dir)).select("query_id", "chunk_id", "rank", "quality")


@query("context_full", f"""WITH {HITS}, {VALID}, {cite_sql('vd')}
SELECT query_id, {context_sql("c || ' [Relevanz: ' || printf('%.3f', score) || ', Rang: ' || rank || ']'")} || {text_sql(X.METADATA_HEADING)}
  || 'Ranking-Methode: bm25' || chr(10) || 'Durchschnittliche Relevanz: ' || printf('%.3f', avg(score)) || chr(10) || 'Gesamte Kandidaten: ' || (100 + query_id)
  || chr(10) || 'Verwendete Dokumente: ' || count(*) || chr(10) AS context FROM ci GROUP BY query_id""")
def context_full(spark, sf_dir):
    h = hits(spark, sf_dir).withColumn("total_candidates", F.col("query_id") + 100)
    return X.build_context_full(h, "bm25")


@query("context_metrics", f"""WITH {HITS} SELECT query_id, round(avg(score), 9) AS avg_relevance, round(avg(length(content)), 9) AS avg_length,
  count(DISTINCT url) AS unique_sources, count(*) AS documents FROM h GROUP BY query_id""", digits=9)
def context_metrics(spark, sf_dir):
    return X.context_metrics(hits(spark, sf_dir))


@query("confidence", f"""WITH {HITS} SELECT query_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, avg(score) * 0.4::DOUBLE + count(*) FILTER (score > 0.7) / count(*) * 0.2::DOUBLE
  + count(DISTINCT url) / count(*) * 0.15::DOUBLE + 0.7::DOUBLE * 0.15::DOUBLE + 0.25::DOUBLE * 0.1::DOUBLE)), 6) AS confidence FROM h GROUP BY query_id""")
def confidence(spark, sf_dir):
    return X.confidence(hits(spark, sf_dir), cache_hit_rate=0.25)


@query("score_bands", f"""WITH {HITS} SELECT query_id, count(*) FILTER (score >= 0.8) AS excellent, count(*) FILTER (score >= 0.6 AND score < 0.8) AS good,
  count(*) FILTER (score < 0.6) AS fair, round(avg(score), 9) AS avg_score, min(score) AS min_score, max(score) AS max_score,
  count(DISTINCT url) AS unique_sources FROM h GROUP BY query_id""", digits=9)
def score_bands(spark, sf_dir):
    return X.score_bands(hits(spark, sf_dir))


@query("retrieval_metadata", f"""WITH {HITS}, a AS (SELECT query_id, count(*) AS n, round(avg(CASE WHEN query_id % 4 = 0 THEN score / 5 ELSE score END), 9) AS s FROM h GROUP BY query_id)
SELECT query_id, (1 + query_id % 3) AS queries_used, (query_id + 100) AS total_documents_searched, n AS documents_retrieved, s AS average_relevance_score,
  CASE WHEN s < 0.25 THEN 'pool_low_confidence' ELSE 'pool' END AS retrieval_method, 'score' AS reranking_method FROM a""", digits=9)
def retrieval_metadata(spark, sf_dir):
    h = hits(spark, sf_dir).withColumn("total_candidates", F.col("query_id") + 100).withColumn(
        "score", F.when(F.col("query_id") % 4 == 0, F.col("score") / 5).otherwise(F.col("score")))
    fan = questions(spark, sf_dir).select("query_id", F.explode(F.sequence(F.lit(0), (F.col("query_id") % 3).cast("int"))).alias("variation_no"))
    return X.retrieval_metadata(h, fan, "pool", "score")


@query("source_list", f"""WITH {HITS} SELECT query_id, rank AS citation_number, url, score AS relevance_score,
  CASE WHEN length(content) > 150 THEN substr(content, 1, 150) || '...' ELSE content END AS excerpt FROM h""")
def source_list(spark, sf_dir):
    return X.source_refs(hits(spark, sf_dir)).select("query_id", F.inline("sources"))


@query("usable_chunks", f"""WITH {HITS}, c AS (SELECT query_id, chunk_id, rank, {clean_wiki_sql("content || chr(10) || 'Weblinks'")} AS cleaned FROM h)
SELECT query_id, chunk_id, rank, cleaned FROM c WHERE rank <= 3 AND length(cleaned) > 50 AND cleaned NOT LIKE '↑%'""")
def usable_chunks(spark, sf_dir):
    from corpusloom.functions.text import clean_wiki

    h = hits(spark, sf_dir).withColumn("cleaned", clean_wiki(F.concat("content", F.lit("\nWeblinks"))))
    return R.usable(h, "cleaned").select("query_id", "chunk_id", "rank", "cleaned")


@query("extractive_answer", rf"""
WITH {HITS}, c AS (SELECT query_id, rank, url, {clean_wiki_sql('content')} AS t FROM h),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM c WHERE rank <= 3 AND length(t) > 50 AND t NOT LIKE '↑%'),
s AS (SELECT query_id, string_split(t, '. ') AS p FROM u WHERE i = 1),
l AS (SELECT query_id, j, p[j] AS p, sum(length(p[j])) OVER (PARTITION BY query_id ORDER BY j) AS used FROM (SELECT *, unnest(range(1, len(p) + 1)) AS j FROM s)),
k AS (SELECT query_id, coalesce(string_agg(p, '. ' ORDER BY j) FILTER (used <= 800), '') AS cut FROM l GROUP BY query_id),
m AS (SELECT u.query_id, CASE WHEN length(t) <= 800 THEN t WHEN cut LIKE '%.' THEN cut ELSE cut || '.' END AS main FROM u JOIN k USING (query_id) WHERE i = 1),
w AS (SELECT query_id, t, substr(t, 1, 300) AS head, length(substr(t, 1, 300)) - instr(reverse(substr(t, 1, 300)), ' ') AS sp FROM u WHERE i = 2),
a AS (SELECT query_id, CASE WHEN length(t) <= 300 THEN t WHEN contains(head, ' ') AND sp > 200 THEN substr(head, 1, sp) || '...' ELSE head END AS more FROM w),
g AS (SELECT query_id, count(*) AS used, list_sort(list_distinct(list(url))) AS urls FROM u GROUP BY query_id),
f AS (SELECT query_id, count(*) AS found FROM h GROUP BY query_id)
SELECT f.query_id, CASE WHEN used IS NULL THEN '{X.NO_USABLE}' ELSE '**Antwort basierend auf ''documents'':**' || chr(10) || chr(10) || main || chr(10)
  || coalesce(chr(10) || '**Weitere relevante Informationen:**' || chr(10) || '• ' || more || chr(10), '') || chr(10) || '**Quellen:**' || chr(10)
  || array_to_string(list_transform(range(1, len(urls) + 1), lambda n: n || '. ' || urls[n]), chr(10)) || chr(10) || chr(10)
  || '*Gefunden: ' || found || ' Chunks, verwendet: ' || used || ' nach Bereinigung*' END AS answer
FROM f LEFT JOIN g USING (query_id) LEFT JOIN m USING (query_id) LEFT JOIN a USING (query_id)""")
def extractive_answer(spark, sf_dir):
    return X.extractive_answer(hits(spark, sf_dir), "documents")


def answers(spark, sf_dir):
    h = materialize(hits(spark, sf_dir).withColumn("total_candidates", F.lit(K)))
    q = questions(spark, sf_dir)
    extra = F.when(F.col("query_id") % 3 == 0, "").otherwise("\nKey:\n- eins zwei\nContact\na@example.org")
    texts = h.filter("rank = 1").select("query_id", F.concat("content", extra).alias("answer_text"))
    meta = X.retrieval_metadata(h, q.withColumn("variation_no", F.lit(0)), "bm25", "none")
    return X.structured_answer(q, h, texts, meta)


# The best hit's text stands for the generated answer; two thirds of them get details and a contact.
ANSWERS = f"""{HITS},
    at_ AS (SELECT query_id, content || CASE WHEN query_id % 3 = 0 THEN '' ELSE chr(10) || 'Key:' || chr(10) || '- eins zwei' || chr(10) || 'Contact' || chr(10) || 'a@example.org' END AS t FROM h WHERE rank = 1),
    {parse_sql('at_', 'query_id')},
    cf AS (SELECT query_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, avg(score) * 0.4::DOUBLE + count(*) FILTER (score > 0.7) / count(*) * 0.2::DOUBLE
      + count(DISTINCT url) / count(*) * 0.15::DOUBLE + 0.7::DOUBLE * 0.15::DOUBLE)), 6) AS confidence, avg(score) AS rel, count(*) AS n FROM h GROUP BY query_id),
    so AS (SELECT query_id, rank, url, score, CASE WHEN length(content) > 150 THEN substr(content, 1, 150) || '...' ELSE content END AS ex FROM h),
    an AS (SELECT item_id AS query_id, text AS question, summary, details, contact_info, confidence, rel, n, CASE
      {' '.join(f"WHEN {contains_any_sql('lower(text)', words)} THEN '{kind}'" for kind, words in ANSWER_TYPES)} ELSE 'informational' END AS answer_type
      FROM benchmark JOIN pa ON query_id = item_id JOIN cf USING (query_id))"""


@query("structured_answer", f"""WITH {ANSWERS}, sj AS (SELECT query_id, string_agg(rank || ' ' || url || ' ' || printf('%.6f', score) || ' ' || ex, '|' ORDER BY rank) AS sources FROM so GROUP BY query_id)
SELECT query_id, question, summary, array_to_string(details, '|') AS key_details, contact_info, confidence, sources, answer_type, 1::BIGINT AS queries_used,
  30::BIGINT AS total_documents_searched, n AS documents_retrieved, round(rel, 9) AS average_relevance_score,
  CASE WHEN rel < 0.25 THEN 'bm25_low_confidence' ELSE 'bm25' END AS retrieval_method, 'none' AS reranking_method
FROM an JOIN sj USING (query_id)""", digits=9)
def structured_answer(spark, sf_dir):
    line = lambda s: F.concat_ws(
        " ", s["citation_number"].cast("string"), s["url"], X.fixed(s["relevance_score"], "0.000000"), s["excerpt"])
    return answers(spark, sf_dir).withColumn("sources", F.array_join(F.transform("sources", line), "|"))


def _bullets(rule):
    return f"array_to_string(list_transform(details, lambda d: '- ' || d || chr(10)), '') {rule}"


@query("rendered_answers", f"""WITH {ANSWERS},
sx AS (SELECT query_id, string_agg('(' || rank || '): ' || url || chr(10), '' ORDER BY rank) AS s_all,
  string_agg('[' || rank || '](' || url || ')' || chr(10), '' ORDER BY rank) FILTER (rank <= 5) AS s_text,
  string_agg(rank || '. [Quelle](' || url || ')' || chr(10) || '   > ' || ex || chr(10) || chr(10), '' ORDER BY rank) FILTER (rank <= 5) AS s_md FROM so GROUP BY query_id),
r AS (SELECT *, printf('%.1f', confidence * 100) || '%' AS pc, {_bullets('')} AS bl FROM an JOIN sx USING (query_id))
SELECT query_id, 'structured' AS format, {text_sql('**Zusammenfassung:**' + chr(10))} || summary || {text_sql(chr(10) * 2 + '**Wichtige Details:**' + chr(10))} || bl
  || coalesce({text_sql(chr(10) + '**Kontakt:**' + chr(10))} || contact_info || chr(10), '') || {text_sql(chr(10) + '**Konfidenz:** ')} || pc
  || {text_sql(chr(10) * 2 + '**Quellen:**' + chr(10))} || s_all AS response FROM r
UNION ALL SELECT query_id, 'text', summary || {text_sql(chr(10) * 2 + '**Wichtige Details:**' + chr(10))} || bl
  || coalesce({text_sql(chr(10) + '**Kontakt:**' + chr(10))} || contact_info || chr(10), '') || {text_sql(chr(10) + '**Konfidenz:** ')} || pc || chr(10)
  || {text_sql(chr(10) + '**Quellen:**' + chr(10))} || s_text || {text_sql(chr(10) + '**Retrieval-Informationen:**' + chr(10) + '- Durchsuchte Dokumente: 30' + chr(10) + '- Verwendete Queries: 1' + chr(10) + '- Durchschnittliche Relevanz: ')}
  || printf('%.3f', rel) || chr(10) FROM r
UNION ALL SELECT query_id, 'markdown', {text_sql('# Antwort' + chr(10) * 2)} || summary || {text_sql(chr(10) * 2 + '## Wichtige Details' + chr(10) * 2)} || bl || chr(10)
  || coalesce({text_sql('## Kontakt' + chr(10) * 2)} || contact_info || chr(10) || chr(10), '') || {text_sql('## Qualitätsbewertung' + chr(10) * 2 + '**Konfidenz:** ')} || pc
  || {text_sql(chr(10) * 2 + '## Quellen' + chr(10) * 2)} || s_md || {text_sql('## Retrieval-Informationen' + chr(10) * 2 + '- **Durchsuchte Dokumente:** 30' + chr(10) + '- **Verwendete Queries:** 1' + chr(10) + '- **Retrieval-Methode:** bm25')} || CASE WHEN rel < 0.25 THEN '_low_confidence' ELSE '' END
  || {text_sql(chr(10) + '- **Re-Ranking-Methode:** none' + chr(10) + '- **Durchschnittliche Relevanz:** ')}
  || printf('%.3f', rel) || chr(10) FROM r""")
def rendered_answers(spark, sf_dir):
    a = materialize(answers(spark, sf_dir))
    one = [X.render_answer(a, f, show_metadata=True).withColumn("format", F.lit(f)) for f in ("structured", "text", "markdown")]
    return one[0].unionByName(one[1]).unionByName(one[2])


@query("rendered_json")
def rendered_json(spark, sf_dir):
    return X.render_answer(answers(spark, sf_dir), "json", show_metadata=True)


@query("answer_all_questions")
def answer_all_questions(spark, sf_dir):
    docs = documents(spark, sf_dir).select("chunk_id", "content", "url")
    return answer_all(questions(spark, sf_dir), materialize(with_embedding(docs, "content")), "markdown")
