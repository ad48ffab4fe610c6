"""Text features, classifiers, keys, truncation, chat and error logs."""

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.cache import export_transcripts, trim_chat
from corpusloom.operators.dims import classify_errors
from corpusloom.operators.ingest import memory_estimate, reduce_chunks
from corpusloom.operators.metrics import chat_stats, collection_stats
from corpusloom.operators.rank import high_recall
from corpusloom.operators.search import expand_queries
from corpusloom.operators.validate import check_answers, check_chunks, check_variations
from workload.base import (
    DOC_URL_SQL, contains_any_sql, documents, list_sql, query, strip_sql, table, text_sql, words_sql,
)

def doc():
    return F.col("text")


def headed(spark, sf_dir):
    """Documents with markdown headers put in front of some sentences."""
    d = documents(spark, sf_dir)
    text = F.replace(F.replace(doc(), F.lit(".\n"), F.lit(".\n## ")), F.lit(", "), F.lit("\n### "))
    return d.withColumn("text", F.concat(F.lit("# Doc "), F.col("chunk_id").cast("string"), F.lit("\n"), text))


HEADED = """headed AS (SELECT doc_id AS chunk_id, '# Doc ' || doc_id || chr(10) ||
    replace(replace(text, '.' || chr(10), '.' || chr(10) || '## '), ', ', chr(10) || '### ') AS text FROM documents)"""


def headers_sql(source, keep):
    """CTE hd(keep..., headers) over source(keep..., text)."""
    return (rf"""h0 AS (SELECT *, regexp_extract_all(text, '(?m)^(#+)\s+(.+)$', 1) AS m1, regexp_extract_all(text, '(?m)^(#+)\s+(.+)$', 2) AS m2 FROM {source}),
    hd AS (SELECT {keep}, array_to_string(list_transform(list_zip(m1, m2), lambda z: z[1] || ' ' || z[2]), '; ') AS headers FROM h0)""")


@query("section_info", f"""WITH {HEADED}, {headers_sql('headed', 'chunk_id, text')} SELECT chunk_id, headers, length(text) AS char_count,
  len({words_sql('text')}) AS word_count FROM hd""")
def section_info(spark, sf_dir):
    return headed(spark, sf_dir).select("chunk_id", T.section_info(doc()).alias("r")).select("chunk_id", "r.*")


ENTROPY = rf"""
    ew AS (SELECT doc_id, {words_sql(r"regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g')")} AS ws FROM documents),
    ec AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(ws) AS w FROM ew) GROUP BY ALL),
    en AS (SELECT doc_id, CASE WHEN sum(c) < 3 THEN 0 ELSE log2(sum(c)) - sum(c * log2(c)) / sum(c) END AS h FROM ec GROUP BY doc_id),
    ent AS (SELECT doc_id, coalesce(h, 0.0) AS entropy FROM ew LEFT JOIN en USING (doc_id))"""


@query("text_features", rf"""WITH {ENTROPY}
SELECT doc_id AS chunk_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 3)::BIGINT) END AS tokens,
  round(entropy, 6) AS entropy,
  round(length(text) * (1 + (length(text) - length(replace(text, '.', ''))) * 0.1::DOUBLE + (length(text) - length(replace(text, '#', ''))) * 0.2::DOUBLE)
    * CASE WHEN contains(text, '##') OR contains(text, '**') THEN 1.2::DOUBLE ELSE 1 END, 6) AS info,
  CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS excerpt FROM documents JOIN ent USING (doc_id)""")
def text_features(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "chunk_id", T.approx_tokens(doc()).alias("tokens"), T.entropy(doc()).alias("entropy"),
        T.info_score(doc()).alias("info"), T.excerpt(doc()).alias("excerpt"))


# Boilerplate phrases and stop words mixed into the documents (on both sides).
PHRASES = ["© 2024 x. All rights reserved", "Cookie: please accept", "Follow us on y\npowered by z",
           "der die das und der die das und oder aber ist", ""]


def boiler(spark, sf_dir):
    d = documents(spark, sf_dir)
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (F.col("chunk_id") % 5 + 1).cast("int"))
    return d.withColumn("text", F.concat_ws(" ", phrase, doc()))


BOILER = f"""boiler AS (SELECT doc_id AS chunk_id, [{', '.join(text_sql(p) for p in PHRASES)}][doc_id % 5 + 1] || ' ' || text AS text FROM documents)"""


def boilerplate_sql(x):
    low = strip_sql(f"lower({x})")
    hits = " + ".join(f"regexp_matches({low}, '{p}')::INT" for p in T.BOILERPLATE_PATTERNS)
    stops = f"len(list_filter({words_sql(low)}, lambda s_: list_contains({list_sql(T.BOILERPLATE_STOP_WORDS)}, s_)))"
    return f"(({hits}) >= 2 OR coalesce({stops} / nullif(len({words_sql(low)}), 0), 0) > 0.7)"


@query("boilerplate", f"WITH {BOILER} SELECT chunk_id, {boilerplate_sql('text')} AS boilerplate FROM boiler")
def boilerplate(spark, sf_dir):
    return boiler(spark, sf_dir).select("chunk_id", T.is_boilerplate(doc()).alias("boilerplate"))


@query("context_quality", rf"""
WITH x AS (SELECT doc_id, {strip_sql('text')} AS c, CASE WHEN doc_id % 9 = 0 THEN ' ' ELSE {DOC_URL_SQL} END AS url,
  CASE WHEN doc_id % 4 = 0 THEN -1.0 ELSE doc_id % 7 / 4 END::DOUBLE AS s FROM documents),
w AS (SELECT *, {words_sql('lower(c)')} AS ws FROM x),
q AS (SELECT *, length(c) >= 10 AND trim(url) <> '' AS ok, least(length(c) / 1000, 1.0::DOUBLE) * 0.3::DOUBLE
  + coalesce(len(list_distinct(ws)) / nullif(len(ws), 0), 0) * 0.3::DOUBLE
  + (regexp_matches(c, '[.!?;:]')::INT + regexp_matches(c, '\p{{Lu}}')::INT) / 2 * 0.2::DOUBLE
  + CASE WHEN s > 0 THEN least(s, 1.0::DOUBLE) ELSE 0.5::DOUBLE END * 0.2::DOUBLE AS v FROM w)
SELECT doc_id AS chunk_id, ok AS valid, round(CASE WHEN ok THEN v ELSE 0 END, 6) AS quality FROM q""")
def context_quality(spark, sf_dir):
    d = documents(spark, sf_dir)
    n = F.col("chunk_id")
    url = F.when(n % 9 == 0, " ").otherwise(F.col("url"))
    score = F.when(n % 4 == 0, -1.0).otherwise((n % 7) / 4)
    return d.select("chunk_id", T.is_valid_context(doc(), url).alias("valid"), T.quality_score(doc(), url, score).alias("quality"))


# ---- questions: conversation turns behind openers of every kind ----------------

OPENERS = ["", "Was ist ", "Definition von ", "Unterschied zwischen ", "Wie ", "Warum ", "kurz "]


def asked(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").filter("role = 'user'")
    short = F.substring_index("text", " ", 2)
    forms = [F.concat(F.lit(o), doc()) for o in OPENERS] + [F.concat(F.lit(o), short) for o in OPENERS]
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.posexplode(F.array(*forms)).alias("form", "text"))


ASKED = f"""
    c_ AS (SELECT conv_id * 1000 + turn AS query_id, text, array_to_string(string_split(text, ' ')[1:2], ' ') AS s FROM conversations WHERE role = 'user'),
    o_ AS (SELECT query_id, list_concat(list_transform({list_sql(OPENERS)}, lambda o: o || text), list_transform({list_sql(OPENERS)}, lambda o: o || s)) AS f FROM c_),
    asked AS (SELECT query_id, (i - 1)::BIGINT AS form, f[i] AS text FROM o_, range(1, {2 * len(OPENERS) + 1}) AS r(i))"""


def complexity_sql(x):
    n, q = f"len({words_sql(x)})", f"lower({x})"
    long = f"len(list_filter({words_sql(x)}, lambda l_: length(l_) > 6)) > 2"
    simple1 = f"{n} <= 4 AND {contains_any_sql(q, T.SIMPLE_OPENERS)}"
    simple2 = f"{n} <= 6 AND {contains_any_sql(q, T.DEFINITION_WORDS)}"
    hard = f"({contains_any_sql(q, T.COMPARISON_WORDS)} OR {contains_any_sql(q, T.COMPLEX_WORDS)} OR {long} OR {n} > 10)"
    return (f"CASE WHEN {simple1} OR {simple2} THEN 'simple' WHEN {hard} THEN 'complex' ELSE 'moderate' END",
            f"CASE WHEN {simple1} THEN 0.2::DOUBLE WHEN {simple2} THEN 0.25::DOUBLE WHEN {hard} "
            f"THEN greatest(0.66::DOUBLE, least(1.0::DOUBLE, 0.8::DOUBLE + ({n} - 10) * 0.02::DOUBLE)) "
            f"ELSE greatest(0.33::DOUBLE, least(0.65::DOUBLE, 0.4::DOUBLE + ({n} - 5) * 0.05::DOUBLE)) END")


STRATEGY_SQL, COMPLEXITY_SQL = complexity_sql("text")


@query("question_complexity", f"""WITH {ASKED} SELECT query_id, form, {STRATEGY_SQL} AS strategy,
  round({COMPLEXITY_SQL}, 6) AS score FROM asked""")
def question_complexity(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", "form", T.complexity(doc()).alias("r")).select("query_id", "form", "r.*")


@query("answer_type", f"""WITH {ASKED} SELECT query_id, form, CASE
  {' '.join(f"WHEN {contains_any_sql('lower(text)', words)} THEN '{kind}'" for kind, words in T.ANSWER_TYPES)}
  ELSE 'informational' END AS answer_type FROM asked""")
def answer_type(spark, sf_dir):
    return asked(spark, sf_dir).select("query_id", "form", T.answer_type(doc()).alias("answer_type"))


@query("cache_keys", rf"""
WITH x AS (SELECT conv_id, turn, '  ' || text || chr(10) AS q, text || ' https://a.b/c?d=' || turn || '   ' || role AS ctx FROM conversations)
SELECT conv_id, turn, sha256(lower({strip_sql('q')}) || '|' || {strip_sql(r"regexp_replace(regexp_replace(ctx, 'https?://[^\s]+', '', 'g'), '\s+', ' ', 'g')")}) AS cache_key,
  md5(lower({strip_sql('q')})) AS query_key FROM x""")
def cache_keys(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    q = F.concat(F.lit("  "), doc(), F.lit("\n"))
    ctx = F.concat(doc(), F.lit(" https://a.b/c?d="), F.col("turn").cast("string"), F.lit("   "), F.col("role"))
    return c.select("conv_id", "turn", T.cache_key(q, ctx).alias("cache_key"), T.query_key(q).alias("query_key"))


@query("dedup_keys", f"""SELECT doc_id AS chunk_id, md5(text) || '_' || length(text) AS text_key,
  md5(text) || '_' || length(text) || '_' || {DOC_URL_SQL} AS text_url_key, substr(text, 1, 100) AS prefix FROM documents""")
def dedup_keys(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "chunk_id", T.text_key(doc()).alias("text_key"), T.text_url_key(doc(), F.col("url")).alias("text_url_key"),
        T.prefix_key(doc()).alias("prefix"))


@query("truncation", r"""
WITH s AS (SELECT doc_id, text, string_split(text, '. ') AS p FROM documents),
u AS (SELECT doc_id, i, p[i] AS p, sum(length(p[i])) OVER (PARTITION BY doc_id ORDER BY i) AS used FROM s, range(1, 100000) AS r(i) WHERE i <= len(p)),
k AS (SELECT doc_id, string_agg(p, '. ' ORDER BY i) FILTER (used <= 800) AS cut FROM u GROUP BY doc_id),
h AS (SELECT doc_id, substr(text, 1, 300) AS head, length(substr(text, 1, 300)) - instr(reverse(substr(text, 1, 300)), ' ') AS sp FROM s)
SELECT s.doc_id AS chunk_id, CASE WHEN length(text) <= 800 THEN text WHEN coalesce(cut, '') LIKE '%.' THEN cut ELSE coalesce(cut, '') || '.' END AS sentences,
  CASE WHEN length(text) <= 300 THEN text WHEN contains(head, ' ') AND sp > 200 THEN substr(head, 1, sp) || '...' ELSE head END AS words
FROM s JOIN k USING (doc_id) JOIN h USING (doc_id)""")
def truncation(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "chunk_id", T.truncate_sentences(doc()).alias("sentences"), T.truncate_words(doc()).alias("words"))


# Wiki marks put into the documents (on both sides).
def wiki(spark, sf_dir):
    d = documents(spark, sf_dir)
    marked = F.replace(F.replace(doc(), F.lit(", "), F.lit("[12] [a b], ")), F.lit(".\n"), F.lit(".\n \n → Hauptartikel: x y\nSiehe auch: z\n"))
    tail = F.when(F.col("chunk_id") % 3 == 0, "\nWeblinks\na\nb").when(F.col("chunk_id") % 3 == 1, "\n  Literatur: c\nd").otherwise(" \nEinzelnachweise\n↑ e")
    return d.withColumn("text", F.concat(F.lit("Datei:Karte.svg) [Bearbeiten | Quelltext bearbeiten] "), marked, tail))


WIKI = r"""wiki AS (SELECT doc_id AS chunk_id, 'Datei:Karte.svg) [Bearbeiten | Quelltext bearbeiten] ' || replace(replace(text, ', ', '[12] [a b], '), '.' || chr(10),
    '.' || chr(10) || ' ' || chr(10) || ' → Hauptartikel: x y' || chr(10) || 'Siehe auch: z' || chr(10)) || CASE doc_id % 3
    WHEN 0 THEN chr(10) || 'Weblinks' || chr(10) || 'a' || chr(10) || 'b' WHEN 1 THEN chr(10) || '  Literatur: c' || chr(10) || 'd'
    ELSE ' ' || chr(10) || 'Einzelnachweise' || chr(10) || '↑ e' END AS text FROM documents)"""


def clean_wiki_sql(x):
    for p, r in T.WIKI_REMOVALS:
        x = f"regexp_replace({x}, '{p}', {text_sql(r)}, 'g')"
    return strip_sql(x)


@query("wiki_cleanup", f"WITH {WIKI} SELECT chunk_id, {clean_wiki_sql('text')} AS cleaned FROM wiki")
def wiki_cleanup(spark, sf_dir):
    return wiki(spark, sf_dir).select("chunk_id", T.clean_wiki(doc()).alias("cleaned"))


@query("prompts", f"""WITH {ASKED}, s AS (SELECT *, {STRATEGY_SQL} AS strategy FROM asked)
SELECT query_id, form, 'Reword this search question ' || CASE strategy WHEN 'simple' THEN 'once, on one line' WHEN 'moderate' THEN 'twice, one wording a line'
    ELSE 'three times, one wording a line' END || ', nothing else:' || chr(10) || text AS variation_prompt,
  CASE WHEN len({words_sql('text')}) <= 3 AND {contains_any_sql('lower(text)', ['was ist', 'was bedeutet', 'definition'])}
    THEN 'Define in one or two sentences: ' || text ELSE 'Write the paragraph of a web page that answers: ' || text END AS hyde_prompt FROM s""")
def prompts(spark, sf_dir):
    strategy = T.complexity(doc())["strategy"]
    return asked(spark, sf_dir).withColumn("strategy", strategy).select(
        "query_id", "form", T.variation_prompt(doc(), F.col("strategy")).alias("variation_prompt"),
        T.hyde_prompt(doc()).alias("hyde_prompt"))


def variations(spark, sf_dir):
    """Questions with a generated text: rewordings of themselves stand for a model's answer."""
    return asked(spark, sf_dir).select(
        (F.col("query_id") * 100 + F.col("form")).alias("query_id"), "text",
        F.concat(F.lit("  "), F.lower("text"), F.lit(" \n\nalso "), F.col("text"), F.lit("\n \nvier\nfünf")).alias("variations_text"))


@query("query_fanout", f"""
WITH {ASKED}, v AS (SELECT query_id * 100 + form AS query_id, text, {STRATEGY_SQL} AS strategy, {COMPLEXITY_SQL} AS complexity,
  '  ' || lower(text) || ' ' || chr(10) || chr(10) || 'also ' || text || chr(10) || ' ' || chr(10) || 'vier' || chr(10) || 'fünf' AS vt FROM asked),
l AS (SELECT query_id, strategy, complexity, list_concat([text], list_filter(list_transform(string_split(vt, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '')
  [1:CASE strategy WHEN 'simple' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END]) AS ts FROM v)
SELECT query_id, (i - 1)::BIGINT AS variation_no, ts[i] AS text, strategy, round(complexity, 6) AS complexity FROM l, range(1, 5) AS r(i) WHERE i <= len(ts)""")
def query_fanout(spark, sf_dir):
    return expand_queries(variations(spark, sf_dir))


@query("variation_rules", f"""
WITH {ASKED}, v AS (SELECT query_id, form, text, {STRATEGY_SQL} AS strategy, CASE WHEN form % 4 = 0 THEN 0.95::DOUBLE ELSE {COMPLEXITY_SQL} END AS score FROM asked)
SELECT query_id, form, array_to_string(list_filter([CASE WHEN form % 3 + 1 > CASE strategy WHEN 'simple' THEN 1 WHEN 'moderate' THEN 2 ELSE 3 END THEN 'count' END,
  CASE WHEN form % 5 = 0 THEN 'empty' END, CASE WHEN form % 2 = 0 AND form <> 0 THEN 'same' END,
  CASE WHEN NOT score BETWEEN CASE strategy WHEN 'simple' THEN 0 WHEN 'moderate' THEN 0.33::DOUBLE ELSE 0.66::DOUBLE END
    AND CASE strategy WHEN 'simple' THEN 0.33::DOUBLE WHEN 'moderate' THEN 0.66::DOUBLE ELSE 1 END THEN 'score' END], lambda x: x IS NOT NULL), '|') AS violations FROM v""")
def variation_rules(spark, sf_dir):
    q = asked(spark, sf_dir).withColumn("_c", T.complexity(doc()))
    form = F.col("form")
    first = F.when(form % 5 == 0, " ").when(form % 2 == 0, F.concat(F.lit("  "), F.lower("text"))).otherwise("andere Frage")
    second = F.when((form % 2 == 0) & (form % 5 == 0), F.lower("text")).otherwise("zweite Frage")
    texts = F.slice(F.array(first, second, F.lit("dritte Frage")), F.lit(1), form % 3 + 1)
    q = q.select("query_id", "form", "text", F.col("_c.strategy").alias("strategy"),
                 F.when(form % 4 == 0, 0.95).otherwise(F.col("_c.score")).alias("score"), texts.alias("variations"))
    return check_variations(q).select("query_id", "form", "violations")


def parse_sql(source, keys):
    """CTEs up to pa(keys, summary, details list, contact_info) from source(keys, t)."""
    return rf"""
pl AS (SELECT {keys}, i, {strip_sql('p[i]')} AS s FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM (SELECT *, string_split(t, chr(10)) AS p FROM {source}))),
pm AS (SELECT *, CASE WHEN {contains_any_sql('lower(s)', T.DETAIL_MARKERS)} THEN 'details' WHEN {contains_any_sql('lower(s)', T.CONTACT_MARKERS)} THEN 'contact' END AS mk
  FROM pl WHERE s <> ''),
pc AS (SELECT *, coalesce(last_value(mk IGNORE NULLS) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'summary') AS sec,
  s LIKE '-%' OR s LIKE '•%' OR s LIKE '*%' AS bullet FROM pm),
pn AS (SELECT *, row_number() OVER (PARTITION BY {keys}, sec, mk IS NULL ORDER BY i) AS k FROM pc),
pg AS (SELECT {keys}, string_agg(s, ' ' ORDER BY i) FILTER (mk IS NULL AND sec = 'summary' AND k <= 3) AS summary,
  list(ltrim(s, '-•* ') ORDER BY i) FILTER (mk IS NULL AND sec = 'details' AND bullet) AS details,
  arg_max(s, i) FILTER (mk IS NULL AND sec = 'contact') AS contact,
  list(regexp_extract(s, '^[-•*]\s*(.+)$', 1) ORDER BY i) FILTER (regexp_matches(s, '^[-•*]\s*.+$')) AS bullets FROM pn GROUP BY {keys}),
pa AS (SELECT {keys}, coalesce(summary, nullif(array_to_string(list_transform(list_filter(list_transform(string_split(t, '.')[1:2], lambda x: {strip_sql('x')}),
  lambda x: x <> ''), lambda x: x || '.'), ' '), ''), substr(t, 1, 200) || '...') AS summary,
  coalesce(details, bullets, ['{T.NO_DETAILS}']) AS details, contact AS contact_info FROM {source} LEFT JOIN pg USING ({keys}))"""


@query("answer_parsing", rf"""
WITH a AS (SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN text || {text_sql(chr(10) + 'Wichtige Details:' + chr(10) + '- eins' + chr(10) + '* zwei' + chr(10) + 'Kontakt' + chr(10) + 'mail@example.org')}
    WHEN 1 THEN 'Key facts' || chr(10) || text WHEN 2 THEN replace(text, chr(10), chr(10) || '- ') ELSE text END AS t FROM conversations WHERE role = 'assistant'),
{parse_sql('a', 'conv_id, turn')} SELECT conv_id, turn, summary, array_to_string(details, '|') AS key_details, contact_info FROM pa""")
def answer_parsing(spark, sf_dir):
    """Assistant turns as generated answers: marker lines put between their lines."""
    c = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    m = F.col("conv_id") % 4
    text = (
        F.when(m == 0, F.concat(doc(), F.lit("\nWichtige Details:\n- eins\n* zwei\nKontakt\nmail@example.org")))
        .when(m == 1, F.concat(F.lit("Key facts\n"), doc())).when(m == 2, F.replace(doc(), F.lit("\n"), F.lit("\n- "))).otherwise(doc())
    )
    return c.select("conv_id", "turn", T.parse_answer(text).alias("r")).select("conv_id", "turn", "r.*")


# ---- error log -------------------------------------------------------------------

def error_log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    kind = F.when(n % 11 == 0, "retrieval").when(n % 11 == 1, "reranking").otherwise("other")
    message = F.concat(F.element_at(F.array(*[F.lit(x) for x in MESSAGES]), (n % 5 + 1).cast("int")), F.lit(" "), F.col("event_type"))
    wanted = (
        F.when(n % 3 == 0, F.array(F.lit("use_cache"), F.lit("retry")))
        .when(n % 3 == 1, F.array(F.lit("use_cache"))).otherwise(F.lit(None).cast("array<string>"))
    )
    return e.select("event_id", kind.alias("kind"), message.alias("message"), wanted.alias("wanted"))


MESSAGES = ["Request TIMEOUT", "Network unreachable", "connection reset", "bad value", "quota"]


def _strategies_sql(kind):
    allowed = T.APPROPRIATE_STRATEGIES[kind]

    def kept(wanted):
        good = [w for w in wanted if w in allowed]
        return "|".join(good or allowed[:1])

    return (f"WHEN '{kind}' THEN CASE event_id % 3 WHEN 0 THEN '{kept(['use_cache', 'retry'])}' WHEN 1 THEN '{kept(['use_cache'])}' "
            f"ELSE '{kept(T.ERROR_STRATEGIES[kind])}' END")


@query("error_classes", f"""
WITH x AS (SELECT event_id, event_id % 11 AS k, lower({list_sql(MESSAGES)}[event_id % 5 + 1] || ' ' || event_type) AS m FROM events),
t AS (SELECT event_id, CASE WHEN k = 0 THEN 'retrieval_error' WHEN k = 1 THEN 'reranking_error' WHEN contains(m, 'timeout') THEN 'timeout_error'
  WHEN contains(m, 'network') OR contains(m, 'connection') THEN 'network_error' ELSE 'unknown_error' END AS error_type FROM x)
SELECT event_id, error_type, CASE WHEN error_type IN ('timeout_error', 'network_error') THEN 'high' ELSE 'medium' END AS severity,
  CASE error_type {' '.join(_strategies_sql(k) for k in ('retrieval_error', 'reranking_error', 'timeout_error', 'network_error', 'unknown_error'))} END
  AS strategies FROM t""")
def error_classes(spark, sf_dir):
    return classify_errors(error_log(spark, sf_dir)).select("event_id", "error_type", "severity", "strategies")


# ---- rows rules, filters, reductions over documents -------------------------------

@query("chunk_rules", f"""
WITH x AS (SELECT doc_id, {strip_sql('text')} AS t, doc_id % 6 = 0 AS bad_url, doc_id - 5 AS ix, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 3 END AS tot FROM documents)
SELECT doc_id AS chunk_id, array_to_string(list_filter([CASE WHEN bad_url THEN 'url' END, CASE WHEN length(t) < 3 THEN 'content' END,
  CASE WHEN ix < 0 THEN 'chunk_index' END, CASE WHEN tot < 1 THEN 'total_chunks' END], lambda v: v IS NOT NULL), '|') AS violations FROM x""")
def chunk_rules(spark, sf_dir):
    n = F.col("chunk_id")
    d = documents(spark, sf_dir).select(
        n.cast("string").alias("chunk_id"), F.col("text").alias("content"), (n - 5).alias("chunk_index"),
        F.when(n % 6 == 0, F.concat(F.lit("ftp:"), "url")).otherwise(F.col("url")).alias("url"),
        F.when(n % 4 == 0, None).otherwise(n % 3).alias("total_chunks"))
    return check_chunks(d).select(n.cast("bigint").alias("chunk_id"), "violations")


@query("answer_rules", f"""
WITH x AS (SELECT doc_id, length({strip_sql('substr(text, 1, 20 + (doc_id % 600)::INT)')}) AS n, doc_id % 7 AS a, doc_id % 11 AS b FROM documents)
SELECT doc_id AS chunk_id, array_to_string(list_filter([CASE WHEN n NOT BETWEEN 20 AND 500 THEN 'summary' END, CASE WHEN a = 0 OR b = 0 THEN 'key_details' END,
  CASE WHEN a = 1 THEN 'confidence' END, CASE WHEN a > b THEN 'retrieved' END, CASE WHEN b = 2 THEN 'queries_used' END], lambda v: v IS NOT NULL), '|') AS violations FROM x""")
def answer_rules(spark, sf_dir):
    """Answers made from documents, some of which break a rule; quarantined rows are those with violations."""
    n = F.col("chunk_id")
    details = F.when(n % 7 == 0, F.array().cast("array<string>")).when(n % 11 == 0, F.array(F.lit("long enough"), F.lit(" ab "))).otherwise(F.array(F.lit("detail")))
    d = documents(spark, sf_dir).select(
        n, F.substring("text", F.lit(1), (n % 600 + 20).cast("int")).alias("summary"), details.alias("key_details"),
        F.when(n % 7 == 1, 1.5).otherwise(0.5).alias("confidence"), (n % 7).alias("documents_retrieved"),
        (n % 11).alias("total_documents_searched"), F.when(n % 11 == 2, 0).otherwise(1).alias("queries_used"))
    return check_answers(d).select("chunk_id", "violations")


@query("high_recall_filter", rf"""
WITH {ENTROPY}, x AS (SELECT doc_id, {strip_sql('text')} AS t, text, entropy FROM documents JOIN ent USING (doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY md5(t), length(t) ORDER BY doc_id) AS rn FROM x)
SELECT doc_id AS chunk_id, 0.5::DOUBLE AS score FROM f WHERE rn = 1 AND length(t) >= 30 AND entropy >= 1.0 AND NOT {boilerplate_sql('t')}""")
def high_recall_filter(spark, sf_dir):
    return high_recall(documents(spark, sf_dir), [], [F.col("chunk_id")]).select("chunk_id", "score")


@query("memory_estimate", """
WITH m AS (SELECT count(*) AS chunks, count(*) * avg(length(text)) * 2 / 1048576 AS mb FROM documents)
SELECT chunks, round(mb, 6) AS estimated_mb, CASE WHEN mb > 1200 THEN 'error' WHEN mb > 800 THEN 'warning' ELSE 'ok' END AS level FROM m""")
def memory_estimate_(spark, sf_dir):
    return memory_estimate(documents(spark, sf_dir))


@query("chunk_reduction", """
WITH x AS (SELECT doc_id, length(text) * (1 + (length(text) - length(replace(text, '.', ''))) * 0.1::DOUBLE + (length(text) - length(replace(text, '#', ''))) * 0.2::DOUBLE)
    * CASE WHEN contains(text, '##') OR contains(text, '**') THEN 1.2::DOUBLE ELSE 1 END AS s FROM documents)
SELECT doc_id AS chunk_id FROM (SELECT doc_id, row_number() OVER (ORDER BY s DESC, doc_id DESC) AS rn FROM x) WHERE rn <= 400""")
def chunk_reduction(spark, sf_dir):
    return reduce_chunks(documents(spark, sf_dir), "chunk_id", max_chunks=400).select("chunk_id")


@query("collection_stats", f"""SELECT lang, count(*) AS chunks, count(DISTINCT {DOC_URL_SQL}) AS urls FROM documents GROUP BY lang""")
def collection_stats_(spark, sf_dir):
    return collection_stats(documents(spark, sf_dir), ["lang"])


# ---- chats -----------------------------------------------------------------------

@query("chat_stats", """SELECT count(*) AS messages, count(*) FILTER (role = 'user') AS user_questions,
  sum(length(text))::BIGINT AS total_chars FROM conversations""")
def chat_stats_(spark, sf_dir):
    return chat_stats(table(spark, sf_dir, "conversations"))


@query("chat_transcripts", """SELECT conv_id, 0::BIGINT AS part, string_agg(CASE WHEN role = 'user' THEN '**Du**' ELSE '**Assistant**' END || ':' || chr(10) || text
  || chr(10) || chr(10) || '---' || chr(10) || chr(10), '' ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id""")
def chat_transcripts(spark, sf_dir):
    return export_transcripts(table(spark, sf_dir, "conversations"))


@query("chat_trim", """
WITH x AS (SELECT conv_id, turn, role, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
SELECT conv_id, turn, role FROM x WHERE n <= 4 OR rn <= 2""")
def chat_trim(spark, sf_dir):
    return trim_chat(table(spark, sf_dir, "conversations"), max_messages=4, keep=2).select("conv_id", "turn", "role")
