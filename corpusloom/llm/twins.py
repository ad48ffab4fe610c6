"""DuckDB twins of `op11_url_filter`, `op12_lexical_ranking` and `op13_spelling_variants`."""

from __future__ import annotations

from corpusloom.llm.url_filter import LOWER, RULES, UPPER

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)

# Canonical links and refreshing metas with whole or rooted targets are followed; classes are what recursion reaches.
URL_SQL = rf"""
WITH RECURSIVE rules(rhost, rpath, rverdict) AS (VALUES {_RULE_ROWS}),
p AS (SELECT page_id, url, coalesce(html, '') AS html, CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
q AS (SELECT *, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
        CASE WHEN contains(url, '://') THEN translate(url[:strpos(url, '://') - 1], '{UPPER}', '{LOWER}') || '://' END AS scheme FROM p),
tags AS (SELECT scheme || host || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) AS a, scheme || host AS site,
           unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\s[^>]*>')) AS tag FROM q),
targets AS (SELECT a, site, CASE WHEN regexp_matches(tag, '(?i)rel\s*=\s*["'']?canonical') THEN regexp_extract(tag, '(?i)href\s*=\s*["'']?([^"''\s>]+)', 1)
              WHEN regexp_matches(tag, '(?i)http-equiv\s*=\s*["'']?refresh') THEN regexp_extract(tag, '(?i)url\s*=\s*([^"''\s>]+)', 1) END AS t FROM tags),
edges AS (SELECT DISTINCT a, CASE WHEN starts_with(t, '/') THEN site || t ELSE regexp_extract(t, '^[^#]*') END AS b FROM targets
          WHERE coalesce(t, '') <> '' AND a IS NOT NULL),
links AS (SELECT a, b FROM edges WHERE a <> b UNION SELECT b, a FROM edges WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
urls AS (SELECT DISTINCT host, path FROM q UNION
         SELECT regexp_extract(node, '://([^/?#]*)', 1), regexp_extract(node, '://[^/?#]*([^?#]*)', 1) FROM comp),
best AS (SELECT host, path, max(struct_pack(size := length(rhost || rpath), host_size := length(rhost), allowed := rverdict = 'allow',
           rule := rhost || rpath, verdict := rverdict)) AS r
         FROM urls JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY host, path),
told AS (SELECT component, CASE WHEN bool_or(r.verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
         FROM comp JOIN best ON regexp_extract(node, '://([^/?#]*)', 1) = host AND regexp_extract(node, '://[^/?#]*([^?#]*)', 1) = path
         GROUP BY component)
SELECT q.page_id, q.host, q.path, best.r.rule AS rule, coalesce(best.r.verdict, told.verdict, 'allow') AS verdict,
  CASE WHEN best.r IS NOT NULL THEN 'rule' WHEN told.verdict IS NOT NULL THEN 'alias' ELSE 'default' END AS decided_by
FROM q LEFT JOIN best USING (host, path)
LEFT JOIN comp ON comp.node = q.scheme || q.host || regexp_extract(q.rest, '^[^/?#]*([^#]*)', 1)
LEFT JOIN told USING (component)"""

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANK_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents),
dn AS (SELECT row_number() OVER () AS row, doc_id, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
st AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM dn),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
tk AS (SELECT row, unnest(ts) AS term FROM dn),
tf AS (SELECT row, term, count(*)::BIGINT AS tf FROM tk WHERE term IN (SELECT term FROM q) GROUP BY row, term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, st GROUP BY term, big_n),
m AS (SELECT row, doc_id, 100 - 90 + (90 * n * big_n) // big_l AS m FROM dn, st),
s AS (SELECT item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
      FROM tf JOIN m USING (row) JOIN w USING (term) JOIN q USING (term) GROUP BY item_id, row, doc_id)
SELECT * FROM (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
               FROM s WHERE score > 0) WHERE rank <= 10"""

_ACCENTS = "".join(map(chr, range(0xC0, 0x100)))
_PLAIN = UPPER + "0123456789" + "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "'")[:28]

# The crc32 runs over UTF-8 bytes; two words of one edit share a word with a letter less. Accented letters become
# single bytes before the distance is taken, which counts bytes.
SPELLING_SQL = rf"""
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS tab FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS c FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bytes AS (SELECT *, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''),
            lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::UBIGINT] ELSE [195::UBIGINT, (unicode(x) - 64)::UBIGINT] END)) AS b FROM low),
crc AS (SELECT doc_id, run, c,
          xor(list_reduce(b, lambda a, x: xor(a >> 8, tab[(xor(a, x) & 255)::BIGINT + 1]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS h
        FROM bytes, tab),
words AS (SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, c FROM crc),
vocab AS (SELECT word, sum(c)::BIGINT AS n FROM words GROUP BY word HAVING sum(c) >= 5 AND length(word) >= 6),
cut AS (SELECT word, n, unnest(list_distinct([word] || list_transform(range(1, length(word) + 1), lambda i: word[:i - 1] || word[i + 1:]))) AS v FROM vocab),
near AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b USING (v)
         WHERE a.word <> b.word AND levenshtein(translate(a.word, '{_ACCENTS}', '{_PLAIN}'), translate(b.word, '{_ACCENTS}', '{_PLAIN}')) = 1),
best AS (SELECT word, n, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
           row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM near),
forms AS (SELECT vocab.word, vocab.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * vocab.n THEN near END AS form,
            CASE WHEN near_n >= 5 * vocab.n THEN near_n END AS form_n
          FROM vocab LEFT JOIN (SELECT * FROM best WHERE k = 1) b ON vocab.word = b.word),
chain(word, root) AS (SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.root FROM chain c JOIN forms f ON c.root = f.word WHERE f.form IS NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)"""
