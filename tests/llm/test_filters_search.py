import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import SCHEMA, awkward  # noqa: E402

from corpusloom.llm import lexical, spelling, url_filter  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 11: url filter ------------------------------------------------------------

PAGE = "page_id long, url string, html string, host string, rule string, address string, component string, node string, `a.b` string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "h", "r", "a", "c", "n", "x") for r in rows], PAGE).repartition(3)


def canonical(href):
    return f'<head><meta charset="utf-8"><link rel="canonical" href="{href}"></head>'


def verdicts(spark, rows, **more):
    return {r["page_id"]: (r["verdict"], r["rule"], r["decided_by"]) for r in url_filter.judge(pages(spark, rows), **more).collect()}


def test_host_and_path(spark):
    rows = spark.createDataFrame(
        [("http://A.Example.NET/x/Y?q#f",), ("//a.net/x",), (None,), ("x://h",), ("x://h?q/r",), ("x://h#/r",), ("a://b://c/d",), ("s://ÄB.de/",), ("",)], "u string")
    got = [tuple(r) for r in rows.select(*url_filter.host_path(F.col("u"))).collect()]
    assert got == [("a.example.net", "/x/Y"), ("", ""), ("", ""), ("h", ""), ("h", ""), ("h", ""), ("b:", "//c/d"), ("Äb.de", "/"), ("", "")]


def test_longest_rule_wins_and_needs_its_path(spark):
    got = verdicts(spark, [
        (1, "https://www.example.net/en/1", None), (2, "https://www.example.net/de/1", None), (3, "https://myexample.net/en/1", None),
        (4, "https://example.com/de/", ""), (5, "https://example.com/de", ""), (6, "https://x.org/fr/1?a", ""), (7, "https://net/", ""),
        (8, "https://a.net", ""), (9, None, None), (10, "nothing", None), (10, "nothing", None), (11, "https://a.net:80/", ""), (12, "https://net.example/", ""),
    ])
    assert got == {
        1: ("allow", "example.net/en/", "rule"), 2: ("block", "net/", "rule"), 3: ("block", "net/", "rule"), 4: ("block", "example.com/de/", "rule"),
        5: ("allow", None, "default"), 6: ("allow", "org/fr/", "rule"), 7: ("block", "net/", "rule"), 8: ("allow", None, "default"),
        9: ("allow", None, "default"), 10: ("allow", None, "default"), 11: ("allow", None, "default"), 12: ("allow", None, "default"),
    }


def test_blocks_reach_aliases_and_explicit_allows_come_first(spark):
    rows = [
        (1, "https://mirror.com/a#top", canonical("https://bad.net/a")),  # alias of a blocked address that is no page
        (2, "https://deep.com/a", '<meta http-equiv=Refresh content="0; URL=https://mirror.com/a">'),  # two steps away
        (3, "https://x.org/fr/a", canonical("https://bad.net/a")),  # allowed itself; its class is allowed, too
        (4, "https://two.com/b", canonical("https://bad.net/b")), (5, "https://bad.net/b", ""),
        (6, "https://www.example.net/en/b", ""), (7, "https://two.com/c", canonical("/d")), (8, "https://two.com/d", canonical("https://bad.net/d")),
        (9, "https://two.com/none", "<!-- " + canonical("https://bad.net/a") + " --><script>'<link rel=canonical href=https://bad.net/a>'</script>"),
        (10, "https://two.com/quote", "<p title=don't><link href='https://bad.net/e' rel='x CANONICAL'>"),
        (11, "https://two.com/self", canonical("https://two.com/self#x")), (12, "https://two.com/b", None), (13, "https://hop.com/", None),
    ]
    got = verdicts(spark, rows, redirects=spark.createDataFrame([("https://hop.com/", "https://HOP2.com/"), ("https://hop2.com/", "https://bad.net/z"), (None, "https://bad.net/z"), ("x", "y")], "src string, dst string"))
    assert {k: v[0] for k, v in got.items()} == {
        1: "allow", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "block", 8: "block", 9: "allow", 10: "block", 11: "allow", 12: "block", 13: "block"}
    assert got[4][2] == "alias" and got[5][2] == "rule" and got[1] == ("allow", None, "alias")
    without = [r for r in rows if r[0] != 3]
    assert {k: v[0] for k, v in verdicts(spark, without).items() if k < 3} == {1: "block", 2: "block"}


def test_random_graphs_equal_a_plain_version(spark, monkeypatch):
    rnd = random.Random(5)
    hosts = ["a.net", "b.example.net", "c.com", "d.example.com", "e.org", "f.io", "g.io"]
    urls = [f"https://{rnd.choice(hosts)}/{rnd.choice(['en', 'de', 'fr'])}/{k}" for k in range(120)]
    rows = [(k, u, canonical(rnd.choice(urls)) if rnd.random() < 0.5 else "<p>x") for k, u in enumerate(urls)]
    parent = {u: u for u in urls}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for _, u, h in rows:
        for t in re.findall('href="(.*?)"', h):
            parent[find(u)] = find(t)

    def own(u):
        host, path = u[8:].split("/", 1)
        fits = [(len(h + p), v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and ("/" + path).startswith(p)]
        return max(fits)[1] if fits else None

    classes = {}
    for u in urls:
        classes.setdefault(find(u), set()).add(own(u))
    expected = {k: own(u) or ("allow" if "allow" in classes[find(u)] else "block" if "block" in classes[find(u)] else "allow") for k, u, _ in rows}
    assert {k: v[0] for k, v in verdicts(spark, rows).items()} == expected
    small = verdicts(spark, rows)
    monkeypatch.setattr(url_filter, "RULE_ROWS", 1)  # rules by a join, decisions by a shuffle
    monkeypatch.setattr(url_filter, "CLASS_ROWS", 1)
    assert verdicts(spark, rows) == small
    assert {v[0] for v in verdicts(spark, rows, rules=[]).values()} == {"allow"}


def test_url_filter_on_empty_and_without_html(spark, empty):
    none = url_filter.judge(pages(spark, []))
    assert none.collect() == [] and none.columns == ["page_id", "url", "host", "path", "rule", "verdict", "decided_by"]
    bare = spark.createDataFrame([(1, "https://a.net/")], "page_id long, url string")
    assert url_filter.judge(bare).first()["verdict"] == "block"
    long = "https://" + "a." * 50_000 + "net/" + "p" * 100_000
    assert verdicts(spark, [(1, long, "<link " + "a='" * 100_000)])[1][0] == "block"


# ---- 12: ranked lexical search ---------------------------------------------------

TERM = re.compile(lexical.TERM)


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(rows, items, k=10):
    docs = [(i, Counter(terms_of(t))) for i, t in rows if terms_of(t)]
    n_docs, n_terms = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms_of(text))
    out = set()
    for item, terms in asked.items():
        scored = []
        for i, c in docs:
            m = 100 - 90 + (90 * sum(c.values()) * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out |= {(item, r + 1, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k])}
    return out


def ranked(docs, items, **more):
    return [tuple(r) for r in lexical.rank(docs, items, **more).collect()]


def random_corpus(seed, n):
    rnd = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(300)] + ["É", "é", "ß9", "漢字"]
    rows = [(k, " ".join(rnd.choice(vocabulary[: rnd.choice([20, 100, 304])]) for _ in range(rnd.choice([0, 1, 5, 40, 200])))) for k in range(n)]
    rows += [(5, rows[7][1]), (5, rows[7][1]), (None, rows[7][1]), (None, None), (9, ""), (10, " ,.- "), (11, "T1-t2.T3_t1" * 3000)]
    items = [(k, rows[rnd.randrange(n)][1][:200].upper()) for k in range(25)] + [(25, None), (26, ""), (27, "nowhere"), (3, "t1 t2"), (28, "t1,T1;t1")]
    return rows, items


def test_ranking_equals_a_plain_version(spark, monkeypatch):
    rows, items = random_corpus(1, 600)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    asked = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, score string").repartition(2)
    expected = plain_ranking(rows, items)
    got = ranked(docs, asked)
    assert len(got) == len(set(got)) and set(got) == expected
    # several passes over the documents, small trees and leaves
    monkeypatch.setattr(lexical, "TERMS_AT_ONCE", 200)
    monkeypatch.setattr(lexical, "TREE_ENTRIES", 500)
    monkeypatch.setattr(lexical, "LEAF_DOCS", 2)
    assert set(ranked(docs, asked)) == expected
    assert set(ranked(docs, asked, k=3)) == plain_ranking(rows, items, 3)


def test_awkward_documents_and_empty_tables(spark, docs, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = [("a", "w1 w2 w3 one UPPER"), ("b", "idiot"), (None, "two")]
    asked = spark.createDataFrame(items, "item_id string, text string")
    assert set(ranked(docs, asked)) == plain_ranking(rows, items)
    assert ranked(empty, asked) == [] and ranked(docs, asked.where("false")) == []
    assert lexical.rank(docs, asked.where("false")).columns == lexical.rank(docs, asked).columns == ["item_id", "rank", "doc_id", "score"]


def test_terms_of_blocks(monkeypatch):
    texts = ["a-B c", None, "", "É漢字 x\x00y\x7fz", "ab" * 400 + " " + "q," * 300, "last"]
    seen = {}
    for size in (1 << 20, 16):
        monkeypatch.setattr(lexical, "BLOCK", size)
        got = [(row, h) for rows, hashes in lexical.term_rows(pa.array(texts)) for row, h in zip(rows.tolist(), hashes.tolist())]
        assert Counter(r for r, _ in got) == Counter({k: len(terms_of(t)) for k, t in enumerate(texts) if terms_of(t)})
        for (row, h), w in zip(got, [w for t in texts for w in terms_of(t)]):
            assert seen.setdefault(h, w) == w


def test_subtrees_are_left_out_and_bounds_hold():
    rng = np.random.default_rng(2)
    items = lexical.Items.of([(i, f"t{i}-{k}".replace("-", "x")) for i in range(20) for k in range(15)] + [(i, f"common{k}") for i in range(20) for k in range(3)])
    weight = rng.integers(500, 9000, len(items.terms))
    lists = [np.sort(rng.choice(len(items.terms), rng.integers(1, 12), replace=False)) for _ in range(3000)] + items.lists * 12
    lengths, t = np.array([len(x) for x in lists]), np.concatenate(lists)
    c = rng.integers(100_000, 900_000, len(t))
    search = lexical.Search(items, weight, np.ones(20, np.int64), 10)
    search.add(list(range(len(lists))), lengths, t, c)
    assert search.scored < 0.5 * search.leaves
    tree = lexical.Tree(lengths, t, c, np.sqrt(weight), items)
    bounds = tree.bounds(items, np.arange(20), np.sqrt(weight), items.norms(weight))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    scores = np.array([[sum(int(weight[a]) * int(v) for a, v in zip(t[starts[d]:starts[d + 1]], c[starts[d]:starts[d + 1]]) if a in own) for d in range(len(lists))]
                       for own in map(set, (x.tolist() for x in items.lists))])
    for node, (lo, hi, _) in enumerate(tree.nodes):
        assert (scores[:, tree.order[lo:hi]].max(1) <= bounds[node]).all()
    for i in range(20):
        best = sorted((-s, d) for d, s in enumerate(scores[i].tolist()) if s)[:10]
        assert [(s, d) for s, _, d in search.best[i]] == best


# ---- 13: spelling variants -------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            k = h % len(run)
            counts[run[:k] + run[k + 1:] if h % 199 == 0 else run] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [x for x in vocab if one_edit(w, x)] for w in vocab}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-vocab[x], x), default=None)
        form[w] = best if best is not None and vocab[best] >= 5 * vocab[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), vocab[w], len(near[w]), vocab[form[w]] if form[w] else None) for w in vocab}


def variants(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variant_groups(df).collect()}


def test_variants_equal_a_plain_version(spark):
    rnd = random.Random(7)
    letters = "abcdeéß×"
    stems = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(5, 12))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab", "x" * 300]

    def changed(w):
        k, c = rnd.randrange(len(w)), rnd.choice(letters)
        return rnd.choice([w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:], w + c])

    words = [(w, 400) for w in stems] + [(changed(w), rnd.choice([5, 20, 80])) for w in stems * 6] + [(changed(changed(w)), 6) for w in stems * 3]
    tokens = [rnd.choice([w, w.upper(), w.capitalize()]) if w.isascii() else w for w, n in words for _ in range(n)]
    rnd.shuffle(tokens)
    rows = [(k, rnd.choice([" ", ", ", "-", "1"]).join(tokens[k * 40:k * 40 + 40])) for k in range(len(tokens) // 40 + 1)]
    rows += [(None, "Nulled nulled NULLED nulled nulled"), (3, None), (4, ""), (4, "twice twice twicee twicee twicee")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got, expected = variants(df), plain_variants(rows)
    assert got == expected
    assert sum(r[1] is not None for r in got) > 50 and any(r[1] != r[2] for r in got if r[1])


def test_a_fuller_bitmap_changes_nothing(spark, docs, monkeypatch):
    digits = str.maketrans("0123456789", "aeioubcdfg")
    rows = [(r["doc_id"], r["text"] and r["text"].translate(digits).replace(" ", " stem")) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    expected = plain_variants(rows)
    assert variants(docs) == expected and len(expected) > 100
    monkeypatch.setattr(spelling, "MOST_BITS", 15)
    assert variants(docs) == expected


def test_neighbourhoods_hold_each_result_once():
    rnd = random.Random(3)
    for k in (2, 3, 8):
        for m in (1, 2, 5, 9):
            s = np.array([[rnd.randrange(1, k + 1) for _ in range(m)] for _ in range(6)], np.uint64)
            made = [(line, key) for lines, keys in spelling.neighbourhoods(s, k) for line, key in zip(lines.tolist(), keys.tolist())]
            assert len(made) == len(set(made))
            for line in range(6):
                w = s[line].tolist()
                whole = {tuple(w)} | {tuple(w[:i] + w[i + 1:]) for i in range(m)} | {
                    tuple(w[:i] + [c] + w[i + d:]) for i in range(m + 1) for c in range(1, k + 1) for d in (0, 1) if i + d <= m}
                keys = {int(spelling.reduced_keys(np.array([x], np.uint64))[0]) if x else 0 for x in whole}
                assert {key for at, key in made if at == line} == keys


def test_no_words_no_groups(spark, empty):
    assert variants(empty) == set()
    assert variants(spark.createDataFrame([(1, "short words only"), (2, None)], "doc_id long, text string")) == set()
