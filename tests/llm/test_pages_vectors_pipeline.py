import os
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import SCHEMA, WORD, awkward, groups, prose  # noqa: E402

import corpus_pipeline  # noqa: E402
from corpusloom.llm import extract, vectors  # noqa: E402
from corpusloom.llm.common import components  # noqa: E402


# ---- pages -------------------------------------------------------------------


def text_of(html):
    return [t for _, t, inside, outside in extract.parse(html) if t and not outside]


def test_blocks_of_a_page():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style></head><body class="home">
      <script>var t = "</p><p>no</p>";</script><header><p>site</p></header><nav><ul><li><a href="/x">menu</a></ul></nav>
      <!-- <p>hidden</p> --><div class="ad box">buy</div><div id='cookie-notice'>cookies</div>
      <article><header><h1>Head&amp;line</h1></header><p>One <b>bold</b>,
      two&nbsp;three<br>four<p>Five &lt;six&gt; <a href="a>b">link</a></p><ul><li>a<li>b</ul>
      <table><tr><td>c<td>d</table><aside>see also</aside><form>mail <input></form></article>
      <div class="comments"><p>first!</p></div><footer>&copy; 2020</footer></body></html>"""
    assert text_of(html) == ["Head&line", "One bold, two three four", "Five <six> link", "a", "b", "c", "d"]
    assert text_of("plain < text & more") == ["plain < text & more"]
    assert text_of("<p>a<script>never closed") == ["a"] and text_of("") == [] and text_of("<div") == []
    assert text_of("<main><div class='adapter'>kept</div></main>") == ["kept"]


def test_quotes_count_after_equals_and_names_inside_the_article_need_every_word():
    assert text_of("<p title=don't>It's main text one.</p><p>Two's</p>") == ["It's main text one.", "Two's"]
    assert text_of('<p title="5" tall">quoted</p>') == ["quoted"]
    assert text_of("<p title='a>b' data-x = \"c>d\" e=f/g=\"h\">text</p>") == ["text"]
    assert text_of('<p title="never closed>text</p>') == ["text"] and text_of("<p a= >x</p><p =>y</p>") == ["x", "y"]
    assert text_of('<div title="x class=ad">kept</div>') == ["kept"]
    inside = "".join(f"<div {name}>{k}</div>" for k, name in enumerate(
        ('class="related-work"', 'class="side-effects"', 'id="notice-of-intent"', 'class="ad-slot"', 'class="text comments"', "id=share-buttons-2")))
    assert text_of(f"<article>{inside}</article>") == ["0", "1", "2"] and text_of(inside) == []


def page(k, host, body, extra=""):
    return (k, f"https://{host}/p{k}", f"<html><body><nav>menu</nav><div class='content'>{extra}{body}</div><footer>f{k}</footer></body></html>")


def test_strings_of_a_template_go(spark):
    rows, expected = [], {}
    for k in range(12):
        body = [prose(k * 10 + j, 20) for j in range(3)]
        rows.append(page(k, "big.example", "".join(f"<p>{b}</p>" for b in body) + "<p>All rights are with us.</p>", "<h2>The Daily</h2>"))
        expected[k] = "\n".join(body)
    for k in range(12, 14):  # too few pages to tell
        rows.append(page(k, "small.example", f"<p>{prose(k, 9)}</p>", "<h2>Small</h2>"))
        expected[k] = "Small\n" + prose(k, 9)
    for k in range(14, 20):  # copies of one page
        rows.append(page(k, "copies.example", "<p>One article.</p><p>On all pages.</p>"))
        expected[k] = "One article.\nOn all pages."
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    found = {r.page_id: (r.text, r.n_chars) for r in extract.extract(df).collect()}
    assert found == {k: (t, len(t)) for k, t in expected.items()}


def test_classes_nest_in_a_template(spark):
    rows = [("h", f"<body><div><p>{prose(k, 5)}</p>{'<ul><li>x</li></ul>' if k < 2 else ''}</div></body>", k) for k in range(8)]
    found = extract.templates(spark.createDataFrame(rows, "host string, html string, page long"))
    tokens = {r.token: r["class"] for r in found.collect()}
    shared = [extract.token(p, "") for p in ("/body", "/body/div", "/body/div/p")]
    assert set(tokens) == set(shared) and len(set(tokens.values())) == 1


def test_each_layout_of_a_host_has_its_own_strings(spark):
    rows, expected = [], {}
    for k in range(30):  # three layouts, each on a third of the pages
        name = "abc"[k % 3]
        body = prose(500 + k, 20)
        rows.append(page(k, "layouts.example", f"<p>{body}</p>", f"<div class='layout-{name}'><p>Notice of layout {name}.</p></div>"))
        expected[k] = body
    found = {r.page_id: r.text for r in extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == expected
    assert text_of("<div class='content no-sidebar has-banner'><p>kept</p><div class='sidebar'>x</div></div>") == ["kept"]


def test_short_articles_lose_a_long_notice_and_copies_count_once(spark):
    notice, rows, expected = prose(600, 80), [], {}
    for k in range(8):
        rows.append(page(k, "short.example", f"<p>{prose(700 + k, 5)}</p><p>{notice}</p>"))
        expected[k] = prose(700 + k, 5)
    for k in range(8, 20):  # copies of one article beside others: no layout, no template
        body = "The copied article." if k < 14 else prose(800 + k, 9)
        rows.append(page(k, "mixed.example", f"<p>{body}</p><p>About us.</p>"))
        expected[k] = body
    rows += [rows[0], rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    found = Counter((r.page_id, r.text) for r in extract.extract(df).collect())
    assert found == Counter({(k, t): 3 if k == 0 else 1 for k, t in expected.items()})


def test_awkward_pages(spark):
    long = "<article><p>" + prose(1, 200_000) + "</p></article>"
    rows = [(1, "http://a.b/x", None, "t", 1), (2, None, "<p>x</p>", "t", 2), (2, None, "<p>x</p>", "t", 2), (None, "nonsense", "", None, None),
            (3, "http://a.b/y", long, "h", 3), (4, "http://é.b/ü", "<p>é漢😀</p>", "h", 4)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, _host long")
    out = extract.extract(df)
    assert out.columns == ["page_id", "url", "_host", "text", "n_chars"]
    found = Counter((r.page_id, r.text, r.n_chars, r._host) for r in out.collect())
    assert found == {(1, "", 0, 1): 1, (2, "x", 1, 2): 2, (None, "", 0, None): 1, (3, prose(1, 200_000), len(prose(1, 200_000)), 3): 1, (4, "é漢😀", 3, 4): 1}
    assert extract.extract(df.limit(0)).count() == 0


# ---- vectors -----------------------------------------------------------------


def plain_links(rows, threshold=0.93):
    good = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            good[i] = (label, len(v), x / np.linalg.norm(x))

    def linked(a, b):
        return good[a][:2] == good[b][:2] and good[a][2] @ good[b][2] >= threshold

    n = Counter(a for a in good for b in good if a != b and linked(a, b))
    return n, groups(sorted(good), linked)


def test_near_vectors_equal_brute_force(spark):
    rng, rows = np.random.default_rng(3), []
    centers = rng.standard_normal((6, 24))
    for k in range(420):
        v = rng.standard_normal(24) if k % 3 == 0 else centers[k % 6 if k % 2 else 0] + 0.12 * rng.standard_normal(24)
        rows.append((k, [float(x) for x in v.astype(np.float32)], 1 if k % 5 else 2))
    rows += [(1000 + k, rows[1][1], 1) for k in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    links, comps = plain_links(rows)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df).collect()}
    assert found == {i: (links[i], comps[i], comps[i] == i) for i in comps}
    assert max(links.values()) > 4 * vectors.NEIGHBOURS  # lists are saturated, counts are whole


def test_floats_at_the_threshold_are_compared_in_double_precision(spark):
    rng, rows, t = np.random.default_rng(17), [], 0.93
    for k in range(60):  # pairs turned until their cosine in doubles lies a hair above or below
        a = rng.standard_normal(24).astype(np.float32)
        b = rng.standard_normal(24)
        u = a.astype(float) / np.linalg.norm(a.astype(float))
        b -= (b @ u) * u
        w = t * u + np.sqrt(1 - t * t) * b / np.linalg.norm(b)
        rows += [(2 * k, [float(x) for x in a], k), (2 * k + 1, [float(x) for x in w.astype(np.float32)], k)]
    links, comps = plain_links(rows)
    near = [abs(float(np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y)) - t) for (_, x, _), (_, y, _) in zip(rows[::2], rows[1::2])]
    assert max(near) < 1e-6 and 10 < len(links) < 110
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    assert {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()} == {i: (links[i], comps[i]) for i in comps}


def clumps():
    """Two clumps of 60 vectors: every link across is weaker than 59 inside, so no list of 32 holds one."""
    rng, rows = np.random.default_rng(5), []
    angle = np.arccos(0.95)
    for k in range(120):
        center = np.zeros(24)
        center[0], center[1] = (1, 0) if k < 60 else (np.cos(angle), np.sin(angle))
        v = center + 0.006 * np.append([0, 0], rng.standard_normal(22))
        rows.append((k, [float(x) for x in v], 1))
    return rows


def test_links_between_saturated_groups_are_kept(spark, monkeypatch):
    rows = clumps()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    links, comps = plain_links(rows)
    assert set(comps.values()) == {0} and set(links.values()) == {119}
    # starts that show no pair across: the audit and the passes after it have to find them
    started = vectors._started
    monkeypatch.setattr(vectors, "_started", lambda nodes, seed: started(nodes, seed).where("(a < 60) = (b < 60)"))
    for block, attempts in ((2048, 3), (16, 1)):
        monkeypatch.setattr(vectors, "QUERY_BLOCK", block)
        monkeypatch.setattr(vectors, "ATTEMPTS", attempts)
        found = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(df).collect()}
        assert found == {i: (links[i], 0) for i in comps}


def test_a_forest_connects_what_is_linked():
    rng = np.random.default_rng(9)
    for n in (1, 2, 7, 40):
        for share in (0.0, 0.03, 0.2, 1.0):
            linked = rng.random((n, n)) < share
            linked |= linked.T
            np.fill_diagonal(linked, False)
            p, q = vectors._forest(linked)
            edges = {(int(min(x, y)), int(max(x, y))) for x, y in zip(p, q)}
            expected = groups(range(n), lambda a, b: linked[a, b])
            assert groups(range(n), lambda a, b: (a, b) in edges) == expected and len(edges) == n - len(set(expected.values()))


def test_awkward_vectors(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [float("inf"), 1.0], 1), (6, [None, 1.0], 1),
            (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [2.0, 0.001], 1), (10, [1.0, 0.0], 2), (11, [1.0, 0.0, 0.0], 1), (8, [1.0, 0.0], 1),
            (None, [1.0, 0.0], 1), (12, [1e300, 1e300], 1), (13, [1e-300, 1e-300], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, node string")
    found = Counter(tuple(r) for r in vectors.near_vectors(df).collect())
    expected = Counter({(i, 0, i, True): 1 for i in (1, 2, 3, 4, 5, 6, 7, 10, 11, None)})
    expected[8, 1, 8, True] = 2
    expected[9, 1, 8, False] = expected[12, 1, 12, True] = expected[13, 1, 12, False] = 1
    assert found == expected
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 60)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.node: r.component for r in components(df).collect()}
    assert found == {**{k: 0 for k in range(41)}, **{100 + k: 100 for k in range(60)}}


# ---- pipeline ----------------------------------------------------------------


@pytest.fixture()
def tables(spark, folder):
    docs = spark.createDataFrame(awkward(), SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, int(k == 12)) for k in range(20)], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(5, 40)), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_stages_keep_columns_and_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        assert stage(spark, docs.limit(0), tables).count() == 0
        if name == "lines":
            rows = {r.doc_id: r for r in out.collect()}
            assert 1 not in rows and rows[10].n_chars == len(rows[10].text) and rows[0].text == awkward()[0][1]
        if name == "near_copies":
            kept = Counter(r.doc_id for r in out.collect())
            assert kept[0] == 1 and kept[1] == kept[2] == kept[8] == kept[15] == 0 and kept[3] == 2 and kept[None] == 2
        if name == "benchmark":
            assert out.where("doc_id = 16").isEmpty() and out.count() == len(awkward()) - 1


def test_pipeline_runs(spark, tables):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    out = corpus_pipeline.run(spark, tables)
    rows = out.collect()
    assert rows and max(r.copy for r in rows) <= 3
    assert not {1, 8, 15, 16} & {r.doc_id for r in rows}
    assert all(WORD.findall(r.text or "") or r.copy <= 3 for r in rows)
