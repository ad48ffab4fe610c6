import hashlib
import os
import random
import sys
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from helpers import SCHEMA, WORD, awkward, groups, lined, prose  # noqa: E402

from corpusloom.llm import decontaminate, licenses, lines, mixing, ngram_join, substrings, tokens, toxicity, words  # noqa: E402


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(spark, texts):
    return spark.createDataFrame(list(texts), "doc_id long, text string").repartition(4)


# ---- words -------------------------------------------------------------------


def test_equal_words_have_equal_hashes_and_others_differ():
    text = "orhe heor orhe\x0b heor é É a\tb  c \x1c x\x00y 漢字 " + "z" * 5000 + " " + "z" * 5001
    for lower in (False, True):
        starts, hashes = words.text_words(np.frombuffer(text.encode(), np.uint8), lower)
        expected = WORD.findall(text)
        assert len(hashes) == len(expected)
        table = {}
        for w, h in zip(expected, hashes.tolist()):
            assert table.setdefault(h, w) == w
        assert len(table) == len(set(expected))


def test_blocks_do_not_change_hashes(monkeypatch):
    import pyarrow as pa

    column = pa.array([prose(k, 50) for k in range(20)] + [None, "", prose(99, 3000)])

    def all_words():
        return [(d, h) for *_, doc, start, hashes, raw in words.word_blocks(column) for d, h in zip(doc.tolist(), hashes.tolist())]

    whole = all_words()
    monkeypatch.setattr(words, "BLOCK", 64)
    assert all_words() == whole
    assert Counter(d for d, _ in whole) == Counter({**{k: 50 for k in range(20)}, 22: 3000})


# ---- token counts ------------------------------------------------------------


def test_token_counts_equal_the_library(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, machine = Tokenizer.from_file(path), tokens.ByteBpe(path)
    rnd = random.Random(5)
    letters = "abcdeehello   \n\n\t'sre tll'dM 0123９é漢字ß😀  .,;!-_\x1c\x85​"
    parts = ["<|endoftext|>", " the ", "ing", "aaaa", "    ", "'ve", "\r\n"]
    for _ in range(2500):
        text = "".join(rnd.choice(letters) if rnd.random() < 0.7 else rnd.choice(parts) for _ in range(rnd.randint(0, 60)))
        monkeypatch.setattr(tokens, "CHUNK", rnd.choice([1, 2, 3, 5, 8, 16, 1 << 16]))
        assert machine.count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_transition_tables_may_start_anew(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    machine, small = tokens.ByteBpe(path), tokens.ByteBpe(path)
    texts = [prose(k, 30) + " antidisestablishmentarianism unbelievably" for k in range(20)]
    expected = [machine.count(t) for t in texts]
    monkeypatch.setattr(tokens, "MEMO", 3)
    assert [small.count(t) for t in texts] == expected


def test_token_counts_of_awkward_rows(docs, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    out = tokens.count_tokens(docs, path)
    assert set(out.columns) == set(docs.columns) - {"text"} | {"n_bytes", "n_tokens", "over_limit"}
    expected = Counter()
    for row in awkward():
        n = len(library.encode(row[1] or "", add_special_tokens=False).ids)
        expected[row[0], len((row[1] or "").encode()), n, n > 512, row[-2]] += 1
    assert Counter(map(tuple, out.select("doc_id", "n_bytes", "n_tokens", "over_limit", "`a.b`").collect())) == expected
    assert tokens.count_tokens(empty, path).count() == 0


# ---- repeated words ----------------------------------------------------------


def repeated(rows, length=20):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            key = tuple(w[k:k + length])
            if key in seen:
                gone[k:k + length] = [True] * length
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_repeated_words_equal_brute_force(spark):
    rnd, passage, rows = random.Random(3), prose(77, 55), []
    for k in range(60):
        w = prose(k, rnd.randint(5, 120)).split()
        for _ in range(rnd.randint(0, 2)):
            a = rnd.randint(0, 30)
            w[rnd.randint(0, len(w)):0] = passage.split()[a:a + rnd.randint(18, 30)]
        rows.append((k, " \n".join(w) if k % 2 else " ".join(w)))
    rows += [(60, rows[3][1]), (61, "a " * 70), (62, "b a " * 40), (63, passage + " " + passage)]
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.remove_repeats(pairs(spark, rows)).collect()}
    assert found == repeated(rows)
    assert sum(v[1] for v in found.values()) > 500


def test_repeated_words_of_awkward_rows(docs, empty):
    found = substrings.remove_repeats(docs).collect()
    expected = repeated({(r[0], r[1]) for r in awkward() if r[0] is not None})
    assert len(found) == len(awkward())
    for r in found:
        if r.doc_id is not None:
            assert (r.n_words, r.n_removed, r.kept_sha256) == expected[r.doc_id]
        else:
            assert r.n_removed == 0
    assert substrings.remove_repeats(empty).count() == 0


# ---- near copies -------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingled(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k:k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near(rows):
    sets = {i: shingled(t) for i, t in rows}

    def linked(a, b):
        common = len(sets[a] & sets[b])
        return common > 0 and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common)

    found = groups(sorted(sets), linked)
    return {i: (len(sets[i]), found[i]) for i in sets}


def test_ngram_join_equals_brute_force(spark):
    rnd, rows = random.Random(9), []
    bases = [prose(200 + k, rnd.randint(20, 160)).split() for k in range(8)]
    for k in range(150):
        w = list(rnd.choice(bases)) if k % 3 else prose(k, rnd.randint(1, 60)).split()
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(99)}"
        rows.append((k, " ".join(w).upper() if k % 7 == 0 else " ".join(w)))
    expected = near(rows)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_join(pairs(spark, rows)).collect()}
    assert found == expected
    assert len({c for _, c in expected.values()}) < 120


def test_a_chain_of_near_copies_is_one_component(spark):
    """Neighbours link, far ends do not: hubs alone would lose the links."""
    w = prose(5, 100).split()
    rows = []
    for k in range(12):
        rows.append((k, " ".join(w)))
        w[(k * 8 + 3) % 100] = f"new{k}"
        w[(k * 8 + 4) % 100] = f"new{k}b"
    assert {r.component_id for r in ngram_join.ngram_join(pairs(spark, rows), hub_rounds=1).collect()} == {0}
    assert near(rows)[11][1] == 0


def test_prefix_grows_with_the_cost_of_its_tokens():
    h = np.sort(np.random.default_rng(1).integers(0, 2**64, 100, dtype=np.uint64))
    quiet = np.full(1 << ngram_join.TABLE_BITS, 5)
    assert ngram_join.prefix(h, quiet, 5.0)[0] == 1
    busy = quiet.copy()
    busy[(h >> np.uint64(64 - ngram_join.TABLE_BITS)).astype(int)] = 5000
    matches, chosen = ngram_join.prefix(h, busy, 5.0)
    assert matches > 1 and len(chosen) == 20 + matches


def test_ngram_join_of_awkward_rows(docs, empty):
    rows = {(r[0], r[1]) for r in awkward() if r[0] is not None}
    expected = near(rows)
    found = ngram_join.ngram_join(docs).collect()
    assert len(found) == len(awkward())
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id]
    assert ngram_join.ngram_join(empty).count() == 0



def test_candidates_of_large_groups_grow_with_the_documents(spark, monkeypatch):
    """Exact copies, near copies that are far from each other, a common line and a common passage, all at once."""
    made = []
    plain = ngram_join._matched
    monkeypatch.setattr(ngram_join, "_matched", lambda found, postings: made.append(found.count()) or plain(found, postings))

    def family(size):
        rnd = random.Random(size)
        base, passage, line = prose(11, 400).split(), prose(12, 60), prose(13, 12)

        def near(k):
            words = list(base)
            for at in rnd.sample(range(400), 6):
                words[at] = f"own{k}x{at}"
            return " ".join(words)

        texts = [" ".join(base)] + [near(k) for k in range(size)] + [" ".join(base)] * (size // 2)
        texts += [f"{prose(k, 6)} {passage}" for k in range(size)] + [f"{prose(-k, 30)} {line}" for k in range(size)]
        return list(enumerate(texts))

    totals = []
    for size in (100, 200):
        made.clear()
        rows = family(size)
        got = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_join(pairs(spark, rows)).collect()}
        sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.lower().split()]}

        def linked(a, b):
            common = len(sets[a] & sets[b])
            return 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common)

        assert got == groups(list(sets), linked)
        totals.append(sum(made))
    assert totals[1] < 2.6 * totals[0] and totals[1] < 3 * len(rows)

# ---- lines -------------------------------------------------------------------


def test_patience_blocks_are_equal_lines_in_order():
    rnd = random.Random(4)
    for _ in range(300):
        a = [rnd.randrange(8) for _ in range(rnd.randint(0, 14))]
        b = [rnd.randrange(8) for _ in range(rnd.randint(0, 14))]
        blocks = lines.patience(a, b)
        for (i, j, n), after in zip(blocks, [*blocks[1:], (99, 99, 0)]):
            assert a[i:i + n] == b[j:j + n] and i + n <= after[0] and j + n <= after[1]
    a = list(range(30))
    assert lines.patience(a, a) == [(0, 0, 30)]
    assert lines.patience(a, [99, *a[5:20], 98, *a[22:]]) == [(5, 1, 15), (22, 17, 8)]


def test_lines_shared_with_an_earlier_document_go(spark):
    first, other = lined(prose(1, 120)).split("\n"), lined(prose(2, 120)).split("\n")
    rows = [(1, "\n".join(first)), (2, "\n".join(other[:5] + first[2:6] + other[5:])), (3, "\n".join(other)), (4, lined(prose(3, 60))),
            (5, "\n".join(first)), (6, "short line\n" + "\n".join(lined(prose(6, 36)).split("\n"))), (7, "short line\n" + lined(prose(7, 36)))]
    found = {r.doc_id: r for r in lines.dedup_lines(pairs(spark, rows)).collect()}
    assert found[1].text == rows[0][1] and found[1].n_removed == 0
    assert found[2].text == "\n".join(other) and found[2].n_removed == 4
    assert found[3].text == "" and found[3].n_removed == 10  # all of it is in document 2
    assert found[4].text == rows[3][1]
    assert found[5].text == "" and found[5].n_removed == 10
    assert found[6].text == rows[5][1] and found[7].text == rows[6][1]  # too few words to be a passage


def test_a_line_of_many_documents_goes_from_all_but_the_first(spark):
    hot = "this line of more than ten words is held by very many documents here"
    rows = [(k, prose(k, 30) + "\n" + hot + "\n" + prose(1000 + k, 30)) for k in range(200)]
    found = {r.doc_id: r.text for r in lines.dedup_lines(pairs(spark, rows), rare=20).collect()}
    assert [k for k, t in found.items() if hot in t] == [0]
    assert all(len(t.split("\n")) == 2 for k, t in found.items() if k)


def test_a_frequent_passage_goes_beside_a_rarer_shared_line(spark):
    hot = "this passage of more than ten words is held by very many documents here"
    rows = [(k, prose(k, 30) + "\n" + hot) for k in range(100)]
    rows += [(200, "rare heading\n" + prose(200, 30)), (201, "rare heading\n" + prose(201, 30) + "\n" + hot + "\n" + prose(202, 30))]
    found = {r.doc_id: r.text for r in lines.dedup_lines(pairs(spark, rows), rare=20).collect()}
    assert found[201] == "rare heading\n" + prose(201, 30) + "\n" + prose(202, 30) and found[200] == rows[100][1]


def test_repeated_passages_and_blocks_of_short_lines_go(spark):
    twice = prose(1, 14)
    short = [prose(10 + k, 4) for k in range(6)]
    rows = [(1, f"{prose(2, 30)}\n{twice}\n{prose(3, 30)}\n{twice}\n{prose(4, 30)}"),
            (2, f"{prose(5, 30)}\n{twice}\n{prose(6, 30)}\n{twice}\n{prose(7, 30)}"),
            *[(3 + k, prose(20 + k, 30) + "\n" + x) for k, x in enumerate(short)],  # each line first stands alone
            (10, "\n".join([prose(30, 30), *short, prose(31, 30)])), (11, "\n".join([prose(32, 30), *short, prose(33, 30)]))]
    found = {r.doc_id: r.text for r in lines.dedup_lines(pairs(spark, rows)).collect()}
    assert found[1] == rows[0][1] and found[10] == dict(rows)[10]
    assert found[2] == f"{prose(5, 30)}\n{prose(6, 30)}\n{prose(7, 30)}"
    assert found[11] == prose(32, 30) + "\n" + prose(33, 30)


def test_runs_cover_what_earlier_texts_hold():
    rnd = random.Random(8)
    for _ in range(300):
        texts = [[rnd.randrange(6) for _ in range(rnd.randint(0, 12))] for _ in range(2)]
        size = [0, 1, 2, 3, 5, 11]  # words of a line
        flat, doc = np.array(sum(texts, [])), np.repeat([0, 1], [len(t) for t in texts])
        a, e = lines.run_spans(np.array([size[x] for x in flat], np.int64), doc, 10)
        held = {tuple(flat[i:j]) for i, j in zip(a, e) if doc[i] == 0}
        base = len(texts[0])
        found = {k - base for i, j in zip(a, e) if doc[i] == 1 and tuple(flat[i:j]) in held for k in range(i, j)}
        first, mine = texts
        expected = {k for i in range(len(mine)) for j in range(i + 1, len(mine) + 1) if sum(size[x] for x in mine[i:j]) >= 10
                    and any(first[p:p + j - i] == mine[i:j] for p in range(len(first))) for k in range(i, j)}
        assert found == expected


def test_lines_of_awkward_rows(docs, empty):
    found = lines.dedup_lines(docs).collect()
    assert len(found) == len(awkward())
    by = {}
    for r in found:
        by.setdefault(r.doc_id, r)
    assert by[4].text is None and by[4].n_lines == 0 and by[5].text == "" and by[6].text == " \n\t "
    assert by[1].text == "" and by[0].text == awkward()[0][1] and by[9].text == awkward()[10][1]
    assert by[10].text == lined(prose(4, 60)) and by[0]["a.b"] == "ab" and by[0]._id == "i"
    assert Counter(r.text for r in found if r.doc_id == 3) == {lined(prose(3, 90)): 2}
    assert all(r.n_removed == 0 for r in found if r.doc_id is None)
    assert lines.dedup_lines(empty).count() == 0


# ---- mixing ------------------------------------------------------------------


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else share[s] for s in names}
        capped |= over


def test_targets_and_copies(spark):
    rnd = random.Random(8)
    rows = [(k, prose(k, rnd.randint(1, 40)), rnd.choice(["b", "a", "é", None, "zz", "Z"]) if k % 40 else "tiny") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    expected = plain_targets(sizes)
    out = mixing.mix(docs).collect()
    taken = Counter()
    for r in out:
        rate = min(3, expected[r.source] / sizes[r.source])
        assert abs(r._target - expected[r.source]) < 1e-6 and r._source_size == sizes[r.source]
        assert r._copies in (int(rate), int(rate) + 1) and r._copies <= 3
        taken[r.source] += r._copies * r._size
    for s, t in expected.items():
        assert abs(taken[s] - t) < 0.15 * t
    again = {r.doc_id: r._copies for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r._copies for r in out}
    emitted = mixing.emit(mixing.mix(docs))
    assert emitted.count() == sum(again.values()) and emitted.groupBy("doc_id", "copy").count().where("count > 1").isEmpty()


def test_mix_of_awkward_rows(docs, empty, spark):
    out = mixing.mix(docs).collect()
    assert len(out) == len(awkward())
    assert all(r._size == 0 for r in out if not (r.text or "").strip())
    assert {r._source_size for r in out if r.source is None} == {sum(len(WORD.findall(r[1] or "")) for r in awkward() if r[3] is None)}
    assert mixing.emit(mixing.mix(empty)).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r._copies for r in mixing.mix(blank).collect()] == [0, 0]


def test_rows_without_an_id_draw_for_themselves_in_the_query(spark, folder):
    from corpusloom.llm import queries

    rows = [(None, f"{prose(k, 9)}", "a") for k in range(400)] + [(k, prose(k, 9), "b") for k in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{folder}/documents.parquet")
    taken = Counter(r.taken for r in queries.op8_mix_sources(spark, folder).where("doc_id is null").collect())
    assert len(taken) == 2 and min(taken.values()) > 50  # one text's draw isn't the other's, though all have nine words


# ---- toxicity ----------------------------------------------------------------


def test_grammar_tells_clauses_apart():
    g = toxicity.Grammar({"idiot$": 5.0, "vequ": 4.0})
    f = dict(zip(toxicity.FEATURES, g.features("What an idiot.")))
    assert f["plain"] > 0 and f["aimed"] == f["negated"] == f["reported"] == 0
    assert dict(zip(toxicity.FEATURES, g.features("You idiot!")))["aimed"] > 0
    assert dict(zip(toxicity.FEATURES, g.features("He is not an idiot, no.")))["negated"] > 0
    assert dict(zip(toxicity.FEATURES, g.features("The paper wrote: “an idiot” yesterday.")))["reported"] > 0
    assert dict(zip(toxicity.FEATURES, g.features("You there, kill time?")))["threats"] == 1
    assert dict(zip(toxicity.FEATURES, g.features("They kill.")))["threats"] == 1
    assert dict(zip(toxicity.FEATURES, g.features("Kill time.")))["threats"] == 0
    assert dict(zip(toxicity.FEATURES, g.features("xx vequabc yy")))["most"] == 4.0
    assert g.features(None) == g.features("") == g.features("all clean here") == [0.0] * len(toxicity.FEATURES)


@pytest.fixture(scope="module")
def labelled(spark):
    rnd, rows = random.Random(2), []
    for k in range(900):
        w = [f"w{rnd.randrange(300)}" for _ in range(60)]
        w = ["".join(chr(97 + int(c)) if c.isdigit() else c for c in x) for x in w]
        toxic = int(k % 5 == 0)
        for _ in range(4 * toxic):
            w[rnd.randrange(60)] = rnd.choice(["moron", "scumbag", "vequ" + chr(97 + rnd.randrange(26)) + "x"])
        rows.append((k, " ".join(w), toxic))
    return rows


def test_held_out_accuracy(spark, labelled):
    docs = spark.createDataFrame([r[:2] for r in labelled], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in labelled], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    out = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    import zlib

    truth = {r[0]: r[2] for r in labelled}
    held = [r for r in out if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out) and len(held) > 100
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)


def test_scores_of_awkward_rows(spark, docs, empty, labelled):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none)
    out = toxicity.score(docs, model)
    assert out.count() == len(awkward()) and out.where("predicted <> 0").isEmpty() and "text" not in out.columns
    assert out.where("score is null").isEmpty()
    odd = spark.createDataFrame([(0, 1), (0, None), (None, 1), (2, 0), (99, 1)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, odd)).count() == len(awkward())
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == 0


# ---- licenses ----------------------------------------------------------------


def test_licenses_are_found_where_they_stand(spark):
    mit, line = licenses.TEMPLATES[3][1], licenses.TEMPLATES[0][1]
    rows = [(k, f"{prose(k, 13 * k)} {mit if k % 2 else line} {prose(50 + k, 40)}") for k in range(1, 12)]
    rows.append((20, f"{line}\n{prose(3, 9)}\n{line.upper()} {prose(4, 700)} {line}"))
    rows.append((21, prose(5, 400)))
    cut = mit.split()
    cut[30] = "xx"
    rows.append((22, prose(6, 33) + " " + " ".join(cut)))
    rows.append((23, prose(6, 33) + " " + " ".join(mit.split()[:40])))
    found = Counter((r.doc_id, r.license, r.start, r.n_words) for r in licenses.scan(pairs(spark, rows)).collect())
    expected = Counter()
    for k in range(1, 12):
        expected[k, "mit-permission" if k % 2 else "apache-2.0-line", 13 * k, len((mit if k % 2 else line).split())] += 1
    for start in (0, 16, 723):
        expected[20, "apache-2.0-line", start, 7] += 1
    expected[22, "mit-permission", 33, len(cut)] += 1
    assert found == expected


def test_bands_meet_every_template_in_its_window():
    """The stated probability of a miss is 0.0001 a template; none is missed in any of these windows."""
    for name, text in licenses.TEMPLATES:
        h = words.text_words(np.frombuffer(text.encode(), np.uint8), True)[1]
        s = np.unique(words.sequences(h, licenses.SHINGLE))
        size = licenses._class(len(h))
        for shift in range(0, size, max(1, size // 7)):
            filler = np.random.default_rng(shift).integers(0, 2**63, shift + 3 * size, dtype=np.uint64)
            row = np.concatenate([filler[:shift], words.sequences(h, licenses.SHINGLE), filler[shift:]])
            assert licenses._hits(row, np.ones(len(row), bool), size, [licenses._signature(s)]), name


def test_licenses_of_awkward_rows(docs, empty):
    assert licenses.scan(docs).count() == 0 and licenses.scan(empty).count() == 0
    own = [("t", "same same same"), ("short", "one two")]
    assert {(r.doc_id, r.license) for r in licenses.scan(docs, own).collect()} == {(11, "t")}


# ---- decontamination ---------------------------------------------------------


def plain_tiles(doc, item, match):
    """Greedy string tiling by comparing all places."""
    marked_d, marked_i, out = set(), set(), 0
    while True:
        best, found = match - 1, []
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in marked_d and q + n not in marked_i:
                    n += 1
                if n > best:
                    best, found = n, [(p, q)]
                elif n == best and n >= match:
                    found.append((p, q))
        if best < match or not found:
            return out
        for p, q in sorted(found, key=lambda x: (x[1], x[0])):
            if all(p + k not in marked_d and q + k not in marked_i for k in range(best)):
                marked_d.update(range(p, p + best))
                marked_i.update(range(q, q + best))
                out += best


def test_tiling_equals_brute_force(spark):
    rnd = random.Random(6)
    items = [(k, prose(500 + k, rnd.randint(3, 60))) for k in range(12)]
    rows = []
    for k in range(80):
        item = rnd.choice(items)[1].split()
        cut = rnd.randint(0, len(item))
        kind = k % 4
        part = [item, item[cut:] + item[:cut], item[:cut], [x if rnd.random() > 0.1 else "zz" for x in item]][kind]
        w = prose(k, rnd.randint(0, 80)).split()
        at = rnd.randint(0, len(w))
        text = " ".join(w[:at] + part + w[at:])
        rows.append((k, text.upper() if k % 9 == 0 else text))
    expected = {}
    for i, text in rows:
        for j, item in items:
            d, t = text.lower().split(), item.lower().split()
            n = plain_tiles(d, t, min(5, len(t)))
            if n >= 0.5 * len(t):
                expected[i, j] = (len(t), n)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_WORDS, 100):
        found = {(r.doc_id, r.item_id): (r.n_words, r.covered) for r in decontaminate.contaminated(pairs(spark, rows), bench, block_words=block).collect()}
        assert found == expected
    assert len(expected) > 40
    left = {r.doc_id for r in decontaminate.decontaminate(pairs(spark, rows), bench).collect()}
    assert left == {k for k, _ in rows} - {i for i, _ in expected}


def test_decontamination_of_awkward_rows(spark, docs, empty):
    bench = spark.createDataFrame([(0, awkward()[3][1]), (1, None), (2, ""), (None, "x y z"), (3, "one two")], "item_id long, text string")
    out = decontaminate.contaminated(docs, bench).collect()
    assert Counter((r.doc_id, r.item_id) for r in out) == {(3, 0): 2, (7, 3): 1, (8, 3): 1}
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.count() == len(awkward()) - 4
    assert decontaminate.contaminated(empty, bench).count() == 0
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, nothing).count() == len(awkward())
