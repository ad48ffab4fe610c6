import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import chunks as C
from corpusloom.operators.ingest import build_chunks, compose_carries, pack_batches

SETTINGS = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXTS = st.lists(st.text(alphabet="aB. \n#!:1", max_size=120), min_size=1, max_size=30)


def chunked(spark, texts, make):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    return [r["r"] for r in df.select("id", make(F.col("text")).alias("r")).orderBy("id").collect()]


def windows(text, size, overlap):
    out, start = [], 0
    while start < len(text):
        out.append(text[start:start + size].strip())
        if start + size >= len(text):
            break
        start += size - overlap
    return [c for c in out if c]


@SETTINGS
@given(TEXTS)
def test_windows_match_a_plain_loop(spark, texts):
    assert chunked(spark, texts, lambda c: C.chunk_fixed(c, 20, 5)) == [windows(t, 20, 5) for t in texts]


def test_overlap_must_be_smaller():
    with pytest.raises(ValueError):
        C.chunk_fixed(F.lit("x"), 10, 10)


def test_headers(spark):
    text = "intro\n# A\na\n## B\nb\n### C\nc\n# D\n" + "d" * 25
    out = chunked(spark, [text, "", "plain", "x" * 20, "x" * 21], lambda c: C.chunk_by_headers(c, 20, 5))
    assert out[0] == ["intro", "# A\na", "## B\nb", "### C\nc", "# D\n" + "d" * 16, "d" * 14]
    assert out[1:] == [[], ["plain"], ["x" * 20], ["x" * 20, "x" * 6]]


@SETTINGS
@given(TEXTS)
def test_no_header_chunk_is_too_long(spark, texts):
    for text, chunks in zip(texts, chunked(spark, texts, lambda c: C.chunk_by_headers(c, 30, 4))):
        assert all(0 < len(c) <= 30 for c in chunks)
        assert set("".join(chunks)) == set(text) - set(" \n") | (set("".join(chunks)) & set(" \n"))


def fill(parts, glue, target):
    out, cur = [], ""
    for p in (p.strip() for p in parts):
        if not p:
            continue
        if cur and len(cur) + len(p) > target:
            out.append(cur)
            cur = p
        else:
            cur = cur + glue + p if cur else p
    return out + [cur] if cur else out


@SETTINGS
@given(TEXTS)
def test_fills_match_a_plain_loop(spark, texts):
    assert chunked(spark, texts, lambda c: C.split_sentences(c, 25)) == [
        fill(re.split(r"[.!?]+(?:\s+|$)", t), ". ", 25) for t in texts]
    assert chunked(spark, texts, lambda c: C.split_paragraphs(c, 25)) == [
        fill(re.split(r"\n\s*\n", t), "\n\n", 25) for t in texts]


@SETTINGS
@given(TEXTS)
def test_character_cuts_match_a_plain_loop(spark, texts):
    def cut(text, size):
        out, start = [], 0
        while start < len(text):
            end = start + size
            if end < len(text):
                while end > start and text[end] not in " \n\t":
                    end -= 1
                end = end if end > start else start + size
            out.append(text[start:end].strip())
            start = end
        return [c for c in out if c]

    assert chunked(spark, texts, lambda c: C.split_chars(c, 10)) == [cut(t, 10) for t in texts]


def test_sections(spark):
    a, b, c = "a" * 400, "b" * 500, "c" * 600
    text = f"{a}\n# One\n{b}\n## Two\n{c}"
    # section 0: up to header 1; the last one: from header 1 to the end, header 2 included
    assert chunked(spark, [text], C.split_sections) == [[a, f"{b}\n## Two\n{c}"]]
    assert chunked(spark, ["\n# One\nx", "no header"], C.split_sections) == [[], []]
    numbered = f"{a}\n1. First part\n{b}\n2. Second part\n{c}"
    assert chunked(spark, [numbered], C.split_sections) == [[a, f"{b}\n2. Second part\n{c}"]]
    titled = f"{a}\nTitle:\n{b}.\nOther title: \n{c}"  # a title may not span a full stop
    assert len(chunked(spark, [titled], C.split_sections)[0]) == 2
    caps = f"{a}\nSECTION HEADING ONE\n{b}\nSECTION HEADING TWO\n{c}"
    assert len(chunked(spark, [caps], C.split_sections)[0]) == 2


def test_sections_lose_no_text(spark):
    import random

    rnd = random.Random(1)
    for _ in range(20):
        parts = [rnd.choice("abcde") * rnd.choice([5, 100, 290, 400, 1700, 1900, 5000]) for _ in range(rnd.randint(3, 7))]
        text = "".join(f"{p}\n# H{i}\n" for i, p in enumerate(parts)) + "x" * 400
        found = chunked(spark, [text], C.split_sections)[0]
        whole = "".join("".join(found).split())
        if found:
            for p in parts:
                assert whole.count(p[0]) >= len(p)
            assert max(map(len, found)) <= 1800


def test_semantic_cascade(spark):
    sentences = " ".join(["Wort " * 30 + "Ende."] * 12)
    out = chunked(spark, ["kurz", sentences, "x" * 3000], C.chunk_semantic)
    assert (out[0].chunk_type, out[0].texts) == ("complete", ["kurz"])
    # one paragraph is one paragraph group, however long it is
    assert out[1].chunk_type == "paragraph_group" and len(out[1].texts) == 1
    assert out[2].texts == ["x" * 3000]
    paragraphs = "\n\n".join(["p" * 700] * 4)
    r = chunked(spark, [paragraphs], C.chunk_semantic)[0]
    assert r.chunk_type == "paragraph_group" and r.texts == ["p" * 700] + ["p" * 150 + " " + "p" * 700] * 3


def test_overlap(spark):
    df = spark.createDataFrame([(["one two three", "next", "last"],)], "cs array<string>")
    assert df.select(C.overlap_chunks(F.col("cs"), 7).alias("r")).first()["r"] == ["one two three", "three next", "next last"]


def test_chunk_rows(spark):
    df = spark.createDataFrame([("https://a.b/c", "# A\nx y\n# B\nz")], "url string, markdown string")
    out = [tuple(r) for r in build_chunks(df).orderBy("chunk_index").collect()]
    assert out == [
        ("doc_https://a.b/c_0", "https://a.b/c", 0, 2, "# A\nx y", "# A", 7, 4),
        ("doc_https://a.b/c_1", "https://a.b/c", 1, 2, "# B\nz", "# B", 5, 3),
    ]


def test_carry_maps_compose():
    import random

    rnd, budget = random.Random(3), 20

    def fill(tokens, carry):
        closed = 0
        for t in tokens:
            closed, carry = (closed + 1, t) if carry + t > budget else (closed, carry + t)
        return closed, carry

    def intervals(tokens):
        out = []
        for carry in range(budget + 1):
            closed, used = fill(tokens, carry)
            row = (True, 0, used - carry) if not closed else (False, closed, used)
            if out and out[-1][2:] == row:
                out[-1] = (out[-1][0], carry, *row)
            else:
                out.append((carry, carry, *row))
        return out

    for _ in range(300):
        a, b, c = ([rnd.randint(0, 9) for _ in range(rnd.randint(1, 6))] for _ in range(3))
        left = compose_carries(compose_carries(intervals(a), intervals(b)), intervals(c))
        assert left == compose_carries(intervals(a), compose_carries(intervals(b), intervals(c))) == intervals(a + b + c)


@pytest.mark.parametrize("parts, fan_in", [("1", 32), ("3", 2), ("8", 32), ("20", 3)])
def test_batches_equal_greedy_for_any_partitioning(spark, parts, fan_in):
    import random

    rnd = random.Random(5)
    rows = [("hot" if rnd.random() < 0.7 else f"g{i % 3}", i, "x" * rnd.choice([0, 1, 30, 90, 299, 300, 301])) for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(rows, "g string, i int, content string")
        got = {r.i: r.batch_no for r in pack_batches(df, "g", "i", budget=100, fan_in=fan_in).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, state = {}, {}
    assert len(got) == len(rows)
    for g, i, text in rows:
        tokens = max(1, len(text) // 3) if text else 0
        batch, used = state.get(g, (0, 0))
        tokens = min(tokens, 100)  # a larger text fills a batch of its own
        if used and used + tokens > 100:
            batch, used = batch + 1, 0
        want[i] = batch
        state[g] = (batch, used + tokens)
    assert got == want
