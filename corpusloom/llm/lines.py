"""Line deduplication by pairwise alignment.

Documents are paired through the rare lines they share: each later document with the first holder of a line. Pairs
are aligned by patience diff over line hashes, and what is aligned in blocks of enough words goes from the later one.
What the pairs leave (frequent lines, sections without unique lines, blocks whose lines first stand in different
documents, moved passages) is settled by a join over hashes of runs of lines: in the end every line goes that lies in
a run of lines of enough words which an earlier document holds. Exact copies of a whole text are settled by a digest
first.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import pack, saved, unpacked
from corpusloom.llm.words import mix, powers
from corpusloom.session import fits_broadcast

RARE = 50  # a line in at most so many documents pairs all its holders with the first one
MIN_WORDS = 10  # words that an aligned block must have to be deleted
ID_ROWS = 500_000  # ids that are broadcast at most (8 bytes each)
_STEP = powers(2)[1:]  # base of the run hashes, odd
_BACK = np.array([pow(int(_STEP[0]), -1, 2**64)], np.uint64)


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, lines: array of (h, words)); a line's hash ignores white space at its ends."""
    clean = F.transform(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    lines = F.transform(clean, lambda x: F.struct(
        F.xxhash64(x).alias("h"), F.when(x == "", 0).otherwise(F.size(F.split(x, r"[\x20\x09-\x0D]+"))).alias("words")))
    return docs.select("doc_id", F.md5(F.array_join(clean, "\n")).alias("digest"), lines.alias("lines"))


def patience(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """Aligned blocks (i, j, n) of equal lines of a and b, in order, by patience diff.

    Lines unique in both sides of a section are anchors; the longest increasing run of them splits the section, and
    sections are grown from their ends by equal lines. Sections wait on a stack, so depth is no matter. A section without
    an anchor is left to the join over runs (see `find_lines`).
    """
    pairs: list[tuple[int, int]] = []
    work = [(0, len(a), 0, len(b))]
    while work:
        i, m, j, n = work.pop()
        while i < m and j < n and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            pairs.append((m, n))
        if i >= m or j >= n:
            continue
        ca, cb = Counter(a[i:m]), Counter(b[j:n])
        where = {h: k for k, h in enumerate(b[j:n], j) if cb[h] == 1}
        anchors = [(k, where[h]) for k, h in enumerate(a[i:m], i) if ca[h] == 1 and h in where]
        if not anchors:
            continue
        # longest increasing run of the places in b
        tops: list[int] = []
        ends: list[int] = []
        before: list[int] = []
        for at, (_, q) in enumerate(anchors):
            k = bisect_left(tops, q)
            tops[k:k + 1] = [q]
            ends[k:k + 1] = [at]
            before.append(ends[k - 1] if k else -1)
        chain, at = [], ends[-1]
        while at >= 0:
            chain.append(anchors[at])
            at = before[at]
        chain.reverse()
        for (p, q), (p2, q2) in zip([(i - 1, j - 1), *chain], [*chain, (m, n)]):
            if p >= i:
                pairs.append((p, q))
            work.append((p + 1, p2, q + 1, q2))
    pairs.sort()
    blocks: list[list[int]] = []
    for i, j in pairs:
        if blocks and blocks[-1][0] + blocks[-1][2] == i and blocks[-1][1] + blocks[-1][2] == j:
            blocks[-1][2] += 1
        else:
            blocks.append([i, j, 1])
    return [tuple(x) for x in blocks]


def _aligned(pairs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, gone): line numbers to delete, from (doc_id, first_lines, lines)."""

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone = []
            for first, mine, words in zip(*(batch.column(k) for k in (1, 2, 3))):
                a, b, w = (x.values.to_pylist() for x in (first, mine, words))
                gone.append([q for _, j, n in patience(a, b) if sum(w[j:j + n]) >= min_words for q in range(j, j + n)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "gone"])

    return pairs.mapInArrow(aligned, "doc_id long, gone array<int>")


def run_spans(words: np.ndarray, doc: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the shortest runs of min_words words or more that start, or that end, at a line of one text.

    Any run of lines with so many words is the union of those inside it, so it is held where they all are.
    """
    total = np.append(0, np.cumsum(words))
    starts = np.arange(len(words))
    ends = np.searchsorted(total, total[:-1] + min_words, "left")
    first = np.searchsorted(doc, doc, "left")
    last = np.searchsorted(doc, doc, "right")
    begins = np.searchsorted(total, total[1:] - min_words, "right") - 1
    forward = ends <= last
    backward = (begins >= first) & (ends[np.maximum(begins, 0)] != starts + 1)
    return np.append(starts[forward], begins[backward]), np.append(ends[forward], starts[backward] + 1)


def _run_hashes(lines: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the lines start .. end - 1: a polynomial over line hashes, moved to place 0, and the length."""
    n = len(lines)
    up = np.multiply.accumulate(np.append(np.uint64(1), np.repeat(_STEP, n)))
    down = np.multiply.accumulate(np.append(np.uint64(1), np.repeat(_BACK, n)))
    total = np.append(np.uint64(0), np.cumsum(mix(lines) * up[:-1], dtype=np.uint64))
    return mix((total[end] - total[start]) * down[start] + mix((end - start).astype(np.uint64)))


def _runs(single: DataFrame, min_words: int) -> DataFrame:
    """(h, doc_id, start, n, open) from (doc_id, h, words, gone); runs are open if some of their lines isn't gone yet."""
    names = ["h", "doc_id", "start", "n", "open"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines, words, gone = (batch.column(k) for k in (1, 2, 3))
            base = np.append(0, np.cumsum(lines.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)))
            h = lines.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            w = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(batch)), np.diff(base))
            away = np.zeros(len(h) + 1, np.int64)
            cut = gone.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            away[1 + np.repeat(base[:-1], cut) + gone.flatten().to_numpy(zero_copy_only=False).astype(np.int64)] = 1
            away = np.cumsum(away)
            a, e = run_spans(w, doc, min_words)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_run_hashes(h, a, e).view(np.int64)), batch.column(0).take(pa.array(doc[a], pa.int64())), pa.array(a - base[doc[a]], pa.int32()),
                 pa.array(e - a, pa.int32()), pa.array(away[e] - away[a] < e - a)], names)

    return single.mapInArrow(hashed, "h long, doc_id long, start int, n int, open boolean")


def find_lines(docs: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(facts, gone): (doc_id, n_lines, copy) of every row, and (doc_id, gone) of documents that lose single lines.

    `copy` tells a text whose lines all equal those of a smaller doc_id and hold min_words words or more. Single lines
    go where they lie in a run of lines of min_words words or more that a smaller doc_id holds, each time they do.
    """
    rows = saved(profile(docs))
    total = F.aggregate("lines", F.lit(0), lambda s, x: s + x["words"])
    leads = rows.where("doc_id is not null and digest is not null").groupBy("digest").agg(F.min("doc_id").alias("first"))
    known = rows.join(leads, "digest", "left").withColumn("copy", F.coalesce(
        (F.col("doc_id") > F.col("first")) & (total >= min_words), F.lit(False)))
    known = saved(known)
    single = known.where("doc_id = first").groupBy("doc_id").agg(F.max_by("lines", "digest").alias("lines"))
    single = saved(single)
    held = single.select("doc_id", F.explode(F.array_distinct(F.transform(F.filter("lines", lambda x: x["words"] > 0), lambda x: x["h"]))).alias("h"))
    shared = held.groupBy("h").agg(F.count("*").alias("df"), F.min("doc_id").alias("first")).where("df > 1")
    # lines that few share pair all their holders; a document without such lines is paired by the rarest it has
    later = held.join(shared, "h").where("doc_id <> first").groupBy("doc_id", "first").agg(F.min("df").alias("df"))
    rarest = F.min(F.struct("df", "first")).over(Window.partitionBy("doc_id"))
    pairs = later.withColumn("_r", rarest).where((F.col("df") <= rare) | (F.col("first") == F.col("_r.first"))).select("doc_id", "first")
    pairs = saved(pairs)
    firsts = single.select(F.col("doc_id").alias("first"), F.col("lines.h").alias("first_lines"))
    both = pairs.join(firsts, "first").join(single.select("doc_id", F.col("lines.h").alias("mine"), F.col("lines.words").alias("words")), "doc_id")
    gone = _aligned(both.select("doc_id", "first_lines", "mine", "words"), min_words).where(F.size("gone") > 0)
    gone = saved(gone.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")))
    # runs of lines that an earlier document holds, whatever the pairs were
    runs = saved(_runs(single.join(gone, "doc_id", "left").select("doc_id", "lines.h", "lines.words", "gone"), min_words))
    held = runs.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "first")
    more = runs.where("open").join(held, "h").where("doc_id > first").groupBy("doc_id").agg(
        F.flatten(F.collect_list(F.sequence("start", F.col("start") + F.col("n") - 1))).alias("gone"))
    gone = saved(gone.unionByName(more).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone")))
    digests = known.where("doc_id = first").groupBy("doc_id").agg(F.max("digest").alias("digest"))
    facts = known.select("doc_id", "digest", F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"), "copy")
    return saved(facts), saved(gone.join(digests, "doc_id"))


def dedup_lines(docs: DataFrame, rare: int = RARE, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the text cut, and n_lines and n_removed of the text as it was.

    Null texts stay null, with no lines; an empty text is one empty line and stays. Rows repeated with the same id and
    text are one document and are cut alike; of different texts with one id one is compared, the others and rows
    without an id are kept whole. Extra columns pass through (n_lines and n_removed are replaced). An empty table
    gives an empty one.
    """
    facts, gone = find_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rare, min_words)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    out = pack(docs.select(*[f"`{c}`" for c in names]), "doc_id", "text")
    hit = saved(facts.where("copy").select("doc_id", "digest", F.lit(None).cast("array<int>").alias("gone")).distinct().unionByName(gone))
    small = fits_broadcast(hit, ID_ROWS)
    keys = hit.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"), F.col("gone").alias("_gone"), F.lit(True).alias("_hit"))
    clean = F.transform(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(" \t\r\x0b\x0c")))
    kept = F.filter(_lines(F.col("text")), lambda x, k: ~F.array_contains("_gone", k))
    ids = keys.select("_id").distinct()
    touched = out.join(F.broadcast(ids) if small else ids, F.col("doc_id").cast("long") == F.col("_id"), "left_semi")
    other = out.join(F.broadcast(ids) if small else ids, F.col("doc_id").cast("long") == F.col("_id"), "left_anti")
    touched = touched.withColumn("_d", F.md5(F.array_join(clean, "\n"))).join(
        keys, (F.col("doc_id").cast("long") == F.col("_id")) & (F.col("_d") == F.col("_digest")), "left")
    lines = F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).cast("long")
    whole = F.col("_hit").isNotNull() & F.col("_gone").isNull()
    cut = F.when(F.col("_hit").isNull(), F.col("text")).when(whole, F.lit("")).otherwise(F.array_join(kept, "\n"))
    touched = touched.select(
        "doc_id", cut.alias("text"), "_rest", lines.alias("n_lines"),
        F.when(F.col("_hit").isNull(), 0).when(whole, lines).otherwise(F.size("_gone")).cast("long").alias("n_removed"))
    whole_texts = other.select("doc_id", "text", "_rest", lines.alias("n_lines"), F.lit(0).cast("long").alias("n_removed"))
    return whole_texts.unionByName(touched).select(*unpacked(names, "doc_id", "text"), "n_lines", "n_removed")
