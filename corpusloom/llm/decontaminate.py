"""Benchmark decontamination by greedy string tiling.

Documents and test items meet through shared seeds, runs of `match` equal lower-cased words, by their Karp-Rabin
hashes. For each pair the longest common run whose words are still free on both sides is marked as a tile, again and
again until none of `match` words is left; tiles may come in any order, so a reordered passage is covered as well. A
document that covers the given share of an item's words holds the item.

The items are a query set against all documents: they go to the tasks in blocks of at most BLOCK_WORDS words.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import pack, unpacked
from corpusloom.llm.words import sequences, text_words, word_blocks
from corpusloom.session import with_position

MATCH = 5
COVERAGE = 0.5
BLOCK_WORDS = 1_000_000  # words of test items that a task holds at a time (about 30 MB of arrays)


def tiles(i: np.ndarray, j: np.ndarray, match: int) -> list[tuple[int, int, int]]:
    """Tiles (start in document, start in item, words) from the seed places (i, j) of one document and item."""
    order = np.lexsort((i, i - j))
    i, j = i[order], j[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] - j[1:] != i[:-1] - j[:-1]) | (i[1:] != i[:-1] + 1)
    at = np.flatnonzero(new)
    sizes = np.diff(np.append(at, len(i))) + match - 1
    heap = [(-int(n), int(j[k]), int(i[k])) for k, n in zip(at, sizes)]
    heapify(heap)
    taken_i: set[int] = set()
    taken_j: set[int] = set()
    out = []
    while heap:
        n, q, p = heappop(heap)
        n = -n
        free = [p + k not in taken_i and q + k not in taken_j for k in range(n)]
        if all(free):
            out.append((p, q, n))
            taken_i.update(range(p, p + n))
            taken_j.update(range(q, q + n))
            continue
        k = 0  # what is left free of it goes back as shorter runs
        while k < n:
            if not free[k]:
                k += 1
                continue
            end = k
            while end < n and free[end]:
                end += 1
            if end - k >= match:
                heappush(heap, (-(end - k), q + k, p + k))
            k = end
    return out


def _blocks(items: DataFrame, words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most `words` words (a longer item is a block of its own)."""
    n = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    placed = with_position(items.select("item_id", "text").where("item_id is not null and text is not null"), [F.col("item_id"), F.col("text")], "_p")
    sized = placed.withColumn("_n", n)
    block: list[tuple[int, str]] = []
    held = 0
    for row in sized.orderBy("_p").toLocalIterator():  # one partition of the query set at a time
        if block and held + row["_n"] > words:
            yield block
            block, held = [], 0
        block.append((row["item_id"], row["text"]))
        held += row["_n"]
    if block:
        yield block


def _tiled(docs: DataFrame, block: list[tuple[int, str]], match: int, coverage: float) -> DataFrame:
    hashes = [text_words(np.frombuffer(t.encode(), np.uint8), True)[1] for _, t in block]
    sizes = np.array([len(h) for h in hashes])
    seeds = [sequences(h, match) if len(h) >= match else sequences(h, len(h)) for h in hashes]
    owner = np.repeat(np.arange(len(block)), [len(s) for s in seeds])
    place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.empty(0, np.int64)
    flat = np.concatenate(seeds) if seeds else np.empty(0, np.uint64)
    order = np.argsort(flat, kind="stable")
    short = sorted({int(n) for n in sizes if 0 < n < match})
    names = ["doc_id", "item_id", "n_words", "covered", "n_tiles"]
    shared = docs.sparkSession.sparkContext.broadcast(
        (flat[order], owner[order], place[order], sizes, np.array([k for k, _ in block], np.int64), short))  # a bounded block

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, whose, where, size, ids, lengths = shared.value
        # the low bits of the seeds: most words of a document are settled by one look into it
        bits = np.zeros(1 << 22, bool)
        bits[(seed & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for batch in batches:
            out = []
            for first, last, doc, _, h, _ in word_blocks(batch.column(1), True):
                for length in (match, *lengths):  # items of fewer words than a seed are met by all their words
                    run = sequences(h, length)
                    if not len(run):
                        continue
                    maybe = np.flatnonzero(bits[(run & np.uint64((1 << 22) - 1)).astype(np.int64)])
                    maybe = maybe[doc[maybe] == doc[maybe + length - 1]]
                    lo, hi = np.searchsorted(seed, run[maybe], "left"), np.searchsorted(seed, run[maybe], "right")
                    hit = hi > lo
                    at, lo, hi = maybe[hit], lo[hit], hi[hit]
                    if not len(at):
                        continue
                    n = hi - lo
                    k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    i, item, j = np.repeat(at, n), whose[k], where[k]
                    fits = size[item] >= match if length == match else size[item] == length
                    i, item, j = i[fits], item[fits], j[fits]
                    row = doc[i]
                    order = np.lexsort((item, row))
                    i, item, j, row = i[order], item[order], j[order], row[order]
                    cut = np.flatnonzero((row[1:] != row[:-1]) | (item[1:] != item[:-1])) + 1
                    for a, b in zip([0, *cut], [*cut, len(row)]):
                        if a == b:
                            continue
                        whole = int(size[item[a]])
                        if len(np.unique(j[a:b])) * length < coverage * whole:
                            continue  # seeds cover `length` words each at most
                        found = tiles(i[a:b], j[a:b], length)
                        covered = sum(t[2] for t in found)
                        if covered >= coverage * whole:
                            out.append((int(row[a]), int(ids[item[a]]), whole, covered, len(found)))
            r, item, whole, covered, n = zip(*out) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(r, pa.int64())), *[pa.array(c, pa.int64()) for c in (item, whole, covered, n)]], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tiled, ", ".join(f"{c} long" for c in names))


def contaminated(docs: DataFrame, items: DataFrame, match: int = MATCH, coverage: float = COVERAGE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words, covered, n_tiles, coverage): one row per document and item that it holds.

    Items without words, and null and empty texts, match nothing; an item of fewer words than a seed is held where all
    its words follow each other. Repeated rows (or ids) give repeated pairs; a null doc_id is kept as null. Empty tables give an
    empty result; other columns are ignored.
    """
    out = None
    for block in _blocks(items, block_words):
        part = _tiled(docs, block, match, coverage)
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_words long, covered long, n_tiles long")
    return out.withColumn("coverage", F.col("covered") / F.col("n_words"))


def decontaminate(docs: DataFrame, items: DataFrame, match: int = MATCH, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs that hold no item; rows without a doc_id are told by their own text, too."""
    packed = pack(docs, "doc_id", "text")
    keyed = packed.withColumn("_row", F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id")))
    bad = contaminated(keyed.select(F.col("_row").alias("doc_id"), "text"), items, match, coverage)
    left = keyed.join(bad.select(F.col("doc_id").alias("_row")).distinct(), "_row", "left_anti")
    return left.select(*unpacked(docs.columns, "doc_id", "text"))
