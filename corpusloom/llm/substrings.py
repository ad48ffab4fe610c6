"""Repeated word windows, found by one step of doubling, from half of the length to all of it.

The first level looks at windows of half the length: of every full window the half-length window with the least
hash stands for it, so equal full windows have equal stand-ins and about one position in six is looked at. Only
full windows whose stand-in is repeated are candidates of the second and last level, and those repeated there are the
result. No row is cut at either level.

A window that occurs twice among the texts of one batch is known to be repeated without a shuffle, and only its first
occurrence is sent on: a passage that a third of all texts share reaches its reducer as one row per batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import saved
from corpusloom.llm.words import sequences, word_blocks
from corpusloom.session import fits_broadcast

LENGTH = 20
ID_ROWS = 500_000  # ids that are broadcast at most (8 bytes each)
EMPTY = hashlib.sha256(b"").hexdigest()


def _profile(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, sha) of the whole texts."""

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "sha"])

    return docs.mapInArrow(profiled, "doc_id long, n_words long, sha string")


def _stand_ins(hashes: np.ndarray, doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stand-in's start) of every full window inside one text, and the hashes of all half windows."""
    half = length // 2
    h = sequences(hashes, half)
    if len(hashes) < length:
        return np.empty(0, np.int64), np.empty(0, np.int64), h
    least = np.lib.stride_tricks.sliding_window_view(h, length - half + 1).argmin(axis=1)
    starts = np.flatnonzero(doc[:len(least)] == doc[length - 1:length - 1 + len(least)])
    return starts, starts + least[starts], h


def _first_words(doc: np.ndarray, first: int, last: int) -> np.ndarray:
    return np.searchsorted(doc, np.arange(first, last + 1))


def _half_windows(docs: DataFrame, length: int) -> DataFrame:
    """(token, known, doc_id, place): stand-ins; known rows are repeated for certain and aren't counted again."""
    names = ["token", "known", "doc_id", "place"]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, tokens = [], [], []
            for first, last, doc, _, hashes, _ in word_blocks(batch.column(1)):
                _, at, h = _stand_ins(hashes, doc, length)
                at = np.unique(at)
                base = _first_words(doc, first, last)
                rows.append(doc[at])
                places.append(at - base[doc[at] - first])
                tokens.append(h[at])
            if not rows:
                continue
            rows, places, tokens = map(np.concatenate, (rows, places, tokens))
            order = np.argsort(tokens, kind="stable")
            rows, places, tokens = rows[order], places[order], tokens[order]
            same = np.zeros(len(tokens), bool)
            same[1:] = tokens[1:] == tokens[:-1]  # later occurrences in this batch
            first_of = np.zeros(len(tokens), bool)
            first_of[:-1] = same[1:]
            first_of &= ~same
            # 0: to be counted; 1: repeated, and to be counted for others; 2: repeated
            known = np.where(same, 2, np.where(first_of, 1, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens.view(np.int64)), pa.array(known, pa.int32()), batch.column(0).take(pa.array(rows)), pa.array(places, pa.int32())], names)

    return docs.mapInArrow(marked, "token long, known int, doc_id long, place int")


def _full_windows(docs: DataFrame, length: int) -> DataFrame:
    """(token, doc_id, start, n) from (doc_id, text, places): full windows whose stand-in is at one of the places.

    Rows without a token are runs of n windows that start earlier in the same batch as well.
    """
    names = ["token", "doc_id", "start", "n"]

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            flat = batch.column(2).values.to_numpy(zero_copy_only=False) if len(batch) else np.empty(0)
            offsets = batch.column(2).offsets.to_numpy()
            docs_, starts_, tokens_ = [], [], []
            for first, last, doc, _, hashes, _ in word_blocks(batch.column(1)):
                start, at, _ = _stand_ins(hashes, doc, length)
                base = _first_words(doc, first, last)
                wanted = np.zeros(len(hashes) + 1, bool)
                for row in range(first, last):
                    wanted[base[row - first] + flat[offsets[row]:offsets[row + 1]].astype(np.int64)] = True
                start = start[wanted[at]]
                docs_.append(doc[start])
                starts_.append(start - base[doc[start] - first])
                tokens_.append(sequences(hashes, length)[start])
            if not docs_:
                continue
            rows, starts, tokens = map(np.concatenate, (docs_, starts_, tokens_))
            owner = ids[rows]
            order = np.lexsort((starts, owner, tokens))
            rows, owner, starts, tokens = rows[order], owner[order], starts[order], tokens[order]
            later = np.zeros(len(tokens), bool)
            later[1:] = (tokens[1:] == tokens[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[~later].view(np.int64)), pa.array(owner[~later]), pa.array(starts[~later], pa.int32()),
                 pa.array(np.ones((~later).sum()), pa.int32())], names)
            o, s = owner[later], starts[later]
            order = np.lexsort((s, o))
            o, s = o[order], s[order]
            if len(o):
                new = np.ones(len(o), bool)
                new[1:] = (o[1:] != o[:-1]) | (s[1:] != s[:-1] + 1)
                at = np.flatnonzero(new)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(at), pa.int64()), pa.array(o[at]), pa.array(s[at], pa.int32()),
                     pa.array(np.diff(np.append(at, len(o))), pa.int32())], names)

    return docs.mapInArrow(hashed, "token long, doc_id long, start int, n int")


def _cut(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, n_removed, kept_sha256) from (doc_id, text, starts, counts)."""
    names = ["doc_id", "n_removed", "kept_sha256"]

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut, sha = [], []
            for text, starts, counts in zip(batch.column(1), batch.column(2), batch.column(3)):
                words = text.as_py().encode().split()
                edges = np.zeros(len(words) + 1, np.int64)
                a = starts.values.to_numpy().astype(np.int64)
                np.add.at(edges, a, 1)
                np.add.at(edges, a + counts.values.to_numpy() + length - 1, -1)
                gone = np.cumsum(edges[:-1]) > 0
                cut.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(words[k] for k in np.flatnonzero(~gone))).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cut, pa.int64()), pa.array(sha, pa.string())], names)

    return docs.mapInArrow(removed, "doc_id long, n_removed long, kept_sha256 string")


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs with one of the ids: by broadcast while the ids are few, else by shuffle."""
    return docs.join(F.broadcast(ids) if fits_broadcast(ids, ID_ROWS) else ids, "doc_id", "left_semi")


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start, n): runs of n windows of `length` words, each of which also starts earlier.

    Earlier means a smaller doc_id, or the same document and an earlier start. docs(doc_id, text) without nulls,
    each id once.
    """
    halves = _half_windows(docs, length)
    # rows that are known anyway are dealt out at random, the others meet by token
    salt = F.when(F.col("known") == 2, F.xxhash64("doc_id", "place")).otherwise(F.lit(0))
    seen = halves.withColumn("_salt", salt).withColumn("_n", F.count("*").over(Window.partitionBy("token", "_salt")))
    places = seen.where("known > 0 or _n > 1").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
    windows = _full_windows(docs.join(places, "doc_id").select("doc_id", "text", "places"), length)
    key = [F.coalesce("token", F.xxhash64("doc_id", "start")), F.col("token").isNull()]
    first = F.min(F.struct("doc_id", "start")).over(Window.partitionBy(*key))
    found = windows.withColumn("_first", first).where("token is null or _first.doc_id <> doc_id or _first.start <> start")
    return found.select("doc_id", "start", "n")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of docs(doc_id, text).

    A text whose words all equal those of a smaller doc_id loses all of them if it has `length` words or more, without
    looking at its windows. Null and empty texts have no words. Rows repeated with the same id and text are one
    document and get the same result; of different texts with one id the one of the largest digest is compared, the
    others and rows without an id are kept whole. An empty table gives an empty one; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = saved(_profile(docs))
    leads = rows.where(f"doc_id is not null and n_words >= {length}").groupBy("sha").agg(F.min("doc_id").alias("first"))
    rows = saved(rows.join(leads, "sha", "left"))
    ids = rows.where("doc_id = first").groupBy("doc_id").agg(F.max("sha").alias("sha"))
    ids = saved(ids)
    # one row an id: the window keeps the text whose digest is wanted
    texts = _only(docs, ids.select("doc_id"))
    found = repeats(_single(texts, rows), length)
    spans = saved(found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("s")).select("doc_id", F.col("s.start").alias("starts"), F.col("s.n").alias("counts")))
    hit = spans.select("doc_id")
    cut = _cut(_single(_only(docs, hit), rows).join(spans, "doc_id").select("doc_id", "text", "starts", "counts"), length)
    done = cut.join(ids, "doc_id").select("doc_id", "sha", "n_removed", "kept_sha256")
    copy = F.col("doc_id") > F.col("first")
    return rows.join(done, ["doc_id", "sha"], "left").select(
        "doc_id", "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))


def _single(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """One text an id. Ids are unique in a well-made table, which a count tells; only else are texts compared."""
    doubled = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if doubled.isEmpty():
        return docs
    doubled = F.broadcast(doubled) if fits_broadcast(doubled, ID_ROWS) else doubled
    words = F.array_join(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")), " ")
    chosen = docs.join(doubled, "doc_id", "left_semi").groupBy("doc_id").agg(F.max_by("text", F.sha2(words, 256)).alias("text"))
    return docs.join(doubled, "doc_id", "left_anti").unionByName(chosen)
