"""Groups of spelling variants: words that one edit turns into a much more frequent one.

Reduced-alphabet generation: letters are hashed to a few symbols, so a word's neighbourhood of one edit has some 17
entries a letter instead of over a hundred. Each word generates the whole neighbourhood of its reduced form; what no
word of the vocabulary reduces to goes at once (a bitmap of fixed size), the rest is joined with the reduced
vocabulary, and the words themselves are compared. Edits of the letters are edits of the symbols, or none, so no pair
is lost. Reduced words are 64-bit hashes: two that meet by chance cost a comparison, nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import saved
from corpusloom.llm.url_filter import ascii_lower
from corpusloom.llm.words import mix

RUN = r"[A-Za-zÀ-ÿ]+"
SYMBOLS = 8
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
DELETE_ONE_IN = 199
MOST_BITS = 26  # the bitmap has 2**26 bits (8 MB) at most; a fuller one lets more rows through, results stay
CELLS = 1 << 20  # neighbours generated at a time: bounds memory, whatever the words' lengths

_B = np.uint64(0x9E3779B97F4A7C15)


def occurrences(docs: DataFrame, one_in: int = DELETE_ONE_IN) -> DataFrame:
    """(word) of every run of letters of docs(doc_id, text) that may still be long enough, a letter less in one of `one_in`.

    The crc32 of `<doc_id>:<run>` picks the runs and the letter; without a doc_id nothing is deleted.
    """
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= LEAST_LENGTH).select("doc_id", ascii_lower(F.col("run")).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.length("run")))
    return runs.select("run", h.alias("h")).select(F.when(F.col("h") % one_in == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of the words of at least LEAST_LENGTH letters and LEAST_COUNT occurrences."""
    counted = occurrences(docs).where(F.length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= LEAST_COUNT)


def symbols(points: np.ndarray, k: int = SYMBOLS) -> np.ndarray:
    """The symbol, 1 to k, of each code point."""
    return mix(points.astype(np.uint64)) % np.uint64(k) + np.uint64(1)


def _points(words: pa.Array, rows: np.ndarray, length: int) -> np.ndarray:
    """Code points of words of one length, a word a line."""
    text = "".join(words.take(pa.array(rows)).to_pylist())
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(-1, length)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _B, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _blocks(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, symbols of those words, a word a line) for words of one length, so many that a block stays small."""
    lengths = pa.compute.utf8_length(words).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        step = max(1, CELLS // (int(length) * (2 * SYMBOLS + 1)))
        for at in range(0, len(rows), step):
            part = rows[at:at + step]
            yield part, symbols(_points(words, part, int(length)))


def reduced_keys(s: np.ndarray) -> np.ndarray:
    """Hash of each line of symbols."""
    return mix((s * _powers(s.shape[1])).sum(1, dtype=np.uint64))


def neighbourhoods(s: np.ndarray, k: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(line, hash) of each line itself and of all that one insertion, deletion or replacement of a symbol makes of it, once each.

    A deletion inside a run of one symbol, or an insertion beside it, has the same result at every place of the run:
    only the first deletion and the insertions before a different symbol, or at the end, are made.
    """
    n, m = s.shape
    p = _powers(m + 2)
    own = s * p[:m]
    before = np.zeros((n, m + 1), np.uint64)
    np.cumsum(own, axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    left = np.zeros((n, m + 1), np.uint64)  # symbols from the second on, moved one place to the left, summed
    np.cumsum(s[:, 1:] * p[:m - 1], axis=1, out=left[:, 2:])
    right = np.zeros((n, m + 1), np.uint64)  # all moved one place to the right
    np.cumsum(s * p[1:m + 1], axis=1, out=right[:, 1:])
    lines = np.arange(n)
    yield lines, mix(whole[:, 0])
    width = max(1, CELLS // max(1, n))  # places at a time
    for lo in range(0, m + 1, width):
        hi = min(m, lo + width)
        first = np.ones((n, hi - lo), bool)
        at = np.arange(max(lo, 1), hi)
        first[:, at - lo] = s[:, at] != s[:, at - 1]
        line, col = np.nonzero(first)
        col = col + lo
        yield line, mix(before[line, col] + left[line, m] - left[line, col + 1])
        for c in range(1, k + 1):
            line, col = np.nonzero(s[:, lo:hi] != c)
            col = col + lo
            put = np.uint64(c) * p[col]
            yield line, mix(before[line, col] + put + whole[line, 0] - before[line, col + 1])
            yield line, mix(before[line, col] + put + right[line, m] - right[line, col])
    for c in range(1, k + 1):
        yield lines, mix(whole[:, 0] + np.uint64(c) * p[m:m + 1])


def _keyed(vocab: DataFrame) -> DataFrame:
    """(key, word, n): the hash of each word's reduced form."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, np.uint64)
            for rows, s in _blocks(batch.column(0)):
                keys[rows] = reduced_keys(s)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(0), batch.column(1)], ["key", "word", "n"])

    return vocab.select("word", "n").mapInArrow(keyed, "key long, word string, n long")


def _bitmap(keyed: DataFrame, bits: int) -> np.ndarray:
    """One bit for the first bits of every key: 2**bits at most, put together from slices of 4 KB."""
    place = F.shiftrightunsigned("key", 64 - bits) + 1
    slices = keyed.groupBy(F.bitmap_bucket_number(place).alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("held"))
    out = np.zeros((max(1, (1 << bits) // 32768), 4096), np.uint8)
    for row in slices.toLocalIterator():
        out[row["slice"] - 1] = np.frombuffer(row["held"], np.uint8)
    return out.reshape(-1)


def _candidates(keyed: DataFrame, held: np.ndarray, bits: int) -> DataFrame:
    """(key, word): what each word's neighbourhood has in common with the reduced vocabulary, and a few more."""
    shared = keyed.sparkSession.sparkContext.broadcast(held)  # 8 MB at most

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            words = batch.column(0)
            for rows, s in _blocks(words):
                keys, lines = [], []
                for line, key in neighbourhoods(s):
                    place = key >> np.uint64(64 - bits)
                    kept = (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
                    keys.append(key[kept])
                    lines.append(rows[line[kept]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), words.take(pa.array(np.concatenate(lines)))], ["key", "word"])

    return keyed.select("word").mapInArrow(near, "key long, word string")


def near_words(vocab: DataFrame) -> DataFrame:
    """(word, near, near_n), both ways, of the words of vocab(word, n) that one edit turns into each other."""
    keyed = saved(_keyed(vocab))
    bits = max(15, min(MOST_BITS, int(np.ceil(np.log2(keyed.count() + 1))) + 6))
    found = _candidates(keyed, _bitmap(keyed, bits), bits).join(
        keyed.select("key", F.col("word").alias("near"), F.col("n").alias("near_n")), "key")
    return found.where((F.col("word") != F.col("near")) & (F.levenshtein("word", "near", 1) == 1)).select("word", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last, two steps becoming one each turn."""
    at = saved(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        # a form has RATIO times the count, so chains are short and end; frequent forms are split by the join
        at = saved(at.join(onward, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        moved = not at.where("_moved").isEmpty()
        at = at.select("word", "root")
        if not moved:
            return at


def variant_groups(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs(doc_id, text).

    The form of a word is its near word of largest n (of equal ones the smallest) if that has RATIO times the word's
    n; the root is where its forms end. Null and empty texts have no words, a text of any length is read whole. Rows
    that repeat count as often as they stand there. Other columns are not looked at. An empty table gives an empty one.
    """
    vocab = saved(vocabulary(docs.select("doc_id", "text")))
    near = near_words(vocab).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min_by(F.struct("near", "near_n"), F.struct(-F.col("near_n"), "near")).alias("best"))
    joined = vocab.join(near, "word", "left")
    known: Column = F.col("best.near_n") >= RATIO * F.col("n")
    told = saved(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(known, F.col("best.near")).alias("form"),
        F.when(known, F.col("best.near_n")).alias("form_n")))
    roots = _roots(told.where("form is not null"))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
