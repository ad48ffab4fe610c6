"""Ranked lexical search by exact inner products over sparse ball trees.

A document is a sparse vector over the terms of the items asked for, an item one over its own terms, and a score is
their inner product. Every task packs its documents into ball trees of bounded size; a node keeps the centroid of its
documents and their radius in each group of terms: the terms that only one item has are a group, every other term is
one of its own. What an item can score in a node is at most the product with the centroid plus the norms of the item's
groups times the radii, in doubles, made larger by more than all rounding can take away. Subtrees are taken best first; one whose bound lies below the item's tenth score so far is left out. At the
leaves scores are exact integers. A first pass over a sample of the trees gives every task tenth scores to start with;
they are scores of real documents, so they only ever leave out what can't be among the best.

Terms are 64-bit hashes of their bytes: two different terms meet with a chance of about 2**-64 a pair.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import saved
from corpusloom.llm.url_filter import ascii_lower
from corpusloom.llm.words import mix, powers
from corpusloom.session import top_k

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 10
TERMS_AT_ONCE = 1 << 15  # (item, term) pairs searched for in one pass over the documents: bounds what tasks are sent
TREE_DOCS, LEAF_DOCS = 4096, 32
TREE_ENTRIES = 1 << 20  # (document, term) entries of a tree; one document may have more
SAMPLE = 16  # one document in so many gives the scores to start with
BLOCK = 1 << 20  # bytes tokenized at a time
SAFE = 1e-9  # relative; sums of some thousand doubles are off by 1e-12 at most

_RNG = np.random.Generator(np.random.PCG64(20260112))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PART = np.zeros(256, bool)
_PART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BYTE[~_PART] = 0
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z


def _term_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, hash) of each term of bytes that neither start nor end inside a term."""
    part = _PART[raw]
    first = part.copy()
    first[1:] &= ~part[:-1]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    gaps = np.diff(np.append(starts, len(raw)))
    place = np.arange(starts[0], len(raw)) - np.repeat(starts, gaps)
    values = _BYTE[raw[starts[0]:]] * powers(int(gaps.max()))[place]
    return starts, mix(np.add.reduceat(values, starts - starts[0]))


def _blocks(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of blocks of about BLOCK bytes, cut between terms."""
    at = 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        while end < len(raw):
            found = np.flatnonzero(~_PART[raw[end:end + 4096]])
            if len(found):
                end += int(found[0])
                break
            end = min(len(raw), end + 4096)
        yield at, end
        at = end


def term_rows(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hash) of all terms of a text column, some rows or a part of a long one at a time; null texts have none."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        last = row + 1
        while last < len(column) and offsets[last + 1] - offsets[row] <= BLOCK:
            last += 1
        part = raw[offsets[row]:offsets[last]]
        if last == row + 1:
            for lo, hi in _blocks(part):
                _, hashes = _term_hashes(part[lo:hi])
                yield np.full(len(hashes), row), hashes
        else:  # a separator after each row, so that no term runs over
            ends = offsets[row:last + 1] - offsets[row]
            padded = np.zeros(len(part) + (last - row), np.uint8)
            padded[np.arange(len(part)) + np.repeat(np.arange(last - row), np.diff(ends))] = part
            starts, hashes = _term_hashes(padded)
            yield np.searchsorted(ends[:-1] + np.arange(last - row), starts, "right") - 1 + row, hashes
        row = last


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) once each, of items(item_id, text)."""
    return items.select("item_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0))).alias("term")).distinct()


class Items:
    """The items of one pass: terms as sorted hashes, and the terms of each item as places in them."""

    @staticmethod
    def of(rows: list[tuple]) -> Items:
        """From (item, term) rows."""
        hashes = [int(h[0]) for h in (_term_hashes(np.frombuffer(term.encode(), np.uint8))[1] for _, term in rows)]
        terms = np.unique(np.array(hashes, np.uint64))
        place = np.searchsorted(terms, np.array(hashes, np.uint64))
        by_item: dict = {}
        for (item, _), t in zip(rows, place.tolist()):
            by_item.setdefault(item, set()).add(t)
        return Items(list(by_item), terms, [np.array(sorted(v)) for v in by_item.values()])

    def __init__(self, ids: list, terms: np.ndarray, lists: list[np.ndarray]):
        self.ids, self.terms, self.lists = ids, terms, lists
        # a group for what only one item has, and one for each other term
        holders = np.bincount(np.concatenate(self.lists), minlength=len(self.terms)) if self.lists else np.zeros(0, int)
        self.group = np.full(len(self.terms), -1)
        for k, own in enumerate(self.lists):
            self.group[own[holders[own] == 1]] = k
        others = np.flatnonzero(self.group < 0)
        self.group[others] = len(self.ids) + np.arange(len(others))
        self.groups = len(self.ids) + len(others)

    def norms(self, weight: np.ndarray) -> np.ndarray:
        """Norm of each item in each group."""
        return np.array([np.sqrt(np.bincount(self.group[own], weight[own], self.groups)) for own in self.lists])


def vectors(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """(doc_id, n, t, tf) of every document that has a term: how many, and places and counts of those in `terms` (sorted hashes)."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)  # TERMS_AT_ONCE of them, or those of one item

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            cells = [np.empty(0, np.int64)]
            for rows, hashes in term_rows(batch.column(1)):
                n += np.bincount(rows, minlength=len(n))
                at = np.searchsorted(known, hashes)
                at[at == len(known)] = 0
                hit = known[at] == hashes
                cells.append(rows[hit] * len(known) + at[hit])
            cells, tf = np.unique(np.concatenate(cells), return_counts=True)
            kept = np.flatnonzero(n)
            offsets = pa.array(np.append(np.searchsorted(cells // len(known), kept), len(cells)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept)), pa.array(n[kept]), pa.ListArray.from_arrays(offsets, pa.array(cells % len(known), pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))], ["doc_id", "n", "t", "tf"])

    return docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, n long, t array<int>, tf array<long>")


class Statistics:
    """What scores need of all documents: their number, their terms, and a weight for each term."""

    def __init__(self, docs: int, terms: int, weight: np.ndarray):
        self.docs, self.terms, self.weight = docs, terms, weight

    @staticmethod
    def of(found: DataFrame, size: int) -> Statistics:
        total = found.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
        docs, weight = int(total["docs"]), np.zeros(size, np.int64)
        for r in found.select(F.explode("t").alias("t")).groupBy("t").count().toLocalIterator():  # one row a term asked for
            weight[r["t"]] = math.floor(1000 * math.log((2 * docs + 2) / (2 * r["count"] + 1)))
        return Statistics(docs, int(total["terms"]), weight)

    def m(self, n: np.ndarray) -> np.ndarray:
        """What the length n of a document adds below the line."""
        return np.array([10 + 90 * int(x) * self.docs // self.terms for x in n.tolist()], np.int64)

    @staticmethod
    def values(m: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """What a term that occurs tf times scores per unit of its weight."""
        return 1_000_000_000 * tf // (1000 * tf + 8 * m)


class Tree:
    """A ball tree over some documents: nodes are ranges of a permutation of them, halved until they fit a leaf."""

    def __init__(self, lengths: np.ndarray, t: np.ndarray, c: np.ndarray, root_weight: np.ndarray, items: Items):
        self.terms, local = np.unique(t, return_inverse=True)  # only the terms that occur here
        x = c * root_weight[t]
        starts = np.concatenate([[0], np.cumsum(lengths)])
        row = np.repeat(np.arange(len(lengths)), lengths)
        squares = np.bincount(row, x * x, len(lengths))
        dense = np.zeros(len(self.terms))

        def distances(to: int, rows: np.ndarray, own: np.ndarray, line: np.ndarray) -> np.ndarray:
            """Squared distances of some rows (entries `own`, of their lines) to a row."""
            mine = slice(starts[to], starts[to + 1])
            dense[local[mine]] = x[mine]
            dot = np.bincount(line, x[own] * dense[local[own]], len(rows))
            dense[local[mine]] = 0
            return squares[rows] + squares[to] - 2 * dot

        self.order = np.arange(len(lengths))
        self.nodes: list[tuple[int, int, int]] = []  # (first, end, first child or -1); the second child comes after the first
        waiting, entries = [(0, len(lengths))], []
        while len(self.nodes) < len(waiting):
            lo, hi = waiting[len(self.nodes)]
            rows = self.order[lo:hi]
            size = lengths[rows]
            own = np.repeat(starts[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            line = np.repeat(np.arange(len(rows)), size)
            entries.append((rows, own, line))
            if hi - lo <= LEAF_DOCS:
                self.nodes.append((lo, hi, -1))
                continue
            a = int(rows[np.argmax(distances(int(rows[0]), rows, own, line))])
            to_a = distances(a, rows, own, line)
            b = int(rows[np.argmax(to_a)])
            side = np.argsort(to_a - distances(b, rows, own, line), kind="stable")
            self.order[lo:hi] = rows[side]
            mid = (lo + hi) // 2
            self.nodes.append((lo, hi, len(waiting)))
            waiting += [(lo, mid), (mid, hi)]
        # entries were taken before their range was split further; the set of rows is the same
        self.centroid = np.zeros((len(self.nodes), len(self.terms)))
        self.radius = np.zeros((len(self.nodes), items.groups))
        group = items.group[self.terms]
        here, group = np.unique(group, return_inverse=True)
        for k, (rows, own, line) in enumerate(entries):
            center = np.bincount(local[own], x[own], len(self.terms)) / len(rows)
            # squared distance in a group: |center|^2 and, where the row has the term, (x - c)^2 - c^2 more
            base = np.bincount(group, center * center, len(here))
            at = center[local[own]]
            cell, place = np.unique(line * len(here) + group[local[own]], return_inverse=True)
            more = np.zeros(len(here))  # a row without a term of the group is at |center|
            np.maximum.at(more, cell % len(here), np.bincount(place, (x[own] - at) ** 2 - at * at, len(cell)))
            # differences of sums: what rounding may have taken away is put back
            lost = SAFE * (base + squares[rows].max())
            self.centroid[k] = center
            self.radius[k, here] = np.sqrt(np.maximum(base + more, 0) + lost)
        self.starts, self.t, self.c, self.lengths = starts, t, c, lengths

    def bounds(self, items: Items, which: np.ndarray, root_weight: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """An upper bound of each chosen item's score in each node (nodes by items)."""
        out = self.radius @ norms[which].T
        for k, i in enumerate(which.tolist()):
            own = items.lists[i]
            at = np.searchsorted(self.terms, own)
            at[at == len(self.terms)] = 0
            hit = self.terms[at] == own
            out[:, k] += self.centroid[:, at[hit]] @ root_weight[own[hit]]
        return out * (1 + SAFE) + 0.25

    def scores(self, node: int, asked: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, exact scores) of a leaf for the item whose terms are marked in `asked`."""
        lo, hi, _ = self.nodes[node]
        rows = self.order[lo:hi]
        size = self.lengths[rows]
        own = np.repeat(self.starts[rows] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        line = np.repeat(np.arange(len(rows)), size)
        hit = asked[self.t[own]]
        total = np.zeros(len(rows), np.int64)
        np.add.at(total, line[hit], weight[self.t[own[hit]]] * self.c[own[hit]])
        return rows, total


class Search:
    """The best K of every item inside one task, tree after tree."""

    def __init__(self, items: Items, weight: np.ndarray, floor: np.ndarray, k: int):
        self.items, self.weight, self.floor, self.k = items, weight, floor.copy(), k
        self.root_weight, self.norms = np.sqrt(weight), items.norms(weight)
        self.best: list[list[tuple]] = [[] for _ in items.ids]
        self.asked = np.zeros(len(items.terms), bool)
        self.leaves = self.scored = 0

    def add(self, ids: list, lengths: np.ndarray, t: np.ndarray, c: np.ndarray) -> None:
        tree = Tree(lengths, t, c, self.root_weight, self.items)
        self.leaves += sum(first < 0 for _, _, first in tree.nodes) * len(self.best)
        which = np.arange(len(self.best))
        bounds = tree.bounds(self.items, which, self.root_weight, self.norms)
        for i in np.flatnonzero(bounds[0] >= self.floor).tolist():
            own, bound = self.items.lists[i], bounds[:, i]
            self.asked[own] = True
            waiting = [(-bound[0], 0)]
            while waiting and -waiting[0][0] >= self.floor[i]:  # the best subtree left
                _, node = heapq.heappop(waiting)
                first = tree.nodes[node][2]
                if first >= 0:
                    for child in (first, first + 1):
                        heapq.heappush(waiting, (-bound[child], child))
                    continue
                self.scored += 1
                rows, total = tree.scores(node, self.asked, self.weight)
                self._keep(i, ids, rows, total)
            self.asked[own] = False

    def _keep(self, i: int, ids: list, rows: np.ndarray, total: np.ndarray) -> None:
        good = total >= self.floor[i]
        if good.any():
            new = [(-s, ids[r] is None, ids[r] or 0) for r, s in zip(rows[good].tolist(), total[good].tolist())]
            self.best[i] = sorted(self.best[i] + new)[:self.k]
            if len(self.best[i]) == self.k:
                self.floor[i] = max(self.floor[i], -self.best[i][-1][0])

    def batch(self, item_type: pa.DataType) -> pa.RecordBatch:
        rows = [(item, None if none else doc, -s) for item, best in zip(self.items.ids, self.best) for s, none, doc in best]
        item, doc, score = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(item, item_type), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"])


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents that make a tree: TREE_DOCS of them, or TREE_ENTRIES entries, at most."""
    at = 0
    upto = np.concatenate([[0], np.cumsum(sizes)])
    while at < len(sizes):
        end = int(np.searchsorted(upto, upto[at] + TREE_ENTRIES, "right")) - 1
        end = min(len(sizes), at + TREE_DOCS, max(end, at + 1))
        yield at, end
        at = end


def _searched(found: DataFrame, items: Items, known: Statistics, floor: np.ndarray, k: int, item_field) -> DataFrame:
    """The best k of every item among the documents found."""
    shared = found.sparkSession.sparkContext.broadcast(
        (items.ids, items.terms, items.lists, known.docs, known.terms, known.weight, floor))  # as long as the items' terms
    item_type = pa.int64() if item_field.dataType.typeName() in ("long", "integer") else pa.string()

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, n_docs, n_terms, weight, floor = shared.value
        known = Statistics(n_docs, n_terms, weight)
        search = Search(Items(*parts), weight, floor, k)
        for batch in batches:
            ids, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            lengths = batch.column(2).value_lengths().to_numpy().astype(np.int64)
            t, tf = (batch.column(c).flatten().to_numpy() for c in (2, 3))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for lo, hi in _runs(lengths):
                part = slice(starts[lo], starts[hi])
                m = np.repeat(known.m(n[lo:hi]), lengths[lo:hi])
                search.add(ids[lo:hi], lengths[lo:hi], t[part], known.values(m, tf[part]))
        yield search.batch(item_type)

    kind = "long" if item_type == pa.int64() else "string"
    # documents without a term of any item score nothing; counts have been taken
    some = found.where(F.size("t") > 0)
    hits = some.mapInArrow(searched, f"item_id {kind}, doc_id long, score long")
    return top_k(hits, ["item_id"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], k)


def _pass(docs: DataFrame, rows: list[tuple], k: int, item_field) -> DataFrame:
    items = Items.of(rows)
    found = saved(vectors(docs, items.terms))
    known = Statistics.of(found, len(items.terms))
    floor = np.ones(len(items.ids), np.int64)
    some = found.where(F.pmod(F.xxhash64("doc_id", "n"), F.lit(SAMPLE)) == 0)
    place = {item: i for i, item in enumerate(items.ids)}
    for r in _searched(some, items, known, floor, k, item_field).where(f"rank = {k}").collect():  # one row an item
        floor[place[r["item_id"]]] = r["score"]
    return _searched(found, items, known, floor, k, item_field)


def rank(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of highest score above 0 of each of items(item_id, text).

    docs(doc_id, text): null and empty texts, and those without a term, count for nothing; a text of any length is read
    whole. Every row is a document: rows that repeat have ranks of their own, a null doc_id comes last among equal
    scores. Items that share an id are one item of all their terms; one without terms, or with terms that no document
    has, has no rows. Other columns are not looked at. Items of more than TERMS_AT_ONCE terms together are searched
    for in several passes over the documents.
    """
    spark = docs.sparkSession
    item_field = items.schema["item_id"]
    terms = saved(item_terms(items.select("item_id", "text")))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pairs = terms.count()
    passes = 1 if pairs <= TERMS_AT_ONCE else -(-2 * pairs // TERMS_AT_ONCE)
    out = None
    for at in range(passes):
        mine = terms if passes == 1 else terms.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == at)
        rows = [tuple(r) for r in mine.collect()]  # TERMS_AT_ONCE, or those of one item
        if rows:
            hits = _pass(docs, rows, k, item_field)
            hits = hits if passes == 1 else saved(hits)
            out = hits if out is None else out.unionAll(hits)
    if out is None:
        kind = "long" if item_field.dataType.typeName() in ("long", "integer") else "string"
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
