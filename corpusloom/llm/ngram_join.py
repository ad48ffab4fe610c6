"""Word-shingle Jaccard join with adaptive multi-match prefixes.

Every text is a set of five-word shingles. Shingles have one global order, rarest first, after counts of hashed
shingles in a table of fixed size. Two sets of similarity >= t share at least l tokens of their prefixes of
n - ceil(t n) + l tokens; each document takes the l that keeps its estimated candidates cheapest, and a pair is
verified only if it shares as many prefix tokens as the smaller of both l asks for, at places that leave enough of both.

Equal sets are one node from the start. Of a posting list of near copies it suffices to check each member against
one hub, the set with the fewest rare tokens of its own: members found similar are connected, and only lists that still hold several components go on, with other
hubs first and with all pairs of different components in the end. So no link between components is lost and
a list of thousands of near copies costs thousands of checks, not their square.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import components, saved
from corpusloom.llm.shingles import digest, shingle_sets
from corpusloom.session import fits_broadcast

PERCENT = 80
TABLE_BITS, SLICE_BITS = 21, 15  # the table of counts: 2**21 counters, in slices of 2**15
MOST_MATCHES = 4  # the largest l that is weighed
ID_ROWS = 500_000  # ids that are broadcast at most (8 bytes each)


def _profile(docs: DataFrame) -> DataFrame:
    """(doc_id, n, d1, d2) of every row, and rows (slice, counts) with the hashed shingle counts of each task."""

    def profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << TABLE_BITS, np.uint32)
        names = ["doc_id", "n", "d1", "d2", "slice", "counts"]
        for batch in batches:
            rows = []
            for row, h in shingle_sets(batch.column(1)):
                np.add.at(table, (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64), 1)
                rows.append((len(h), *digest(h)))
            n, d1, d2 = zip(*rows) if rows else ((), (), ())
            nulls = pa.nulls(len(n), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), nulls, pa.nulls(len(n), pa.binary())], names)
        if table.any():
            k = 1 << (TABLE_BITS - SLICE_BITS)
            none = pa.nulls(k, pa.int64())
            parts = [part.tobytes() for part in table.reshape(k, -1)]
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        profiled, "doc_id long, n long, d1 long, d2 long, slice int, counts binary")


def _table(profile: DataFrame) -> np.ndarray:
    """Sums of the counters: each task adds up the slices it is sent, one after the other."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(counts.as_py(), np.uint32)
                sums[k] = sums[k] + part if k in sums else part.astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slice", "counts"])

    some = profile.where("slice is not null").select("slice", "counts")
    # a first sum per source of slices keeps what one task gathers small, however many tasks wrote slices
    partial = some.repartition(F.col("slice"), F.floor(F.rand(7) * 16)).mapInArrow(added, "slice int, counts binary")
    whole = np.zeros((1 << (TABLE_BITS - SLICE_BITS), 1 << SLICE_BITS), np.int64)
    for row in partial.repartition("slice").mapInArrow(lambda it: _added64(it), "slice int, counts binary").collect():  # 2**21 counters
        whole[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return whole.reshape(-1)


def _added64(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
            sums[k] = sums.get(k, 0) + np.frombuffer(counts.as_py(), np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slice", "counts"])


def prefix(h: np.ndarray, counts: np.ndarray, usual: float, percent: int = PERCENT) -> tuple[int, np.ndarray]:
    """(l, prefix tokens) of a set: the l with the least estimated cost of postings and candidates."""
    n = len(h)
    df = counts[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)]
    order = np.lexsort((h, df))
    least = -(-n * percent // 100)  # tokens that a partner shares at least
    # candidates of a token beyond what unrelated shingles put into its counter
    extra = np.maximum(df[order].astype(float) - 1.5 * usual, 0.0)
    cost = np.cumsum(extra)
    options = range(1, min(MOST_MATCHES, least) + 1)
    best = min(options, key=lambda l: cost[n - least + l - 1] / l + (n - least + l))
    return best, h[order[:n - least + best]]


def _prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """(doc_id, n, d1, d2, l, tokens) of every row with a set."""
    shared = docs.sparkSession.sparkContext.broadcast(np.minimum(counts, 2**31 - 1).astype(np.int32))  # 8 MB
    usual = float(np.median(counts))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            rows, ids = [], batch.column(0)
            for row, h in shingle_sets(batch.column(1)):
                if len(h):
                    matches, tokens = prefix(h, table, usual)
                    rows.append((row, len(h), *digest(h), matches, tokens.view(np.int64)))
            at, n, d1, d2, matches, tokens = zip(*rows) if rows else ((),) * 6
            flat = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
            offsets = np.cumsum([0, *map(len, tokens)])
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()),
                 pa.array(matches, pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                ["doc_id", "n", "d1", "d2", "l", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        cut, "doc_id long, n long, d1 long, d2 long, l int, tokens array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, tokens) with the whole set."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [h for _, h in shingle_sets(batch.column(1))]
            digests = [digest(h) for h in sets]
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            offsets = np.cumsum([0, *map(len, sets)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)],
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))], ["doc_id", "d1", "d2", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(whole, "doc_id long, d1 long, d2 long, tokens array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 x intersection >= percent x union."""
    x = sets.select(F.col("node").alias("a"), F.col("tokens").alias("ta"))
    y = sets.select(F.col("node").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.select("a", "b").join(x, "a").join(y, "b")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.where(100 * common >= percent * (F.size("ta") + F.size("tb") - common)).select("a", "b")


def _merged(labels: DataFrame | None, found: DataFrame) -> DataFrame:
    """(node, component) after further links: components of what has been known are joined, not their nodes again.

    A link stands for one between the components of its ends, and several between the same two are one, so the
    graph that is left shrinks with every round, however many links a group of near copies has.
    """
    if labels is None:
        return saved(components(found))
    side = labels.select(F.col("node").alias("_node"), F.col("component").alias("_c"))
    ends = found.join(side, F.col("a") == F.col("_node"), "left").select(F.coalesce("_c", "a").alias("a"), "b")
    ends = ends.join(side, F.col("b") == F.col("_node"), "left").select("a", F.coalesce("_c", "b").alias("b"))
    between = saved(ends.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    joined = saved(components(between)).select(F.col("node").alias("_was"), F.col("component").alias("_now"))
    moved = labels.join(joined, F.col("component") == F.col("_was"), "left").select("node", F.coalesce("_now", "component").alias("component"))
    # a node that had no link so far was its own component
    new = joined.join(labels, F.col("_was") == F.col("node"), "left_anti").select(F.col("_was").alias("node"), F.col("_now").alias("component"))
    return saved(moved.unionAll(new))


def _with_components(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings (token, node, n, pos, comp) of the tokens whose nodes are in several components."""
    if labels is None:
        labelled = shared.withColumn("comp", F.col("node"))
    else:
        known = labels.withColumnRenamed("component", "c")
        labelled = shared.join(known, "node", "left").select("token", "node", "n", "pos", F.coalesce("c", "node").alias("comp"))
    w = Window.partitionBy("token")
    mixed = labelled.withColumn("_lo", F.min("comp").over(w)).withColumn("_hi", F.max("comp").over(w))
    return mixed.where("_lo <> _hi").drop("_lo", "_hi")


def ngram_join(docs: DataFrame, percent: int = PERCENT, hub_rounds: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs(doc_id, text).

    Null and empty texts, and those of white space only, have no shingle and are their own component. Rows that
    share an id are one document: the text with the largest set speaks for it. A null id gets a null component. An
    empty table gives an empty one; columns other than doc_id and text are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = saved(_profile(docs))
    rows = profile.where("slice is null").select("doc_id", "n", "d1", "d2")
    speakers = rows.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("n", "d1", "d2")).alias("s")).select("doc_id", "s.*")
    speakers = saved(speakers.where("n > 0"))
    nodes = saved(speakers.groupBy("d1", "d2").agg(F.min("doc_id").alias("node")))

    postings = _prefixes(docs, _table(profile)).join(nodes, ["d1", "d2"]).where("doc_id = node")
    # one row a node, where the join has put it
    postings = saved(postings.dropDuplicates(["d1", "d2", "node"]).select("node", "n", "l", "tokens"))
    # n and the place of the token in the prefix travel in one number
    listed = postings.select("node", "n", F.posexplode("tokens").alias("pos", "token")).select(
        "token", "node", (F.shiftleft("n", 32) + F.col("pos")).alias("at"))
    shared = saved(
        listed.withColumn("_n", F.count("*").over(Window.partitionBy("token"))).where("_n > 1").select(
            "token", "node", F.shiftright("at", 32).alias("n"), F.col("at").bitwiseAND(F.lit((1 << 32) - 1)).alias("pos")))

    def verified(pairs: DataFrame) -> DataFrame:
        """The similar ones; whole sets are built for the nodes of the pairs only."""
        ids = saved(pairs.select(F.col("a").alias("doc_id")).unionAll(pairs.select("b")).distinct())
        wanted = docs.join(F.broadcast(ids) if fits_broadcast(ids, ID_ROWS) else ids, "doc_id", "left_semi")
        sets = _sets(wanted).withColumnRenamed("doc_id", "node").join(nodes, ["node", "d1", "d2"], "left_semi")
        sets = saved(sets.dropDuplicates(["node", "d1", "d2"]).select("node", "tokens"))
        return saved(_verified(pairs, sets, percent))

    labels = tried = None
    mixed = saved(_with_components(shared, None))
    for turn in range(hub_rounds):
        # the set with the fewest rarer tokens of its own first: what the others are copies of has none, and of a list it is
        # the one that all others are nearest to; then the smallest set, then any
        order = [F.struct("pos", "n", "node"), F.struct("n", "node"), F.struct(F.xxhash64("node", F.lit(turn)), "node")][min(turn, 2)]
        hub = F.min_by(F.struct("node", "comp", "n", "pos"), order).over(Window.partitionBy("token"))
        stars = mixed.withColumn("hub", hub).where("hub.node <> node and hub.comp <> comp").where(
            _possible(F.col("hub.n"), F.col("hub.pos"), F.col("n"), F.col("pos"), percent))
        a, b = F.least("hub.node", "node"), F.greatest("hub.node", "node")
        pairs = stars.select(a.alias("a"), b.alias("b")).distinct()
        # a hub is only a short cut: members that share little of their prefix with it are left to what follows
        likely = F.col("matches") >= F.greatest(F.least("la", "lb"), F.least("na", "nb") / 40)
        pairs = saved(_matched(pairs, postings).where(likely).select("a", "b"))
        tried = pairs if tried is None else tried.unionAll(pairs)
        labels = _merged(labels, verified(pairs))
        mixed = saved(_with_components(shared, labels))
        if mixed.isEmpty():
            break
    x = mixed.select("token", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    y = mixed.select("token", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    near = (x["token"] == y["token"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
    pairs = x.join(y, near & _possible(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), percent))
    pairs = saved(pairs.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
    pairs = saved(_matched(pairs, postings).where(F.col("matches") >= F.least("la", "lb")).select("a", "b"))
    linked = _merged(labels, verified(pairs))
    by_doc = (
        speakers.join(nodes, ["d1", "d2"]).join(linked, "node", "left")
        .select("doc_id", F.coalesce("component", "node").alias("component_id"))
    )
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(by_doc, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def _possible(na, pa, nb, pb, percent: int):
    """Whether two sets whose first shared token is at these places of their orders can be similar.

    What they share is that token and what follows it in the shorter rest at most. A similar pair has such a first
    token, so one of its rows passes; later ones need not, which is why matches are counted on the prefixes.
    """
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (F.least(na - pa, nb - pb) * (100 + percent) >= percent * (na + nb))


def _matched(pairs: DataFrame, postings: DataFrame) -> DataFrame:
    """The pairs with the size and l of both, and how many tokens their prefixes share."""
    x = postings.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("l").alias("la"), F.col("tokens").alias("ta"))
    y = postings.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("l").alias("lb"), F.col("tokens").alias("tb"))
    both = pairs.join(x, "a").join(y, "b")
    return both.withColumn("matches", F.size(F.array_intersect("ta", "tb"))).drop("ta", "tb")
