"""A stored vector index: k-means cells as partitions, residuals as product codes, vectors for exact scores.

    <path>/rows/cell=<c>/   chunk_id, slice, dist, embedding, code, err
    <path>/centres/         cell, centre, radius, size
    <path>/books/           part, words: written last, an index without them doesn't count

Centres and codebooks are fitted to a sample of bounded size; every vector is indexed. All vectors have length 1 here,
so a cosine is 1 - d**2 / 2 of a distance d, and the triangle inequality bounds it: a cell of radius r around a centre
at distance D from a question holds nothing nearer than D - r, a vector at distance s from its centre none nearer than
|D - s|.

`search` is exact: the nearest cells give each question a k-th score, other cells are read only where their bound
reaches it. `search_codes` reads the codes of the `probes` nearest cells, estimates all cosines from them, and scores the
best by their vectors. Questions near each other form blocks of bounded size. A task holds one block and the best hits of
each of its questions; the cells that the block asks for stream past it, the nearest first. So no (question, cell) pair
becomes a row, and a task emits k hits a question, however many vectors there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.session import broadcast_if_small, materialize, top_k
from corpusloom.sources.files import children

SCORE_DIGITS = 6
SAMPLE_ROWS = 20_000  # vectors that centres and codebooks are fitted to, at most
MOST_CELLS = 1024
SLICE_ROWS = 20_000  # vectors of a cell that lie in one stored slice
BLOCK_ROWS, LEAST_BLOCK, BLOCKS = 4096, 256, 24  # questions of a block, at most and at least; blocks if there is a choice
LOOSE = 500_000  # candidates of a block that wait to be sorted in
SEED_CELLS = 2  # nearest cells that give a question its first k-th score
PART_DIMS, WORDS = 4, 256  # of the product code
ROUNDS = 8  # of k-means
PRODUCT = 2_000_000  # scores computed at a time inside a task


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1, norms)


def _matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors as doubles, a vector a line."""
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if rows and (len(flat) % rows or (column.value_lengths().to_numpy(zero_copy_only=False) != len(flat) // rows).any()):
        raise ValueError("vectors of a collection must all have one width")
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))


def _kmeans(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k centres; one that loses all its points takes the point that is worst served."""
    rng = np.random.default_rng(seed)
    centres = points[rng.choice(len(points), min(k, len(points)), replace=False)].copy()
    for _ in range(ROUNDS):
        d = _distances(points, centres)
        near = d.argmin(1)
        size = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, points)
        centres = total / np.maximum(size, 1)[:, None]
        lost = np.flatnonzero(size == 0)
        if len(lost):
            centres[lost] = points[np.argsort(-d[np.arange(len(points)), near])[:len(lost)]]
    return centres


def _parts(width: int) -> list[slice]:
    return [slice(at, min(width, at + PART_DIMS)) for at in range(0, width, PART_DIMS)]


def build(chunks: DataFrame, path: str, cells: int | None = None, seed: int = 7, codes: bool = True) -> None:
    """Index chunks(chunk_id, embedding); null vectors are left out.

    As many cells as the square root of the vectors, MOST_CELLS at most, unless given. Without codes the index serves
    the exact search only.
    """
    spark = chunks.sparkSession
    chunks = chunks.select("chunk_id", "embedding").where("embedding is not null")
    sample = chunks.orderBy(F.xxhash64("chunk_id", "embedding")).limit(SAMPLE_ROWS).select("embedding").toArrow()
    points = _unit(_matrix(sample["embedding"].combine_chunks())) if sample.num_rows else np.zeros((1, 1))
    cells = cells or max(1, min(MOST_CELLS, round(chunks.count() ** 0.5)))
    centres = _kmeans(points, cells, seed)
    rest = points - centres[_distances(points, centres).argmin(1)]
    books = [_kmeans(rest[:, part], WORDS, seed + 1) for part in _parts(points.shape[1])] if codes else []
    shared = spark.sparkContext.broadcast((centres, books))  # MOST_CELLS + WORDS vectors
    schema = T.StructType([
        chunks.schema["chunk_id"], T.StructField("cell", T.IntegerType()), T.StructField("dist", T.DoubleType()),
        chunks.schema["embedding"], T.StructField("code", T.BinaryType()), T.StructField("err", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, books = shared.value
        step = max(1, PRODUCT // max(WORDS, len(centres)))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            unit = _unit(_matrix(batch.column(1)))
            d = _distances(unit, centres)
            cell = d.argmin(1)
            rest = unit - centres[cell]
            codes = np.empty((len(unit), len(books)), np.uint8)
            left = np.zeros(len(unit))
            for j, (part, words) in enumerate(zip(_parts(unit.shape[1]), books)):
                off = _distances(rest[:, part], words)
                codes[:, j] = off.argmin(1)
                left += off.min(1) ** 2
            # distances of points that are near each other lose digits: bounds get more slack than that
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(cell, pa.int32()), pa.array(np.linalg.norm(rest, axis=1)), batch.column(1),
                pa.array([row.tobytes() for row in codes], pa.binary()), pa.array(np.sqrt(left) + 1e-7)], schema=arrow)

    rows = materialize(chunks.mapInArrow(placed, schema))
    known = materialize(rows.groupBy("cell").agg(
        F.max("dist").alias("radius"), F.count("*").alias("size"), F.ceil(F.count("*") / SLICE_ROWS).cast("int").alias("slices")))
    slices = F.broadcast(known.select("cell", "slices"))  # MOST_CELLS rows
    rows = rows.join(slices, "cell").withColumn("slice", F.pmod(F.xxhash64("chunk_id"), F.col("slices")).cast("int")).drop("slices")
    rows.hint("rebalance", "cell").sortWithinPartitions("cell", "slice", "dist").write.partitionBy("cell").parquet(f"{path}/rows")
    made = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
    made.join(F.broadcast(known), "cell").coalesce(1).write.parquet(f"{path}/centres")
    spark.createDataFrame([(k, b.tolist()) for k, b in enumerate(books)], "part int, words array<array<double>>").coalesce(1).write.parquet(f"{path}/books")


def _centres(spark: SparkSession, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cells, centres, radii) of the cells that hold vectors: MOST_CELLS at most."""
    if "_SUCCESS" not in children(spark, f"{path}/books"):
        raise ValueError(f"no vector index in {path}")
    found = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()
    return (np.array([r["cell"] for r in found], int), np.array([r["centre"] for r in found]), np.array([r["radius"] for r in found]))


def _asked(queries: DataFrame, centres: tuple, choose) -> DataFrame:
    """(query_id, vec, cell, off, floor): a row for every cell that `choose` picks for a question.

    choose(distances, bounds, floors) -> mask, questions by cells; `off` is the distance to the centre. Emitted for the
    picked cells only, never for all pairs.
    """
    shared = queries.sparkSession.sparkContext.broadcast(centres)
    schema = T.StructType([queries.schema["query_id"], *T.StructType.fromDDL("vec array<double>, cell int, off double, floor double")])
    arrow = to_arrow_schema(schema)

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, centre, radius = shared.value
        for batch in batches:
            step = max(1, 4 * PRODUCT // max(1, centre.size))  # all cells of so many questions may be picked
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                unit = _unit(_matrix(part.column(1)))
                floor = part.column(2).to_numpy(zero_copy_only=False)
                off = _distances(unit, centre)
                bound = 1 - np.maximum(off - radius - 1e-9, 0) ** 2 / 2 + 10.0**-SCORE_DIGITS
                q, c = np.nonzero(choose(off, bound, floor))
                width = unit.shape[1]
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(q)), pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * width, pa.int32()), pa.array(unit[q].reshape(-1))),
                    pa.array(cells[c], pa.int32()), pa.array(off[q, c]), pa.array(floor[q])], schema=arrow)

    return queries.select("query_id", "embedding", "floor").mapInArrow(chosen, schema)


class _Top:
    """The k best rows of every question of a block so far: score descending, then id; with `distinct` an id counts once.

    `floor` is what a further row has to reach. Rows wait unsorted until there are many.
    """

    def __init__(self, floor: np.ndarray, k: int, distinct: bool):
        self.floor, self.k, self.distinct = floor.copy(), k, distinct
        self.held: list[tuple] = []
        self.size, self.limit = 0, max(LOOSE, 2 * k * len(floor))

    def add(self, q: np.ndarray, ids: pa.Array, score: np.ndarray, exact: np.ndarray) -> None:
        if len(q):
            self.held.append((q, ids, score, exact))
            self.size += len(q)
        if self.size > self.limit:
            self.settle()

    def settle(self) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
        if not self.held:
            return np.empty(0, int), pa.array([]), np.empty(0), np.empty(0)
        q, score, exact = (np.concatenate([h[i] for h in self.held]) for i in (0, 2, 3))
        ids = pa.concat_arrays([h[1] for h in self.held])
        code = pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        at = np.lexsort((code, -score, q))
        if self.distinct:
            _, one = np.unique(q[at] * (code.max() + 1) + code[at], return_index=True)
            at = at[np.sort(one)]
        start = np.searchsorted(q[at], np.arange(len(self.floor)))
        at = at[np.arange(len(at)) - start[q[at]] < self.k]
        q, ids, score, exact = q[at], ids.take(pa.array(at)), score[at], exact[at]
        end = np.searchsorted(q, np.arange(len(self.floor)), "right")
        full = np.flatnonzero(np.bincount(q, minlength=len(self.floor)) == self.k)
        self.floor[full] = np.maximum(self.floor[full], score[end[full] - 1])
        self.held, self.size = [(q, ids, score, exact)], len(q)
        return self.held[0]


def _rounded(score: np.ndarray) -> np.ndarray:
    return np.rint(score * 10**SCORE_DIGITS) / 10**SCORE_DIGITS


def _blocks(asked: DataFrame, centres: tuple, most: int, choose) -> tuple[DataFrame, DataFrame, int]:
    """(block, query_id, embedding, floor), (block, cell, near) of the cells that `choose` picks for a question of the block, and the
    number of blocks.

    Blocks are runs of nearest cells, ordered along the centres' widest direction; a cell of many questions is split by a hash.
    """
    spark = asked.sparkSession
    cells, centre, radius = centres
    shared = spark.sparkContext.broadcast(centres)
    schema = T.StructType([*asked.select("query_id", "embedding", "floor").schema, T.StructField("home", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        step = max(1, PRODUCT // max(1, len(shared.value[0])))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                yield part, _distances(_unit(_matrix(part.column(1))), shared.value[1])

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, off in steps(batches):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(off.argmin(1), pa.int32())], schema=arrow)

    def picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {}
        for part, off in steps(batches):
            block = part.column(3).to_numpy()
            chosen = choose(off, _bound(off, shared.value[2]), part.column(2).to_numpy(zero_copy_only=False))
            for b in np.unique(block):
                one = (np.zeros(len(cells), bool), np.full(len(cells), np.inf)) if b not in seen else seen[b]
                seen[b] = (one[0] | chosen[block == b].any(0), np.fmin(one[1], np.fmin.reduce(off[block == b], 0)))
        for b, (wanted, near) in seen.items():
            at = np.flatnonzero(wanted)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), b), pa.int32()), pa.array(shared.value[0][at], pa.int32()), pa.array(near[at])], ["block", "cell", "near"])

    placed = materialize(asked.select("query_id", "embedding", "floor").mapInArrow(homes, schema))
    sizes = {r["home"]: r["count"] for r in placed.groupBy("home").count().collect()}  # MOST_CELLS rows
    target = min(most, max(LEAST_BLOCK, -(-sum(sizes.values()) // BLOCKS)))
    spare = centre - centre.mean(0)
    line = np.nan_to_num(spare @ np.linalg.eigh(np.nan_to_num(spare.T @ spare))[1][:, -1])
    table, block, filled = [], 0, 0
    for home in np.argsort(line, kind="stable").tolist():
        n = sizes.get(home, 0)
        parts = -(-n // target)
        if filled and filled + n > target:
            block, filled = block + 1, 0
        table.append((home, block, max(1, parts)))
        block, filled = (block + parts, 0) if parts > 1 else (block, filled + n)
    table = spark.createDataFrame(table, "home int, first int, parts int")
    dealt = placed.join(F.broadcast(table), "home").select(  # MOST_CELLS rows
        "query_id", "embedding", "floor", (F.col("first") + F.pmod(F.xxhash64("query_id", "embedding"), F.col("parts"))).cast("int").alias("block"))
    dealt = materialize(dealt)
    wanted = dealt.mapInArrow(picked, "block int, cell int, near double").groupBy("block", "cell").agg(F.min("near").alias("near"))
    return dealt, materialize(wanted), block + 1


def _bound(off: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The highest cosine that a cell can hold for a question at distance `off` of its centre."""
    return 1 - np.maximum(off - radius - 1e-9, 0) ** 2 / 2 + 10.0**-SCORE_DIGITS


def _met(asked: DataFrame, centres: tuple, path: str, columns: list[str], schema: T.StructType, most: int, choose, begin) -> DataFrame:
    """The hits of every question among the cells that `choose` picks for it.

    A block's questions come first, then the rows of its cells, each copied to the blocks that ask for its cell.
    begin(vectors, floors, cells chosen) makes what meets the rows: meet(cell, batch), and end() with (question, id, score).
    """
    spark = asked.sparkSession
    dealt, wanted, blocks = _blocks(asked, centres, most, choose)
    rows = _rows(spark, path, wanted).select("cell", *columns).join(F.broadcast(wanted), "cell")  # blocks x MOST_CELLS rows
    types = {f.name: f.dataType for f in [*rows.schema, *dealt.withColumnRenamed("embedding", "vec").schema]}
    names = ["cell", *columns, "query_id", "vec", "floor"]
    shared = spark.sparkContext.broadcast(centres)

    def lined(df: DataFrame, kind: int) -> DataFrame:
        near = F.col("near") if kind else F.lit(0.0)
        return df.select("block", F.lit(kind).alias("kind"), near.alias("near"), *[(F.col(c) if c in df.columns else F.lit(None)).cast(types[c]).alias(c) for c in names])

    both = lined(dealt.withColumnRenamed("embedding", "vec"), 0).unionByName(lined(rows, 1))
    arrow = to_arrow_schema(schema)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, ready = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if ready is not None:
                q, ids, score = ready.end()
                if len(q):
                    yield pa.RecordBatch.from_arrays([asking.take(pa.array(q)).cast(arrow.field(0).type), ids.cast(arrow.field(1).type), pa.array(score)], schema=arrow)

        for batch in batches:
            col = {c: batch.column(c) for c in ("block", "kind", "cell")}
            block, kind = col["block"].to_numpy(), col["kind"].to_numpy()
            cell = col["cell"].fill_null(-1).to_numpy()
            edge = np.flatnonzero(np.diff(block, prepend=-1) | np.diff(kind, prepend=-1) | np.diff(cell, prepend=-2))
            for lo, hi in zip(edge, [*edge[1:], batch.num_rows]):
                if block[lo] != here:
                    yield from done()
                    here, held, ready = block[lo], [], None
                if kind[lo] == 0:
                    held.append(batch.slice(lo, hi - lo).select(["query_id", "vec", "floor"]))
                    continue
                if ready is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    asking, held = table.column("query_id").combine_chunks(), []
                    vectors, floor = _unit(_matrix(table.column("vec").combine_chunks())), table.column("floor").to_numpy()
                    off = _distances(vectors, shared.value[1])
                    chosen = choose(off, _bound(off, shared.value[2]), floor)
                    ready = begin(vectors, floor, off, chosen)
                ready.meet(int(np.searchsorted(shared.value[0], cell[lo])), batch.slice(lo, hi - lo))
        yield from done()

    dealt = both.repartition(4 * blocks, "block")
    order = ["block", "kind", "near", "cell", *(["dist"] if "dist" in columns else [])]
    return dealt.sortWithinPartitions(*order).mapInArrow(met, schema)


class _Exact:
    """The best k for each question; only vectors that the triangle inequality can't leave out are scored.

    With `lists` above 1, a question has that many cells, and each gives its own best k, repeated rows as they come.
    """

    def __init__(self, k: int, counter, radius: np.ndarray, lists: int, vectors: np.ndarray, floor: np.ndarray, off: np.ndarray, chosen: np.ndarray):
        self.counter, self.radius, self.vectors, self.off, self.chosen, self.lists = counter, radius, vectors, off, chosen, lists
        self.top = _Top(np.repeat(floor, lists), k, lists == 1)

    def meet(self, cell: int, rows: pa.RecordBatch) -> None:
        off = self.off[:, cell]
        line = np.arange(len(off)) * self.lists + (self.chosen[:, :cell].sum(1) if self.lists > 1 else 0)
        floor = self.top.floor[np.minimum(line, len(self.top.floor) - 1)]
        at = np.flatnonzero(self.chosen[:, cell] & ~(_bound(off, self.radius[cell]) < floor))
        if not len(at):
            return
        ids, dist = rows.column("chunk_id"), rows.column("dist").to_numpy()
        unit = _unit(_matrix(rows.column("embedding")))
        step = max(1, PRODUCT // len(dist))
        for at in np.split(at, range(step, len(at), step)):
            reach = np.sqrt(np.maximum(2 - 2 * (floor[at] - 10.0**-SCORE_DIGITS), 0)) + 1e-9
            first, end = np.searchsorted(dist, off[at] - reach), np.searchsorted(dist, off[at] + reach, "right")
            size = (end - first).clip(0)
            if 3 * int(size.sum()) > len(at) * len(dist):  # little to leave out: all questions in one product
                self._count(len(at) * len(dist))
                score = _rounded(self.vectors[at] @ unit.T)
                q, found = np.nonzero(score >= floor[at][:, None])
                self.top.add(line[at[q]], ids.take(pa.array(found)), score[q, found], score[q, found])
                continue
            self._count(int(size.sum()))
            q = np.repeat(np.arange(len(at)), size)
            found = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
            score = _rounded(_pairs(self.vectors[at], q, unit, found))
            good = score >= floor[at][q]
            self.top.add(line[at[q[good]]], ids.take(pa.array(found[good])), score[good], score[good])

    def _count(self, n: int) -> None:
        if self.counter is not None:
            self.counter.add(n)

    def end(self) -> tuple:
        line, ids, score, _ = self.top.settle()
        return line // self.lists, ids, score


def _pairs(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of single pairs of rows, in steps."""
    step = max(1, PRODUCT // max(1, a.shape[1]))
    parts = [(a[i[at:at + step]] * b[j[at:at + step]]).sum(1) for at in range(0, len(i), step)]
    return np.concatenate(parts) if parts else np.empty(0)


class _Codes:
    """Cosines estimated from product codes; the `depth` best of each question are scored by their vectors.

    A question whose cells hold no more than `depth` vectors has all of them for its best: there only those are scored
    whose estimate, given the error that is stored with the code, may still reach the question's k-th score.
    """

    def __init__(self, k: int, depth: int, sizes: np.ndarray, shared, vectors: np.ndarray, floor: np.ndarray, off: np.ndarray, chosen: np.ndarray):
        self.shared, self.vectors, self.chosen = shared, vectors, chosen
        self.every = chosen @ sizes <= depth
        self.best = _Top(floor, k, True)  # by their vectors
        self.likely = _Top(floor, depth, False)  # by estimates, with the score that the vector gives

    def meet(self, cell: int, rows: pa.RecordBatch) -> None:
        at = np.flatnonzero(self.chosen[:, cell])
        if not len(at):
            return
        _, centres, books = self.shared.value
        ids, unit = rows.column("chunk_id"), _unit(_matrix(rows.column("embedding")))
        codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
        err = rows.column("err").to_numpy()
        near = centres[cell] + np.concatenate([words[codes[:, j]] for j, words in enumerate(books)], 1)
        step = max(1, PRODUCT // rows.num_rows)
        for at in np.split(at, range(step, len(at), step)):
            estimate = self.vectors[at] @ near.T
            every = self.every[at]
            worth = np.where(every[:, None], estimate + err + 10.0**-SCORE_DIGITS >= self.best.floor[at][:, None], estimate >= self.likely.floor[at][:, None])
            q, found = np.nonzero(worth)
            score = (self.vectors[at] @ unit.T)[q, found] if 8 * len(q) > worth.size else _pairs(self.vectors[at], q, unit, found)
            score, all_of = _rounded(score), every[q]
            good = all_of & (score >= self.best.floor[at][q])
            self.best.add(at[q[good]], ids.take(pa.array(found[good])), score[good], score[good])
            good = ~all_of
            self.likely.add(at[q[good]], ids.take(pa.array(found[good])), estimate[q, found][good], score[good])

    def end(self) -> tuple:
        q, ids, _, exact = self.likely.settle()
        if len(q):
            self.best.add(q, ids, exact, exact)
        return self.best.settle()[:3]


def _questions(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "embedding", F.lit(-2.0).alias("floor")).where("embedding is not null")


def _rows(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The stored rows of the cells asked for: a filter of partitions."""
    wanted = sorted(r[0] for r in asked.select("cell").distinct().collect())  # MOST_CELLS at most
    return spark.read.parquet(f"{path}/rows").where(F.col("cell").isin(wanted))


def _ranked(hits: DataFrame, k: int, method: str) -> DataFrame:
    best = top_k(hits.select("query_id", "chunk_id", "score"), ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k)
    return best.withColumn("distance", F.round(1 - F.col("score"), SCORE_DIGITS)).withColumn("method", F.lit(method))


def search(queries: DataFrame, path: str, k: int, counter=None) -> DataFrame:
    """Exact cosine top-k of every query: query_id, chunk_id, score, rank, distance, method (as `search.knn`).

    Rows that share a query_id are one question of several vectors: its hits are the best of all of them. counter: an
    accumulator that gets the number of vectors scored.
    """
    spark = queries.sparkSession
    centres = _centres(spark, path)
    asked = materialize(_questions(queries))
    if not len(centres[0]):
        none = T.StructType([queries.schema["query_id"], *T.StructType.fromDDL("chunk_id string, score double")])
        return _ranked(spark.createDataFrame([], none), k, "knn_cells")
    ids = spark.read.parquet(f"{path}/rows").schema["chunk_id"]
    schema = T.StructType([queries.schema["query_id"], ids, T.StructField("score", T.DoubleType())])
    columns = ["chunk_id", "embedding", "dist"]
    radius = centres[2]

    def nearest(off: np.ndarray, bound: np.ndarray, floor: np.ndarray) -> np.ndarray:
        return off.argsort(1, kind="stable").argsort(1) < SEED_CELLS

    def reached(off: np.ndarray, bound: np.ndarray, floor: np.ndarray) -> np.ndarray:
        return (bound >= floor[:, None]) & ~nearest(off, bound, floor)

    def begin(lists: int):
        return lambda *block: _Exact(k, counter, radius, lists, *block)

    hits = materialize(_met(asked, centres, path, columns, schema, BLOCK_ROWS, nearest, begin(min(SEED_CELLS, len(radius)))))
    kth = top_k(hits, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], k).where(f"rank = {k}").select("query_id", F.col("score").alias("_kth"))
    raised = asked.join(broadcast_if_small(kth, 200_000), "query_id", "left").select(
        "query_id", "embedding", F.coalesce("_kth", "floor").alias("floor"))
    hits = hits.unionByName(_met(raised, centres, path, columns, schema, BLOCK_ROWS, reached, begin(1)))
    return _ranked(hits.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k, "knn_cells")


def search_codes(queries: DataFrame, path: str, k: int, probes: int | None = 8, depth: int | None = None) -> DataFrame:
    """Cosine top-k among the `probes` nearest cells of every query (all cells if None), columns as `search`.

    The `depth` best by their codes (32 k unless given) are scored by their vectors, exactly.
    """
    spark = queries.sparkSession
    depth = depth or 32 * k
    cells, centre, radius = centres = _centres(spark, path)
    asked = materialize(_questions(queries))
    probes = min(len(cells), probes or len(cells))

    def nearest(off: np.ndarray, bound: np.ndarray, floor: np.ndarray) -> np.ndarray:
        return off.argsort(1, kind="stable").argsort(1) < probes

    stored = spark.read.parquet(f"{path}/rows")
    books = [np.array(r["words"]) for r in spark.read.parquet(f"{path}/books").orderBy("part").collect()]  # WORDS vectors
    if not books:
        raise ValueError(f"the index in {path} has no codes")
    sizes = np.array([r["size"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").collect()])
    schema = T.StructType([queries.schema["query_id"], stored.schema["chunk_id"], T.StructField("score", T.DoubleType())])
    shared = spark.sparkContext.broadcast((cells, centre, books))

    def begin(*block) -> _Codes:
        return _Codes(k, depth, sizes, shared, *block)

    most = max(1, min(BLOCK_ROWS // 2, PRODUCT // depth))  # a block keeps `depth` estimates a question
    if sizes.sum() <= depth:
        most = BLOCK_ROWS  # no question has more vectors than that, so none are kept
    scored = _met(asked, centres, path, ["chunk_id", "code", "err", "embedding"], schema, most, nearest, begin)
    return _ranked(scored.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")), k, "knn_codes")


def fit_probes(queries: DataFrame, path: str, k: int, target: float = 0.97, sample: int = 256) -> int:
    """The number of nearest cells that hold `target` of the exact hits of a sample of the queries.

    Fitted to `sample` queries at most, picked by a hash. Vectors that form no clusters need most of the cells.
    """
    spark = queries.sparkSession
    some = materialize(queries.where("embedding is not null").orderBy(F.xxhash64("query_id", "embedding")).limit(sample))
    every = _asked(_questions(some), _centres(spark, path), lambda off, bound, floor: off > -1)  # sample x MOST_CELLS rows at most
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("off", "cell"))
    hits = search(some, path, k).select("query_id", "chunk_id")
    at = spark.read.parquet(f"{path}/rows").select("chunk_id", "cell").join(F.broadcast(hits), "chunk_id")  # sample x k rows
    found = at.join(every.select("query_id", "cell", place.alias("place")), ["query_id", "cell"])
    return int(found.agg(F.percentile("place", target)).first()[0] or 1) + 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, wanted, recall: the share of the exact hits that have been found; hits of equal score stand for each other."""
    least = exact.groupBy("query_id").agg(F.min("score").alias("_least"), F.count("*").alias("_wanted"))
    good = found.join(least, "query_id").where("score >= _least").groupBy("query_id").agg(F.count("*").alias("_found"))
    both = least.join(good, "query_id", "left")
    return both.agg(
        F.count("*").alias("queries"), F.sum("_wanted").alias("wanted"), (F.sum(F.least(F.coalesce("_found", F.lit(0)), "_wanted")) / F.sum("_wanted")).alias("recall"))
