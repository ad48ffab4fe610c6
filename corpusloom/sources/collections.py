"""Named collections: a log of commits over folders that are written once.

    <root>/log/<n>.json                       commit n, one line of what it changes; <n>.state.json: all up to it
    <root>/rows/<folder>/id_part=<part>/id_bucket=<b>/   chunk_id, content, url, embedding, ...
    <root>/filters/<folder>/id_part=<part>/   id_bucket, slot, held: a Bloom filter of each bucket's ids

A collection is an entry of the log: name, folder, model, distance, and its parts with their rows, columns and filters.
Jobs write a part first and commit it then, so a job that dies leaves nothing that is read; renaming is one commit and
moves nothing. Two writers that commit the same number: one finds the name taken, reads the log again and goes on.
Appending by id reads the filters; of the stored rows it reads the ids of those buckets whose filter an id hits.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom import schemas
from corpusloom.session import broadcast_if_small, keep_first, materialize
from corpusloom.sources.files import children, drop, read_text, write_new

REQUIRED = ("chunk_id", "content", "url")
BUCKETS = 32  # of ids; fixed for a root, as all parts share it
SLOT_BITS = 32768  # what bitmap_construct_agg packs into one value
HASHES, BITS_PER_ID = 6, 24  # one id in some 10,000 hits a filter without being there
STATE_EVERY = 20  # commits between two states, so that a reader replays few


# ---- log ------------------------------------------------------------------------


def _numbers(spark: SparkSession, root: str) -> tuple[list[int], list[int]]:
    names = children(spark, f"{root}/log")
    states = sorted(int(n.split(".")[0]) for n in names if n.endswith(".state.json"))
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.count(".") == 1), states


def _apply(state: dict, change: dict) -> dict:
    """The collections after one commit. Every change names whole entries, so replaying one twice does no harm."""
    state = {**state, **change.get("put", {})}
    return {name: entry for name, entry in state.items() if name not in change.get("drop", [])}


def _state(spark: SparkSession, root: str) -> tuple[int, dict]:
    """(number of the last commit, collections by name)."""
    commits, states = _numbers(spark, root)
    at, state = 0, {}
    if states:
        at, state = states[-1], json.loads(read_text(spark, f"{root}/log/{states[-1]:012d}.state.json"))
    for n in commits:
        if n > at:
            state, at = _apply(state, json.loads(read_text(spark, f"{root}/log/{n:012d}.json"))), n
    return at, state


def _commit(spark: SparkSession, root: str, make: Callable[[dict], dict | None]) -> dict | None:
    """Write the change that `make` derives from the collections as they are; None from it means nothing to do."""
    while True:
        at, state = _state(spark, root)
        change = make(state)
        if change is None:
            return None
        if write_new(spark, f"{root}/log/{at + 1:012d}.json", json.dumps(change)):
            if (at + 1) % STATE_EVERY == 0:
                write_new(spark, f"{root}/log/{at + 1:012d}.state.json", json.dumps(_apply(state, change)))
            return change


def exists(spark: SparkSession, root: str, name: str) -> bool:
    return name in _state(spark, root)[1]


def create_collection(
    spark: SparkSession, root: str, name: str, model: str = "default", distance: str = "cosine"
) -> None:
    """Open or create: an existing collection keeps its stored model and distance."""
    new = {"folder": uuid.uuid4().hex, "model": model, "distance": distance, "parts": [], "batches": {}}
    _commit(spark, root, lambda state: None if name in state else {"put": {name: new}})


def delete_collection(spark: SparkSession, root: str, name: str) -> None:
    gone: list[str] = []

    def change(state: dict) -> dict | None:
        gone[:] = [state[name]["folder"]] if name in state else []
        return {"drop": [name]} if gone else None

    _commit(spark, root, change)
    for folder in gone:
        drop(spark, f"{root}/rows/{folder}")
        drop(spark, f"{root}/filters/{folder}")


def rename_collection(spark: SparkSession, root: str, old: str, new: str) -> None:
    """Give the collection the new name: one commit, no row moves."""

    def change(state: dict) -> dict:
        if new in state:
            raise ValueError(f"collection {new!r} already exists")
        if old not in state:
            raise ValueError(f"collection {old!r} does not exist")
        return {"put": {new: state[old]}, "drop": [old]}

    _commit(spark, root, change)


def list_collections(spark: SparkSession, root: str) -> DataFrame:
    """collection, embedding_model, distance_function, chunks: from the log alone."""
    rows = [(name, e["model"], e["distance"], sum(p["rows"] for p in e["parts"])) for name, e in sorted(_state(spark, root)[1].items())]
    return spark.createDataFrame(rows, "collection string, embedding_model string, distance_function string, chunks long")


# ---- parts ----------------------------------------------------------------------


def check_rows(chunks: DataFrame) -> DataFrame:
    """Fail the job on a row without id, document or metadata (inside the tasks, no extra pass)."""
    for c in REQUIRED:
        chunks = chunks.withColumn(
            c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"collection row without {c}"))).otherwise(F.col(c))
        )
    return chunks


def _bucket(chunk_id: Column) -> Column:
    return F.pmod(F.xxhash64(chunk_id.cast("string")), F.lit(BUCKETS)).cast("int")


def _places(ids: DataFrame, slots: Column, *keep: str) -> DataFrame:
    """A row for each of the HASHES bits of an id: its slot and the bit in it."""
    hashes = F.array(*[F.pmod(F.xxhash64(F.col("chunk_id").cast("string"), F.lit(k + 1)), slots * SLOT_BITS) for k in range(HASHES)])
    each = ids.select("chunk_id", "id_bucket", *keep, F.explode(hashes).alias("_place"))
    return each.select("chunk_id", "id_bucket", *keep, F.floor(F.col("_place") / SLOT_BITS).cast("int").alias("slot"), (F.col("_place") % SLOT_BITS).alias("bit"))


def _write_part(chunks: DataFrame, root: str, folder: str) -> dict:
    """Write rows as a part of their own, without a filter yet."""
    part = uuid.uuid4().hex
    rows = chunks.withColumn("id_bucket", _bucket(F.col("chunk_id")))
    rows.hint("rebalance", "id_bucket").write.partitionBy("id_bucket").parquet(f"{root}/rows/{folder}/id_part={part}")
    return {"part": part, "schema": json.loads(chunks.schema.json())}


def _with_filter(spark: SparkSession, root: str, folder: str, part: dict) -> dict:
    """Count a part's rows and write the Bloom filters of its ids, a slot a row."""
    ids = _ids(spark, root, folder, [part])
    sizes = ids.groupBy("id_bucket").agg(F.count("*").alias("n")).agg(F.max("n"), F.sum("n")).first()
    slots = max(1, -(-(sizes[0] or 0) * BITS_PER_ID // SLOT_BITS))
    held = _places(ids, F.lit(slots)).groupBy("id_bucket", "slot").agg(F.bitmap_construct_agg("bit").alias("held"))
    held.write.mode("overwrite").parquet(f"{root}/filters/{folder}/id_part={part['part']}")
    return {**part, "rows": int(sizes[1] or 0), "slots": slots}


def _schema(parts: list[dict]) -> T.StructType:
    """The columns of all parts, each of the type that it had first."""
    fields: dict[str, T.StructField] = {}
    for p in parts:
        for f in T.StructType.fromJson(p["schema"]).fields:
            fields.setdefault(f.name, f)
    return T.StructType(list(fields.values()))


def _rows(spark: SparkSession, root: str, folder: str, parts: list[dict]) -> DataFrame:
    schema = T.StructType([*_schema(parts).fields, T.StructField("id_part", T.StringType()), T.StructField("id_bucket", T.IntegerType())])
    base = f"{root}/rows/{folder}"
    return spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/id_part={p['part']}" for p in parts]).drop("id_part")


def _ids(spark: SparkSession, root: str, folder: str, parts: list[dict]) -> DataFrame:
    return _rows(spark, root, folder, parts).select("chunk_id", "id_bucket")


def _known(spark: SparkSession, root: str, entry: dict, part: dict) -> DataFrame | None:
    """The ids of a new part that its collection holds already; None if no filter is hit."""
    folder, parts = entry["folder"], [p for p in entry["parts"] if p["rows"]]
    if not parts:
        return None
    new = _ids(spark, root, folder, [part])
    hits = []
    for slots in sorted({p["slots"] for p in parts}):  # filters of one size are asked at once
        same = [p["part"] for p in parts if p["slots"] == slots]
        base = f"{root}/filters/{folder}"
        filters = spark.read.schema("id_bucket int, slot int, held binary, id_part string").option("basePath", base).parquet(
            *[f"{base}/id_part={p}" for p in same])
        byte = F.conv(F.hex(F.substring("held", (F.floor(F.col("bit") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        asked = _places(new, F.lit(slots)).join(filters, ["id_bucket", "slot"]).select("chunk_id", "id_bucket", "id_part", "bit", byte.alias("_byte"))
        found = asked.where(F.expr("getbit(_byte, cast(bit % 8 as int)) = 1"))
        per = found.groupBy("chunk_id", "id_bucket", "id_part").agg(F.count("*").alias("_n"))
        hits.append(per.where(F.col("_n") >= HASHES).select("chunk_id", "id_bucket"))
    hit = materialize(reduce(DataFrame.unionAll, hits).distinct())
    buckets = sorted(r[0] for r in hit.select("id_bucket").distinct().collect())  # BUCKETS at most
    if not buckets:
        return None
    stored = _ids(spark, root, folder, parts).where(F.col("id_bucket").isin(buckets))
    return materialize(stored.join(broadcast_if_small(hit.select("chunk_id"), 500_000), "chunk_id", "left_semi").select("chunk_id").distinct())


def merge_by_id(existing: DataFrame, incoming: DataFrame, mode: str = "keep") -> DataFrame:
    """Rows to append ("keep": the id already stored wins) or the merged whole ("replace": the new row wins)."""
    incoming = keep_first(incoming, ["chunk_id"], [F.xxhash64("content"), F.col("content")]).drop("_copies")
    if mode == "keep":
        return incoming.join(existing.select("chunk_id"), "chunk_id", "left_anti")
    if mode == "replace":
        kept = existing.join(incoming.select("chunk_id"), "chunk_id", "left_anti")
        return kept.unionByName(incoming, allowMissingColumns=True)
    raise ValueError(f"unknown mode {mode!r}")


# ---- writing ----------------------------------------------------------------------


def write_collection(chunks: DataFrame, root: str, name: str, mode: str = "overwrite", **meta: str) -> None:
    """Replace ("overwrite") or extend ("append", without a look at ids) the rows of a collection."""
    spark, root = chunks.sparkSession, root.rstrip("/")
    create_collection(spark, root, name, **meta)
    folder = _state(spark, root)[1][name]["folder"]
    part = _with_filter(spark, root, folder, _write_part(check_rows(chunks), root, folder))
    old: list[dict] = []

    def change(state: dict) -> dict:
        entry = _open(state, name, folder)
        old[:] = entry["parts"] if mode == "overwrite" else []
        return {"put": {name: {**entry, "parts": [part] if mode == "overwrite" else [*entry["parts"], part]}}}

    _commit(spark, root, change)
    _drop_parts(spark, root, folder, old)


def _open(state: dict, name: str, folder: str) -> dict:
    entry = state.get(name)
    if entry is None or entry["folder"] != folder:
        raise ValueError(f"collection {name!r} was dropped or renamed meanwhile")
    return entry


def _drop_parts(spark: SparkSession, root: str, folder: str, parts: list[dict]) -> None:
    for p in parts:
        drop(spark, f"{root}/rows/{folder}/id_part={p['part']}")
        drop(spark, f"{root}/filters/{folder}/id_part={p['part']}")


def append_collection(chunks: DataFrame, root: str, name: str, mode: str = "keep", batch: tuple[str, int] | None = None) -> bool:
    """Append by id: a stored id wins ("keep") or its row is replaced ("replace"). False if nothing had to be done.

    The new rows are written as they come and their ids compared with the filters; only if some are known the part is
    written again without them, or the stored parts that hold them are. batch: (stream, number); a number that the
    stream has committed already is recognised by the log, and nothing is read.
    """
    if mode not in ("keep", "replace"):
        raise ValueError(f"unknown mode {mode!r}")
    spark, root = chunks.sparkSession, root.rstrip("/")
    create_collection(spark, root, name)
    fresh = None
    while True:
        at, state = _state(spark, root)
        entry = state[name]
        folder = entry["folder"]
        if batch and entry["batches"].get(batch[0], -1) >= batch[1]:
            if fresh:
                _drop_parts(spark, root, folder, [fresh])
            return False
        if fresh is None:
            unique = keep_first(check_rows(chunks), ["chunk_id"], [F.xxhash64("content"), F.col("content")]).drop("_copies")
            fresh = _write_part(unique.select(*chunks.columns), root, folder)
        known = _known(spark, root, entry, fresh)
        parts, part, gone = entry["parts"], fresh, []
        if known is not None and not known.isEmpty():
            if mode == "keep":
                rest = _rows(spark, root, folder, [fresh]).drop("id_bucket").join(known, "chunk_id", "left_anti")
                part, gone = _write_part(rest.select(*chunks.columns), root, folder), [fresh]
            else:
                parts, gone = _without(spark, root, folder, parts, known)
        made = [p for p in parts if p not in entry["parts"]]
        part = _with_filter(spark, root, folder, part)
        batches = {**entry["batches"], batch[0]: batch[1]} if batch else entry["batches"]
        change = {"put": {name: {**entry, "parts": [*parts, part] if part["rows"] else parts, "batches": batches}}}
        # the look at the ids holds for this state only: another writer's commit in between means another look
        if write_new(spark, f"{root}/log/{at + 1:012d}.json", json.dumps(change)):
            if (at + 1) % STATE_EVERY == 0:
                write_new(spark, f"{root}/log/{at + 1:012d}.state.json", json.dumps(_apply(state, change)))
            _drop_parts(spark, root, folder, gone)
            return True
        _drop_parts(spark, root, folder, [p for p in [*made, part] if p["part"] != fresh["part"]])


def _without(spark: SparkSession, root: str, folder: str, parts: list[dict], known: DataFrame) -> tuple[list[dict], list[dict]]:
    """(parts without the known ids, parts that they stand for): parts that hold none of them stay as they are."""
    kept, gone = [], []
    for p in parts:
        rows = _rows(spark, root, folder, [p]).drop("id_bucket")
        if rows.select("chunk_id").join(known, "chunk_id", "left_semi").isEmpty():
            kept.append(p)
            continue
        gone.append(p)
        part = _with_filter(spark, root, folder, _write_part(rows.join(known, "chunk_id", "left_anti").select(*rows.columns), root, folder))
        kept += [part] if part["rows"] else []
    return kept, gone


def compact_collection(spark: SparkSession, root: str, name: str) -> None:
    """Write the parts of a collection as one: many small appends make many filters."""
    root = root.rstrip("/")
    at, state = _state(spark, root)
    entry = state[name]
    if len(entry["parts"]) < 2:
        return
    rows = _rows(spark, root, entry["folder"], entry["parts"]).drop("id_bucket")
    part = _with_filter(spark, root, entry["folder"], _write_part(rows, root, entry["folder"]))

    def change(now: dict) -> dict:
        own = _open(now, name, entry["folder"])
        old = {p["part"] for p in entry["parts"]}
        if not old <= {p["part"] for p in own["parts"]}:
            raise ValueError(f"rows of collection {name!r} were replaced meanwhile")
        return {"put": {name: {**own, "parts": [part, *[p for p in own["parts"] if p["part"] not in old]]}}}

    _commit(spark, root, change)
    _drop_parts(spark, root, entry["folder"], entry["parts"])


def vacuum(spark: SparkSession, root: str) -> int:
    """Drop the folders that no collection names, left by jobs that died; how many. Not while a job writes."""
    root = root.rstrip("/")
    used = {(e["folder"], p["part"]) for e in _state(spark, root)[1].values() for p in e["parts"]}
    dropped = 0
    for kind in ("rows", "filters"):
        for folder in children(spark, f"{root}/{kind}"):
            for part in children(spark, f"{root}/{kind}/{folder}"):
                if (folder, part.removeprefix("id_part=")) not in used:
                    drop(spark, f"{root}/{kind}/{folder}/{part}")
                    dropped += 1
    return dropped


# ---- reading ----------------------------------------------------------------------


def read_collection(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The rows of a collection; without any an empty frame of the chunk schema. No job is run to find them."""
    entry = _state(spark, root.rstrip("/"))[1].get(name)
    if entry is None or not entry["parts"]:
        rows = spark.createDataFrame([], schemas.CHUNKS)
    else:
        rows = _rows(spark, root.rstrip("/"), entry["folder"], entry["parts"]).drop("id_bucket")
    return rows.withColumn("collection", F.lit(name))


def get_rows(chunks: DataFrame, limit: int | None = None, include: list[str] | None = None) -> DataFrame:
    """First rows by id with only the columns asked for."""
    out = chunks.select("chunk_id", *[c for c in (include or chunks.columns) if c != "chunk_id"])
    return out if limit is None else out.orderBy("chunk_id").limit(limit)


def get_collection(
    spark: SparkSession, root: str, name: str, limit: int | None = None, include: list[str] | None = None
) -> DataFrame:
    return get_rows(read_collection(spark, root, name), limit, include)
