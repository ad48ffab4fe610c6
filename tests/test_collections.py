import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.sources import collections as S
from corpusloom.sources import files
from corpusloom.streaming import jobs

CHUNK = "chunk_id string, url string, content string"


def chunks(spark, ids, text="a"):
    return spark.createDataFrame([(str(i), "u", f"{text}{i}") for i in ids], CHUNK)


def stored(spark, root, name="c"):
    return {r["chunk_id"]: r["content"] for r in S.read_collection(spark, root, name).collect()}


def test_renaming_is_one_commit_and_moves_nothing(spark, folder):
    S.write_collection(chunks(spark, range(50)), folder, "old", model="m")
    files_before = sorted(f for _, _, fs in os.walk(f"{folder}/rows") for f in fs)
    commits = len(os.listdir(f"{folder}/log"))
    S.rename_collection(spark, folder, "old", "new/1=x")
    assert sorted(f for _, _, fs in os.walk(f"{folder}/rows") for f in fs) == files_before
    names = [n for n in os.listdir(f"{folder}/log") if not n.endswith(".crc")]
    assert len(names) == len([n for n in names if n.endswith(".json")]) and len(os.listdir(f"{folder}/log")) - commits <= 2
    assert len(stored(spark, folder, "new/1=x")) == 50 and not S.exists(spark, folder, "old")
    assert [tuple(r) for r in S.list_collections(spark, folder).collect()] == [("new/1=x", "m", "cosine", 50)]


def test_an_append_of_new_ids_reads_no_stored_id(spark, folder, monkeypatch):
    S.append_collection(chunks(spark, range(3000)), folder, "c")
    S.append_collection(chunks(spark, range(3000, 3100)), folder, "c")
    read = []
    plain = S._ids
    monkeypatch.setattr(S, "_ids", lambda spark, root, where, parts: read.append(len(parts)) or plain(spark, root, where, parts))
    S.append_collection(chunks(spark, range(3100, 3105)), folder, "c")
    assert read == [1, 1]  # the new part's own ids, for the look and for its filter
    read.clear()
    plans = []
    kept = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df: plans.append(df._jdf.queryExecution().toString()) or kept(df))
    S.append_collection(chunks(spark, [7, 5000], "b"), folder, "c")
    assert read == [1, 3, 1]
    assert "PartitionFilters: [isnotnull(id_bucket" in plans[-1] and "ReadSchema: struct<chunk_id:string>" in plans[-1]
    got = stored(spark, folder)
    assert len(got) == 3106 and got["7"] == "a7" and got["5000"] == "b5000"


def test_filters_know_every_id(spark, folder):
    S.append_collection(chunks(spark, range(0, 4000, 2)), folder, "c")
    S.append_collection(chunks(spark, range(1, 1000, 2)), folder, "c")
    S.append_collection(chunks(spark, range(4000), "new"), folder, "c", mode="replace")
    assert stored(spark, folder) == {str(k): f"new{k}" for k in range(4000)}
    S.append_collection(chunks(spark, range(4100), "later"), folder, "c")
    assert stored(spark, folder) == {str(k): f"{'new' if k < 4000 else 'later'}{k}" for k in range(4100)}
    S.compact_collection(spark, folder, "c")
    assert len(S._state(spark, folder)[1]["c"]["parts"]) == 1 and len(stored(spark, folder)) == 4100
    assert not S.append_collection(chunks(spark, [1]), folder, "c", batch=("s", 3)) is None
    assert stored(spark, folder)["1"] == "new1"


def test_replaced_rows_leave_other_parts_alone(spark, folder):
    for at in (0, 100, 200):
        S.append_collection(chunks(spark, range(at, at + 20)), folder, "c")
    before = [p["part"] for p in S._state(spark, folder)[1]["c"]["parts"]]
    S.append_collection(chunks(spark, [105], "b").withColumn("more", F.lit(1)), folder, "c", mode="replace")
    after = [p["part"] for p in S._state(spark, folder)[1]["c"]["parts"]]
    assert before[0] in after and before[2] in after and before[1] not in after
    rows = S.read_collection(spark, folder, "c")
    assert rows.count() == 60 and [(r["content"], r["more"]) for r in rows.where("chunk_id in ('104', '105')").orderBy("chunk_id").collect()] == [("a104", None), ("b105", 1)]


@pytest.mark.parametrize("step", ["_write_part", "_with_filter", "write_new", "_drop_parts"])
def test_interrupted_writes(spark, folder, monkeypatch, step):
    S.append_collection(chunks(spark, range(10)), folder, "c")
    plain = getattr(S, step)

    def lost(*args, **more):
        if step == "_drop_parts":
            raise OSError("lost")
        plain(*args, **more) if step != "write_new" else None
        raise OSError("lost")

    for write in (lambda: S.append_collection(chunks(spark, [5, 11], "b"), folder, "c"),
                  lambda: S.append_collection(chunks(spark, [5, 12], "b"), folder, "c", mode="replace"),
                  lambda: S.write_collection(chunks(spark, [1], "b"), folder, "c")):
        before = stored(spark, folder)
        monkeypatch.setattr(S, step, lost)
        with pytest.raises(OSError):
            write()
        monkeypatch.setattr(S, step, plain)
        if step != "_drop_parts":  # the commit comes before old parts are dropped
            assert stored(spark, folder) == before
        write()
    assert stored(spark, folder) == {"1": "b1"}
    S.vacuum(spark, folder)
    parts = [p for where in os.listdir(f"{folder}/rows") for p in os.listdir(f"{folder}/rows/{where}")]
    assert len(parts) == 1 and stored(spark, folder) == {"1": "b1"} and S.vacuum(spark, folder) == 0


def test_two_writers_meet(spark, folder, monkeypatch):
    S.append_collection(chunks(spark, range(5)), folder, "c")
    plain, state = files.write_new, {"first": True}

    def raced(session, path, text):
        if state["first"]:  # another writer commits the same number, with an id that this one has as well
            state["first"] = False
            monkeypatch.setattr(S, "write_new", plain)
            S.append_collection(chunks(session, [10, 11], "other"), folder, "c")
        return plain(session, path, text)

    monkeypatch.setattr(S, "write_new", raced)
    S.append_collection(chunks(spark, [11, 12], "mine"), folder, "c")
    assert stored(spark, folder) == {**{str(k): f"a{k}" for k in range(5)}, "10": "other10", "11": "other11", "12": "mine12"}


def test_replayed_batches_and_states(spark, folder, monkeypatch):
    monkeypatch.setattr(S, "STATE_EVERY", 3)
    for n in range(7):
        assert S.append_collection(chunks(spark, [n]), folder, "c", batch=("stream", n))
    assert any(n.endswith(".state.json") for n in os.listdir(f"{folder}/log"))
    monkeypatch.setattr(S, "_write_part", None)  # a replayed batch writes and reads nothing
    assert not S.append_collection(chunks(spark, [6, 99]), folder, "c", batch=("stream", 6))
    assert sorted(stored(spark, folder)) == [str(n) for n in range(7)]
    last = max(n for n in os.listdir(f"{folder}/log") if n.endswith(".json"))
    assert json.loads(files.read_text(spark, f"{folder}/log/{last}"))


def test_a_stream_names_its_batches(spark, folder):
    schema = "page_id long, url string, html string"
    spark.createDataFrame([(1, "https://a.org/x", "<p>one</p>"), (2, "https://a.org/y", "<p>two</p>")], schema).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    jobs.stream_ingest(stream, f"{folder}/root", "live", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    entry = S._state(spark, f"{folder}/root")[1]["live"]
    assert list(entry["batches"].values()) == [0] and S.read_collection(spark, f"{folder}/root", "live").count() == 2
