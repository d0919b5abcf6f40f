import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerline import cli
from ledgerline.operators import lookup, resolve
from ledgerline.schema import DEL, OPS, PUT
from ledgerline.sources import files, log
from ledgerline.store import Store
from ledgerline.streaming import ingest


def held(store):
    return {bytes(r["key"]): bytes(r["value"]) for r in store.snapshot().collect()}


def test_put_overwrite_delete_and_reopen(spark, tmp_path):
    path = str(tmp_path / "s")
    with Store(spark, path) as store:
        store.write_many([(PUT, b"key1", b"val1"), (PUT, b"key2", b"val2"), (PUT, b"key1", b"val1_new"), (DEL, b"key2", None), (PUT, b"", b""), (PUT, b"\xff\x00", b"\x80")])
        assert store.get(b"key1") == b"val1_new" and store.get(b"key2") is None and store.get(b"none") is None
        assert store.get(b"") == b"" and store.get(b"\xff\x00") == b"\x80"
        assert store.stats()["memtable_entries"] == 4 and store.stats()["runs"] == 0
        store.delete(b"absent")
        assert store.stats()["memtable_bytes"] == (4 + 8 + 8) + (4 + 8) + 8 + (2 + 8 + 1) + (6 + 8)
        with pytest.raises(RuntimeError):
            Store(spark, path)
    with Store(spark, path) as store:
        assert store.stats()["runs"] == 1 and store.stats()["memtable_entries"] == 0
        assert held(store) == {b"key1": b"val1_new", b"": b"", b"\xff\x00": b"\x80"}
        store.flush()
        assert store.stats()["runs"] == 1


def test_compaction_purges_tombstones(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), l1_entries=20) as store:
        for batch in range(3):
            store.write_many([(PUT, f"key_{i}".encode(), f"batch_{batch}".encode()) for i in range(50)])
            store.flush()
        store.write_many([(PUT, b"key_0", b"final"), (DEL, b"key_5", None)])
        store.flush()
        runs = store.manifest().orderBy("run_rank").collect()
        assert [(r["level"], r["counter"], r["n_entries"], r["n_tombstones"]) for r in runs] == [(1, 0, 20, 0), (1, 1, 20, 0), (1, 2, 9, 0)]
        assert all(a["largest_key"] < b["smallest_key"] for a, b in zip(runs, runs[1:], strict=False))
        assert store.get(b"key_0") == b"final" and store.get(b"key_5") is None and store.get(b"key_49") == b"batch_2"
        store.write_many([(DEL, f"key_{i}".encode(), None) for i in range(50)])
        store.flush()
        store.compact()
        assert store.stats()["runs"] == 0 and held(store) == {}


def test_flush_at_the_byte_limit(spark, tmp_path):
    with Store(spark, str(tmp_path / "s"), memtable_bytes=1024) as store:
        store.write_many([(PUT, f"key_{i}".encode(), b"batch_0") for i in range(10)])
        assert store.stats()["runs"] == 0
        store.write_many([(PUT, f"key_{i}".encode(), b"batch_0") for i in range(60)])
        assert store.stats()["runs"] == 1 and store.stats()["memtable_entries"] == 0


def test_a_crash_before_the_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "s")
    store = Store(spark, path)
    store.put(b"a", b"1")
    monkeypatch.setattr(os, "rename", lambda *a: (_ for _ in ()).throw(OSError("crash")))
    with pytest.raises(OSError):
        store.flush()
    monkeypatch.undo()
    store.files.unlock()
    with Store(spark, path) as again:
        assert held(again) == {b"a": b"1"} and again.stats()["runs"] == 0
        assert any(x.startswith("runs/") for x in again.vacuum())
        assert held(again) == {b"a": b"1"}


def test_late_operations_count_by_seq(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as store:
        batch = lambda *rows: store.apply(spark.createDataFrame(list(rows), OPS))
        batch((10, PUT, b"a", b"new"), (11, DEL, b"b", None))
        batch((3, PUT, b"a", b"old"), (4, PUT, b"b", b"old"), (5, PUT, b"c", b"only"))
        assert held(store) == {b"a": b"new", b"c": b"only"} and store.stats()["seq"] == 11
        store.compact()  # the deletion of b is forgotten, so nothing older may come any more
        assert held(store) == {b"a": b"new", b"c": b"only"} and store.stats()["memtable_entries"] == 0
        with pytest.raises(ValueError):
            batch((9, PUT, b"b", b"older"))
        batch((12, PUT, b"b", b"newer"))
        assert held(store)[b"b"] == b"newer"


def test_a_failed_compaction_leaves_nothing(spark, tmp_path, monkeypatch):
    with Store(spark, str(tmp_path / "s")) as store:
        store.put(b"a", b"1")
        store.flush()
        before = store.manifest().collect()
        monkeypatch.setattr(resolve, "run_statistics", lambda *a: (_ for _ in ()).throw(RuntimeError("crash")))
        with pytest.raises(RuntimeError):
            store.compact()
        monkeypatch.undo()
        assert store.manifest().collect() == before and len(os.listdir(tmp_path / "s" / "runs")) == 1
        store.compact(only_if_due=True)
        assert store.manifest().collect() == before


def test_any_file_system(spark, tmp_path, monkeypatch):
    hadoop = lambda spark, path: files.Hadoop(spark, path)
    monkeypatch.setattr(files, "folder", hadoop)
    path = f"file://{tmp_path}/s"
    with Store(spark, path, l1_entries=2, l0_runs=2) as store:
        assert isinstance(store.files, files.Hadoop)
        store.write_many([(PUT, k, k) for k in (b"a", b"b", b"c", b"\xff")])
        with pytest.raises(RuntimeError):
            Store(spark, path)
        store.flush()
        store.delete(b"b")
        store.flush()
        assert [r["n_entries"] for r in store.manifest().orderBy("counter").collect()] == [2, 1]
        with pytest.raises(FileExistsError):
            store.files.publish(f"manifest/{store._state['version']:010d}.json", b"{}")
    with Store(spark, path) as store:
        assert held(store) == {b"a": b"a", b"c": b"c", b"\xff": b"\xff"} and store.get(b"c") == b"c"
    files.Hadoop(spark, path).lock()
    files.break_lock(spark, path)
    Store(spark, path).close()


@pytest.mark.parametrize("form", ["{}", "file:{}", "file://{}"])
def test_folders_named_in_any_form(spark, tmp_path, form):
    with Store(spark, form.format(tmp_path / "s")) as store:
        store.put(b"a", b"1")
        store.flush()
        assert held(store) == {b"a": b"1"}
    assert (tmp_path / "s" / "manifest").is_dir()


def test_batch_reads(spark, tmp_path):
    with Store(spark, str(tmp_path / "s")) as store:
        store.write_many([(PUT, f"key_{i}".encode(), str(i).encode()) for i in range(20)])
        store.flush()
        store.delete(b"key_3")
        keys = spark.createDataFrame([(b"key_1",), (b"key_3",), (b"none",)], "key binary")
        assert {bytes(r["key"]): r["found"] for r in store.multi_get(keys).collect()} == {b"key_1": True, b"key_3": False, b"none": False}
        assert [bytes(r["key"]) for r in store.scan(b"key_10", b"key_13").collect()] == [b"key_10", b"key_11", b"key_12"]
        assert lookup.prefix(store.snapshot(), b"key_1").count() == 11
        assert lookup.missing(keys, store.snapshot()).count() == 2
        store.view("live")
        assert spark.sql("select count(*) from live").first()[0] == 19
        assert store.snapshot(cached=True).count() == 19


steps = st.lists(st.one_of(st.tuples(st.just("put"), st.sampled_from([b"a", b"b", b"", b"\x00\xff"]), st.sampled_from([b"", b"1", b"2"])), st.tuples(st.just("del"), st.sampled_from([b"a", b"b", b""])), st.just(("flush",)), st.just(("reopen",))), min_size=4, max_size=9)


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(steps)
def test_any_schedule_equals_a_dictionary(spark, tmp_path_factory, steps):
    path, want = str(tmp_path_factory.mktemp("m")), {}
    store = Store(spark, path, l0_runs=2)
    for step in steps:
        if step[0] == "put":
            store.put(step[1], step[2])
            want[step[1]] = step[2]
        elif step[0] == "del":
            store.delete(step[1])
            want.pop(step[1], None)
        elif step[0] == "flush":
            store.flush()
        else:
            store.close()
            store = Store(spark, path, l0_runs=2)
    assert held(store) == want
    store.close()


def test_stream_is_idempotent_and_ordered_by_seq(spark, tmp_path):
    rows = [(0, PUT, b"a", b"1"), (1, PUT, b"b", b"1"), (2, DEL, b"a", None)]
    spark.createDataFrame(rows, OPS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(OPS).parquet(str(tmp_path / "in"))
    with Store(spark, str(tmp_path / "s")) as store:
        ingest.into_store(stream, store, str(tmp_path / "c"), name="ingest").awaitTermination()
        assert held(store) == {b"b": b"1"}
        store.apply(spark.createDataFrame([(3, DEL, b"b", None)], OPS), token="ingest/0")
        assert held(store) == {b"b": b"1"} and store.stats()["seq"] == 2
        # a stream of its own counts its batches anew
        spark.createDataFrame([(4, PUT, b"c", b"2")], OPS).coalesce(1).write.parquet(str(tmp_path / "more"))
        more = spark.readStream.schema(OPS).parquet(str(tmp_path / "more"))
        ingest.into_store(more, store, str(tmp_path / "d")).awaitTermination()
        assert held(store) == {b"b": b"1", b"c": b"2"}


def test_keyed_state_ignores_late_operations(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(OPS).parquet(str(tmp_path / "in"))
    for i, rows in enumerate([[(5, PUT, b"a", b"new"), (6, DEL, b"b", None)], [(1, PUT, b"a", b"old"), (2, PUT, b"c", b"1")]]):
        spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = ingest.latest_state(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, n, i=i: df.write.mode("append").parquet(str(tmp_path / f"out{i}"))).trigger(availableNow=True).start()
        q.awaitTermination()
    first = {bytes(r["key"]): (r["is_tombstone"], r["seq"]) for r in spark.read.parquet(str(tmp_path / "out0")).collect()}
    second = {bytes(r["key"]): r["seq"] for r in spark.read.parquet(str(tmp_path / "out1")).collect()}
    assert first == {b"a": (False, 5), b"b": (True, 6)} and second == {b"c": 2}


def test_log_replay_and_truncation(spark, tmp_path):
    path = str(tmp_path / "wal.log")
    log.write_log(path, [(PUT, b"before", b"v")])
    log.clear_log(path)
    log.write_log(path, [(PUT, b"after", b"v"), (PUT, b"gone", b"v"), (DEL, b"gone", None)])
    with Store(spark, str(tmp_path / "s")) as store:
        store.replay_log(path)
        assert held(store) == {b"after": b"v"}


def test_shell(spark, tmp_path):
    said = []
    with Store(spark, str(tmp_path / "s")) as store:
        cli.run(store, ["", "put k  a value\n", "get k", "put k", "get", "del k", "get k", "flush", "stats", "help", "what", "exit", "put x y"], said.append)
    text = "\n".join(said)
    assert "OK k => a value" in text and "FOUND k => a value" in text and "NOT FOUND k" in text and "DELETED k" in text
    assert "Usage: put" in text and "Usage: get" in text and "FLUSHED" in text and "runs: 1" in text and "Unknown command: what" in text and "Closing." in text


def test_streamed_files_come_in_order_of_seq(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from ledgerline.plans import catalog

    monkeypatch.setattr(catalog.files, "scratch", lambda spark, name: str(tmp_path / name))
    catalog._event_files(spark, "/root/testdata/sf0.01", 6)
    written = spark.read.schema(OPS).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    got = written.groupBy("_metadata.file_path").agg(F.max("_metadata.file_modification_time").alias("at"), F.min("seq").alias("low"), F.max("seq").alias("high")).orderBy("low").collect()
    assert len(got) == 6
    assert all(a["high"] < b["low"] and a["at"] < b["at"] for a, b in zip(got, got[1:], strict=False))
