import os
import struct
import zlib

import numpy as np
import pytest

from ledgerline.functions.binary import parse_run_name, run_name
from ledgerline.operators import bloom, ordered
from ledgerline.operators.blocks import cut
from ledgerline.schema import DEL, PUT
from ledgerline.sources import log, run_file


def n_blocks(sizes):
    return int(cut(np.array(sizes), -1, 4096)[0].sum())


@pytest.mark.parametrize(
    "entries, blocks",
    [
        ([(f"key_{i}", f"val_{i}") for i in range(1000, 1500)], 4),
        ([(f"lkey_{i}", "Z" * 16384) for i in range(10)], 10),
        ([(f"ckey_{i}", f"cval_{i}") for i in range(1000, 1200)], 2),
        (sorted((f"key_{i}", f"value_{i}") for i in range(5000)), 33),
        ([(f"key_{100000 + i}", "x" * 16) for i in range(640)], 6),
        ([(f"key_{100000 + i}", "Y" * 65536) for i in range(640)], 640),
    ],
)
def test_block_counts(entries, blocks):
    assert n_blocks([9 + len(k) + len(v) for k, v in entries]) == blocks


def test_filter_has_no_false_negatives_and_the_known_rate():
    keys = [f"capacity_key_{i}".encode() for i in range(1000)]
    blocks = bloom.n_blocks(1000)
    data = bloom.build(keys, blocks)
    assert blocks == 19 and bloom.may_contain(data, keys).all()
    absent = [f"capacity_absent_{i}".encode() for i in range(100_000)]
    assert int(bloom.may_contain(data, absent).sum()) == 1278
    data = bloom.build([f"key_{i}".encode() for i in range(5000)], bloom.n_blocks(5000))
    assert int(bloom.may_contain(data, [f"non_existent_key_{i}".encode() for i in range(5000)]).sum()) == 73
    assert bloom.may_contain(bloom.build([b""], 1), [b""]).all() and bloom.n_blocks(0) == 1


def test_filters_of_runs(spark):
    frame = spark.createDataFrame([(i % 3, f"k{i}".encode()) for i in range(600)], "run long, key binary")
    for r in bloom.build_filters(frame).collect():
        keys = [f"k{i}".encode() for i in range(600) if i % 3 == r["run"]]
        assert bytes(r["filter"]) == bloom.build(keys, bloom.n_blocks(200))
    pairs = bloom.prune(spark.createDataFrame([(b"k1",)], "key binary"), bloom.build_filters(frame)).collect()
    assert 1 in {r["run"] for r in pairs}


OPS = [(PUT, b"keyA", b"dataA"), (DEL, b"keyA", None), (PUT, b"", b""), (PUT, bytes([0, 127, 128, 255]), b"x" * 2000)]


def decoded(data):
    return [x[1:] for x in log.decode(data)]


def test_log_round_trip_and_resynchronisation(tmp_path):
    path = str(tmp_path / "wal.log")
    log.write_log(path, OPS[:2])
    log.write_log(path, OPS[2:])
    data = open(path, "rb").read()
    assert len(data) % 512 == 0 and decoded(data) == OPS
    bad = bytearray(data)
    bad[512] = 3  # the checksum covers the type
    assert decoded(bytes(bad)) == [OPS[0], *OPS[2:]]
    bad = bytearray(data)
    bad[1:5] = struct.pack("<I", 1 << 30)  # a length beyond the end
    assert decoded(bytes(bad)) == OPS[1:]
    unknown = b"\3" + struct.pack("<II", 1, 0) + b"k"
    unknown += struct.pack("<I", zlib.crc32(b"\3k"))
    assert decoded(unknown.ljust(512, b"\0") + data) == OPS
    assert decoded(bytes(512) + data) == OPS and decoded(data + b"\1\0\0") == OPS and decoded(b"") == []
    bad = bytearray(data)
    bad[1536 + 600] ^= 1  # inside the record of several blocks
    assert decoded(bytes(bad)) == OPS[:3]


def test_log_columns_equal_the_plain_encoder(spark, tmp_path):
    frame = spark.createDataFrame([(i, *op) for i, op in enumerate(OPS)], "seq long, op byte, key binary, value binary")
    got = [bytes(r["record"]) for r in log.encoded(frame).orderBy("seq").collect()]
    assert got == [log.encode(*op) for op in OPS]
    assert [(r["offset"], r["length"]) for r in log.layout(frame).orderBy("seq").collect()] == [(0, 512), (512, 512), (1024, 512), (1536, 2048)]
    log.write_log(str(tmp_path / "a.log"), OPS)
    back = log.replay(log.recover(spark, str(tmp_path / "a.log"))).orderBy("seq").collect()
    assert [(r["op"], bytes(r["key"]), None if r["value"] is None else bytes(r["value"])) for r in back] == OPS
    assert log.recover(spark, str(tmp_path / "none.log")).count() == 0


def test_what_is_appended_behind_a_torn_write_is_recovered(spark, tmp_path):
    path = str(tmp_path / "wal.log")
    log.write_log(path, OPS[:1])
    with open(path, "ab") as f:
        f.write(b"\1\2\0\0\0")
    log.write_log(path, OPS[1:3])
    assert decoded(open(path, "rb").read()) == OPS[:3]
    assert log.damage(spark, path).collect()[0][1:] == ("checksum", 1, 512)


def test_recovery_warns_of_what_it_passes_over(spark, tmp_path):
    unknown = b"\3" + struct.pack("<II", 1, 0) + b"k"
    unknown = (unknown + struct.pack("<I", zlib.crc32(b"\3k"))).ljust(512, b"\0")
    far = (b"\1" + struct.pack("<II", 1 << 30, 0)).ljust(512, b"\0")
    wrong = bytearray(log.encode(*OPS[0]))
    wrong[9] ^= 1
    with open(tmp_path / "a.log", "wb") as f:
        f.write(unknown + bytes(512) + far + bytes(wrong) + far + log.encode(*OPS[0]) + b"\1\0")
    got = {r["outcome"]: (r["places"], r["first_offset"]) for r in log.damage(spark, str(tmp_path / "a.log")).collect()}
    assert got == {"type": (1, 0), "lengths": (2, 1024), "checksum": (1, 1536)}
    assert log.damage(spark, str(tmp_path / "none.log")).count() == 0
    assert log.recover(spark, str(tmp_path / "a.log")).count() == 1


def test_layout_per_log(spark):
    frame = spark.createDataFrame([(i, i % 2, *op) for i, op in enumerate(OPS)], "seq long, log int, op byte, key binary, value binary")
    assert [(r["offset"], r["length"]) for r in log.layout(frame, ["log"]).orderBy("seq").collect()] == [(0, 512), (0, 512), (512, 512), (512, 2048)]


def test_filters_of_several_segments(spark, monkeypatch):
    monkeypatch.setattr(bloom, "SEGMENT", 2)
    keys = [f"k{i}".encode() for i in range(600)]
    frame = spark.createDataFrame([(1, k) for k in keys] + [(2, b"one")], "run long, key binary")
    got = {r["run"]: (r["n_keys"], bytes(r["filter"])) for r in bloom.build_filters(frame).collect()}
    assert got == {1: (600, bloom.build(keys, bloom.n_blocks(600))), 2: (1, bloom.build([b"one"], 1))}


def test_running_sums_and_numbers(spark):
    frame = spark.createDataFrame([(i * 7 % 100, i % 3) for i in range(100)], "at long, n long")
    got = ordered.running_sum(frame, ["at"], "n", "total").orderBy("at").collect()
    assert [r["total"] for r in got] == np.cumsum([r["n"] for r in got]).tolist()
    assert [r["i"] for r in ordered.numbered(frame, ["at"], "i").orderBy("at").collect()] == list(range(100))
    assert ordered.running_sum(frame.limit(0), ["at"], "n", "total").count() == 0


def test_log_size_limit(monkeypatch):
    monkeypatch.setattr(log, "MAX_BYTES", 100)
    with pytest.raises(ValueError):
        list(log.decode(bytes(101)))


def test_run_names():
    assert run_name(0, 3) == "sst-0-000003.sst" and run_name(1, 1_000_000) == "sst-1-1000000.sst"
    assert parse_run_name("sst-10-000000.sst") == (10, 0) and parse_run_name("sst-1-1000000.sst") == (1, 1_000_000)
    assert all(parse_run_name(n) is None for n in ("sst--1-0.sst", "sst-1.sst", "sst-x-000000.sst", "sst-0-000000.sst.tmp"))


def test_run_file(spark, tmp_path):
    run_file.register(spark)
    entries = [(f"key_{i}".encode(), None if i % 7 == 0 else f"val_{i}".encode()) for i in range(1000, 1500)]
    path = str(tmp_path / "sst-0-000000.sst")
    run_file.write_run(path, entries)
    run = run_file.RunFile(path)
    assert list(run.entries()) == entries and len(run.index) > 1
    assert run.find(b"key_1007") == [entries[7]] and run.find(b"key_9999") == [] and run.find(b"a") == []
    run_file.write_run(str(tmp_path / "sst-1-000000.sst"), [(b"", b"")])
    open(tmp_path / "sst-x-000000.sst", "w").close()
    frame = spark.read.format("runfile").load(str(tmp_path))
    assert frame.count() == 501 and frame.filter("is_tombstone").count() == sum(v is None for _, v in entries)
    from pyspark.sql import functions as F

    assert [bytes(r["value"]) for r in frame.filter(F.col("key") == F.lit(b"key_1002")).collect()] == [b"val_1002"]
    with pytest.raises(ValueError):
        run_file.write_run(str(tmp_path / "sst-0-000009.sst"), [(b"b", b""), (b"a", b"")])
    assert not os.path.exists(tmp_path / "sst-0-000009.sst")


def test_damaged_run_files_are_refused(tmp_path):
    data = run_file.encode_run([(b"a", b"1"), (b"b", None)])
    path = str(tmp_path / "sst-0-000000.sst")
    for bad in (b"", data[:10], data[:-16] + struct.pack("<QQ", 1 << 40, 0), data[:-8] + struct.pack("<Q", len(data))):
        with open(path, "wb") as f:
            f.write(bad)
        with pytest.raises(ValueError):
            run_file.RunFile(path)


def test_keys_meet_only_runs_whose_range_holds_them(spark, monkeypatch):
    monkeypatch.setattr(bloom, "PAIRS", 2)
    ranges = spark.createDataFrame([(1, b"b", b"d"), (2, b"e", b"e"), (3, b"c", b"\xff"), (4, b"a", b"a"), (5, None, None)], "run long, smallest_key binary, largest_key binary")
    keys = spark.createDataFrame([(k,) for k in (b"", b"a", b"b", b"c", b"d", b"d\x00", b"e", b"e", b"\xff", b"\xff\x00", None)], "key binary")
    got = sorted((bytes(r["key"]), r["run"]) for r in bloom.in_range(keys, ranges).collect())
    assert got == [(b"a", 4), (b"b", 1), (b"c", 1), (b"c", 3), (b"d", 1), (b"d", 3), (b"d\x00", 3), (b"e", 2), (b"e", 2), (b"e", 3), (b"e", 3), (b"\xff", 3)]
    assert bloom.in_range(keys, ranges.limit(0)).count() == 0


def test_filtered_read_asks_no_run_that_cannot_hold_the_key(spark, monkeypatch):
    from store_helpers import DATA

    from ledgerline.plans import catalog

    asked, probe = [], bloom.probe
    monkeypatch.setattr(catalog, "RUN_OPS", 20)
    monkeypatch.setattr(bloom, "probe", lambda pairs, filters: (asked.append(pairs), probe(pairs, filters))[1])
    got = catalog.filtered_read(spark, DATA)
    parts = spark.read.parquet(f"{DATA}/part.parquet").filter("p_partkey % 5 = 0").count()
    assert got.count() == parts and asked[0].count() == parts


def test_logs_of_a_batch_are_held_one_at_a_time(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    data = b"".join(log.encode(PUT, b"k%d" % i, b"v") for i in range(1000))
    batch = pa.record_batch({"name": [f"{i}" for i in range(41)], "data": pa.array([data] * 40 + [None], pa.binary())})
    for read, rows in ((log.decode_batches, 40_000), (log.warned_batches, 0)):
        tracemalloc.start()
        assert sum(b.num_rows for b in read([batch])) == rows
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 8 * len(data)
    monkeypatch.setattr(log, "BATCH_BYTES", 100)
    assert max(b.num_rows for b in log.decode_batches([batch.slice(0, 1)])) <= 100 // 3


@pytest.mark.parametrize("name", ["log_recovery", "log_replay", "log_damage"])
def test_damaged_logs_are_read_where_they_are_joined(spark, monkeypatch, name):
    from store_helpers import DATA

    from ledgerline.plans import catalog

    plans, replay = [], log.replay
    monkeypatch.setattr(log, "replay", lambda df, *a, **b: (plans.append(df), replay(df, *a, **b))[1])
    plans.append(catalog.queries()[name](spark, DATA))
    plan = plans[0]._jdf.queryExecution().toString()
    assert "FlatMapGroupsInArrow" in plan and "MapInArrow" not in plan
