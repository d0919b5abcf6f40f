"""Queries of the engine over the driver's tables, and their SQL for DuckDB.

Two tables are read as operation logs: events (key user, deleted by errors) and orders (key customer,
deleted by status F). part gives sorted entries for blocks. Keys are shown as text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import binary
from ledgerline.operators import blocks, bloom, compact, lookup, resolve
from ledgerline.schema import OPS, operations, puts
from ledgerline.sources import files, log, run_file

RUN_OPS = 1000
FILE_ENTRIES = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "events")
    return operations(t, "event_id", F.concat(F.lit("user_"), F.col("user_id").cast("string")), "props", F.col("event_type") == "error")


def order_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "orders")
    return operations(t, "o_orderkey", F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")), "o_orderpriority", F.col("o_orderstatus") == "F")


def part_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "part")
    ops = puts(t, "p_partkey", F.lpad(F.col("p_partkey").cast("string"), 10, "0"), "p_type")
    return ops.select("key", F.lit(False).alias("is_tombstone"), "value", "seq", F.floor(F.col("seq") / RUN_OPS).cast("long").alias("run"))


def customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer, and as many keys that never occur."""
    t = _table(spark, sf_dir, "customer")
    key = lambda add: t.select(F.concat(F.lit("cust_"), (F.col("c_custkey") + add).cast("string")).cast("binary").alias("key"))
    return key(0).unionAll(key(10_000_000))


def _shown(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("string") for c in columns or ("key", "value")})


def _runs(ops: DataFrame) -> DataFrame:
    return resolve.latest(ops.withColumn("run", F.floor(F.col("seq") / RUN_OPS).cast("long")), "run")


def snapshot_events(spark, sf_dir):
    return _shown(resolve.snapshot(event_ops(spark, sf_dir)))


def snapshot_orders(spark, sf_dir):
    return _shown(resolve.snapshot(order_ops(spark, sf_dir)))


def snapshot_as_of(spark, sf_dir):
    return _shown(resolve.snapshot(order_ops(spark, sf_dir), as_of=5000))


def tombstone_list(spark, sf_dir):
    return _shown(resolve.tombstones(order_ops(spark, sf_dir)), "key")


def memtable_stats(spark, sf_dir):
    return resolve.memtable_bytes(resolve.latest(event_ops(spark, sf_dir)))


def run_stats(spark, sf_dir):
    return _shown(resolve.run_statistics(_runs(event_ops(spark, sf_dir))), "smallest_key", "largest_key")


def run_recency(spark, sf_dir):
    """Runs with alternating levels, in order of age."""
    runs = resolve.run_statistics(_runs(order_ops(spark, sf_dir))).select((F.col("run") % 2).cast("int").alias("level"), F.floor(F.col("run") / 2).cast("long").alias("counter"), "n_entries")
    return resolve.recency(runs)


def newest_run_wins(spark, sf_dir):
    entries = _runs(order_ops(spark, sf_dir)).withColumnRenamed("run", "run_rank")
    return _shown(resolve.live(resolve.merge_ranked(entries)))


def level_counts(spark, sf_dir):
    runs = resolve.run_statistics(_runs(order_ops(spark, sf_dir)))
    return runs.groupBy((F.col("run") % 2).cast("int").alias("level")).agg(F.count("*").alias("n_runs"), (F.max(F.floor(F.col("run") / 2)) + 1).cast("long").alias("next_counter"))


def compaction_files(spark, sf_dir):
    numbered = compact.number_files(compact.compacted([_runs(order_ops(spark, sf_dir)).drop("run")]), FILE_ENTRIES)
    stats = resolve.run_statistics(numbered, "file").drop("n_tombstones")
    return _shown(stats, "smallest_key", "largest_key")


def point_get(spark, sf_dir):
    return _shown(lookup.get(resolve.snapshot(order_ops(spark, sf_dir)), b"cust_7"), "value")


def multi_get(spark, sf_dir):
    return _shown(lookup.multi_get(customer_keys(spark, sf_dir), resolve.snapshot(order_ops(spark, sf_dir))))


def missing_keys(spark, sf_dir):
    return _shown(lookup.missing(customer_keys(spark, sf_dir), resolve.snapshot(order_ops(spark, sf_dir))), "key")


def range_scan(spark, sf_dir):
    return _shown(lookup.scan(resolve.snapshot(order_ops(spark, sf_dir)), b"cust_2", b"cust_5"))


def prefix_scan(spark, sf_dir):
    return _shown(lookup.prefix(resolve.snapshot(order_ops(spark, sf_dir)), b"cust_10"))


def probed_runs(spark, sf_dir):
    runs = resolve.run_statistics(_runs(order_ops(spark, sf_dir)))
    return _shown(lookup.probed_runs(customer_keys(spark, sf_dir), runs), "key")


def log_layout(spark, sf_dir):
    return log.layout(event_ops(spark, sf_dir)).select("seq", "offset", "length")


def log_record_sizes(spark, sf_dir):
    encoded = log.encoded(event_ops(spark, sf_dir))
    return encoded.select("seq", F.octet_length("record").cast("long").alias("record_bytes"))


def log_round_trip(spark, sf_dir):
    """Operations encoded by column functions, decoded by recovery's rules and resolved again."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(s, o, k, v) for s, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for _, o, k, v in log.decode(r)]
            yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int8(), pa.binary(), pa.binary()))], names=["seq", "op", "key", "value"])

    back = log.encoded(event_ops(spark, sf_dir)).mapInArrow(run, "seq long, op byte, key binary, value binary")
    return _shown(resolve.snapshot(back))


def run_names(spark, sf_dir):
    runs = resolve.run_statistics(_runs(order_ops(spark, sf_dir)))
    name = F.format_string("sst-%d-%06d.sst", (F.col("run") % 2).cast("int"), F.floor(F.col("run") / 2).cast("long"))
    named = runs.select(name.alias("name"))
    return named.select("name", binary.run_level(F.col("name")).alias("level"), binary.run_counter(F.col("name")).alias("counter"))


def entry_blocks(spark, sf_dir):
    index = blocks.block_index(blocks.form_blocks(part_entries(spark, sf_dir)))
    return _shown(index, "first_key")


def block_lookup(spark, sf_dir):
    entries = part_entries(spark, sf_dir)
    index = blocks.block_index(blocks.form_blocks(entries))
    return _shown(blocks.locate(entries.select("run", "key"), index), "key")


def filter_check(spark, sf_dir):
    """Every run's filter against the run's own keys: none may be missed."""
    entries = part_entries(spark, sf_dir)
    filters = bloom.build_filters(entries)
    return bloom.probe(entries, filters).groupBy("run").agg(F.count("*").alias("n_keys"), F.count_if(~F.col("hit")).alias("n_missed"))


def filter_sizes(spark, sf_dir):
    filters = bloom.build_filters(part_entries(spark, sf_dir))
    return filters.select("run", "n_keys", (F.octet_length("filter") / 64).cast("long").alias("n_blocks"))


def filter_rate(spark, sf_dir):
    """How many of 20,000 keys that no run has each run's filter lets pass: at most a twentieth."""
    filters = bloom.build_filters(part_entries(spark, sf_dir))
    absent = spark.range(20_000).select(F.concat(F.lit("absent_"), F.col("id").cast("string")).cast("binary").alias("key"))
    passed = bloom.prune(absent, filters).groupBy("run").agg(F.count("*").alias("n"))
    return filters.select("run", "n_keys").join(passed, "run", "left").select("run", "n_keys", (F.coalesce("n", F.lit(0)) <= 1000).alias("within_limit"))


def filtered_read(spark, sf_dir):
    """Keys to the runs whose range holds them and whose filter lets them pass, and only those are read
    for them."""
    entries = part_entries(spark, sf_dir)
    keys = entries.filter(F.col("seq") % 5 == 0).select("key").unionAll(customer_keys(spark, sf_dir))
    ranges = resolve.run_statistics(entries)
    worth = bloom.prune(keys, bloom.build_filters(entries), ranges)
    return _shown(worth.join(entries, ["run", "key"]).select("run", "key", "value"))


def order_check(spark, sf_dir):
    return blocks.out_of_order(event_ops(spark, sf_dir).withColumn("run", F.floor(F.col("seq") / RUN_OPS).cast("long")))


def _bad_logs(spark, sf_dir, read: Callable, schema: str) -> DataFrame:
    """The events as logs of 1,000 records each, of which some are damaged: a changed byte, a length beyond
    the end, a type that isn't known under a good checksum, a type that is cleared. A log is read where it
    is joined, so a task holds one at a time, however many it has."""
    import pyarrow as pa

    ops = event_ops(spark, sf_dir)
    odd = ops.withColumn("op", F.when(F.col("seq") % 13 == 3, F.lit(3)).otherwise(F.col("op")).cast("byte"))
    seq, r = F.col("seq"), F.col("record")
    put = lambda at, data: F.concat(F.substring(r, 1, at), F.lit(data), F.substring(r, at + len(data) + 1, 1 << 20))
    bad = F.when(seq % 13 == 5, put(9, b"\xfe")).when(seq % 13 == 7, put(1, b"\xff\xff\xff\x3f")).when(seq % 13 == 9, put(0, b"\x00")).otherwise(r)
    records = log.encoded(odd).select(F.floor(seq / RUN_OPS).cast("long").alias("log"), "seq", bad.alias("record"))

    def joined(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        name = f"{table.column('log')[0].as_py():08d}"
        data = pa.record_batch({"name": [name], "data": pa.array([b"".join(table.column("record").to_pylist())], pa.binary())})
        return pa.Table.from_batches(read([data]))

    return records.groupBy("log").applyInArrow(joined, schema)


def log_recovery(spark, sf_dir):
    """What recovery accepts of damaged logs, resolved."""
    back = _bad_logs(spark, sf_dir, log.decode_batches, log.RECOVERED)
    return _shown(resolve.snapshot(log.replay(back)))


def log_replay(spark, sf_dir):
    """What recovery accepts of damaged logs, numbered in order of logs and places."""
    back = _bad_logs(spark, sf_dir, log.decode_batches, log.RECOVERED)
    return _shown(log.replay(back, after=100), "key", "value")


def log_damage(spark, sf_dir):
    return log.counted(_bad_logs(spark, sf_dir, log.warned_batches, log.WARNED)).select(F.col("file").cast("long").alias("log"), "outcome", "places")


def _event_runs(spark, sf_dir):
    return run_file.encoded_runs(_runs(event_ops(spark, sf_dir)))


def run_file_scan(spark, sf_dir):
    return _shown(run_file.decoded_runs(_event_runs(spark, sf_dir)))


def run_file_get(spark, sf_dir):
    return _shown(run_file.decoded_runs(_event_runs(spark, sf_dir), b"user_7"))


def _store(spark, name, **limits):
    from ledgerline.store import Store

    return Store(spark, files.scratch(spark, name), **limits)


def _filled(store, ops: DataFrame, batches: int, flushed: int) -> None:
    """The operations in batches of seq, all sent twice as a stream would; the first are flushed."""
    last = ops.agg(F.max("seq")).first()[0] or 0
    for i in range(batches):
        batch = ops.filter((F.col("seq") > (last * i // batches if i else -1)) & (F.col("seq") <= last * (i + 1) // batches))
        for _ in range(2):
            store.apply(batch, token=f"orders/{i}")
        if i < flushed:
            store.flush()


def store_snapshot(spark, sf_dir):
    """The orders written to a store in five flushed batches, so compacted once, then read."""
    with _store(spark, "store") as store:
        _filled(store, order_ops(spark, sf_dir), 5, 5)
        return _shown(store.snapshot())


def store_get(spark, sf_dir):
    """Single keys read from pending operations over a run, present, deleted and absent ones."""
    with _store(spark, "store") as store:
        _filled(store, order_ops(spark, sf_dir), 2, 1)
        keys = [f"cust_{i}" for i in (1, 2, 4, 5, 7, 8, 99_999_999)]
        return spark.createDataFrame([(k, v.decode() if v is not None else None) for k in keys for v in [store.get(k.encode())]], "key string, value string")


def store_multi_get(spark, sf_dir):
    """Many keys at once from pending operations, runs and compacted files."""
    with _store(spark, "store") as store:
        _filled(store, order_ops(spark, sf_dir), 6, 5)
        return _shown(files.written(store.multi_get(customer_keys(spark, sf_dir)), files.scratch(spark, "got")))


def store_scan(spark, sf_dir):
    with _store(spark, "store") as store:
        _filled(store, order_ops(spark, sf_dir), 3, 2)
        return _shown(files.written(store.scan(b"cust_2", b"cust_5"), files.scratch(spark, "got")))


def store_pending(spark, sf_dir):
    """What is pending, in key order and with deletions."""
    with _store(spark, "store", memtable_bytes=1 << 40) as store:
        _filled(store, event_ops(spark, sf_dir), 2, 0)
        return _shown(files.written(store.pending_entries(), files.scratch(spark, "got")))


def store_files(spark, sf_dir):
    """The files of level 1 after a compaction, newest run and counters included."""
    with _store(spark, "store", l1_entries=FILE_ENTRIES) as store:
        _filled(store, order_ops(spark, sf_dir), 4, 4)
        return _shown(store.manifest().drop("path"), "smallest_key", "largest_key")


def store_stats(spark, sf_dir):
    with _store(spark, "store", memtable_bytes=1 << 40) as store:
        _filled(store, order_ops(spark, sf_dir), 3, 2)
        return spark.createDataFrame([store.stats()], "memtable_entries long, memtable_bytes long, runs long, seq long")


def _event_files(spark, sf_dir, parts: int) -> DataFrame:
    """The events' operations as a stream of as many files, in order of seq. A stream takes files by the
    time they were written, and by name where times are equal, so each is written after the one before."""
    folder, ops = files.scratch(spark, "in"), event_ops(spark, sf_dir)
    cuts = ops.agg(F.percentile_approx("seq", [i / parts for i in range(1, parts)])).first()[0] or []
    for i, (low, high) in enumerate(zip([None, *cuts], [*cuts, None], strict=True)):
        part = ops if low is None else ops.filter(F.col("seq") > low)
        part = part if high is None else part.filter(F.col("seq") <= high)
        part.repartition(1).sortWithinPartitions("seq").write.parquet(f"{folder}/{i:03d}")
    return spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


def stream_snapshot(spark, sf_dir):
    """The events as a stream of six micro-batches into a store, each of which is flushed by its size; the
    fourth flush compacts."""
    from ledgerline.streaming.ingest import into_store

    with _store(spark, "store", memtable_bytes=64) as store:
        into_store(_event_files(spark, sf_dir, 6), store, files.scratch(spark, "checkpoint")).awaitTermination()
        return _shown(store.snapshot())


def stream_state(spark, sf_dir):
    """The latest operation of each key in a stream's keyed state."""
    from ledgerline.streaming.ingest import latest_state

    out = files.scratch(spark, "state")
    write = lambda df, n: df.write.mode("append").parquet(out)
    latest_state(_event_files(spark, sf_dir, 2)).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", files.scratch(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    every = spark.read.schema("key binary, is_tombstone boolean, value binary, seq long").parquet(out)
    return _shown(resolve.merge([every]))


_NAMES = "snapshot_events snapshot_orders snapshot_as_of tombstone_list memtable_stats run_stats run_recency newest_run_wins level_counts compaction_files point_get multi_get missing_keys range_scan prefix_scan probed_runs log_layout log_record_sizes log_round_trip run_names entry_blocks block_lookup filter_check filter_sizes filter_rate filtered_read order_check log_recovery log_replay log_damage run_file_scan run_file_get store_snapshot store_get store_multi_get store_scan store_pending store_files store_stats stream_snapshot stream_state".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in _NAMES}


_EVENTS = "SELECT event_id AS seq, 'user_' || user_id AS k, event_type = 'error' AS gone, CASE WHEN event_type <> 'error' THEN coalesce(props, '') END AS v FROM events"
_ORDERS = "SELECT o_orderkey AS seq, 'cust_' || o_custkey AS k, o_orderstatus = 'F' AS gone, CASE WHEN o_orderstatus <> 'F' THEN coalesce(o_orderpriority, '') END AS v FROM orders"
_PARTS = f"SELECT p_partkey AS seq, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS k, p_type AS v, p_partkey // {RUN_OPS} AS run FROM part"
_KEYS = "SELECT 'cust_' || c_custkey AS key FROM customer UNION ALL SELECT 'cust_' || (c_custkey + 10000000) FROM customer"


def _latest(ops: str, by: str = "", where: str = "true") -> str:
    part = f"{by}, k" if by else "k"
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY seq DESC) AS n FROM ({ops}) WHERE {where}) WHERE n = 1"


def _in_runs(ops: str) -> str:
    return _latest(f"SELECT *, seq // {RUN_OPS} AS run FROM ({ops})", "run")


def oracle_sql() -> dict[str, str]:
    live = lambda ops, where="true": f"SELECT k AS key, v AS value FROM ({_latest(ops, where=where)}) WHERE NOT gone"
    orders, stats = live(_ORDERS), lambda ops: f"SELECT run, count(*) AS n_entries, count(*) FILTER (WHERE gone) AS n_tombstones, min(k) AS smallest_key, max(k) AS largest_key FROM ({_in_runs(ops)}) GROUP BY run"
    by_run = stats(_ORDERS)
    fold = f"""
WITH RECURSIVE e AS (SELECT run, k, 9 + strlen(k) + strlen(v) AS bytes, row_number() OVER (PARTITION BY run ORDER BY k) AS i FROM ({_PARTS})),
f AS (SELECT run, k, bytes, i, CAST(0 AS BIGINT) AS b, CAST(bytes AS BIGINT) AS filled, CAST(0 AS BIGINT) AS pos FROM e WHERE i = 1
      UNION ALL
      SELECT e.run, e.k, e.bytes, e.i, f.b + CASE WHEN f.filled >= 4096 THEN 1 ELSE 0 END,
             CASE WHEN f.filled >= 4096 THEN 0 ELSE f.filled END + e.bytes, f.pos + f.bytes
      FROM f JOIN e ON e.run = f.run AND e.i = f.i + 1)"""
    return {
        "snapshot_events": live(_EVENTS),
        "snapshot_orders": orders,
        "snapshot_as_of": live(_ORDERS, "seq <= 5000"),
        "tombstone_list": f"SELECT k AS key, seq FROM ({_latest(_ORDERS)}) WHERE gone",
        "memtable_stats": f"SELECT count(*) AS entries, CAST(coalesce(sum(strlen(k) + 8 + coalesce(strlen(v), 0)), 0) AS BIGINT) AS bytes, count(*) FILTER (WHERE gone) AS tombstones FROM ({_latest(_EVENTS)})",
        "run_stats": stats(_EVENTS),
        "run_recency": f"SELECT *, row_number() OVER (ORDER BY level DESC, counter) AS run_rank FROM (SELECT CAST(run % 2 AS INTEGER) AS level, run // 2 AS counter, n_entries FROM ({by_run}))",
        "newest_run_wins": orders,
        "level_counts": f"SELECT CAST(run % 2 AS INTEGER) AS level, count(*) AS n_runs, max(run // 2) + 1 AS next_counter FROM ({by_run}) GROUP BY 1",
        "compaction_files": f"SELECT file, count(*) AS n_entries, min(key) AS smallest_key, max(key) AS largest_key FROM (SELECT key, (row_number() OVER (ORDER BY key) - 1) // {FILE_ENTRIES} AS file FROM ({orders})) GROUP BY file",
        "point_get": f"SELECT value FROM ({orders}) WHERE key = 'cust_7'",
        "multi_get": f"SELECT q.key, s.key IS NOT NULL AS found, s.value FROM ({_KEYS}) q LEFT JOIN ({orders}) s ON q.key = s.key",
        "missing_keys": f"SELECT q.key FROM ({_KEYS}) q ANTI JOIN ({orders}) s ON q.key = s.key",
        "range_scan": f"SELECT * FROM ({orders}) WHERE key >= 'cust_2' AND key < 'cust_5' ORDER BY key",
        "prefix_scan": f"SELECT * FROM ({orders}) WHERE starts_with(key, 'cust_10') ORDER BY key",
        "probed_runs": f"SELECT q.key, count(r.run) AS n_runs FROM ({_KEYS}) q LEFT JOIN ({by_run}) r ON r.smallest_key <= q.key AND q.key <= r.largest_key GROUP BY q.key",
        "log_layout": f"SELECT seq, CAST(sum(n) OVER (ORDER BY seq) - n AS BIGINT) AS \"offset\", n AS length FROM (SELECT seq, (13 + strlen(k) + coalesce(strlen(v), 0) + 511) // 512 * 512 AS n FROM ({_EVENTS}))",
        "log_record_sizes": f"SELECT seq, (13 + strlen(k) + coalesce(strlen(v), 0) + 511) // 512 * 512 AS record_bytes FROM ({_EVENTS})",
        "log_round_trip": live(_EVENTS),
        "run_names": f"SELECT printf('sst-%d-%06d.sst', run % 2, run // 2) AS name, run % 2 AS level, run // 2 AS counter FROM ({by_run})",
        "entry_blocks": f"{fold} SELECT run, b AS block_id, min(k) AS first_key, min(pos) AS \"offset\", CAST(sum(bytes) AS BIGINT) AS bytes, count(*) AS n_entries, CAST(min(pos) + sum(bytes) AS BIGINT) AS \"end\" FROM f GROUP BY run, b",
        "block_lookup": f"{fold} SELECT run, k AS key, b AS block_id FROM f",
        "filter_check": f"SELECT run, count(*) AS n_keys, CAST(0 AS BIGINT) AS n_missed FROM ({_PARTS}) GROUP BY run",
        "filter_sizes": f"SELECT run, count(*) AS n_keys, CAST(greatest(1, ceil(floor(-count(*) * ln(0.01) / (ln(2) * ln(2))) / 512)) AS BIGINT) AS n_blocks FROM ({_PARTS}) GROUP BY run",
        "filter_rate": f"SELECT run, count(*) AS n_keys, true AS within_limit FROM ({_PARTS}) GROUP BY run",
        "filtered_read": f"SELECT run, k AS key, v AS value FROM ({_PARTS}) WHERE seq % 5 = 0",
        "order_check": f"SELECT run, count(*) AS n_entries, count(*) FILTER (WHERE k <= before) AS n_violations FROM (SELECT seq // {RUN_OPS} AS run, k, lag(k) OVER (PARTITION BY seq // {RUN_OPS} ORDER BY seq) AS before FROM ({_EVENTS})) GROUP BY run",
        "log_recovery": live(f"SELECT * FROM ({_EVENTS}) WHERE seq % 13 NOT IN (3, 5, 7, 9)"),
        "log_replay": f"SELECT row_number() OVER (ORDER BY seq) + 100 AS seq, CAST(CASE WHEN gone THEN 2 ELSE 1 END AS TINYINT) AS op, k AS key, v AS value FROM ({_EVENTS}) WHERE seq % 13 NOT IN (3, 5, 7, 9)",
        "log_damage": f"SELECT seq // {RUN_OPS} AS log, CASE seq % 13 WHEN 3 THEN 'type' WHEN 5 THEN 'checksum' ELSE 'lengths' END AS outcome, count(*) AS places FROM ({_EVENTS}) WHERE seq % 13 IN (3, 5, 7) GROUP BY 1, 2",
        "run_file_scan": f"SELECT run, k AS key, gone AS is_tombstone, v AS value FROM ({_in_runs(_EVENTS)})",
        "run_file_get": f"SELECT run, k AS key, gone AS is_tombstone, v AS value FROM ({_in_runs(_EVENTS)}) WHERE k = 'user_7'",
        "store_snapshot": orders,
        "store_get": f"SELECT q.key, s.value FROM (SELECT 'cust_' || unnest([1, 2, 4, 5, 7, 8, 99999999]) AS key) q LEFT JOIN ({orders}) s ON q.key = s.key",
        "store_multi_get": f"SELECT q.key, s.key IS NOT NULL AS found, s.value FROM ({_KEYS}) q LEFT JOIN ({orders}) s ON q.key = s.key",
        "store_scan": f"SELECT * FROM ({orders}) WHERE key >= 'cust_2' AND key < 'cust_5'",
        "store_pending": f"SELECT k AS key, gone AS is_tombstone, v AS value, seq FROM ({_latest(_EVENTS)})",
        "store_files": f"SELECT 1 AS level, f AS counter, count(*) AS n_entries, CAST(0 AS BIGINT) AS n_tombstones, min(key) AS smallest_key, max(key) AS largest_key, f + 1 AS run_rank FROM (SELECT key, (row_number() OVER (ORDER BY key) - 1) // {FILE_ENTRIES} AS f FROM ({orders})) GROUP BY f",
        "store_stats": f"SELECT count(*) AS memtable_entries, CAST(sum(strlen(k) + 8 + coalesce(strlen(v), 0)) AS BIGINT) AS memtable_bytes, CAST(2 AS BIGINT) AS runs, max(seq) AS seq FROM ({_latest(_ORDERS, where=f'seq > (SELECT max(o_orderkey) * 2 // 3 FROM orders)')})",
        "stream_snapshot": live(_EVENTS),
        "stream_state": f"SELECT k AS key, gone AS is_tombstone, v AS value, seq FROM ({_latest(_EVENTS)})",
    }
