"""The store: a directory of Parquet runs, pending operations and a manifest.

    manifest/0000000012.json   which runs and pending parts make up the store, and how far seq has come
    runs/L0-000003-<id>/       a flush: one entry per key, sorted by key
    runs/L1-000001-<id>/data/  a compaction: live entries in ranges of the key, sorted; every l1_entries
                               of them make a file of level 1, by their place
    runs/L1-000001-<id>/files/ those files' counts and least and greatest keys
    ops/<id>/                  operations appended and not flushed yet

Every change writes its data first and then a new manifest under a temporary name, which is renamed:
readers see the whole change or none, and a second writer that lost its lock fails instead of
overwriting. Data that no manifest names is swept, and can never bring a key back. The manifest has a
row per flush or compaction, never per file or key. The directory may lie on any file system that Spark
reads and driver and executors share. One process writes at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import compact, lookup, resolve
from ledgerline.schema import DEL, L0_RUNS, L1_ENTRIES, MEMTABLE_BYTES, OPS, PUT, RUN
from ledgerline.sources import files, log


class Store:
    def __init__(self, spark: SparkSession, path: str, memtable_bytes: int = MEMTABLE_BYTES, l0_runs: int = L0_RUNS, l1_entries: int = L1_ENTRIES):
        self.spark, self.path, self.files = spark, path, files.folder(spark, path)
        self.memtable_bytes, self.l0_runs, self.l1_entries = memtable_bytes, l0_runs, l1_entries
        for part in ("manifest", "runs", "ops"):
            self.files.make(part)
        self.files.lock()
        self._open = True
        self._state = self._load()
        self._cached: DataFrame | None = None

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        if self._open:
            try:
                self.flush()
            finally:
                self._forget()
                self._open = False
                self.files.unlock()

    # -- manifest

    def _load(self) -> dict:
        names = [n for n in self.files.names("manifest") if n.endswith(".json")]
        if not names:
            return {"version": 0, "seq": -1, "floor": -1, "runs": [], "ops": [], "streams": {}}
        return json.loads(self.files.read(f"manifest/{names[-1]}"))

    def _commit(self, **change) -> None:
        state = self._state | change | {"version": self._state["version"] + 1}
        self.files.publish(f"manifest/{state['version']:010d}.json", json.dumps(state).encode())
        self._state = state
        self._forget()

    def _forget(self) -> None:
        if self._cached is not None:
            self._cached.unpersist()
            self._cached = None

    def vacuum(self) -> list[str]:
        """Delete data and temporary files that the newest manifest doesn't name."""
        named = {r["path"] for r in self._state["runs"]} | {o["path"] for o in self._state["ops"]}
        gone = [f"{part}/{name}" for part in ("runs", "ops") for name in self.files.names(part) if f"{part}/{name}" not in named]
        for name in self.files.names("manifest"):
            if name.endswith(".tmp") or name.endswith(".json") and int(name[:10]) < self._state["version"]:
                self.files.remove(f"manifest/{name}")
        for name in gone:
            self.files.remove(name)
        return gone

    # -- writing

    def apply(self, ops: DataFrame, token: str | None = None) -> None:
        """Append a batch of operations (seq, op, key, value). Their order is that of seq, whenever they
        arrive; only what may be older than a deletion that compaction has forgotten is refused. A token
        is a stream's name and a batch's number, name/7: batches up to the last that was applied are
        ignored."""
        streams = dict(self._state["streams"])
        if token is not None:
            name, number = token.rsplit("/", 1)
            if int(number) <= streams.get(name, -1):
                return
            streams[name] = int(number)
        at = f"ops/{uuid.uuid4().hex}"
        ops.select([F.col(f.name).cast(f.dataType) for f in OPS]).write.parquet(self.files.url(at))
        low, high, n = self._ops([at]).agg(F.min("seq"), F.max("seq"), F.count("*")).first()
        if not n:
            self.files.remove(at)
            return
        if low <= self._state["floor"]:
            self.files.remove(at)
            raise ValueError(f"seq {low} isn't beyond {self._state['floor']}, up to which deletions are forgotten")
        self.files.settle(at)
        self._commit(ops=[*self._state["ops"], {"path": at, "n": n}], seq=max(high, self._state["seq"]), streams=streams)
        if self.stats()["memtable_bytes"] >= self.memtable_bytes:
            self.flush()

    def _rows(self, rows: Iterable[tuple[int, bytes, bytes | None]]) -> DataFrame:
        seq = self._state["seq"]
        return self.spark.createDataFrame([(seq + i, op, key, value) for i, (op, key, value) in enumerate(rows, 1)], OPS)

    def put(self, key: bytes, value: bytes) -> None:
        self.apply(self._rows([(PUT, key, value)]))

    def delete(self, key: bytes) -> None:
        """A tombstone, written whether or not the key is there."""
        self.apply(self._rows([(DEL, key, None)]))

    def write_many(self, rows: Iterable[tuple[int, bytes, bytes | None]]) -> None:
        self.apply(self._rows(rows))

    def replay_log(self, path: str) -> None:
        """Apply what recovery accepts of the binary logs under path, in file order, beyond the store's
        own operations."""
        self.apply(log.replay(log.recover(self.spark, path), after=self._state["seq"]))

    def flush(self) -> None:
        """Pending operations to a new run of level 0; nothing to do without any."""
        if self._state["ops"]:
            self._settle_pending()
            self.compact(only_if_due=True)

    def _settle_pending(self) -> None:
        entries = resolve.latest(self.pending())
        self._commit(runs=[*self._state["runs"], self._write(entries, 0, self._next(0))], ops=[])

    def compact(self, only_if_due: bool = False) -> None:
        """All runs of all levels to disjoint files of live entries in level 1; only once level 0 has
        enough runs, if asked so. What is pending takes part, as it may be older than a deletion that is
        forgotten now. A failure leaves the store as it was."""
        if only_if_due and sum(r["level"] == 0 for r in self._state["runs"]) < self.l0_runs:
            return
        if self._state["ops"]:
            self._settle_pending()
        runs = self._state["runs"]
        if not runs:
            return
        self.vacuum()
        first = self._next(1)
        name = f"runs/L1-{first:06d}-{uuid.uuid4().hex}"
        entries = [self._run(r) for r in runs]
        try:
            forgotten = resolve.merge(entries).filter("is_tombstone").agg(F.max("seq")).first()[0]
            numbered = compact.number_files(compact.compacted(entries), self.l1_entries, first, self.files.url(f"{name}/data"))
            resolve.run_statistics(numbered, "file").write.parquet(self.files.url(f"{name}/files"))
            r = self._files(name).agg(F.count("*"), F.sum("n_entries"), F.min("smallest_key"), F.max("largest_key")).first()
            made = [{"level": 1, "counter": first, "path": name, "n_files": r[0], "n_entries": r[1], "n_tombstones": 0, "smallest_key": bytes(r[2]).hex(), "largest_key": bytes(r[3]).hex()}] if r[0] else []
            self.files.settle(name)
        except BaseException:
            self.files.remove(name)
            raise
        self._commit(runs=made, floor=max(self._state["floor"], -1 if forgotten is None else forgotten))
        self.vacuum()

    def _files(self, name: str) -> DataFrame:
        return self.spark.read.schema("file long, n_entries long, n_tombstones long, smallest_key binary, largest_key binary").parquet(self.files.url(f"{name}/files"))

    def _next(self, level: int) -> int:
        return max((r["counter"] + r.get("n_files", 1) for r in self._state["runs"] if r["level"] == level), default=0)

    def _write(self, entries: DataFrame, level: int, counter: int) -> dict:
        name = f"runs/L{level}-{counter:06d}-{uuid.uuid4().hex}"
        try:
            entries.select("key", "is_tombstone", "value", "seq").repartitionByRange("key").sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(self.files.url(name))
            r = self.spark.read.schema(RUN).parquet(self.files.url(name)).agg(F.count("*"), F.count_if("is_tombstone"), F.min("key"), F.max("key")).first()
            self.files.settle(name)
        except BaseException:
            self.files.remove(name)
            raise
        return {"level": level, "counter": counter, "path": name, "n_entries": r[0], "n_tombstones": r[1], "smallest_key": bytes(r[2]).hex(), "largest_key": bytes(r[3]).hex()}

    # -- reading

    def _ops(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], OPS)
        return self.spark.read.schema(OPS).parquet(*(self.files.url(n) for n in names))

    def pending(self) -> DataFrame:
        return self._ops([o["path"] for o in self._state["ops"]])

    def pending_entries(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        """What is pending, one row per key with deletions, in key order."""
        return lookup.scan(resolve.latest(self.pending()), low, high)

    def _run(self, run: dict) -> DataFrame:
        return self.spark.read.schema(RUN).parquet(self.files.url(run["path"] + "/data" * ("n_files" in run)))

    def _entries(self, low: bytes | None = None, high: bytes | None = None, keys: DataFrame | None = None) -> DataFrame:
        """One row per key: pending operations over all runs whose key range meets [low, high], or only
        what they have of keys."""
        held = [r for r in self._state["runs"] if (high is None or bytes.fromhex(r["smallest_key"]) <= high) and (low is None or bytes.fromhex(r["largest_key"]) >= low)]
        parts = [resolve.latest(self.pending()), *map(self._run, held)]
        return resolve.merge(parts if keys is None else [lookup.only(p, keys) for p in parts])

    def snapshot(self, cached: bool = False) -> DataFrame:
        """The live pairs, an ordinary lazy DataFrame (key, value). A cached one lasts until the next
        change."""
        if not cached:
            return resolve.live(self._entries())
        if self._cached is None:
            self._cached = resolve.live(self._entries()).persist()
        return self._cached

    def view(self, name: str) -> None:
        self.snapshot().createOrReplaceTempView(name)

    def get(self, key: bytes) -> bytes | None:
        row = lookup.get(resolve.live(self._entries(key, key).filter(F.col("key") == F.lit(key))), key).head(1)
        return bytes(row[0]["value"]) if row else None

    def multi_get(self, keys: DataFrame) -> DataFrame:
        return lookup.multi_get(keys, resolve.live(self._entries(keys=keys)))

    def scan(self, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
        return lookup.scan(resolve.live(self._entries(low, high)), low, high)

    def manifest(self) -> DataFrame:
        """The runs, and in their place the files of level 1, in order of age."""
        ddl = "level int, counter long, path string, n_entries long, n_tombstones long, smallest_key binary, largest_key binary"
        rows = [(r["level"], r["counter"], r["path"], r["n_entries"], r["n_tombstones"], bytes.fromhex(r["smallest_key"]), bytes.fromhex(r["largest_key"])) for r in self._state["runs"] if "n_files" not in r]
        frame = self.spark.createDataFrame(rows, ddl)
        for r in self._state["runs"]:
            if "n_files" in r:
                frame = frame.unionByName(self._files(r["path"]).select(F.lit(r["level"]).alias("level"), F.col("file").alias("counter"), F.lit(r["path"]).alias("path"), "n_entries", "n_tombstones", "smallest_key", "largest_key"))
        return resolve.recency(frame)

    def stats(self) -> dict:
        r = resolve.memtable_bytes(resolve.latest(self.pending())).first() if self._state["ops"] else {"entries": 0, "bytes": 0}
        return {"memtable_entries": r["entries"], "memtable_bytes": r["bytes"], "runs": sum(x.get("n_files", 1) for x in self._state["runs"]), "seq": self._state["seq"]}
