"""The sorted run file as a Spark data source: register(spark), then spark.read.format("runfile").load(path).

A file holds its entries in strictly ascending key order, an index of the first key of each block, a
membership filter and a footer. The reader yields one partition per file; a filter on key for equality
is pushed down and answered by filter, index and one block.
"""

from __future__ import annotations

import glob
import os
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from ledgerline.functions.binary import parse_run_name
from ledgerline.operators.bloom import PROBES, build, may_contain, n_blocks
from ledgerline.schema import BLOCK_BYTES

Entry = tuple[bytes, bytes | None]


def _packed(key: bytes) -> bytes:
    return struct.pack("<I", len(key)) + key


def encode_run(entries: Iterable[Entry], block: int = BLOCK_BYTES, rate: float = 0.01) -> bytes:
    """A run file's bytes. A value of None is a tombstone. Keys must ascend strictly."""
    data, index, keys, filled = bytearray(), [], [], None
    for key, value in entries:
        if keys and key <= keys[-1]:
            raise ValueError("keys must ascend strictly")
        if filled is None or filled >= block:
            index.append((key, len(data)))
            filled = 0
        body = value or b""
        record = bytes([value is None]) + _packed(key) + _packed(body)
        data += record
        filled += len(record)
        keys.append(key)
    index_at = len(data)
    data += struct.pack("<I", len(index)) + b"".join(_packed(k) + struct.pack("<Q", at) for k, at in index)
    filter_at = len(data)
    blocks = n_blocks(len(keys), rate)
    data += struct.pack("<QQ", PROBES, blocks) + build(keys, blocks) + struct.pack("<QQ", index_at, filter_at)
    return bytes(data)


def write_run(path: str, entries: Iterable[Entry]) -> None:
    """Write a run file so that it is either whole or absent: temporary file, sync, rename, sync."""
    data, part = encode_run(entries), path + ".tmp"
    try:
        with open(part, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.rename(part, path)
    except BaseException:
        if os.path.exists(part):
            os.remove(part)
        raise
    folder = os.open(os.path.dirname(path) or ".", os.O_RDONLY)
    try:
        os.fsync(folder)
    finally:
        os.close(folder)


def parse_entries(data: bytes) -> Iterator[Entry]:
    """Entries of a buffer, until its end or a cut-off one."""
    at = 0
    while at + 5 <= len(data):
        gone, (k,) = data[at], struct.unpack_from("<I", data, at + 1)
        if at + 9 + k > len(data):
            return
        (v,) = struct.unpack_from("<I", data, at + 5 + k)
        end = at + 9 + k + v
        if end > len(data):
            return
        yield data[at + 5 : at + 5 + k], None if gone else data[at + 9 + k : end]
        at = end


class RunFile:
    """A run file, by its path or its bytes. The footer, index and filter are read at once, blocks when
    they are needed."""

    def __init__(self, source: str | bytes):
        self.source = source
        size = os.path.getsize(source) if isinstance(source, str) else len(source)
        if size < 16:
            raise ValueError(f"{self}: no footer")
        self.index_at, filter_at = struct.unpack("<QQ", self._read(size - 16, size))
        if not self.index_at + 4 <= filter_at <= size - 32:
            raise ValueError(f"{self}: footer out of bounds")
        raw, blocks = self._read(self.index_at, filter_at), struct.unpack("<QQ", self._read(filter_at, filter_at + 16))[1]
        if max(1, blocks) * 64 > size - filter_at - 32:
            raise ValueError(f"{self}: filter out of bounds")
        self.filter = self._read(filter_at + 16, filter_at + 16 + max(1, blocks) * 64)
        (count,), at, self.index = struct.unpack_from("<I", raw, 0), 4, []
        for _ in range(count):
            if at + 12 > len(raw):
                raise ValueError(f"{self}: index out of bounds")
            (k,) = struct.unpack_from("<I", raw, at)
            if at + 12 + k > len(raw):
                raise ValueError(f"{self}: index out of bounds")
            self.index.append((raw[at + 4 : at + 4 + k], struct.unpack_from("<Q", raw, at + 4 + k)[0]))
            at += 12 + k

    def __str__(self) -> str:
        return self.source if isinstance(self.source, str) else "run file"

    def _read(self, begin: int, end: int) -> bytes:
        if not isinstance(self.source, str):
            return self.source[begin:end]
        with open(self.source, "rb") as f:
            f.seek(begin)
            return f.read(end - begin)

    def entries(self) -> Iterator[Entry]:
        for i in range(len(self.index)):
            yield from parse_entries(self._block(i))

    def _block(self, i: int) -> bytes:
        return self._read(self.index[i][1], self.index[i + 1][1] if i + 1 < len(self.index) else self.index_at)

    def find(self, key: bytes) -> list[Entry]:
        """The key's entry, a tombstone included, or none."""
        from bisect import bisect_right

        if not may_contain(self.filter, [key])[0]:
            return []
        i = bisect_right(self.index, key, key=lambda x: x[0]) - 1
        return [e for e in parse_entries(self._block(i)) if e[0] == key] if i >= 0 else []


def encoded_runs(entries: DataFrame, run: str = "run") -> DataFrame:
    """Each run's entries (key, is_tombstone, value) as a run file's bytes: run, data. A run is a file,
    so its entries meet in one task; they are bounded by the flush limit or the entries of a file."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        rows = zip(*(table.column(n).to_pylist() for n in ("key", "is_tombstone", "value")), strict=True)
        return pa.table({"run": table.column("run")[:1], "data": pa.array([encode_run((k, None if gone else v or b"") for k, gone, v in rows)], pa.binary())})

    own = entries.select(F.col(run).cast("long").alias("run"), "key", "is_tombstone", "value")
    return own.groupBy("run").applyInArrow(one, "run long, data binary")


def decoded_runs(runs: DataFrame, keys: bytes | None = None) -> DataFrame:
    """Run files as bytes (run, data), of any file system that Spark reads (format "binaryFile"), to
    their entries, or those of one key: run, key, is_tombstone, value."""

    def run(batches):
        for batch in batches:
            for r, data in ((r.as_py(), d.as_py()) for r, d in zip(batch.column(0), batch.column(1), strict=True)):
                file = RunFile(data)
                found = list(file.entries() if keys is None else file.find(keys))
                yield pa.record_batch([pa.array([r] * len(found), pa.int64()), pa.array([k for k, _ in found], pa.binary()), pa.array([v is None for _, v in found], pa.bool_()), pa.array([v for _, v in found], pa.binary())], names=["run", "key", "is_tombstone", "value"])

    return runs.select("run", "data").mapInArrow(run, "run long, key binary, is_tombstone boolean, value binary")


@dataclass
class _File(InputPartition):
    path: str
    key: bytes | None = None

    def __init__(self, path: str, key: bytes | None = None):
        self.path, self.key = path, key


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.key = options["path"], None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("key",) and self.key is None:
                self.key = bytes(f.value)
            yield f

    def partitions(self):
        found = sorted(glob.glob(os.path.join(self.path, "*.sst"))) if os.path.isdir(self.path) else [self.path]
        return [_File(p, self.key) for p in found if parse_run_name(os.path.basename(p))]

    def read(self, partition: _File):
        run, (level, counter) = RunFile(partition.path), parse_run_name(os.path.basename(partition.path))
        for key, value in run.entries() if partition.key is None else run.find(partition.key):
            yield level, counter, key, value is None, value


class RunFileSource(DataSource):
    """Run files of a folder that every executor can read; names that don't parse are skipped."""

    @classmethod
    def name(cls) -> str:
        return "runfile"

    def schema(self) -> str:
        return "level long, counter long, key binary, is_tombstone boolean, value binary"

    def reader(self, schema):
        return _Reader(self.options)


def register(spark) -> None:
    """Make the format "runfile" known, with filters handed down to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RunFileSource)
