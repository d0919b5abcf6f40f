"""What the operators share: written intermediate tables, hashing and Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
#: While a table is written: shuffle files go at its end, and batches for Python are of few bytes.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}
_written: dict[str, SparkSession] = {}
_watching: list[list[str]] = []

U = np.uint64
MIX1, MIX2 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. The cluster names it in spark.checkpoint.dir; where that is
    unset, driver and executors must be one process, and a temporary folder is named there."""
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set(_SETTING, folder)
    return folder.rstrip("/")


def materialize(df: DataFrame, name: str = "part") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there, and a lost
    executor loses nothing. The shuffle files of the write go when it ends. The table goes with
    release(), and at the latest when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ledgerline/{os.getpid()}-{name}-{uuid.uuid4().hex}"
    before = {name: spark.conf.get(name) for name in _WRITING}
    for name, value in _WRITING.items():
        spark.conf.set(name, value)
    try:
        df.write.parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    _written[path] = spark
    for seen in _watching:
        seen.append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


@contextmanager
def written() -> Iterator[list[str]]:
    """The paths of what materialize() writes meanwhile."""
    seen: list[str] = []
    _watching.append(seen)
    try:
        yield seen
    finally:
        _watching.remove(seen)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame | str) -> None:
    """Delete written tables, or their paths, that nothing reads any more."""
    for table in tables:
        path = table if isinstance(table, str) else table.written_to
        if path in _written:
            _delete(_written.pop(path), path)


def reads(df: DataFrame, paths: list[str]) -> bool:
    """Whether df's plan still reads one of the paths."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        if leaf.getClass().getSimpleName() == "LogicalRelation" and leaf.relation().getClass().getSimpleName() == "HadoopFsRelation":
            found.append(leaf.relation().location().rootPaths().mkString("\n"))
    own = {path.rsplit("/", 1)[1] for path in paths}
    return any(name in text for name in own for text in found)


def cleanup() -> None:
    """Delete every table that materialize() wrote in this process."""
    while _written:
        path, spark = _written.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the session may already have ended
            if path.startswith("file://"):
                import shutil

                shutil.rmtree(path[7:], ignore_errors=True)


atexit.register(cleanup)


_claimed: list = []


def claim(owner: str, drop: Callable[[], None]) -> None:
    """Of a Python worker, which goes from one operator's tasks to another's: what the operator before
    has kept is dropped."""
    if _claimed and _claimed[0] != owner:
        _claimed[1]()
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)
    _claimed[:] = [owner, drop]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


def schema_of(*fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([pa.field(n, t) for n, t in fields])


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names; a null text becomes empty."""
    return df.select(
        df[id_col].cast("long").alias("doc_id"),
        F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"),
    )


def slices(batches, rows: int = 512, limit: int = 8 << 20):
    """Cut Arrow batches so that one slice holds few rows and, beyond its first row, few bytes."""
    for batch in batches:
        sizes = np.zeros(batch.num_rows, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                sizes += np.asarray(pa.compute.binary_length(column).fill_null(0))
        start = held = 0
        for at in range(batch.num_rows):
            if at > start and (at - start >= rows or held + sizes[at] > limit):
                yield batch.slice(start, at - start)
                start, held = at, 0
            held += sizes[at]
        if start < batch.num_rows:
            yield batch.slice(start)
