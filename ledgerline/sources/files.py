"""Files of a store's directory: a POSIX folder, or any file system that Hadoop knows.

Both publish a file whole or not at all, never over another one, and hold a lock for one writer.
"""

from __future__ import annotations

import atexit
import contextlib
import fcntl
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"


class Posix:
    """A folder that driver and executors share under one path."""

    def __init__(self, path: str):
        self.path = path

    def url(self, name: str = "") -> str:
        return "file://" + os.path.abspath(os.path.join(self.path, name))

    def _at(self, name: str) -> str:
        return os.path.join(self.path, name)

    def make(self, name: str) -> None:
        os.makedirs(self._at(name), exist_ok=True)

    def names(self, name: str) -> list[str]:
        return sorted(os.listdir(self._at(name)))

    def read(self, name: str) -> bytes:
        with open(self._at(name), "rb") as f:
            return f.read()

    def publish(self, name: str, data: bytes) -> None:
        part = self._at(name) + ".tmp"
        with open(part, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        if os.path.exists(self._at(name)):
            raise FileExistsError(self._at(name))
        os.rename(part, self._at(name))
        self._sync(os.path.dirname(self._at(name)))

    def _sync(self, path: str) -> None:
        fd = os.open(path, os.O_RDONLY)
        try:
            os.fsync(fd)
        finally:
            os.close(fd)

    def settle(self, name: str) -> None:
        """Force a written folder to disk."""
        for folder, _, names in os.walk(self._at(name)):
            for n in names:
                self._sync(os.path.join(folder, n))
            self._sync(folder)

    def remove(self, name: str) -> None:
        at = self._at(name)
        if os.path.isdir(at):
            shutil.rmtree(at)
        elif os.path.exists(at):
            os.remove(at)

    def lock(self) -> None:
        self._held = open(self._at("LOCK"), "a")  # noqa: SIM115
        try:
            fcntl.flock(self._held, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            self._held.close()
            raise RuntimeError(f"{self.path} is open in another process") from e

    def unlock(self) -> None:
        self._held.close()


class Hadoop:
    """A folder of a file system that Spark's own readers use. A file is written under a temporary name
    and renamed, which such systems refuse if the name is taken. The lock is a file; that of a process
    which died stays, until break_lock()."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def url(self, name: str = "") -> str:
        return f"{self.path}/{name}" if name else self.path

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self.url(name))

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._at(name))

    def names(self, name: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._at(name)))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._at(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def publish(self, name: str, data: bytes) -> None:
        part = self._at(f"{name}.{uuid.uuid4().hex}.tmp")
        out = self._fs.create(part, False)
        try:
            out.write(bytearray(data))
            out.hsync()
        finally:
            out.close()
        if self._fs.exists(self._at(name)) or not self._fs.rename(part, self._at(name)):
            self._fs.delete(part, False)
            raise FileExistsError(self.url(name))

    def settle(self, name: str) -> None:
        """Such systems keep what is closed."""

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)

    def lock(self) -> None:
        try:
            self._fs.create(self._at("LOCK"), False).close()
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                raise RuntimeError(f"{self.path} is open in another process; after a crash, call break_lock()") from e
            raise

    def unlock(self) -> None:
        self.remove("LOCK")


def folder(spark: SparkSession, path: str) -> Posix | Hadoop:
    """The folder at path, of whichever file system path names."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.getScheme() == "file":
        return Posix(where.toUri().getPath())
    return Hadoop(spark, path)


def break_lock(spark: SparkSession, path: str) -> None:
    """Remove the lock of a process that died; never while it lives."""
    folder(spark, path).remove("LOCK")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share, which the cluster names in
    spark.checkpoint.dir; where that is unset, driver and executors must be one process."""
    shared = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if not shared:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError(f"set {_SETTING} to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="ledgerline-")
        spark.conf.set(_SETTING, shared)
    path = f"{shared.rstrip('/')}/ledgerline/{name}-{uuid.uuid4().hex}"
    _scratches[path] = spark
    return path


_scratches: dict[str, SparkSession] = {}


@atexit.register
def cleanup() -> None:
    """Delete what scratch() named in this process."""
    while _scratches:
        path, spark = _scratches.popitem()
        with contextlib.suppress(Exception):  # the session may already have ended
            folder(spark, path).remove("")
            continue
        if path.startswith("file:/"):
            shutil.rmtree("/" + path[5:].lstrip("/"), ignore_errors=True)


def written(df: DataFrame, path: str) -> DataFrame:
    """df, written as Parquet to path and read back."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
