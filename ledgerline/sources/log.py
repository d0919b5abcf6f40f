"""The binary operation log: encoding, layout and recovery.

A record is type, key and value lengths, key, value and a CRC-32 of type, key and value, padded with
zeros to 512 bytes. Recovery walks a file record by record and takes up again at the next 512-byte step
after anything it can't accept. Files are independent, so each is a task; operations are emitted in
file order.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.functions.binary import ALIGN, aligned, op_byte, record_bytes, record_crc
from ledgerline.operators import ordered
from ledgerline.schema import DEL, PUT

#: A log beyond this many bytes is refused.
MAX_BYTES = 1 << 30
#: Records in an Arrow batch, and bytes of keys and values after which it is closed.
BATCH, BATCH_BYTES = 16_384, 16 << 20
RECOVERED = "file string, offset long, op byte, key binary, value binary"
WARNED = "file string, outcome string, offset long"
#: Outcomes of recovery at a place.
VALID, PADDING, SHORT, LENGTHS, CHECKSUM, TYPE = "valid", "padding", "short", "lengths", "checksum", "type"


def _little(n, width: int = 4):
    """A column's low bytes, least first."""
    h = F.lpad(F.hex(n.cast("long")), 2 * width, "0")
    return F.unhex(F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(width)))))


def encoded(ops: DataFrame) -> DataFrame:
    """seq and record, the padded bytes of each operation, by column functions only."""
    value = F.coalesce("value", F.lit(b""))
    plain = F.concat(op_byte(F.col("op")), _little(F.octet_length("key")), _little(F.octet_length(value)), F.col("key"), value, _little(record_crc(F.col("op"), F.col("key"), F.col("value"))))
    size = record_bytes(F.col("key"), F.col("value"))
    zeros = F.unhex(F.repeat(F.lit("00"), (aligned(size) - size).cast("int")))
    return ops.select("seq", F.concat(plain, zeros).alias("record"))


def layout(ops: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Where each record begins in its log: seq, offset, length. One log of all operations is a running
    sum over ranges of seq; with the columns by there is a log per value, each of bounded size."""
    length = aligned(record_bytes(F.col("key"), F.col("value")))
    sized = ops.select(*(by or []), "seq", length.alias("length"))
    if by:
        order = Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        return sized.withColumn("offset", F.sum("length").over(order) - F.col("length"))
    total = ordered.running_sum(sized, ["seq"], "length", "offset")
    return total.withColumn("offset", F.col("offset") - F.col("length"))


def encode(op: int, key: bytes, value: bytes | None) -> bytes:
    value = value or b""
    crc = zlib.crc32(bytes([op]) + key + value)
    plain = struct.pack("<BII", op, len(key), len(value)) + key + value + struct.pack("<I", crc)
    return plain + bytes(-len(plain) % ALIGN)


def walk(data: bytes | memoryview) -> Iterator[tuple[int, int, int, int, str]]:
    """What recovery makes of each place it looks at: offset, type, end of the key and of the value, and
    the outcome. After anything but a valid record it goes on at the next 512-byte step."""
    if len(data) > MAX_BYTES:
        raise ValueError(f"the log has {len(data)} bytes; at most {MAX_BYTES} are recovered")
    at, total, lengths, crc32, view = 0, len(data), struct.Struct("<BII").unpack_from, zlib.crc32, memoryview(data)
    while at < total:
        kind = data[at]
        if not kind:
            yield at, 0, at, at, PADDING
        elif at + 9 > total:
            yield at, kind, at, at, SHORT
        else:
            _, k, v = lengths(data, at)
            key_end = at + 9 + k
            end = key_end + v
            if end + 4 > total:
                yield at, kind, at, at, LENGTHS
            elif crc32(view[at + 9 : end], crc32(view[at : at + 1])) != int.from_bytes(view[end : end + 4], "little"):
                yield at, kind, at, at, CHECKSUM
            elif kind not in (PUT, DEL):
                yield at, kind, at, at, TYPE
            else:
                yield at, kind, key_end, end, VALID
                at += (13 + k + v + ALIGN - 1) // ALIGN * ALIGN
                continue
        at = (at // ALIGN + 1) * ALIGN


def decode(data: bytes | memoryview) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """(offset, op, key, value) of the records that recovery accepts."""
    for at, kind, key_end, end, outcome in walk(data):
        if outcome is VALID:
            yield at, kind, bytes(data[at + 9 : key_end]), bytes(data[key_end:end]) if kind == PUT else None


def write_log(path: str, ops: Iterable[tuple[int, bytes, bytes | None]]) -> None:
    """Append operations to a local log file, resuming at its end, and force them to disk. Behind a torn
    write it resumes at the next 512-byte step, where recovery looks again."""
    with open(path, "ab") as f:
        f.write(bytes(-f.tell() % ALIGN))
        for op, key, value in ops:
            f.write(encode(op, key, value))
        f.flush()
        os.fsync(f.fileno())


def clear_log(path: str) -> None:
    """Empty a log whose operations are safe elsewhere: an empty file takes its place at once."""
    with open(path + ".tmp", "wb") as f:
        os.fsync(f.fileno())
    os.rename(path + ".tmp", path)


def _logs(spark: SparkSession, path: str) -> DataFrame | None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where) in (None, []):
        return None
    files_ = spark.read.format("binaryFile").load(path)
    if files_.filter(F.col("length") > MAX_BYTES).head(1):
        raise ValueError(f"a log under {path} has more than {MAX_BYTES} bytes")
    return files_.select("path", "content")


def recover(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, op, key and value of the accepted records of all logs under path. A missing path
    gives no rows."""
    logs = _logs(spark, path)
    return spark.createDataFrame([], RECOVERED) if logs is None else logs.mapInArrow(decode_batches, RECOVERED)


def _each(batches) -> Iterator[tuple[str, bytes | memoryview]]:
    """The names and bytes of logs in Arrow batches, one at a time and not copied."""
    for batch in batches:
        for name, data in zip(batch.column(0), batch.column(1), strict=True):
            yield name.as_py(), memoryview(data.as_buffer()).cast("B") if data.is_valid else b""


def decode_batches(batches):
    """Arrow batches of a name and a log's bytes, as batches of the accepted records."""
    for name, data in _each(batches):
        records, held = [], 0
        for record in decode(data):
            records.append(record)
            held += len(record[2]) + len(record[3] or b"")
            if len(records) == BATCH or held >= BATCH_BYTES:
                yield _records(name, records)
                records, held = [], 0
        yield _records(name, records)


def _records(name, rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int8(), pa.binary(), pa.binary())
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.record_batch([pa.array([name] * len(rows), pa.string()), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=["file", "offset", "op", "key", "value"])


def warned_batches(batches):
    """Arrow batches of a name and a log's bytes, as batches of the places recovery warns of."""
    for name, data in _each(batches):
        met = [(w[4], w[0]) for w in walk(data) if w[4] in (LENGTHS, CHECKSUM, TYPE)]
        yield pa.record_batch([pa.array([name] * len(met), pa.string()), pa.array([m[0] for m in met], pa.string()), pa.array([m[1] for m in met], pa.int64())], names=["file", "outcome", "offset"])


def warnings(logs: DataFrame) -> DataFrame:
    """What recovery warns of in logs (a name and the bytes): per log the outcome (lengths, checksum or
    type), at how many places it was met, and the first of them: file, outcome, places, first_offset.
    Padding and a tail too short for lengths are passed over in silence."""
    return counted(logs.mapInArrow(warned_batches, WARNED))


def counted(met: DataFrame) -> DataFrame:
    """Warned places (file, outcome, offset) as warnings() shows them."""
    return met.groupBy("file", "outcome").agg(F.count("*").alias("places"), F.min("offset").alias("first_offset"))


def damage(spark: SparkSession, path: str) -> DataFrame:
    """The warnings of all logs under path."""
    logs = _logs(spark, path)
    return warnings(spark.createDataFrame([], "path string, content binary") if logs is None else logs)


def replay(recovered: DataFrame, after: int = 0) -> DataFrame:
    """Recovered records as operations: seq follows file and offset, from after + 1 on."""
    placed = ordered.numbered(recovered, ["file", "offset"], "_place")
    return placed.select((F.col("_place") + (after + 1)).cast("long").alias("seq"), "op", "key", "value")
