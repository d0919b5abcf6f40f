"""Rows of the engine: operations, run entries, and how tables become operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUT, DEL = 1, 2

OPS = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("op", T.ByteType(), False),
        T.StructField("key", T.BinaryType(), False),
        T.StructField("value", T.BinaryType(), True),
    ]
)
RUN = T.StructType(
    [
        T.StructField("key", T.BinaryType(), False),
        T.StructField("is_tombstone", T.BooleanType(), False),
        T.StructField("value", T.BinaryType(), True),
        T.StructField("seq", T.LongType(), False),
    ]
)

# The limits and sizes of the engine.
MEMTABLE_BYTES = 4 << 20
L0_RUNS = 4
L1_ENTRIES = 1000
BLOCK_BYTES = 4096


def operations(df: DataFrame, seq: Column | str, key: Column | str, value: Column | str, deleted: Column) -> DataFrame:
    """Any table as operations: a row deletes where deleted holds, else puts its value (a null value
    is put as empty: null alone never means deletion)."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    gone = F.coalesce(deleted, F.lit(False))
    return df.select(
        col(seq).cast("long").alias("seq"),
        F.when(gone, DEL).otherwise(PUT).cast("byte").alias("op"),
        F.coalesce(col(key).cast("binary"), F.lit(b"")).alias("key"),
        F.when(~gone, F.coalesce(col(value).cast("binary"), F.lit(b""))).alias("value"),
    )


def puts(df: DataFrame, seq: Column | str, key: Column | str, value: Column | str) -> DataFrame:
    return operations(df, seq, key, value, F.lit(False))


def deletes(df: DataFrame, seq: Column | str, key: Column | str) -> DataFrame:
    return operations(df, seq, key, F.lit(None).cast("binary"), F.lit(True))
