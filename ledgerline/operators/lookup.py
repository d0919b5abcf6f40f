"""Reads over a snapshot: point and batch lookups, scans, and which runs a key may be in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import ordered


def get(entries: DataFrame, key: bytes) -> DataFrame:
    """The value of one key, no row if it isn't live. The filter reaches every scan below."""
    return entries.filter(F.col("key") == F.lit(key)).select("value")


def multi_get(keys: DataFrame, entries: DataFrame) -> DataFrame:
    """Every requested key with found and value. Spark picks the join by size."""
    return keys.join(entries.withColumn("found", F.lit(True)), "key", "left").select("key", F.coalesce("found", F.lit(False)).alias("found"), "value")


def only(entries: DataFrame, keys: DataFrame) -> DataFrame:
    """The entries of certain keys, cut down before anything is aggregated. A large set of keys is dealt
    by key, which the aggregate needs anyhow."""
    return entries.join(keys.select("key"), "key", "left_semi")


def missing(keys: DataFrame, entries: DataFrame) -> DataFrame:
    return keys.join(entries, "key", "left_anti")


def scan(entries: DataFrame, low: bytes | None = None, high: bytes | None = None) -> DataFrame:
    """Entries in key order from low (included) to high (excluded)."""
    if low is not None:
        entries = entries.filter(F.col("key") >= F.lit(low))
    if high is not None:
        entries = entries.filter(F.col("key") < F.lit(high))
    return entries.orderBy("key")


def prefix(entries: DataFrame, start: bytes) -> DataFrame:
    """Entries whose key begins so, as a range that scans can skip by."""
    stem = start.rstrip(b"\xff")
    return scan(entries, start, stem[:-1] + bytes([stem[-1] + 1]) if stem else None)


def probed_runs(keys: DataFrame, runs: DataFrame) -> DataFrame:
    """How many runs' key ranges each distinct key falls into: key, n_runs. Keys and the ranges' ends are
    put in one order, and the ranges that are open at a key are a running sum."""
    step = lambda df, c, kind, by: df.select(F.col(c).cast("binary").alias("key"), F.lit(kind).alias("kind"), F.lit(by).cast("long").alias("step"))
    ends = step(runs, "smallest_key", 0, 1).unionAll(step(runs, "largest_key", 2, -1))
    every = ordered.running_sum(step(keys.select("key").distinct(), "key", 1, 0).unionAll(ends), ["key", "kind"], "step", "n_runs")
    return every.filter("kind = 1").select("key", "n_runs")
