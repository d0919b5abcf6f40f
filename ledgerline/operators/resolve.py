"""Last writer wins: operations or runs to their latest state. Hash aggregates with partial stages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.schema import DEL


def latest(ops: DataFrame, *by: str) -> DataFrame:
    """The last operation of each key (within each value of the columns by): key, is_tombstone, value,
    seq. The flag and the value travel in one struct, so a null value never reads as a tombstone."""
    last = F.max_by(F.struct((F.col("op") == DEL).alias("is_tombstone"), "value", "seq"), "seq").alias("last")
    return ops.groupBy(*by, "key").agg(last).select(*by, "key", "last.is_tombstone", "last.value", "last.seq")


def snapshot(ops: DataFrame, as_of: int | None = None) -> DataFrame:
    """The live (key, value) pairs after all operations, or after those up to a sequence number."""
    if as_of is not None:
        ops = ops.filter(F.col("seq") <= as_of)
    return live(latest(ops))


def live(entries: DataFrame) -> DataFrame:
    """Drops tombstones. Only right on entries with one row per key."""
    return entries.filter(~F.col("is_tombstone")).select("key", "value")


def tombstones(ops: DataFrame) -> DataFrame:
    return latest(ops).filter("is_tombstone").select("key", "seq")


def merge(runs: list[DataFrame]) -> DataFrame:
    """The newest entry of each key over runs, which carry seq. One aggregate over their union."""
    every = reduce(DataFrame.unionByName, runs)
    last = F.max_by(F.struct("is_tombstone", "value", "seq"), "seq").alias("last")
    return every.groupBy("key").agg(last).select("key", "last.is_tombstone", "last.value", "last.seq")


def merge_ranked(entries: DataFrame, rank: str = "run_rank") -> DataFrame:
    """As merge, for entries without seq: the run of the greatest rank is the newest."""
    last = F.max_by(F.struct("is_tombstone", "value"), rank).alias("last")
    return entries.groupBy("key").agg(last, F.max(rank).alias(rank)).select("key", "last.is_tombstone", "last.value", rank)


def size_of(c: Column | str) -> Column:
    return F.octet_length(c).cast("long")


def memtable_bytes(entries: DataFrame) -> DataFrame:
    """Entries (tombstones count) and bytes: each distinct key costs 8, its length and its value's."""
    cost = size_of("key") + 8 + F.coalesce(size_of("value"), F.lit(0))
    return entries.agg(F.count("*").alias("entries"), F.coalesce(F.sum(cost), F.lit(0)).cast("long").alias("bytes"), F.count_if("is_tombstone").alias("tombstones"))


def run_statistics(entries: DataFrame, by: str = "run") -> DataFrame:
    """Per run: entries, tombstones and the least and greatest key."""
    return entries.groupBy(by).agg(F.count("*").alias("n_entries"), F.count_if("is_tombstone").alias("n_tombstones"), F.min("key").alias("smallest_key"), F.max("key").alias("largest_key"))


def recency(runs: DataFrame) -> DataFrame:
    """run_rank: the deepest level is the oldest, and in a level the least counter. The window goes
    over the manifest's rows, one per run."""
    from pyspark.sql import Window

    return runs.withColumn("run_rank", F.row_number().over(Window.orderBy(F.desc("level"), F.asc("counter"))).cast("long"))
