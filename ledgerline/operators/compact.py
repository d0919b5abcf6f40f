"""Compaction: the total merge of all runs, without tombstones, in files of bounded entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import ordered
from ledgerline.operators.resolve import merge
from ledgerline.schema import L1_ENTRIES


def compacted(runs: list[DataFrame]) -> DataFrame:
    """Live entries of all runs. Tombstones may go only because every run takes part."""
    return merge(runs).filter(~F.col("is_tombstone"))


def number_files(entries: DataFrame, per_file: int = L1_ENTRIES, first: int = 0, path: str | None = None) -> DataFrame:
    """entries, sorted and written (to path, if given), with file: disjoint ascending files of exactly
    per_file keys but for the last."""
    placed = ordered.numbered(entries, ["key"], "_place", path, **{"parquet.bloom.filter.enabled#key": "true"})
    return placed.withColumn("file", (F.floor(F.col("_place") / per_file) + first).cast("long")).drop("_place")
