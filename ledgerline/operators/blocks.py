"""Block formation and block lookup.

A block takes entries until those already in it reach the block size. The cut depends on all entries
before it, so it is a fold over each run in key order; runs are folded in parallel, batch by batch,
and only a run's counters are held.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.schema import BLOCK_BYTES


def entry_bytes():
    """Bytes of an entry in a run file: flag, two lengths, key and value."""
    return (F.octet_length("key") + 9 + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long")


def cut(sizes: np.ndarray, filled: int, limit: int) -> tuple[np.ndarray, int]:
    """Which entries start a block, and the fill after the last. filled < 0: no block is open."""
    starts = np.zeros(len(sizes), bool)
    for i, n in enumerate(sizes.tolist()):
        if filled < 0 or filled >= limit:
            starts[i], filled = True, 0
        filled += n
    return starts, filled


def out_of_order(entries: DataFrame, run: str = "run", order: str = "seq") -> DataFrame:
    """Per run how many entries, in the order they were appended in, don't come behind the key before:
    run, n_entries, n_violations. A run may be written only without any."""
    before = F.lag("key").over(Window.partitionBy(run).orderBy(order))
    seen = entries.select(F.col(run).cast("long").alias("run"), (F.col("key") <= before).alias("bad"))
    return seen.groupBy("run").agg(F.count("*").alias("n_entries"), F.count_if("bad").alias("n_violations"))


def form_blocks(entries: DataFrame, run: str = "run", limit: int = BLOCK_BYTES) -> DataFrame:
    """Per entry its block: run, key, bytes, offset in the run's data, block_id from 0."""
    sized = entries.select(F.col(run).cast("long").alias("run"), "key", entry_bytes().alias("bytes"))
    key = sized.schema["key"].dataType.simpleString()

    def fold(batches):
        now, filled, block, offset = None, -1, -1, 0
        for batch in batches:
            runs, sizes = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            blocks, offsets = np.zeros(len(runs), np.int64), np.zeros(len(runs), np.int64)
            edges = [0, *(np.flatnonzero(np.diff(runs)) + 1).tolist(), len(runs)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if runs[a] != now:
                    now, filled, block, offset = runs[a], -1, -1, 0
                starts, filled = cut(sizes[a:b], filled, limit)
                blocks[a:b] = block + np.cumsum(starts)
                offsets[a:b] = offset + np.cumsum(sizes[a:b]) - sizes[a:b]
                block, offset = int(blocks[b - 1]), int(offsets[b - 1] + sizes[b - 1])
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(offsets), pa.array(blocks)], names=["run", "key", "bytes", "offset", "block_id"])

    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sized.repartition(parts, "run").sortWithinPartitions("run", "key").mapInArrow(fold, f"run long, key {key}, bytes long, offset long, block_id long")


def block_index(formed: DataFrame) -> DataFrame:
    """The sparse index: run, block_id, first_key, offset, end, entries and bytes of each block."""
    blocks = formed.groupBy("run", "block_id").agg(F.min("key").alias("first_key"), F.min("offset").alias("offset"), F.sum("bytes").alias("bytes"), F.count("*").alias("n_entries"))
    return blocks.withColumn("end", F.col("offset") + F.col("bytes"))


def locate(keys: DataFrame, index: DataFrame) -> DataFrame:
    """For each (run, key) the block whose first key is the greatest not after it; none before the first
    block. Keys and index are merged in one ordered pass per run instead of a range join."""
    marks = index.select("run", F.col("first_key").alias("key"), "block_id", F.lit(0).alias("ask"))
    asks = keys.select("run", "key", F.lit(None).cast("long").alias("block_id"), F.lit(1).alias("ask"))
    order = Window.partitionBy("run").orderBy("key", "ask").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(asks).withColumn("block_id", F.last("block_id", ignorenulls=True).over(order)).filter("ask = 1").select("run", "key", "block_id")
