"""Streams of operations: into a store, or to a live snapshot in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from ledgerline.schema import DEL
from ledgerline.store import Store


def into_store(ops: DataFrame, store: Store, checkpoint: str, name: str | None = None, **trigger) -> StreamingQuery:
    """Apply each micro-batch to the store. A batch delivered again after a crash is recognised by its
    number and ignored; flush and compaction follow as for any batch. Numbers are those of the stream's
    checkpoint, by which it is known to the store unless it has a name."""

    def write(batch: DataFrame, number: int) -> None:
        store.apply(batch, token=f"{name or checkpoint}/{number}")

    return ops.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest_state(ops: DataFrame) -> DataFrame:
    """Per key the last operation so far, kept in state by seq, so late and repeated operations change
    nothing: key, is_tombstone, value, seq, emitted whenever a key changes (update mode)."""
    schema = "key binary, is_tombstone boolean, value binary, seq long"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, gone, value = state.get if state.exists else (-1, False, None)
        before = seq
        for pdf in frames:
            at = pdf["seq"].idxmax()
            if pdf["seq"][at] > seq:
                seq, gone = int(pdf["seq"][at]), bool(pdf["op"][at] == DEL)
                value = None if gone else bytes(pdf["value"][at])
        if seq > before:
            state.update((seq, gone, value))
            yield pd.DataFrame({"key": [bytes(key[0])], "is_tombstone": [gone], "value": [value], "seq": [seq]})

    return ops.groupBy("key").applyInPandasWithState(step, schema, "seq long, is_tombstone boolean, value binary", "update", GroupStateTimeout.NoTimeout)


def windowed_counts(ops: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """Operations by event-time window and type, with a watermark for late data."""
    return ops.withWatermark(time, late).groupBy(F.window(time, width), "op").agg(F.count("*").alias("n"))
