"""A blocked membership filter, one block of 512 bits and eight probes per key, in NumPy.

Keys are hashed column-wise: all keys of a batch advance by one byte at a time. 64-bit arithmetic wraps
in NumPy, which SQL's does not.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U = np.uint64
# Bases, multipliers and sizes of the filter's format.
BASIS, PRIME = U(14695981039346656037), U(1099511628211)
SPREAD, FINISH = U(0x9E3779B97F4A7C15), U(0xFF51AFD7ED558CCD)
BLOCK_BITS, PROBES = 512, 8
#: Blocks in a segment of a filter that is built, and bytes of segments a task holds.
SEGMENT, HELD = 1 << 14, 64 << 20
#: Pairs of a key and a run in an Arrow batch.
PAIRS = 16_384


def n_blocks(keys: int, rate: float = 0.01) -> int:
    bits = int(-keys * math.log(rate) / math.log(2) ** 2)
    return max(1, -(-bits // BLOCK_BITS))


def hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(k) for k in keys], np.int64)
    starts = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(keys), np.uint8)
    one, two = np.full(len(keys), BASIS), np.full(len(keys), PRIME)
    order = np.argsort(-sizes, kind="stable")
    for at in range(int(sizes.max(initial=0))):
        order = order[: int(np.count_nonzero(sizes[order] > at))]
        c = data[starts[order] + at].astype(U)
        one[order] = (one[order] ^ c) * PRIME
        h = (two[order] ^ c) * SPREAD
        two[order] = h << U(27) | h >> U(37)
    two ^= two >> U(33)
    two *= FINISH
    two ^= two >> U(29)
    return one, two | U(1)


def positions(keys: list[bytes], blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Each key's block, and its eight bits in it."""
    one, two = hashes(keys)
    return (one % U(blocks)).astype(np.int64), ((one[:, None] + np.arange(PROBES, dtype=U) * two[:, None]) % U(BLOCK_BITS)).astype(np.int64)


def build(keys: list[bytes], blocks: int) -> bytes:
    bits = np.zeros(max(1, blocks) * BLOCK_BITS, np.uint8)
    if keys:
        block, bit = positions(keys, max(1, blocks))
        bits[(block[:, None] * BLOCK_BITS + bit).ravel()] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_contain(data: bytes, keys: list[bytes]) -> np.ndarray:
    blocks = max(1, len(data) // (BLOCK_BITS // 8))
    bits = np.unpackbits(np.frombuffer(data.ljust(BLOCK_BITS // 8, b"\0"), np.uint8), bitorder="little")
    if not keys:
        return np.zeros(0, bool)
    block, bit = positions(keys, blocks)
    return bits[block[:, None] * BLOCK_BITS + bit].all(axis=1)


def build_filters(entries: DataFrame, run: str = "run", rate: float = 0.01) -> DataFrame:
    """Per run its filter: run, n_keys, filter. A run's filter is made in segments of its blocks, each
    task reduces its keys to bits first, and only the bits of one segment meet in a task."""
    counts = entries.groupBy(F.col(run).cast("long").alias("run")).agg(F.count("*").alias("n_keys"))
    keyed = entries.select(F.col(run).cast("long").alias("run"), F.col("key").cast("binary").alias("key")).join(counts, "run")

    def partial(frames):
        made: dict[tuple[int, int, int], np.ndarray] = {}
        for pdf in frames:
            for (r, n), part in pdf.groupby(["run", "n_keys"]):
                blocks = n_blocks(n, rate)
                block, bit = positions([bytes(k) for k in part["key"]], blocks)
                for s in np.unique(block // SEGMENT).tolist():
                    own = block // SEGMENT == s
                    size = min(SEGMENT, blocks - s * SEGMENT)
                    bits = np.zeros(size * BLOCK_BITS, np.uint8)
                    bits[((block[own] - s * SEGMENT)[:, None] * BLOCK_BITS + bit[own]).ravel()] = 1
                    packed = np.packbits(bits, bitorder="little")
                    made[r, n, s] = made[r, n, s] | packed if (r, n, s) in made else packed
            if len(made) * SEGMENT * BLOCK_BITS // 8 > HELD:
                yield frame(made)
                made = {}
        yield frame(made)

    def frame(made: dict) -> pd.DataFrame:
        r, n, s = zip(*made, strict=True) if made else ((), (), ())
        return pd.DataFrame({"run": np.array(r, np.int64), "n_keys": np.array(n, np.int64), "segment": np.array(s, np.int64), "bits": [b.tobytes() for b in made.values()]})

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in pdf["bits"]])
        return pd.DataFrame({"run": pdf["run"][:1], "n_keys": pdf["n_keys"][:1], "segment": pdf["segment"][:1], "bits": [bits.tobytes()]})

    blank = counts.select("run", "n_keys", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((_blocks(rate) - 1) / SEGMENT))).alias("segment"))
    size = F.least(F.lit(SEGMENT), _blocks(rate) - F.col("segment") * SEGMENT)
    set_ = keyed.mapInPandas(partial, "run long, n_keys long, segment long, bits binary").groupBy("run", "segment").applyInPandas(join, "run long, n_keys long, segment long, bits binary")
    every = blank.join(set_.select("run", "segment", "bits"), ["run", "segment"], "left")
    bits = F.coalesce("bits", F.unhex(F.repeat(F.lit("00"), (size * (BLOCK_BITS // 8)).cast("int"))))
    pieces = every.groupBy("run", "n_keys").agg(F.sort_array(F.collect_list(F.struct("segment", bits.alias("bits")))).alias("p"))  # a filter is one value by its format
    return pieces.select("run", "n_keys", F.aggregate("p.bits", F.lit(b""), lambda a, b: F.concat(a, b)).alias("filter"))


def _blocks(rate: float) -> Column:
    """n_blocks() of the column n_keys."""
    bits = F.floor(F.col("n_keys") * F.lit(-math.log(rate)) / F.lit(math.log(2) ** 2))
    return F.greatest(F.lit(1), F.ceil(bits / BLOCK_BITS)).cast("long")


def probe(pairs: DataFrame, filters: DataFrame, salts: int = 8) -> DataFrame:
    """pairs (key, run) with hit: whether the run may hold the key by its filter, if it has one. A run's keys are dealt to
    salts tasks, and its filter goes to each of them once."""
    key = F.col("key").cast("binary").alias("key")
    asks = pairs.select(F.col("run").cast("long").alias("run"), F.pmod(F.xxhash64("key"), F.lit(salts)).alias("salt"), F.lit(1).alias("ask"), key, F.lit(None).cast("binary").alias("filter"))
    held = filters.select(F.col("run").cast("long").alias("run"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("salt"), F.lit(0).alias("ask"), F.lit(None).cast("binary").alias("key"), "filter")
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(frames):
        now, data = None, b""
        for pdf in frames:
            for r, part in pdf.groupby("run", sort=False):
                first = part[part["ask"] == 0]
                if len(first):
                    now, data = r, bytes(first["filter"].iloc[0])
                keys = [bytes(k) for k in part.loc[part["ask"] == 1, "key"]]
                hit = may_contain(data, keys) if now == r else np.ones(len(keys), bool)
                yield pd.DataFrame({"key": keys, "run": np.full(len(keys), r), "hit": hit})

    dealt = asks.unionByName(held).repartition(parts, "run", "salt").sortWithinPartitions("run", "salt", "ask")
    return dealt.mapInPandas(run, "key binary, run long, hit boolean")


def prune(keys: DataFrame, filters: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """The (key, run) pairs worth reading: runs whose filter may hold the key. The pairs are a stated set
    of keys against all runs; with the runs' ranges (run, smallest_key, largest_key) only against those
    whose range holds the key, at most one where ranges are disjoint."""
    if ranges is not None:
        return probe(in_range(keys, ranges), filters).filter("hit").select("key", "run")
    runs = sorted(r["run"] for r in filters.select("run").collect())  # one number per run
    pairs = keys.select("key", F.explode(F.array(*(F.lit(r).cast("long") for r in runs))).alias("run")) if runs else keys.select("key", F.lit(0).cast("long").alias("run")).limit(0)
    return probe(pairs, filters).filter("hit").select("key", "run")


def in_range(keys: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each key with the runs whose range of keys, ends included, holds it: key, run. Runs go by their
    least keys; those before the first that reaches up to a key are never looked at."""
    ends = ranges.select(F.col("run").cast("long"), F.col("smallest_key").cast("binary"), F.col("largest_key").cast("binary"))
    rows = sorted((bytes(r[1]), bytes(r[2]), r[0]) for r in ends.collect() if r[1] is not None)  # one row per run
    lows, highs, runs = ([r[i] for r in rows] for i in range(3))
    reach = list(accumulate(highs, max))

    def held(batches):
        for batch in batches:
            found, which = [], []
            for key in batch.column(0).to_pylist():
                if key is None:
                    continue
                last = bisect_right(lows, key)
                for i in range(bisect_left(reach, key, 0, last), last):
                    if highs[i] >= key:
                        found.append(key)
                        which.append(runs[i])
                if len(found) >= PAIRS:
                    yield pairs(found, which)
                    found, which = [], []
            yield pairs(found, which)

    def pairs(found: list[bytes], which: list[int]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(found, pa.binary()), pa.array(which, pa.int64())], names=["key", "run"])

    return keys.select(F.col("key").cast("binary")).mapInArrow(held, "key binary, run long")
