"""Repeated byte strings across documents by bucket-pointer refinement of suffixes.

To find every L-byte string that starts earlier too, suffixes need sorting to depth L only, and only
where a repeat is possible.

1. Each L-byte window names its anchor, the q-gram in it with the least identifier (the first of
   equals). Equal windows have equal anchors at equal places, and about two in L - q positions are
   anchors. Anchors and the range of windows each stands for are written. An identifier is a hash of
   the q-gram, so it means the same in every task.
2. Initial buckets: anchors are counted by identifier; buckets of one are settled and dropped.
3. The bytes that the windows of an anchor in a shared bucket cover are brought together by bucket.
   Equal stretches are one, and all but the earliest are repeats. What differs is refined in rounds:
   suffixes are sorted inside their buckets by the buckets of the suffixes q bytes on, which gives
   depth 2q; buckets of one are dropped; the buckets of double depth, made of those at hand, are the
   keys of the next round. At depth L all but the first of a bucket are repeats, if the bytes of the two
   are equal.
   A bucket too large for one task goes by 128-bit identifiers of its windows instead, whose earliest
   start is a pre-aggregated minimum.
4. Repeats are merged to byte ranges by document and cut.

Cases: null and empty texts have no bytes; texts shorter than L keep all; a text that repeats itself
loses the later parts, overlapping ones too; the order of documents is that of their ids, a null id
first; rows that share an id are one document, and equal starts in them are one; a text of any length
is read in segments; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import U, documents, materialize, mix64, release, schema_of, slices

Q = 32
SEGMENT = 1 << 18
#: Windows of a bucket beyond which it is refined before the shuffle.
LARGE = 20_000
#: Bytes of contexts sorted at once in a task.
CHUNK = 1 << 20
_POS_BITS = 20
_ODD = U(0x9E3779B97F4A7C15)
_BYTE = mix64(np.arange(1, 257, dtype=U) * _ODD)


def refine(ids: np.ndarray, by: int) -> np.ndarray:
    """Identifiers at depth d + by (by <= d) from those at depth d."""
    if len(ids) <= by:
        return np.zeros(0, U)
    out = ids[:-by] * _ODD
    out ^= out >> U(29)
    out += ids[by:]
    out *= U(0xBF58476D1CE4E5B9)
    out ^= out >> U(32)
    return out


def buckets(data: np.ndarray, depth: int) -> np.ndarray:
    """Identifiers of the depth-byte string at every start."""
    ids, at = _BYTE[data], 1
    while at < depth:
        by = min(at, depth - at)
        ids = refine(ids, by)
        at += by
    return ids


def _anchors(data: np.ndarray, length: int):
    """(identifier, place, first window, last window) of the anchors of one document's bytes."""
    found = []
    for begin in range(0, max(1, len(data) - length + 1), SEGMENT):
        part = data[begin : begin + SEGMENT + length - 1]
        ids = buckets(part, Q)
        width = length - Q + 1
        if len(ids) < width:
            continue
        low = (ids >> U(_POS_BITS) << U(_POS_BITS)) | np.arange(len(ids), dtype=U)
        at = 1
        while at < width:
            by = min(at, width - at)
            low = np.minimum(low[:-by], low[by:])
            at += by
        place = (low & U((1 << _POS_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], len(place)) - 1
        place = place[first]
        found.append((ids[place], place + begin, first + begin, last + begin))
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else None


_PACKED = schema_of(("known", pa.bool_()), ("doc", pa.int64()), ("salt", pa.int64()), ("anchors", pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64())]))))
#: What names a text: whether its id is known, the id, and the text's hash.
_TEXT = ("known", "doc", "salt")
_CONTEXT = schema_of(("h", pa.int64()), ("known", pa.bool_()), ("doc", pa.int64()), ("salt", pa.int64()), ("first", pa.int64()), ("context", pa.binary()))
_WINDOW = schema_of(("w", pa.int64()), ("v", pa.int64()), ("known", pa.bool_()), ("doc", pa.int64()), ("salt", pa.int64()), ("first", pa.int64()))
_RANGE = schema_of(("known", pa.bool_()), ("doc", pa.int64()), ("salt", pa.int64()), ("begin", pa.int64()), ("end", pa.int64()))


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """Per text its anchors: identifier and, packed, the first window (from bit 7 on) and how many windows
    follow (7 bits)."""

    def run(batches):
        for part in slices(batches, limit=1 << 20):
            ids, flat, ends = [], [], [0]
            for text in part.column(3).to_pylist():
                got = _anchors(np.frombuffer(text.encode(), np.uint8), length)
                if got:
                    h, _, first, last = got
                    ids.append(h.view(np.int64))
                    flat.append(first << 7 | last - first)
                    ends.append(ends[-1] + len(h))
                else:
                    ends.append(ends[-1])
            none, kind = np.zeros(0, np.int64), _PACKED.field("anchors").type
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(ids or [none])), pa.array(np.concatenate(flat or [none]))], fields=list(kind.value_type))
            yield pa.record_batch([*(part.column(i) for i in range(3)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs).cast(kind)], schema=_PACKED)

    return docs.select(*_TEXT, "text").mapInArrow(run, "known boolean, doc long, salt long, anchors array<struct<h:long,at:long>>")


def _cut(joined: DataFrame, length: int) -> DataFrame:
    """From texts with their anchors in shared buckets: the bytes that an anchor's windows cover."""

    def run(batches):
        for part in slices(batches, rows=64, limit=1 << 20):
            h, row, start, cut = [], [], [], []
            for i, (text, shared) in enumerate(zip(part.column("text").to_pylist(), part.column("shared").to_pylist(), strict=True)):
                raw = text.encode()
                for a in shared:
                    h.append(a["h"])
                    row.append(i)
                    start.append(a["at"] >> 7)
                    cut.append(raw[start[-1] : start[-1] + (a["at"] & 127) + length])
            rows = pa.array(row, pa.int64())
            yield pa.record_batch([pa.array(h, pa.int64()), *(part.column(n).take(rows) for n in _TEXT), pa.array(start, pa.int64()), pa.array(cut, pa.binary())], schema=_CONTEXT)

    return joined.mapInArrow(run, "h long, known boolean, doc long, salt long, first long, context binary")


def _refined(joined: DataFrame, length: int) -> DataFrame:
    """The windows themselves, under 128-bit identifiers of their whole depth."""

    def run(batches):
        for part in slices(batches, rows=64, limit=1 << 20):
            for i, (text, shared) in enumerate(zip(part.column("text").to_pylist(), part.column("shared").to_pylist(), strict=True)):
                raw, w, v, start = text.encode(), [], [], []
                for a in shared:
                    first = a["at"] >> 7
                    piece = np.frombuffer(raw[first : first + (a["at"] & 127) + length], np.uint8)
                    w.append(mix64(buckets(piece, length) + U(a["h"] & (1 << 64) - 1)).view(np.int64))
                    v.append(buckets(piece[::-1], length)[::-1].view(np.int64))
                    start.append(np.arange(first, first + len(w[-1])))
                rows = pa.array(np.full(sum(map(len, w)), i))
                yield pa.record_batch([pa.array(np.concatenate(w)), pa.array(np.concatenate(v)), *(part.column(n).take(rows) for n in _TEXT), pa.array(np.concatenate(start))], schema=_WINDOW)

    return joined.mapInArrow(run, "w long, v long, known boolean, doc long, salt long, first long")


def _sorted_buckets(bucket: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round: suffixes sorted by the identifiers of their buckets at a later offset, inside their
    buckets so far. What stands in buckets of several, in order, and their new buckets."""
    order = np.lexsort((key, bucket))
    bucket, key = bucket[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (key[1:] != key[:-1])
    number = np.cumsum(new)
    several = np.bincount(number)[number] > 1
    return order[several], number[several]


def _settle(table: pa.Table, length: int) -> pa.RecordBatch:
    """The ranges of whole buckets' windows that start earlier too."""
    h, known, doc, salt, first = (table.column(n).to_numpy() for n in ("h", "known", "doc", "salt", "first"))
    pieces = table.column("context").to_pylist()
    sizes = np.array([len(p) for p in pieces], np.int64)
    # equal contexts are one, that of the earliest start; the others are repeats as a whole
    order = np.lexsort((first, doc, known, h))
    lead, leader, anchor = {}, np.zeros(len(h), np.int64), h.tolist()
    for i in order.tolist():
        leader[i] = lead.setdefault((anchor[i], pieces[i]), i)
    same = (doc == doc[leader]) & (known == known[leader]) & (first == first[leader])
    whole = np.flatnonzero(~same)
    kept = np.unique(leader)
    # the windows of the contexts that differ, in the buckets of their anchors
    data = np.frombuffer(b"".join([pieces[i] for i in kept.tolist()]), np.uint8)
    n = sizes[kept] - length + 1
    at = np.cumsum(sizes[kept]) - sizes[kept]
    row = np.repeat(np.arange(len(kept)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    place, bucket = at[row] + step, np.cumsum(np.diff(h[kept], prepend=h[kept[:1]] if len(kept) else 0) != 0)[row]
    ids, live, depth = buckets(data, Q), np.arange(len(row)), Q
    later = 0
    while len(live):
        pick, bucket = _sorted_buckets(bucket, ids[place[live] + later])
        live = live[pick]
        if later + depth == length:
            break
        if later and 2 * depth <= length:
            # every suffix's bucket of twice the depth, from its own and that of the suffix a depth on
            ids, depth = refine(ids, depth), 2 * depth
        later = min(later + depth if later == 0 else depth, length - depth)
    begin, end = [first[whole]], [first[whole] + sizes[whole]]
    rows = [whole]
    if len(live):
        source = kept[row[live]]
        start = first[source] + step[live]
        order = np.lexsort((start, doc[source], known[source], bucket))
        bucket, source, start, live = bucket[order], source[order], start[order], live[order]
        head = np.diff(bucket, prepend=-1) != 0
        of = np.maximum.accumulate(np.where(head, np.arange(len(live)), 0))
        again = ~((doc[source] == doc[source[of]]) & (known[source] == known[source[of]]) & (start == start[of]))
        mine, its = place[live[again]], place[live[of[again]]]
        source, start = source[again], start[again]
        # runs of windows that follow one another, in a context and in what they repeat
        order = np.lexsort((mine, source))
        mine, its, source, start = mine[order], its[order], source[order], start[order]
        cut = np.ones(len(mine), bool)
        cut[1:] = (np.diff(mine) != 1) | (np.diff(its) != 1) | (np.diff(source) != 0)
        a = np.flatnonzero(cut)
        count = np.diff(np.append(a, len(mine)))
        wide = count + length - 1
        inner = np.arange(int(wide.sum())) - np.repeat(np.cumsum(wide) - wide, wide)
        equal = data[np.repeat(mine[a], wide) + inner] == data[np.repeat(its[a], wide) + inner]
        if not equal.all():  # buckets of equal identifiers and other bytes: only whole equal runs count
            good = np.logical_and.reduceat(equal, np.cumsum(wide) - wide)
            a, count = _equal_runs(a, count, good, mine, its, data, length)
        rows.append(source[a])
        begin.append(start[a])
        end.append(start[a] + count + length - 1)
    rows = np.concatenate(rows)
    return pa.record_batch([pa.array(known[rows]), pa.array(doc[rows]), pa.array(salt[rows]), pa.array(np.concatenate(begin)), pa.array(np.concatenate(end))], schema=_RANGE)


def _equal_runs(a: np.ndarray, count: np.ndarray, good: np.ndarray, mine: np.ndarray, its: np.ndarray, data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs whose bytes differ somewhere, window by window: those windows that are equal."""
    firsts, counts = list(a[good]), list(count[good])
    for i, k in zip(a[~good].tolist(), count[~good].tolist(), strict=True):
        for j in range(i, i + k):
            if (data[mine[j] : mine[j] + length] == data[its[j] : its[j] + length]).all():
                firsts.append(j)
                counts.append(1)
    return np.array(firsts, np.int64), np.array(counts, np.int64)


def _repeats(contexts: DataFrame, length: int) -> DataFrame:
    """Byte ranges that repeat an earlier string, bucket by bucket."""
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.column("context").nbytes
            if size < CHUNK:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            h = whole.column("h").to_numpy()
            edges = np.flatnonzero(np.diff(h)) + 1  # the last bucket may go on
            ends = np.concatenate([[0], np.cumsum(np.asarray(pa.compute.binary_length(whole.column("context"))).astype(np.int64))])
            done = 0
            while True:
                later = edges[edges > done]
                if not len(later):
                    break
                full = later[ends[later] - ends[done] >= CHUNK]
                stop = int(full[0]) if len(full) else int(later[-1])
                yield _settle(whole.slice(done, stop - done), length)
                done = stop
            rest = whole.slice(done).combine_chunks()
            held = rest.to_batches()
            size = sum(b.column("context").nbytes for b in held) if done else size
        if held:
            yield _settle(pa.Table.from_batches(held), length)

    return contexts.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(run, "known boolean, doc long, salt long, begin long, end long")


_RESULT = schema_of(("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()))


def _merged(ranges: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for r in sorted(ranges or (), key=lambda r: r["begin"]):
        if out and r["begin"] <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], r["end"]))
        else:
            out.append((r["begin"], r["end"]))
    return out


def repeated_ranges(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text of every row, with ranges: the byte ranges (begin, end), not merged yet, that
    are covered by strings which start earlier too."""
    if not Q + 1 <= length <= 2 * Q + 64:
        raise ValueError("length out of range")
    docs = documents(df, id_col, text_col)
    named = docs.select(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc"), F.xxhash64("text").alias("salt"), "doc_id", "text")

    found = materialize(anchors(named, length), "anchors")
    single = found.select(*_TEXT, F.explode("anchors").alias("a")).select("a.h", *_TEXT, "a.at")
    # written first, so that the join has plain inputs and Spark can split a very common bucket
    counts = materialize(single.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1"), "counts")
    by_text = materialize(single.join(counts, "h").groupBy(*_TEXT).agg(F.collect_set(F.struct("at", "h", "n")).alias("shared")), "anchors")
    release(found, counts)

    joined = named.join(by_text, list(_TEXT))
    pick = lambda large: joined.withColumn("shared", F.filter("shared", lambda a: (a["n"] > LARGE) == F.lit(large))).filter(F.size("shared") > 0).select(*_TEXT, "text", "shared")
    ranges = materialize(_repeats(_cut(pick(False), length), length), "ranges")
    over = None
    if not by_text.filter(F.exists("shared", lambda a: a["n"] > LARGE)).isEmpty():
        windows = materialize(_refined(pick(True), length), "windows")
        start = F.struct("known", "doc", "first")
        lead = materialize(windows.groupBy("w", "v").agg(F.min(start).alias("lead"), F.count("*").alias("n")).filter("n > 1").drop("n"), "lead")
        again = windows.join(lead, ["w", "v"]).filter(F.col("lead") != start)
        over = materialize(again.select(*_TEXT, F.col("first").alias("begin"), (F.col("first") + length).alias("end")), "ranges")
        release(windows, lead)
    release(by_text)
    every = ranges.unionByName(over) if over else ranges
    lists = materialize(every.groupBy(*_TEXT).agg(F.collect_set(F.struct("begin", "end")).alias("ranges")), "ranges")
    release(ranges, *([over] if over else []))
    return named.join(lists.hint("merge"), list(_TEXT), "left").select("doc_id", "text", "ranges")


def drop_repeats(df: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept_sha256; with_text adds the
    remaining bytes as kept."""
    schema = _RESULT.append(pa.field("kept", pa.binary())) if with_text else _RESULT

    def run(batches):
        for part in slices(batches):
            rows = []
            for text, ranges in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                raw = text.encode()
                spans = _merged(ranges)
                at, keep = 0, []
                for begin, end in spans:
                    keep.append(raw[at:begin])
                    at = end
                keep.append(raw[at:])
                kept = b"".join(keep)
                rows.append((len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return repeated_ranges(df, length, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))
