"""Packing of documents into training sequences: first-fit decreasing in randomised groups.

A document's ids are those of the tokenizer, then an end id. It is cut at every full sequence; only
its last piece shares one. Pieces are dealt to partitions by a hash of document, content and place in
the input, sorted by that hash, and cut into groups of at most GROUP pieces; each group is packed by
itself, the longest piece first, each into the first bin with room, found by descent in a tournament tree whose
inner nodes hold the most room below them.

Tokenizing works chunk by chunk, as white space separates and nothing merges across it; ids of chunks
and words are kept, those met again longest, and plain chunks go to the library's merging alone, without
its normalisation. Texts with characters outside a plain range, or with special strings, go whole through
the library.

Cases: a null or empty text is the end id alone; repeated rows are packed each for itself; a long
text becomes many full sequences and a rest; ties fall to the smaller document; an empty table gives
an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import claim, documents, schema_of, slices
from ledgerline.llm.token_counts import _byte_letters

#: Chunks and words that a worker keeps, about, and the characters of the longest.
MEMO, LONGEST = 600_000, 128
#: Pieces packed together at most.
GROUP = 16_384
#: Characters that normalisation leaves alone but for case, with the white space that separates.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ]*\\Z")
#: A lower-case chunk whose letters, digits and marks are as below, and the pieces it is split into.
_CHUNK = re.compile("[!-~ß-öø-ÿ]+\\Z")
_PIECES_OF = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@[-`{-~]+")


class Known(dict):
    """What make gives for a chunk, kept under it once it was asked for twice; before, it is among the
    new, which go first when there are too many."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.new = make, {}

    def __missing__(self, chunk: str) -> bytes:
        found = self.new.pop(chunk, None)
        if found is not None:
            self[chunk] = found
        else:
            found = self.make(chunk)
            if len(chunk) <= LONGEST:
                self.new[chunk] = found
        return found

    def trim(self) -> None:
        if len(self) > MEMO * 2 // 3:
            self.new = dict(self)
            self.clear()
        elif len(self) + len(self.new) > MEMO:
            self.new = {}


class Ids:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.end = np.array([end_id], "<u4").tobytes()
        self.known = Known(self._chunk)
        self.letters = [c for _, c in sorted((b, c) for c, b in _byte_letters().items())]
        self.merge = self.library.model.tokenize
        self.bytes_of = [i.to_bytes(4, "little") for i in range(1 + max(self.library.get_vocab().values()))]

    def _chunk(self, chunk: str) -> bytes:
        low = chunk.lower()
        if not _CHUNK.match(low):
            return self._encode([chunk])[0]
        split = _PIECES_OF.findall(low)
        if split != [chunk]:
            return b"".join([self.known[piece] for piece in split])
        spelt = low if low.isascii() else "".join([self.letters[b] for b in low.encode()])
        return b"".join([self.bytes_of[t.id] for t in self.merge(spelt)])

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def all(self, texts: list[str]) -> list[bytes]:
        self.known.trim()
        ids = self.known.__getitem__
        plain = [bool(_PLAIN.match(t)) and not any(s in t for s in self.special) for t in texts]
        return [(b"".join(map(ids, t.split())) if p else self._encode([t])[0]) + self.end for p, t in zip(plain, texts, strict=True)]


@lru_cache(maxsize=4)
def encoder(path: str, end_id: int) -> Ids:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    claim("packing", encoder.cache_clear)
    return Ids(path, end_id)


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each length (all from 1 to capacity), and the number of bins. Equal lengths
    keep their order."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    full = int(np.count_nonzero(lengths == capacity))
    bins[order[:full]] = np.arange(full)
    leaves = 1
    while leaves < max(1, n - full):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    used = 0
    for item in order[full:].tolist():
        size, node = int(lengths[item]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[item], offsets[item] = full + node - leaves, capacity - room[node]
        used = max(used, node - leaves + 1)
        room[node] -= size
        node //= 2
        while node:
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
            node //= 2
    return bins, offsets, full + used


_PIECES = schema_of(("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()))
_PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(df: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """The pieces of every document, with the ids themselves (array<int>) if asked for."""
    schema = _PIECES.append(pa.field("ids", pa.list_(pa.int32()))) if with_ids else _PIECES

    def run(batches):
        encode = encoder(vocabulary, end_id).all
        for part in slices(batches):
            out: list[list] = [[] for _ in schema]
            for doc, data in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                total = len(data) // 4
                for start in range(0, total, capacity):
                    piece = data[4 * start : 4 * (start + capacity)]
                    row = (doc, start, len(piece) // 4, zlib.crc32(piece), total, *([np.frombuffer(piece, "<u4").astype(np.int32)] if with_ids else []))
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return documents(df, id_col, text_col).mapInArrow(run, _PIECES_DDL + (", ids array<int>" if with_ids else ""))


def pack(cut: DataFrame, capacity: int = 2048, group: int = GROUP, seed: int = 7) -> DataFrame:
    """The pieces with sequence_id, offset, and the sequence's tokens and padded length. A sequence is
    padded to capacity unless its tokens number a power of two."""
    from pyspark import TaskContext

    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal pieces of unnamed documents, which may be many, are told apart by their place
    deal = F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    names = [c for c in cut.columns]

    def run(batches):
        made = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []

        def flush():
            nonlocal made
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            lengths = whole.column("length").to_numpy()
            bins, offsets, used = first_fit_decreasing(lengths, capacity)
            tokens = np.bincount(bins, weights=lengths, minlength=used).astype(np.int64)
            even = (tokens & (tokens - 1)) == 0
            padded = np.where(even, tokens, capacity)
            extra = [bins + made, offsets, tokens[bins], padded[bins]]
            made += used
            columns = [whole.column(n) for n in names] + [pa.array(x, pa.int64()) for x in extra]
            return pa.record_batch(columns, names=[*names, "sequence_id", "offset", "sequence_tokens", "padded_length"])

        rows = 0
        for batch in batches:
            while batch.num_rows:
                taken = batch.slice(0, group - rows)
                batch = batch.slice(group - rows) if batch.num_rows > group - rows else batch.slice(0, 0)
                held.append(taken)
                rows += taken.num_rows
                if rows == group:
                    yield flush()
                    held, rows = [], 0
        if rows:
            yield flush()

    dealt = cut.withColumn("_deal", deal).repartition(parts, "_deal").sortWithinPartitions("_deal", "doc_id", "start", "ids_crc32").drop("_deal")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(run, f"{ddl}, sequence_id long, offset long, sequence_tokens long, padded_length long")


def packed_sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """From packed pieces with their ids: one row per sequence with its ids, padded, and the starts of
    its pieces (which attention masks need)."""
    piece = F.sort_array(F.collect_list(F.struct("offset", "ids")))  # at most capacity pieces
    rows = packed.groupBy("sequence_id", "padded_length").agg(piece.alias("p"))
    ids = F.flatten("p.ids")
    return rows.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), (F.col("padded_length") - F.size(ids)).cast("int"))).alias("ids"), F.col("p.offset").alias("piece_starts"))
