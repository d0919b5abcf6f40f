"""Benchmark decontamination: shared rare words, then local alignment.

A document is a copy of an item if the Smith-Waterman score of their words, which bears replaced,
dropped and added words, reaches a share of the item's own score, and that of N words in a row (an
item of fewer words must be there whole). Whatever sifts before the alignment loses no copy:

- An alignment of that score matches so many of the item's words that, whichever positions of the item
  are left out, a number of the others must match, and its passage is of bounded length. So an item is
  looked for by its words that are rarest in the documents, common ones left out, and only where the
  needed number of them stand close enough together. The counts change the cost, never the result.
- A passage's words that the item has gain a match at most, all others cost a gap at least.

Passages that pass are aligned, those of one item together.

Nothing is shuffled but the counts. Items are taken in blocks of bounded size, each block against all
documents, and what a block has found is written before the next, so what the driver holds and the tasks
are sent is bounded whatever the benchmark's size. Long documents are read in pieces that overlap by
more than an alignment's length.

Cases: null and empty texts or items match nothing; words are compared without case and without
punctuation around them; an item of one or two words is in every document that has them in a row; rows
repeating an id are reported once per item; documents of any length are
read whole; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import claim, documents, materialize, release, schema_of, slices

#: Words of items in a block at most (beyond one item), and words in a row a copy's score needs at least.
BLOCK_WORDS, N = 500_000, 3
#: The share of an item's own score that makes a copy.
SHARE = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: Words in a piece of a document, and pairs of a word and an item held at once.
PIECE, PAIRS = 20_000, 2_000_000
MEMO = 300_000
_AROUND = string.punctuation + "«»„“”‘’…–—¿¡"


def words(text: str) -> list[str]:
    return [w for w in (c.strip(_AROUND).lower() for c in text.split()) if w]


class Items:
    """A block of test items: their words as numbers from 1 on, and the scores that make a copy."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        split = [words(t) for _, t in items]
        self.vocabulary: dict[str, int] = {}
        self.words = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws], np.int64) for ws in split]
        size = np.array([len(w) for w in self.words], np.int64)
        self.least = np.maximum(np.ceil(SHARE * MATCH * size).astype(np.int64), MATCH * np.minimum(size, N))
        # of score s and at most m matches, each worth MATCH, an alignment has at most MATCH * m - s other words
        self.reach = size + MATCH * size - self.least
        self.choose(np.zeros(len(self.vocabulary) + 1, np.int64))

    def choose(self, counts: np.ndarray) -> None:
        """Per item the words to look for and how many of them any copy has, by how often each
        word occurs in the documents; the number of items with it is added."""
        counts = counts.copy()
        for ws in self.words:
            counts[np.unique(ws)] += 1
        self.need, posts = np.ones(len(self.words), np.int64), []
        for item, ws in enumerate(self.words):
            matched = -(-int(self.least[item]) // MATCH)
            self.need[item] = (matched + 1) // 2
            rare = np.argsort(counts[ws], kind="stable")[: len(ws) - matched + int(self.need[item])]
            own = np.unique(ws[rare])
            posts.append(np.stack([own, np.full(len(own), item)]))
        words_, items_ = np.concatenate([np.zeros((2, 0), np.int64), *posts], axis=1)
        order = np.argsort(words_, kind="stable")
        self.post_items = items_[order]
        self.post_size = np.bincount(words_, minlength=len(self.vocabulary) + 1)
        self.post_start = np.cumsum(self.post_size) - self.post_size

    def reader(self):
        """A function from texts to word numbers, 0 for words of no item."""
        vocabulary = self.vocabulary
        claim("decontamination", lambda: None)  # what is known here goes with the task

        class Known(dict):
            def __missing__(self, chunk: str) -> int:
                word = chunk.strip(_AROUND).lower()
                self[chunk] = number = vocabulary.get(word, 0) if word else -1
                return number

        memo = Known()

        def read(text: str) -> np.ndarray:
            if len(memo) > MEMO:
                memo.clear()
            chunks = text.split()
            found = np.fromiter(map(memo.__getitem__, chunks), np.int64, len(chunks))
            return found[found >= 0]

        return read

    def passages(self, pieces: list[np.ndarray]) -> tuple[np.ndarray, ...]:
        """item, piece, begin and end in words of the passages that hold the needed words of an item, in
        order of items. Whatever alignment makes a copy lies inside one passage."""
        gap = int(self.reach.max(initial=0)) + 1
        size = np.array([len(p) for p in pieces], np.int64)
        start = np.cumsum(size + gap) - size - gap  # pieces are set apart by more than any reach
        span = int((size + gap).sum()) + gap
        flat = np.concatenate(pieces)
        at = np.flatnonzero(self.post_size[flat])
        word, place = flat[at], at + np.repeat(np.arange(len(pieces)) * gap, size)[at]
        times = self.post_size[word]
        ramp = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
        key = self.post_items[np.repeat(self.post_start[word], times) + ramp] * span + np.repeat(place, times)
        key.sort()
        item = key // span
        last = np.arange(len(key)) + self.need[item] - 1
        near = np.flatnonzero(last < len(key))
        near = near[key[last[near]] - key[near] < self.reach[item[near]]]
        item, begin, end = item[near], key[last[near]] % span, key[near] % span
        piece = np.searchsorted(start, end, side="right") - 1
        begin = np.maximum(begin - self.reach[item] + 1 - start[piece], 0)
        end = np.minimum(end + self.reach[item] - start[piece], size[piece])
        first = np.ones(len(near), bool)
        first[1:] = (item[1:] != item[:-1]) | (piece[1:] != piece[:-1]) | (begin[1:] > end[:-1])
        first = np.flatnonzero(first)
        return item[first], piece[first], begin[first], end[np.append(first[1:], len(near)) - 1] if len(first) else end

    def copies(self, texts: list[np.ndarray]) -> dict[tuple[int, int], float]:
        """The best score's share of each (text, item) of which the text holds a copy."""
        overlap, out, held, pairs = int(self.reach.max(initial=0)), {}, [], 0
        for number, ws in enumerate(texts):
            for b in range(0, max(1, len(ws) - overlap), PIECE):
                piece = ws[b : b + PIECE + overlap]
                more = int(self.post_size[piece].sum())
                if held and pairs + more > PAIRS:
                    self._align(held, out)
                    held, pairs = [], 0
                held.append((number, piece))
                pairs += more
        if held:
            self._align(held, out)
        return out

    def _align(self, held: list[tuple[int, np.ndarray]], out: dict[tuple[int, int], float]) -> None:
        found = self.passages([p for _, p in held])
        edges = np.flatnonzero(np.diff(found[0], prepend=-1, append=-1)) if len(found[0]) else []
        gain = np.full(len(self.vocabulary) + 1, GAP)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            item = int(found[0][lo])
            target, least = self.words[item], int(self.least[item])
            gain[target] = MATCH
            kept = []
            for piece, b, e in zip(*(f[lo:hi].tolist() for f in found[1:]), strict=True):
                passage = held[piece][1][b:e]
                total = np.cumsum(gain[passage])
                if (total - np.minimum(np.minimum.accumulate(total), 0)).max() >= least:
                    kept.append((held[piece][0], passage))
            gain[target] = GAP
            if not kept:
                continue
            for (number, _), score in zip(kept, align(target, *(p for _, p in kept)).tolist(), strict=True):
                if score >= least:
                    out[number, item] = max(out.get((number, item), 0.0), score / (MATCH * len(target)))


def align(a: np.ndarray, *passages: np.ndarray) -> np.ndarray:
    """The best local alignment score of a word sequence with each of the passages. Word number 0
    matches nothing."""
    # one row for all: each passage behind a place of its own that stays 0
    starts = np.cumsum([0, *(len(p) + 1 for p in passages)])
    b = np.zeros(starts[-1], np.int64)
    for s, p in zip(starts, passages, strict=False):
        b[s + 1 : s + 1 + len(p)] = p
    # gaps along b: the running maximum of what each place can hand on, lifted at each passage's begin
    # so that nothing is handed on from the one before
    lift = np.repeat(np.arange(len(passages)) * (MATCH * len(a) + 1), np.diff(starts))
    step = np.arange(len(b)) * -GAP + lift
    row, best = np.zeros(len(b), np.int64), np.zeros(len(b), np.int64)
    for w in a.tolist():
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(b[1:] == w, MATCH, MISMATCH))
        new[starts[:-1]] = 0
        row = np.maximum.accumulate(new + step) - step
        np.maximum(best, row, out=best)
    return np.maximum.reduceat(best, starts[:-1])


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """Blocks of items, read from the benchmark one after the other."""
    held, size = [], 0
    for r in items.select(items[id_col].cast("long").alias("i"), items[text_col].cast("string").alias("t")).filter("t is not null").orderBy("i", "t").toLocalIterator():
        n = len(r["t"].split())
        if held and size + n > BLOCK_WORDS:
            yield Items(held)
            held, size = [], 0
        held.append((r["i"], r["t"]))
        size += n
    if held:
        yield Items(held)


def _counts(docs: DataFrame, block: Items) -> np.ndarray:
    """How often each word of the block occurs in the documents. Each task adds up what it has read."""

    def run(batches):
        total, seen = [0] * (len(block.vocabulary) + 1), Counter()

        def add_up() -> None:
            for chunk, n in seen.items():
                total[block.vocabulary.get(chunk.strip(_AROUND).lower(), 0)] += n
            seen.clear()

        for part in slices(batches):
            for text in part.column(1).to_pylist():
                seen.update(text.split())
            if len(seen) > MEMO:
                add_up()
        add_up()
        at = [w for w in range(1, len(total)) if total[w]]
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array([total[w] for w in at], pa.int64())], names=["word", "n"])

    total = np.zeros(len(block.vocabulary) + 1, np.int64)
    for r in docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():  # at most the block's words
        total[r["word"]] = r["n"]
    return total


_FOUND = schema_of(("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()))


def contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id and score (from SHARE to 1) for each document and item it holds a copy of."""
    docs, out = documents(df, id_col, text_col), None
    for block in _blocks(items, item_id, item_text):
        out = out if out is None else materialize(out, "found")
        block.choose(_counts(docs, block))

        def run(batches, block=block):
            read = block.reader()
            for part in slices(batches):
                ids = part.column(0).to_pylist()
                rows = [(ids[d], block.ids[i], s) for (d, i), s in block.copies([read(t) for t in part.column(1).to_pylist()]).items()]
                yield pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_FOUND)], schema=_FOUND)

        found = docs.mapInArrow(run, "doc_id long, item_id long, score double")
        out = found if out is None else out.union(found)
    if out is None:
        return df.sparkSession.createDataFrame([], "doc_id long, item_id long, score double")
    return out.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def drop_contaminated(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of df that hold no copy of any item, with all columns. The alignment runs where the
    rows are; none is shuffled."""
    schema, out, left = df.schema, df, None
    at = df.columns.index(text_col)
    docs = documents(df, id_col, text_col)
    for block in _blocks(items, names.get("item_id", "item_id"), names.get("item_text", "text")):
        if out is not df:
            before, out = left, materialize(out, "left")
            left = out
            if before is not None:
                release(before)
        block.choose(_counts(docs, block))

        def run(batches, block=block):
            read = block.reader()
            for part in slices(batches):
                copies = {d for d, _ in block.copies([read(t or "") for t in part.column(at).to_pylist()])}
                yield part.filter(pa.array([d not in copies for d in range(part.num_rows)], pa.bool_()))

        out = out.mapInArrow(run, schema)
    return out
