"""Token counts by prefix dynamic programming over a byte-level BPE vocabulary.

The merges of a piece of text are deterministic, and the encoding of a prefix is the encoding of a
shorter prefix plus one last token. So for each prefix in turn the last token is the one vocabulary
entry ending there that may stand after the shorter prefix's last token: a pair may stand if
encoding both together gives the two again. One sweep gives the exact count at every prefix; tables of
the steps from one count to the next are written, and questions of length, truncation and budget are
answered from them.

Cases: a null or empty text has no bytes and no tokens; repeated rows give repeated results; a text
of any length is handled in time linear in it; an empty table gives an empty result; columns other
than the two named are ignored.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import claim, documents, materialize, schema_of, slices

#: Chunks, and nodes of the trie of their prefixes, that a worker keeps; emptied beyond it.
MEMO, NODES = 500_000, 800_000
# Fixed value: the pattern that splits text before the merges.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point the split above and the library's own agree.
_PLAIN = re.compile(r"[\x00-ԯ]*\Z")
#: White space beside a space.
_BESIDE = re.compile(r"\s | \s")
#: A chunk of plain letters, and a mark after them, which is a piece by itself.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)\Z")


#: Pieces of which two characters are two pieces.
_SPLIT_SHORT = frozenset(["'re", "'ve", "'ll"])


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.ranks: dict[tuple[bytes, bytes], int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks.setdefault((raw(left), raw(right)), rank)
        self.texts = {i: s for s, i in self.ids.items()}
        self._tokens = ahocorasick.Automaton()  # finds the entries that end at each place
        for token, i in self.ids.items():
            self._tokens.add_word(token.decode("latin-1"), (len(token), i))
        self._tokens.make_automaton()
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._cut_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._pieces = regex.compile(PIECES)
        self._library = Tokenizer.from_file(path).pre_tokenizer
        self._run = regex.compile(r"\s\s+")
        self._pairs: dict[int, bool] = {}
        self._chunks: dict[str, bytes] = {}
        self._pieces_known: dict[str, bytes] = {}
        self._new_trie()

    def _merge(self, data: bytes) -> list[int]:
        """Plain merging, for short strings only."""
        parts, rank, never = [data[i : i + 1] for i in range(len(data))], self.ranks.get, 1 << 60
        order = [rank(pair, never) for pair in zip(parts, parts[1:])]  # noqa: B905
        while order and (least := min(order)) < never:
            at = order.index(least)  # equal pairs further on come next
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del order[at]
            if at:
                order[at - 1] = rank((parts[at - 1], parts[at]), never)
            if at < len(order):
                order[at] = rank((parts[at], parts[at + 1]), never)
        return [self.ids[p] for p in parts]

    def _stands(self, left: int, right: int) -> bool:
        key = left << 32 | right
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) > MEMO:
                self._pairs.clear()
            found = self._pairs[key] = self._merge(self.texts[left] + self.texts[right]) == [left, right]
        return found

    def _new_trie(self) -> None:
        # of each node, which is a prefix of a piece, the last token and the count; the first is empty
        self._child, self._last, self._count = {}, [-1], [0]

    def prefixes(self, piece: bytes) -> list[int]:
        """The count at every byte prefix of one piece, from the empty one on. Prefixes that pieces share
        are worked out once."""
        if len(self._last) > NODES:
            self._new_trie()
        child, last, count, path, node = self._child, self._last, self._count, [0], 0
        for byte in piece:
            node = child.get(node << 8 | byte)
            if node is None:
                break
            path.append(node)
        else:
            return [count[n] for n in path]
        have, node, known = len(path), path[-1], self._pairs.get
        for at, (size, token) in self._tokens.iter(piece.decode("latin-1")):
            if at + 1 < have:  # worked out already
                continue
            before = path[have - size]
            if before:
                stands = known(last[before] << 32 | token)
                if stands is None:
                    stands = self._stands(last[before], token)
                if not stands:
                    continue
            key, node = node << 8 | piece[at], len(last)
            child[key] = node
            path.append(node)
            last.append(token)
            count.append(count[before] + 1)
            have += 1
        return [count[n] for n in path]

    def _split(self, text: str) -> list[str]:
        if _PLAIN.match(text):
            return self._pieces.findall(text)
        return [text[a:b] for _, (a, b) in self._library.pre_tokenize_str(text)]

    def _kept(self, piece: str) -> bytes:
        """By how much the count changes with each character of one piece, as 16-bit integers."""
        data = piece.encode()
        counts = self.prefixes(data)
        if len(data) > len(piece):
            counts = [n for n, byte in zip(counts, data, strict=False) if byte & 0xC0 != 0x80] + counts[-1:]
        if piece in _SPLIT_SHORT:  # without its last letter it is two pieces
            counts[2] = counts[1] + self.prefixes(piece[1].encode())[-1]
        found = self._pieces_known[piece] = array("h", map(int.__sub__, counts[1:], counts)).tobytes()
        return found

    def _chunk(self, text: str) -> bytes:
        """The steps of a text without special strings."""
        known, parts = self._pieces_known, []
        for piece in self._split(text):
            parts.append(known.get(piece) or self._kept(piece))
        if not self._run.search(text):
            return b"".join(parts)
        # a prefix that ends in white space has the whole run up to there as one piece
        counts = np.cumsum(np.frombuffer(b"".join(parts), np.int16), dtype=np.int64)
        for m in self._run.finditer(text):
            begin, end = m.span()
            before = int(counts[begin - 1]) if begin else 0
            counts[begin:end] = before + np.cumsum(np.frombuffer(self._kept(m[0]), np.int16), dtype=np.int64)
        steps = np.diff(counts, prepend=0)
        if np.abs(steps).max() > 32767:
            raise OverflowError("a count changes by more than 32,767 with one character")
        return steps.astype(np.int16).tobytes()

    def steps(self, text: str) -> bytes:
        """By how much the count changes with each character of a whole text, as 16-bit integers. Where
        single spaces separate chunks, no piece crosses the start of one, so steps of chunks are kept."""
        if self._cut_special and any(s in text for s in self.special):
            return self._with_special(text)
        if not _PLAIN.match(text) or _BESIDE.search(text):
            return self._chunk(text)
        first, *rest = text.split(" ")
        known = self._chunks
        try:
            parts = list(map(known.__getitem__, rest))
        except KeyError:
            if len(known) > MEMO or len(self._pieces_known) > MEMO:
                known.clear()
                self._pieces_known.clear()
            parts = [known.get(c) or self._new(c) for c in rest]
        return self._chunk(first) + b"".join(parts)

    def _new(self, chunk: str) -> bytes:
        known, m = self._chunks, _WORD.match(chunk)
        if m is None:
            found = self._chunk(" " + chunk)
        else:
            found = known.get(m[1])
            if found is None:
                found = known[m[1]] = self._word(m[1])
            if m[2]:
                found += self._pieces_known.get(m[2]) or self._kept(m[2])
        known[chunk] = found
        return found

    def _word(self, word: str) -> bytes:
        """The steps of a space and a word of letters, which is one piece."""
        piece = " " + word
        found = self._kept(piece)
        del self._pieces_known[piece]  # it is kept as a chunk
        return found

    def _with_special(self, text: str) -> bytes:
        """A special string is one token as a whole, and ordinary text up to its last character."""
        out, at = [], 0
        for m in self._cut_special.finditer(text):
            steps = np.frombuffer(self._chunk(text[at : m.end()]), np.int16).copy()
            steps[-1] = 1 - steps[m.start() - at : -1].sum(dtype=np.int64)
            out.append(steps.tobytes())
            at = m.end()
        return b"".join(out) + self._chunk(text[at:])

    def count(self, text: str) -> int:
        return int(np.frombuffer(self.steps(text), np.int16).sum(dtype=np.int64))

    def table(self, text: str) -> np.ndarray:
        """Exact token counts of text[:k] for every k from 0 to len(text)."""
        return np.concatenate([[0], np.cumsum(np.frombuffer(self.steps(text), np.int16), dtype=np.int64)])


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    claim("token counts", counter.cache_clear)
    return PrefixCounter(path)


_TABLES = schema_of(("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("steps", pa.binary()))


def prefix_tables(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and steps: by how much the exact count changes with each character, as
    little-endian 16-bit integers, whose running sum is the count at every prefix."""

    def run(batches):
        steps = counter(vocabulary).steps
        for part in slices(batches, limit=1 << 20):
            texts = part.column(1).to_pylist()
            yield pa.record_batch([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(list(map(steps, texts)), pa.binary())], schema=_TABLES)

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, steps binary")


_ANSWERS = schema_of(("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("n_chars", pa.int64()), ("kept_tokens", pa.int64()))


def answers(tables: DataFrame, budget: int) -> DataFrame:
    """From stored tables, without encoding anything: doc_id, n_bytes, n_tokens, and where each document
    is to be cut for a budget: n_chars, the most characters whose count is within it, and kept_tokens,
    that count."""

    def run(batches):
        for part in slices(batches):
            rows = []
            for steps in part.column(2).to_pylist():
                counts = np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64)
                n = int(np.flatnonzero(counts <= budget)[-1]) + 1 if len(counts) and counts.min() <= budget else 0
                rows.append((int(counts[-1]) if len(counts) else 0, n, int(counts[n - 1]) if n else 0))
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([part.column(0), part.column(1), *(pa.array(c, pa.int64()) for c in columns)], schema=_ANSWERS)

    return tables.select("doc_id", "n_bytes", "steps").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, n_chars long, kept_tokens long")


def token_counts(df: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), n_chars and kept_tokens of every row,
    answered from the tables, which are written."""
    tables = materialize(prefix_tables(df, vocabulary, id_col, text_col), "tables")
    found = answers(tables, limit)
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chars", "kept_tokens")


def prefix_tokens(tables: DataFrame) -> DataFrame:
    """The tables spelt out: doc_id and prefix_tokens, whose element k (from 0) is the exact count of the
    first k characters."""
    schema = schema_of(("doc_id", pa.int64()), ("prefix_tokens", pa.list_(pa.int32())))

    def run(batches):
        for part in slices(batches, limit=1 << 20):
            counts = [np.concatenate([[0], np.cumsum(np.frombuffer(s, "<i2"), dtype=np.int64)]) for s in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(counts, pa.list_(pa.int32()))], schema=schema)

    return tables.select("doc_id", "steps").mapInArrow(run, "doc_id long, prefix_tokens array<int>")
