"""Media columns: types by signature, confirmed by the format's own structure.

An Aho-Corasick automaton locates the magic bytes of all known formats in one pass over a blob. A
validator walks each hit's structure (chunks, boxes, pages, checksums) and returns its confirmed
length, or none. The first confirmed hit at offset 0 gives the true type, which corrects the declared
one; confirmed hits further on are embedded media and are carved out.

Cases: a null blob is empty, of type none; an empty table gives an empty result; truncated or forged
headers fail validation and count as hits only; media inside others, of the same kind too, are carved,
outermost first; a PDF ends at its last end mark whose cross-reference it holds, a ZIP archive at its
central directory's end; other columns are ignored by the query and kept by sniff().
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_right
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.llm.common import documents, schema_of, slices

# Magic bytes, the format they announce, and where in the file they stand.
MAGIC = [
    (b"\x89PNG\r\n\x1a\n", "png", 0),
    (b"\xff\xd8\xff", "jpeg", 0),
    (b"GIF87a", "gif", 0),
    (b"GIF89a", "gif", 0),
    (b"RIFF", "riff", 0),
    (b"BM", "bmp", 0),
    (b"OggS", "ogg", 0),
    (b"fLaC", "flac", 0),
    (b"MThd", "midi", 0),
    (b"ftyp", "mp4", 4),
    (b"%PDF-", "pdf", 0),
    (b"PK\x03\x04", "zip", 0),
    (b"\x1f\x8b\x08", "gzip", 0),
]
#: Declared media types for the formats.
MIME = {"png": "image/png", "jpeg": "image/jpeg", "gif": "image/gif", "wav": "audio/wav", "webp": "image/webp", "avi": "video/avi", "bmp": "image/bmp", "ogg": "audio/ogg", "flac": "audio/flac", "midi": "audio/midi", "mp4": "video/mp4", "pdf": "application/pdf", "zip": "application/zip", "gzip": "application/gzip"}


def _png(b: bytes, at: int):
    pos, first = at + 8, True
    while pos + 12 <= len(b):
        (n,), kind = struct.unpack_from(">I", b, pos), b[pos + 4 : pos + 8]
        if pos + 12 + n > len(b) or first != (kind == b"IHDR"):
            return None
        if zlib.crc32(b[pos + 4 : pos + 8 + n]) != struct.unpack_from(">I", b, pos + 8 + n)[0]:
            return None
        pos, first = pos + 12 + n, False
        if kind == b"IEND":
            return "png", pos - at
    return None


def _jpeg(b: bytes, at: int):
    pos = at + 2
    while pos + 4 <= len(b) and b[pos] == 0xFF:
        mark = b[pos + 1]
        (n,) = struct.unpack_from(">H", b, pos + 2)
        if mark < 0xC0 or n < 2:
            return None
        pos += 2 + n
        if mark == 0xDA:  # entropy-coded data runs to the next marker that isn't a restart
            while (pos := b.find(b"\xff", pos)) >= 0 and pos + 1 < len(b):
                if b[pos + 1] == 0xD9:
                    return "jpeg", pos + 2 - at
                if b[pos + 1] and not 0xD0 <= b[pos + 1] <= 0xD7:
                    break
                pos += 2
            if pos < 0:
                return None
    return None


def _gif(b: bytes, at: int):
    if at + 13 > len(b):
        return None
    pos = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += b[p] + 1
        return p + 1

    while pos < len(b):
        if b[pos] == 0x3B:
            return "gif", pos + 1 - at
        if b[pos] == 0x21:
            pos = blocks(pos + 2)
        elif b[pos] == 0x2C and pos + 10 < len(b):
            pos = blocks(pos + 11 + (3 << ((b[pos + 9] & 7) + 1) if b[pos + 9] & 0x80 else 0))
        else:
            return None
    return None


def _riff(b: bytes, at: int):
    if at + 12 > len(b):
        return None
    (n,), kind = struct.unpack_from("<I", b, at + 4), {b"WAVE": "wav", b"WEBP": "webp", b"AVI ": "avi"}.get(b[at + 8 : at + 12])
    end, pos = at + 8 + n, at + 12
    if not kind or n < 4 or end > len(b):
        return None
    while pos + 8 <= end:
        (size,) = struct.unpack_from("<I", b, pos + 4)
        pos += 8 + size + (size & 1)
    return (kind, end - at) if pos == end else None


def _bmp(b: bytes, at: int):
    if at + 30 > len(b):
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", b, at + 2)
    planes, depth = struct.unpack_from("<HH", b, at + 26)
    good = zero == 0 and header in (40, 52, 56, 108, 124) and 14 + header <= offset <= size and planes == 1 and depth in (1, 4, 8, 16, 24, 32)
    return ("bmp", size) if good and at + size <= len(b) else None


@lru_cache(maxsize=1)
def _ogg_table() -> list[int]:
    out = []
    for i in range(256):
        r = i << 24
        for _ in range(8):
            r = (r << 1 ^ 0x04C11DB7) & 0xFFFFFFFF if r & 0x80000000 else r << 1
        out.append(r)
    return out


def _ogg(b: bytes, at: int, known: _Blob):
    pos, table, pages, done = at, _ogg_table(), [], False
    while not done and pos not in known.dead and pos + 27 <= len(b) and b[pos : pos + 4] == b"OggS" and b[pos + 4] == 0:
        n = b[pos + 26]
        end = pos + 27 + n + sum(b[pos + 27 : pos + 27 + n])
        if end > len(b):
            break
        crc = 0
        for byte in b[pos : pos + 22] + bytes(4) + b[pos + 26 : end]:
            crc = (crc << 8 & 0xFFFFFFFF) ^ table[crc >> 24 ^ byte]
        if crc != struct.unpack_from("<I", b, pos + 22)[0]:
            break
        pages.append(pos)
        done, pos = bool(b[pos + 5] & 4), end
    if not done:  # neither does any chain end that begins further on in this one
        known.dead.update(pages)
        return None
    known.parts.update(pages[1:])
    return "ogg", pos - at


def _flac(b: bytes, at: int):
    pos, first = at + 4, True
    while pos + 4 <= len(b):
        head, n = b[pos], int.from_bytes(b[pos + 1 : pos + 4], "big")
        if first and (head & 0x7F or n != 34) or pos + 4 + n > len(b):
            return None
        pos, first = pos + 4 + n, False
        if head & 0x80:  # frames follow, whose end isn't declared: they run to the blob's end
            return ("flac", len(b) - at) if pos == len(b) or b[pos] == 0xFF else None
    return None


def _midi(b: bytes, at: int):
    if at + 14 > len(b) or b[at + 4 : at + 8] != b"\0\0\0\6":
        return None
    (tracks,), pos = struct.unpack_from(">H", b, at + 10), at + 14
    for _ in range(tracks):
        if b[pos : pos + 4] != b"MTrk" or pos + 8 > len(b):
            return None
        pos += 8 + struct.unpack_from(">I", b, pos + 4)[0]
    return ("midi", pos - at) if tracks and pos <= len(b) else None


def _mp4(b: bytes, at: int):
    pos, kinds = at, []
    while pos + 8 <= len(b):
        (n,), kind = struct.unpack_from(">I", b, pos), b[pos + 4 : pos + 8]
        if n < 8 or pos + n > len(b) or not kind.isalnum():
            break
        kinds.append(kind)
        pos += n
    return ("mp4", pos - at) if kinds[:1] == [b"ftyp"] and b"moov" in kinds else None


def _pdf(b: bytes, at: int, known: _Blob):
    end = known.pdfs.get(at)
    return ("pdf", end - at) if end else None


def _zip(b: bytes, at: int, known: _Blob):
    if at not in known.zips:
        return None
    end, entries = known.zips[at]
    known.parts.update(e for e in entries if e not in known.zips)
    return "zip", end - at


class _Blob:
    """What is found once for all hits in a blob: the places that are parts of a confirmed medium, and
    where media end that declare their beginning at their end."""

    def __init__(self, data: bytes):
        self.data, self.parts, self.dead = data, set(), set()

    @cached_property
    def zips(self) -> dict[int, tuple[int, list[int]]]:
        """By beginning, the end and the entries of archives, as their central directories say."""
        b, found = self.data, {}
        for m in _ZIP_END.finditer(b):
            end = m.start()
            if end + 22 > len(b):
                break
            n, size, offset, comment = struct.unpack_from("<HIIH", b, end + 10)
            begin, pos, entries = end - size - offset, end - size, []
            while n and begin >= 0 and pos + 46 <= end and b[pos : pos + 4] == b"PK\x01\x02":
                entries.append(begin + struct.unpack_from("<I", b, pos + 42)[0])
                pos += 46 + sum(struct.unpack_from("<HHH", b, pos + 28))
            good = n and n == len(entries) and pos == end and entries[0] >= begin and end + 22 + comment <= len(b)
            if good and all(b[e : e + 4] == b"PK\x03\x04" for e in entries):
                found[begin] = (end + 22 + comment, [e for e in entries if e != begin])
        return found

    @cached_property
    def pdfs(self) -> dict[int, int]:
        """By beginning, the last end whose cross-reference stands where the file says, counted from its
        beginning; that of a linearised file's end stands in its first part."""
        b, found, first_parts = self.data, {}, {}
        begins = [m.start() for m in _PDF_BEGIN.finditer(b)]
        tables = [m.start() for m in _PDF_TABLE.finditer(b)]
        if not begins:
            return found
        own, at = set(begins), 0
        for m in _PDF_END.finditer(b):
            offset, here = int(m[1]), []
            while at < len(tables) and tables[at] < m.start():
                here.append(tables[at])
                at += 1
            owners = {x - offset for x in here} & own
            if offset == 0:  # the first part of a linearised file
                begin = begins[max(0, bisect_right(begins, m.start()) - 1)]
                first_parts.update({x - begin: begin for x in here if x > begin})
            elif not owners and offset in first_parts:
                owners = {first_parts[offset]}
            for begin in owners:
                if begin < m.start():
                    found[begin] = m.end()
        return found


_ZIP_END, _PDF_BEGIN = re.compile(rb"PK\x05\x06"), re.compile(rb"%PDF-")
_PDF_TABLE = re.compile(rb"(?<!start)xref|(?<![0-9])[0-9]{1,10}\s{1,4}[0-9]{1,5}\s{1,4}obj")
_PDF_END = re.compile(rb"startxref\s{1,8}([0-9]{1,12})\s{1,8}%%EOF")


def _gzip(b: bytes, at: int):
    work, pos = zlib.decompressobj(31), at
    try:
        while pos < len(b) and not work.eof:
            data = b[pos : pos + 65536]
            while data and not work.eof:
                work.decompress(data, 1 << 20)
                data = work.unconsumed_tail
            pos += 65536
    except zlib.error:
        return None
    return ("gzip", min(pos, len(b)) - len(work.unused_data) - at) if work.eof else None


VALIDATORS = {"png": _png, "jpeg": _jpeg, "gif": _gif, "riff": _riff, "bmp": _bmp, "flac": _flac, "midi": _midi, "mp4": _mp4, "gzip": _gzip}
#: These use what is found once for a blob.
SHARED = {"ogg": _ogg, "pdf": _pdf, "zip": _zip}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, kind, offset in MAGIC:
        found.add_word(magic.decode("latin-1"), (len(magic), kind, offset))
    found.make_automaton()
    return found


def scan(blob: bytes) -> tuple[int, list[tuple[int, int, str]]]:
    """The number of signature hits, and (start, end, type) of all confirmed media, outermost first."""
    hits, media, known = 0, [], _Blob(blob)
    for last, (size, kind, offset) in _automaton().iter(blob.decode("latin-1")):
        at = last + 1 - size - offset
        hits += 1
        # pages and entries of a confirmed medium aren't media of their own; whatever else it holds may be
        if at < 0 or at in known.parts:
            continue
        confirmed = SHARED[kind](blob, at, known) if kind in SHARED else VALIDATORS[kind](blob, at)
        if confirmed:
            media.append((at, at + confirmed[1], confirmed[0]))
    return hits, sorted(media, key=lambda m: (m[0], -m[1]))


def examine(blob: bytes, declared: str) -> dict:
    hits, media = scan(blob)
    whole = next((m for m in media if m[0] == 0), None)
    kind = whole[2] if whole else "none"
    true = MIME.get(kind, declared)
    return {"type": kind, "length": whole[1] if whole else 0, "corrected": true, "was_wrong": true != declared, "hits": hits, "embedded": [m for m in media if m is not whole]}


_SNIFFED = "type string, length long, corrected string, was_wrong boolean, hits long, embedded array<struct<start:long,end:long,type:string,content:binary>>"


def sniff(df: DataFrame, blob_col: str, declared_col: str) -> DataFrame:
    """df with what examine() finds in each blob, the content of embedded media included, as a struct
    in a column named media (or media_ with a number, if df has such columns)."""
    from pyspark.sql import functions as F

    @F.pandas_udf(_SNIFFED)
    def run(blobs, declared):
        import pandas as pd

        rows = []
        for blob, said in zip(blobs, declared, strict=True):
            blob = bytes(blob) if blob is not None else b""
            found = examine(blob, said)
            found["embedded"] = [{"start": s, "end": e, "type": t, "content": blob[s:e]} for s, e, t in found["embedded"]]
            rows.append(found)
        return pd.DataFrame(rows, columns=["type", "length", "corrected", "was_wrong", "hits", "embedded"])

    name, n = "media", 0
    while name in df.columns:
        n += 1
        name = f"media_{n}"
    return df.withColumn(name, run(df[blob_col].cast("binary"), df[declared_col].cast("string")))


def store_samples(payload: bytes, rate: int = 8000) -> bytes:
    """A WAVE file whose 8-bit samples are the payload."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def read_samples(stored: bytes) -> bytes:
    """The samples of a WAVE file, found by walking its chunks."""
    pos = 12
    while pos + 8 <= len(stored):
        (n,) = struct.unpack_from("<I", stored, pos + 4)
        if stored[pos : pos + 4] == b"data":
            return stored[pos + 8 : pos + 8 + n]
        pos += 8 + n + (n & 1)
    raise ValueError("no data chunk")


_FIELDS = (("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))


def media_digests(df: DataFrame, declared: str = "application/octet-stream", block: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a WAVE of 8-bit samples, sniffed as stored under a declared type, and read
    back. The feature names the true type, its confirmed length, the correction, signature hits and
    embedded media, and the samples' least, most and sum."""
    schema = schema_of(*_FIELDS)

    def one(text: str) -> tuple:
        raw = text.encode()
        payload = raw + bytes(-len(raw) % block if raw else block)
        stored = store_samples(payload)
        found = examine(stored, declared)
        back = read_samples(stored[: found["length"]])
        samples = np.frombuffer(back, np.uint8)
        inside = ",".join(f"{s}-{e}:{t}" for s, e, t in found["embedded"])
        feature = f"{found['type']}:{found['length']};{declared}>{found['corrected']};hits={found['hits']};embedded=[{inside}];samples={samples.min()}-{samples.max()}/{int(samples.sum())}"
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-block:]), len(stored), hashlib.sha256(stored).hexdigest(), feature

    def run(batches):
        for part in slices(batches):
            rows = [one(t) for t in part.column(1).to_pylist()]
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
