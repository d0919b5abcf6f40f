"""Every query over a whole small table, against brute force or the library."""

import hashlib
import zlib

import helpers as H
import numpy as np
import pytest

from ledgerline.llm import media, queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def result(spark, name):
    rows = queries.queries()[name](spark, DATA).collect()
    return rows if name == "op7_packing" else {r["doc_id"]: r for r in rows}


def test_op1(spark, texts):
    want, got = H.near_duplicates(list(texts.items()), 3, 85, 100), result(spark, "op1_minhash_near_dedup")
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == {d: (n, c, c == d) for d, (n, c) in want.items()}
    assert sum(not r["kept"] for r in got.values()) > 0


@pytest.mark.parametrize("name, kinds, brute, by_start", [("op3_pii", ("email", "ip", "card", "phone"), H.pii, False), ("op5_secret_scan", ("assign", "access", "hex"), H.secrets, True)])
def test_op3_and_op5(spark, texts, name, kinds, brute, by_start):
    got = result(spark, name)
    assert set(got) == set(texts)
    for d, text in texts.items():
        spans = [(k, s, e) for k, found in enumerate(brute(text)) for s, e in found]
        spans.sort(key=lambda x: (x[1], x[0]) if by_start else x)
        told = [f"{kinds[k]}:{s}:{e}" for k, s, e in spans]
        assert [got[d][f"n_{k}"] for k in kinds] == [sum(x[0] == i for x in spans) for i in range(len(kinds))]
        assert got[d]["base_sha256"] == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [x for x in got[d]["spans"].split(",") if x in set(told)] == told
        assert len([x for x in got[d]["spans"].split(",") if x]) == len(told) + got[d]["n_added"]


def test_op7(spark, texts):
    from tokenizers import Tokenizer

    library, ids = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json")), {}
    for d, text in texts.items():
        ids[d] = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
    rows, filled, at = result(spark, "op7_packing"), {}, {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        piece = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == at.get(r["doc_id"], 0) and r["doc_tokens"] == len(ids[r["doc_id"]])
        assert len(piece) == r["length"] and zlib.crc32(piece.tobytes()) == r["ids_crc32"]
        at[r["doc_id"]] = r["start"] + r["length"]
    assert at == {d: len(x) for d, x in ids.items()}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048
    # no packing needs fewer sequences than this, and each of the four tasks may leave one open
    assert len(filled) <= -(-sum(map(len, ids.values())) // 2048) + 4


def test_op8(spark, texts):
    from tokenizers import Tokenizer

    library, got = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json")), result(spark, "op8_token_counts")
    size = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    for d, text in texts.items():
        r, n = got[d], size(text)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(text.encode()), n, n > 512)
        assert r["kept_tokens"] == size(text[: r["n_chars"]]) <= 512
        assert r["n_chars"] == len(text) or all(size(text[:k]) > 512 for k in range(r["n_chars"] + 1, min(len(text), r["n_chars"] + 4) + 1))


def test_op9(spark, texts):
    want, got = H.repeated_bytes(list(texts.items())), result(spark, "op9_suffix_dedup")
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == want


def test_op10(spark, texts):
    got = result(spark, "op10_media")
    for d, text in texts.items():
        raw, r = text.encode(), got[d]
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        stored = media.store_samples(payload)
        assert stored[44:] == payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and r["feature"]
