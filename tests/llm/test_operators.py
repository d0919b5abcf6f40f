import hashlib
import random
import struct
import zlib

import helpers as H
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import decontam, lines, media, minhash, packing, pii, quality, secrets, suffix, token_counts
from ledgerline.llm.queries import vocabulary

DATA = "/root/testdata/sf0.001"


def pairs(rows=None):
    return [(r[0], r[1]) for r in (H.odd_documents() if rows is None else rows)]


@pytest.fixture(scope="module")
def empty(spark):
    return H.frame(spark, [])


# -- 1

@pytest.mark.parametrize("w, num, bands", [(3, 85, 24), (5, 80, 32)])
def test_near_duplicates_equal_brute_force(spark, w, num, bands):
    want = H.near_duplicates(pairs(), w, num, 100)
    got = minhash.near_duplicates(H.frame(spark), w=w, num=num, bands=bands).collect()
    assert len(got) == len(H.odd_documents())
    for r in got:
        assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


@pytest.mark.parametrize("crowded", [16_384, 5])
def test_near_duplicates_of_one_crowded_bucket(spark, monkeypatch, crowded):
    """Copies with ever more changes, so that hubs alone don't find all links; small blocks, and buckets
    that are parted further."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "CROWDED", crowded)
    r = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for d in range(90):
        ws = list(base)
        for _ in range(r.randint(0, 6)):
            ws[r.randrange(len(ws))] = f"x{r.randrange(10**6)}"
        rows.append((d, " ".join(ws)))
    want = H.near_duplicates(rows, 3, 85, 100)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), w=3, num=85, bands=24).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_odd_sketch_estimates_similarity():
    r = np.random.default_rng(2)
    pool = r.integers(0, 2**63, 4000).astype(np.uint64)
    sets = [np.unique(pool[:2000]), np.unique(pool[100:2100])]
    sketch = minhash.odd_sketches(minhash.samples(sets, 1024), 4096)
    far = int(np.bitwise_count((sketch[0] ^ sketch[1]).view(np.uint64)).sum())
    apart = -4096 / 2 * np.log(1 - 2 * far / 4096)
    assert abs(1 - apart / 2048 - 1900 / 2100) < 0.05
    assert minhash.most_bits(0.95) < minhash.most_bits(0.85) < minhash.BITS / 2


def test_near_duplicates_of_nothing(spark, empty):
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.drop_near_duplicates(H.frame(spark))
    want = {d for d, (_, c) in H.near_duplicates(pairs(), 5, 80, 100).items() if d == c}
    assert kept.columns == H.frame(spark).columns and {r["doc_id"] for r in kept.collect()} == want


# -- 2

def test_lines_equal_brute_force(spark, empty):
    want = H.repeated_lines(pairs())
    got = lines.drop_repeated_lines(H.frame(spark))
    assert set(H.frame(spark).columns) < set(got.columns)
    for r in got.collect():
        n, gone, kept = want[r["doc_id"]]
        assert (r["n_lines"], r["n_removed"], r["text"] or "") == (n, gone, kept)
    assert sum(g for _, g, _ in want.values()) > 0
    assert lines.drop_repeated_lines(empty).count() == 0


def test_lines_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "a\nb\nc", 5, 6), (2, "a\nb\nc", 5, 6)], "doc_id long, text string, n_lines int, _doc int")
    got = {r["doc_id"]: r for r in lines.drop_repeated_lines(df).collect()}
    assert got[1]["text"] == "a\nb\nc" and got[2]["text"] == "" and got[2]["n_lines"] == 5 and got[2]["_n_lines"] == 3


# -- 3 and 5

MESSY = ["a@b.c", "x.y@mail.example.com", "1", "2.", "3.4", "10.0.0.256", "1.2.3.4", "+", "(", ") ", " ", "-", "_", "@", "255.", "4111 1111 1111 1111", "+1 555-123-4567", "é", "0", ".", "token = ", "Password:", '"', "api_key='", "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef01234567", "=", "ſecret=abcdefg"]


@pytest.mark.parametrize("module, brute", [(pii, H.pii), (secrets, H.secrets)])
def test_base_spans_equal_plain_patterns(module, brute):
    for seed in range(1500):
        r = random.Random(seed)
        text = "".join(r.choice(MESSY) for _ in range(r.randint(0, 14)))
        assert module.base_spans(text) == brute(text), text


def test_linear_time_on_long_runs():
    for text in ("a" * 200_000 + " @", "1" * 200_000, "+1" + "(" * 100_000, "f" * 100_000 + "=", "token" + " " * 100_000):
        pii.base_spans(text)
        secrets.base_spans(text)


@pytest.mark.parametrize("function, brute, names", [(pii.personal_spans, H.pii, pii.KINDS), (secrets.secret_spans, H.secrets, secrets.KINDS)])
def test_span_queries(spark, empty, function, brute, names):
    r = random.Random(3)
    rows = [*H.odd_documents(), *((1000 + i, " ".join(r.choice(MESSY) for _ in range(12)), None, None, None) for i in range(60))]
    texts = dict(pairs(rows))
    for row in function(H.frame(spark, rows)).collect():
        found = brute(texts[row["doc_id"]] or "")
        assert [row[f"n_{k}"] for k in names] == list(map(len, found))
        spans = [(s, names.index(k), f"{k}:{s}:{e}") for k, xs in zip(names, found, strict=True) for s, e in xs]
        if function is secrets.secret_spans:
            spans.sort()
        base = [x for _, _, x in spans]
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(row["spans"].split(",")) | {""} and len([x for x in row["spans"].split(",") if x]) == len(base) + row["n_added"]
    assert function(empty).count() == 0


def test_reliable_labelers_win():
    counts = {(0, (2, 2, 2, 0, 2)): 80, (0, (0, 1, 1, 0, 2)): 60, (0, (2, 2, 1, 0, 2)): 5, (0, (0, 1, 2, 0, 1)): 5}
    sure = pii.reliabilities(counts)
    assert sure[0, (2, 2, 2, 0, 2)] > 0.95 and sure[0, (0, 1, 1, 0, 2)] < 0.05


def labelled_texts(n=600, seed=3):
    """Texts with personal data that the plain patterns miss, or with what looks like it, and the spans."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8)))
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))

    def card(valid):
        while H.luhn(d := "4" + digits(15)) != valid:
            pass
        return d

    def dotted(d):
        return ".".join(d[i : i + 4] for i in range(0, 16, 4))

    good = [
        lambda: ("email", f"{word()} at {word()} dot com", "email "), lambda: ("email", f"{word()}.{word()}(at){word()}.org", "contact "),
        lambda: ("card", dotted(card(True)), r.choice(["card ", "visa ", "payment "])), lambda: ("phone", f"({r.randint(200, 999)}) {digits(3)}-{digits(4)}", r.choice(["phone ", "tel ", "mobile "])),
        lambda: ("ip", f"{r.randint(11, 126)}[.]{r.randint(0, 255)}[.]{r.randint(0, 255)}[.]{r.randint(1, 255)}", "host "),
    ]
    bad = [
        lambda: ("card", card(False), r.choice(["order ", "invoice ", "number "])), lambda: ("card", dotted(card(False)), "version "), lambda: ("email", f"{word()} at {word()}.{word()}", "release "),
        lambda: ("ip", f"{r.randint(300, 999)}[.]{r.randint(300, 999)}[.]{r.randint(300, 999)}[.]{r.randint(300, 999)}", "version "),
    ]
    rows, spans = [], {}
    for i in range(n):
        kind, body, lead = r.choice(good if i % 2 else bad)()
        text = " ".join(word() for _ in range(6)) + " " + lead
        spans[i] = {f"{kind}:{len(text)}:{len(text) + len(body)}"} if i % 2 else set()
        rows.append((i, text + body + " " + word() + ". " + word(), None, None, None))
    return rows, spans


def test_added_personal_spans_recall_and_precision(spark):
    rows, want = labelled_texts()
    got = {x["doc_id"]: {s for s in x["spans"].split(",") if s} for x in pii.personal_spans(H.frame(spark, rows)).collect()}
    right = sum(len(got[i] & want[i]) for i in want)
    assert right >= 0.9 * sum(map(len, want.values())) and right >= 0.95 * sum(map(len, got.values()))


@pytest.mark.parametrize("unit", ["a@b.c at x dot y ", "4111 1111 1111 1111 1111.", "call 555-123-4567 ", "1" * 50, "a.b at ", "x at y.z dot "])
def test_candidates_take_linear_time(unit):
    import time

    took = []
    for n in (60_000, 240_000):
        text = unit * (n // len(unit))
        began = time.process_time()
        pii.candidates(text)
        secrets.candidates(text, [x for spans in secrets.base_spans(text) for x in spans])
        took.append(time.process_time() - began)
    assert took[1] <= 10 * took[0] + 0.2


def test_written_out_addresses_become_candidates():
    text = "write to jane.doe (at) example (dot) org or 2001:0db8:0000:0000:0000:ff00:0042:8329"
    assert {(pii.KINDS[k], text[s:e]) for k, s, e, b in pii.candidates(text) if not b} == {("email", "jane.doe (at) example (dot) org"), ("ip", "2001:0db8:0000:0000:0000:ff00:0042:8329")}


def test_network_keeps_its_recall():
    network = secrets.Network().fit(*secrets.findings())
    x, y = secrets.findings(800, seed=77)
    said = network.probability(x) >= network.threshold
    assert network.recall >= secrets.RECALL and said[y == 1].mean() >= 0.9 and said[y == 0].mean() <= 0.05


def test_what_base_spans_leave_of_a_run_is_a_candidate(spark):
    token, key, hexes = "Zq7Rk2Wm9Xv4Lp8Tn3Bd6Hs1", "AKIA" + "Q7RK2WM9XV4LP8TN", "0123456789abcdef01234567"
    text = f"see {key}/{token} and {token}X{hexes}Y{token} or {hexes} at the end"
    left = [f"/{token}", f"{token}X", f"Y{token}"]
    base = [s for spans in secrets.base_spans(text) for s in spans]
    assert [text[s:e] for s, e in secrets.candidates(text, base)] == left
    assert secrets.candidates(text) == [(s, s + len(w)) for w in (f"{key}/{token}", f"{token}X{hexes}Y{token}", hexes) for s in [text.index(w) if w != hexes else text.rindex(w)]]
    row = secrets.secret_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [x for x in row["spans"].split(",") if x.startswith("model")] == [f"model:{s}:{e}" for s, e in secrets.candidates(text, base)]
    r = random.Random(16)
    for _ in range(500):
        text = "".join(r.choice(["a", "Z", "7", " ", "a1b2c3d4e5f6g7h8", key, hexes, "token=", "é"]) for _ in range(12))
        base = [s for spans in secrets.base_spans(text) for s in spans]
        free = [(s, e) for s, e in secrets.candidates(text, base)]
        assert all(e <= a or b <= s for s, e in free for a, b in base) and len(set(free)) == len(free)
        assert {c for c in secrets.candidates(text) if all(c[1] <= a or b <= c[0] for a, b in base)} <= set(free)


def test_base_findings_have_no_say_in_the_threshold(spark, monkeypatch):
    """The recall holds on the generator's own held-out secrets, however many base findings there are."""
    network, fit = [], secrets.Network.fit

    def spy(self, codes, y, *args, **kwargs):
        network.append((fit(self, codes, y, *args, **kwargs), codes, y))
        return self

    monkeypatch.setattr(secrets.Network, "fit", spy)
    monkeypatch.setattr(secrets, "findings", lambda f=secrets.findings: f(400))
    r = random.Random(15)
    base = [(d, " ".join("".join(r.choice("0123456789abcdef") for _ in range(40)) for _ in range(200))) for d in range(10)]
    secrets.secret_spans(spark.createDataFrame(base, "doc_id long, text string"))
    (got, codes, y), = network
    order = np.random.default_rng(5).permutation(len(y))
    held = order[: len(y) // 5]
    long = 400 + len(secrets.long_findings()[1])
    short = long + len(secrets.short_findings()[1])
    assert len(y) == short + secrets.SAMPLE and got.base_recall >= 0.9
    for lo, hi, threshold in ((0, 400, got.threshold), (400, long, got.threshold), (long, short, got.short_threshold)):
        own = held[(held >= lo) & (held < hi) & (y[held] == 1)]
        assert (got.probability(codes[own]) >= threshold).mean() >= secrets.RECALL


def test_secrets_beyond_the_patterns_are_found_and_others_left_alone(spark):
    """Kinds without a digit, without a lower-case letter, short ones that the context names, and what
    looks like them."""
    r = random.Random(23)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    word = lambda: pick("aeioulnrst", r.randint(3, 8))
    short = lambda: pick(lower, 3) + pick(digits, 2) + pick(lower.upper(), 3) + pick(digits, 2)
    good = [lambda: "use " + pick(lower + lower.upper(), 28), lambda: "key: " + pick("0123456789ABCDEF", 32), lambda: "pwd is " + short(), lambda: "login admin " + short(), lambda: "bearer " + pick(lower + lower.upper() + digits, 30)]
    bad = [lambda: f"{word()}-{word()}-{word()}", lambda: pick(digits, 16), lambda: f"{r.randint(1, 255)}.{r.randint(1, 255)}.{r.randint(1, 255)}.7", lambda: f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-11", lambda: f"www.{word()}.com/{word()}", lambda: f"{word()}.{r.randint(10, 99)}", lambda: word() + word() + word()]
    rows = [(i, f"{word()} {word()} " + r.choice(good if i < 300 else bad)() + f" {word()} {word()}") for i in range(600)]
    added = {x["doc_id"]: x["n_added"] for x in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(added[i] > 0 for i in range(300)) >= 270 and sum(added[i] > 0 for i in range(300, 600)) <= 15


def test_every_run_but_plain_words_is_a_candidate():
    text = "Internationalization STRASSENBAHN plain 12345678 abcdefgh.1 12-34 a1b2c3d4 camelCaseWord x=y=z=w=v= end-to-end"
    assert [text[s:e] for s, e in secrets.candidates(text)] == ["12345678", "abcdefgh.1", "a1b2c3d4", "camelCaseWord", "x=y=z=w=v", "end-to-end"]


def test_long_candidates_are_read_whole(spark):
    """A token behind, between and before paths of 60 characters and more, and paths without one."""
    r = random.Random(14)
    token = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(24))
    name = lambda: "".join(r.choice("aeiourstnlmd") for _ in range(r.randint(3, 8)))
    path = lambda: "/".join(name() for _ in range(12)) + "/2024"
    texts = [f"see //hooks.example.com/services/T00000000/B00000000/{token()} now" for _ in range(20)]
    texts += [f"see {path()}/{token()} now" for _ in range(20)] + [f"see {path()}/{token()}/{path()} now" for _ in range(20)] + [f"see {token()}/{path()} now" for _ in range(20)]
    texts += [f"see {path()}/{path()} now" for _ in range(40)]
    assert secrets.windows(5, 40) == [(5, 40)] and secrets.windows(0, 100) == [(0, 44), (22, 66), (44, 88), (56, 100)]
    found = {x["doc_id"]: x for x in secrets.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for kind in range(4):
        assert sum(found[d]["n_added"] for d in range(20 * kind, 20 * kind + 20)) >= 18
    assert sum(found[d]["n_added"] for d in range(80, 120)) <= 4
    assert all(x["spans"] in ("", f"model:4:{len(texts[d]) - 4}") for d, x in found.items())


# -- 4

def test_quality_drops_what_the_target_never_says(spark, empty):
    r = random.Random(5)
    words = [f"word{i}" for i in range(400)]
    rows, labels = [], []
    for d in range(600):
        bad = d % 5 == 0
        ws = [r.choice(words) for _ in range(60)] + (["vile", "slur", "Filth!"] if bad else [])
        r.shuffle(ws)
        rows.append((d, " ".join(ws), None, None, None))
        if d % 2:
            labels.append((d, 1, int(bad)))
    rows += [(900, None, None, None, None), (901, "", None, None, None)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = quality.resample(H.frame(spark, rows), lab)
    assert kept.columns == [*H.frame(spark).columns, "log_weight", "key"]
    ids = {x["doc_id"] for x in kept.collect()}
    clean = {d for d, *_ in rows if d >= 900 or d % 5}
    assert clean <= ids and len(ids - clean) <= 2
    assert ids == {x["doc_id"] for x in quality.resample(H.frame(spark, rows), lab, keep=["doc_id"]).collect()}
    assert quality.resample(empty, lab).count() == 0
    assert quality.resample(H.frame(spark), lab.limit(0)).count() == len(H.odd_documents())


def test_ratios_and_draw_equal_brute_force(spark):
    """The models counted one document after the other, and the draw as a sort of all keys."""
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = [(d, " ".join(r.choice(words[: 30 if d % 3 else 60]) for _ in range(40)), None, None, None) for d in range(300)]
    labels = [(d, int(d % 3 > 0), 0) for d in range(0, 300, 2)]
    df, lab = H.frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    ratios, held = quality.fit(df, lab)
    assert 10 <= len(held) <= 60 and all(good == (d % 3 > 0) for d, good in held.items())
    raw, target = np.zeros(quality.BUCKETS, np.int64), np.zeros(quality.BUCKETS, np.int64)
    for d, text, *_ in rows:
        for b in {int(x) for part in quality._buckets(text) for x in part}:
            raw[b] += 1
            target[b] += d % 2 == 0 and d % 3 > 0 and d not in held
    assert np.array_equal(ratios, quality.log_ratios(raw, target))
    kept = {x["doc_id"]: (x["log_weight"], x["key"]) for x in quality.resample(df, lab).collect()}
    weights = {d: quality.log_weight(t, ratios) for d, t, *_ in rows}
    heat = quality.temperature(np.array([weights[d] for d in held]), np.array(list(held.values())))
    hashes = {x["doc_id"]: x["h"] for x in df.select("doc_id", F.xxhash64(F.lit(3), df["doc_id"], df["text"]).alias("h")).collect()}
    u = {d: ((int(quality.mix64(np.array([h]).view(np.uint64))[0]) >> 11) + 0.5) / 2**53 for d, h in hashes.items()}
    keys = {d: weights[d] / heat - np.log(-np.log(u[d])) for d in weights}
    k = round(sum(1 - np.exp(-np.exp(min(w / heat - quality.FLOOR, 700))) for w in weights.values()))
    want = sorted(keys, key=keys.get, reverse=True)[:k]
    assert set(kept) == set(want) and 150 < k < 300
    assert all(abs(kept[d][0] - weights[d]) < 1e-9 and abs(kept[d][1] - keys[d]) < 1e-9 for d in want)


def test_temperature_follows_the_labels():
    r = np.random.default_rng(2)
    good = r.random(4000) < 0.7
    weights = np.where(good, 0.0, -2.0)
    sure = quality.temperature(weights, good)
    # labels drawn by the ratio itself keep it
    weights = -6 * r.random(4000)
    drawn = r.random(4000) < -np.expm1(-np.exp(weights - quality.FLOOR))
    assert sure < 0.5 and 0.85 < quality.temperature(weights, drawn) < 1.15 and quality.temperature(np.zeros(0), np.zeros(0, bool)) == 1.0


def test_kth_greatest(spark):
    r = random.Random(6)
    values = [r.choice([r.gauss(0, 1), 0.5, -1e6, 1e9]) for _ in range(500)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 250, 500):
        assert quality.kth_greatest(df, "x", k, most=16) == sorted(values, reverse=True)[k - 1]


# -- 6

def test_alignment_equals_plain_smith_waterman():
    r = random.Random(7)
    for _ in range(60):
        a, b = ([r.randint(1, 5) for _ in range(r.randint(1, 12))] for _ in range(2))
        assert decontam.align(np.array(a), np.array(b))[0] == H.smith_waterman(a, b)


def test_decontamination_finds_edited_copies(spark, empty):
    r = random.Random(8)
    words = [f"w{i}" for i in range(500)]
    say = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(say(40))) for i in range(6)] + [(9, None), (10, ""), (11, "tiny item")]
    edited = items[1][1].split()
    edited[5], edited[20] = "other", "words"
    del edited[30]
    rows = [(1, " ".join(say(50)) + " " + items[0][1].upper() + "."), (2, " ".join(say(20) + edited + say(20))), (3, " ".join(say(400))), (4, None), (5, ""), (6, "a tiny, item."), (7, items[0][1] + " " + items[2][1])]
    rows += [(100 + i, "common " + items[3][1]) for i in range(200)]
    df, tests = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]): x["score"] for x in decontam.contaminated(df, tests).collect()}
    assert set(found) == {(1, 0), (2, 1), (6, 11), (7, 0), (7, 2)} | {(100 + i, 3) for i in range(200)}
    assert found[1, 0] == 1 and 0.8 < found[2, 1] < 1
    assert {x["doc_id"] for x in decontam.drop_contaminated(df, tests).collect()} == {3, 4, 5}
    assert decontam.contaminated(empty, tests).count() == 0 and decontam.contaminated(df, tests.limit(0)).count() == 0


def test_decontamination_equals_brute_force(spark, monkeypatch):
    """Every 3rd to 6th word replaced, a word put in after every one or two, halves, short items, long
    texts in pieces; many words are common, so that items share them."""
    monkeypatch.setattr(decontam, "PIECE", 90)
    monkeypatch.setattr(decontam, "PAIRS", 300)
    r = random.Random(12)
    vocabulary = [f"w{i}" for i in range(150)]
    say = lambda n: [vocabulary[int(150 * r.random() ** 2)] for _ in range(n)]
    items = [(i, say(r.choice([15, 30, 40, 60]))) for i in range(12)] + [(20 + n, [f"u{n}{i}" for i in range(n)]) for n in range(1, 9)]
    texts = [say(300) for _ in range(4)]
    for _, ws in items:
        texts += [say(70) + [w if i % k else "new" for i, w in enumerate(ws, 1)] + say(70) for k in (3, 4, 5, 6)]
        texts += [say(9) + [x for i, w in enumerate(ws, 1) for x in ([w, "put"] if i % k == 0 else [w])] for k in (1, 2)]
        texts += [ws[: len(ws) // 2 + more] + say(5) for more in (0, 1)]
    want = {}
    for d, text in enumerate(texts):
        for i, ws in items:
            score = H.smith_waterman(ws, text)
            if score >= max(len(ws), 2 * min(len(ws), 3)):
                want[d, i] = score / (2 * len(ws))
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")
    assert {(x["doc_id"], x["item_id"]): x["score"] for x in decontam.contaminated(df, tests).collect()} == want
    assert {x["doc_id"] for x in decontam.drop_contaminated(df, tests).collect()} == set(range(len(texts))) - {d for d, _ in want}
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 150)  # several blocks
    assert {(x["doc_id"], x["item_id"]): x["score"] for x in decontam.contaminated(df, tests).collect()} == want
    assert {x["doc_id"] for x in decontam.drop_contaminated(df, tests).collect()} == set(range(len(texts))) - {d for d, _ in want}


# -- 7

def test_first_fit_decreasing_equals_the_plain_loop():
    r = random.Random(9)
    for _ in range(30):
        sizes = np.array([r.randint(1, 32) for _ in range(r.randint(0, 60))], np.int64)
        bins, offsets, used = packing.first_fit_decreasing(sizes, 32)
        room, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((b for b, left in enumerate(room) if left >= sizes[i]), len(room))
            if b == len(room):
                room.append(32)
            want[i] = (b, 32 - room[b])
            room[b] -= int(sizes[i])
        assert [(int(b), int(o)) for b, o in zip(bins, offsets, strict=True)] == [want[i] for i in range(len(sizes))] and used == len(room)


def test_packing_holds_every_id_once(spark, empty):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok, rows = Tokenizer.from_file(path), H.odd_documents() + [(500, "x <|endoftext|> ÀÉ don't 12,5 naïve's", None, None, None)]
    ids = {d: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for d, t, *_ in rows}
    cut = packing.pieces(H.frame(spark, rows), path, with_ids=True)
    got = packing.pack(cut).collect()
    for x in got:
        part = ids[x["doc_id"]][x["start"] : x["start"] + x["length"]]
        assert len(part) == x["length"] and zlib.crc32(part.tobytes()) == x["ids_crc32"] and x["doc_tokens"] == len(ids[x["doc_id"]]) and list(part) == x["ids"]
    assert sum(x["length"] for x in got) == sum(len(ids[d]) for d, *_ in rows)
    by = {}
    for x in sorted(got, key=lambda x: (x["sequence_id"], x["offset"])):
        assert x["offset"] == by.get(x["sequence_id"], 0)
        by[x["sequence_id"]] = x["offset"] + x["length"]
    assert max(by.values()) <= 2048
    for s in packing.packed_sequences(packing.pack(cut)).collect():
        n = by[s["sequence_id"]]
        assert len(s["ids"]) == (n if n & (n - 1) == 0 else 2048)
    assert packing.pack(packing.pieces(empty, path)).count() == 0


@pytest.mark.parametrize("memo", [300, 20])
def test_packing_keeps_the_ids_of_common_words(monkeypatch, memo):
    """Rare words don't drive common ones out, marks and digits don't go whole through the library."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "MEMO", memo)
    path = vocabulary("word_bpe_49k.json")
    tok, ids, r, merged, whole = Tokenizer.from_file(path), packing.Ids(path, 1), random.Random(11), [], []
    merge, encode = ids.merge, ids._encode
    ids.merge, ids._encode = lambda w: merged.append(w) or merge(w), lambda texts: whole.extend(texts) or encode(texts)
    common = ["the", "The", "don't", "'sword", "été***", '"Ça,"', "12,5", "x'LL'", "a.b@c-d", "'\"s"]
    for _ in range(30):
        texts = [" ".join(r.sample(common, 10) + ["".join(r.choices("abcdeé", k=9)) for _ in range(20)]) for _ in range(4)]
        want = [np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes() for t in texts]
        assert ids.all(texts) == want
    assert whole == []
    assert memo == 20 or max(merged.count(w) for w in ("the", "don", "sword", "1")) == 1
    long = "ab" * 5000
    assert ids.all([f"{long} the {long}"]) == [np.array([*tok.encode(f"{long} the {long}", add_special_tokens=False).ids, 1], "<u4").tobytes()]
    assert long not in {**ids.known, **ids.known.new}


# -- 8

def test_token_counts_equal_the_library(spark, empty):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    texts = dict(pairs())
    for x in token_counts.token_counts(H.frame(spark), path).collect():
        t = texts[x["doc_id"]] or ""
        n = len(tok.encode(t, add_special_tokens=False).ids)
        assert (x["n_bytes"], x["n_tokens"], x["over_limit"]) == (len(t.encode()), n, n > 512)
    assert token_counts.token_counts(empty, path).count() == 0
    r, count = random.Random(10), token_counts.counter(path)
    letters = [*"ab '\n\t  eéñ1.!?日🙂̀ 　\xa0ת՘", "<|endoftext|>", "the ", "ing", "'re", "'s", "  ", "<|end", "Word,", "   ", " \n", "\n ", "'ll", "\x1c", "\x85"]
    for i in range(600):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 24)))
        assert count.count(t) == len(tok.encode(t, add_special_tokens=False).ids), t
        if i < 400:
            assert list(count.table(t)) == [len(tok.encode(t[:k], add_special_tokens=False).ids) for k in range(len(t) + 1)], t


def test_budgets_are_answered_from_stored_tables(spark):
    path = vocabulary("byte_bpe_50k.json")
    tables = token_counts.prefix_tables(H.frame(spark), path)
    texts, count = dict(pairs()), token_counts.counter(path)
    for x in token_counts.answers(tables, 20).collect():
        t = texts[x["doc_id"]] or ""
        fits = [k for k in range(min(len(t), 200) + 1) if count.count(t[:k]) <= 20]
        assert x["n_chars"] == fits[-1] and x["kept_tokens"] == count.count(t[: x["n_chars"]]) and x["n_tokens"] == count.count(t)
    spelt = {x["doc_id"]: list(x["prefix_tokens"]) for x in token_counts.prefix_tokens(tables).collect()}
    assert all(spelt[d] == list(count.table(t or "")) for d, t in texts.items())


@pytest.mark.parametrize("unit", [" ", "\n ", "a", "<|endoftext|>", "'re "])
def test_tables_take_linear_time(unit):
    import time

    count, took = token_counts.counter(vocabulary("byte_bpe_50k.json")), []
    for n in (4_000, 16_000):
        text = unit * (n // len(unit))
        began = time.process_time()
        count.steps(text)
        took.append(time.process_time() - began)
    assert took[1] <= 10 * took[0] + 0.2


# -- 9

@pytest.mark.parametrize("large", [20_000, 1])
def test_repeats_equal_brute_force(spark, empty, monkeypatch, large):
    monkeypatch.setattr(suffix, "LARGE", large)
    monkeypatch.setattr(suffix, "SEGMENT", 700)
    monkeypatch.setattr(suffix, "CHUNK", 3000)
    want = H.repeated_bytes(pairs())
    got = suffix.drop_repeats(H.frame(spark), with_text=True).collect()
    assert len(got) == len(H.odd_documents()) and sum(w[1] for w in want.values()) > 500
    for x in got:
        assert (x["n_bytes"], x["n_removed"], x["n_spans"], x["kept_sha256"]) == want[x["doc_id"]]
        assert hashlib.sha256(bytes(x["kept"])).hexdigest() == x["kept_sha256"]
    assert suffix.drop_repeats(empty).count() == 0


def test_buckets_tell_strings_apart():
    data = np.frombuffer(b"abcdefgh" * 40 + b"x" + b"abcdefgh" * 20, np.uint8)
    ids = suffix.buckets(data, 100)
    raw = data.tobytes()
    for i in range(0, len(ids), 7):
        for j in range(0, len(ids), 5):
            assert (ids[i] == ids[j]) == (raw[i : i + 100] == raw[j : j + 100])


# -- 10

def png():
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


GIF = b"GIF89a\1\0\1\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\1\0\1\0\0\2\2D\1\0;"
MIDI = b"MThd\0\0\0\6\0\1\0\1\0\x60MTrk\0\0\0\4\0\xff\x2f\0"


def test_sniffing_confirms_corrects_and_carves(spark):
    import gzip
    import io
    import zipfile

    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", "hello")
    bmp = b"BM" + struct.pack("<IIIIIIHH", 58, 0, 54, 40, 1, 1, 1, 24) + bytes(24 + 4)
    whole = {"png": png(), "gif": GIF, "midi": MIDI, "gzip": gzip.compress(b"data"), "zip": buffer.getvalue(), "wav": media.store_samples(b"ab" * 9), "bmp": bmp, "pdf": PDF, "ogg": ogg_page(0) + ogg_page(4)}
    for kind, blob in whole.items():
        assert media.examine(blob, "text/plain")["type"] == kind and media.examine(blob, "text/plain")["length"] == len(blob), kind
        assert media.examine(blob[:-1] if kind != "bmp" else blob[:50], media.MIME[kind])["type"] == "none", kind
    inside = b"junk" + png() + b"\0\0" + GIF + b"PK\3\4 not a zip"
    rows = [(1, whole["png"], "image/jpeg"), (2, inside, "application/octet-stream"), (3, None, None), (4, b"", "x/y"), (5, whole["wav"], "audio/wav")]
    got = {r["id"]: r["media_1"] for r in media.sniff(spark.createDataFrame(rows, "id int, blob binary, said string").withColumn("media", F.lit(1)), "blob", "said").collect()}
    assert (got[1]["type"], got[1]["corrected"], got[1]["was_wrong"]) == ("png", "image/png", True) and not got[5]["was_wrong"]
    assert [(e["type"], bytes(e["content"])) for e in got[2]["embedded"]] == [("png", png()), ("gif", GIF)]
    assert got[3]["type"] == got[4]["type"] == "none" and got[2]["hits"] >= 3


PDF = b"%PDF-1.4\nxref\n0 1\nstartxref\n9\n%%EOF"


def ogg_page(flags, body=b"sound"):
    page = bytearray(b"OggS\0" + bytes([flags]) + bytes(20) + bytes([1, len(body)]) + body)
    crc = 0
    for byte in page:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1) ^ (0x104C11DB7 if crc & 0x80000000 else 0)
    page[22:26] = struct.pack("<I", crc)
    return bytes(page)


def jpeg(segment=b""):
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", 2 + len(segment)) + segment + b"\xff\xda\0\2\1\2\xff\0\3\xff\xd9"


def test_media_inside_media_of_the_same_kind():
    import io
    import zipfile

    def archive(*files, stream=False):
        class Pipe(io.BytesIO):
            def tell(self):
                if stream:
                    raise OSError
                return super().tell()

        out = Pipe()
        with zipfile.ZipFile(out, "w") as z:
            for name, data in files:
                z.writestr(name, data)
        return out.getvalue()

    def found(blob):
        return [(blob[s:e], t) for s, e, t in media.scan(blob)[1]]

    small = media.store_samples(b"inner!")
    big = media.store_samples(b"xx" + small + b"yy")
    assert found(big) == [(big, "wav"), (small, "wav")]
    assert media.examine(big, "audio/wav")["embedded"] == [(46, 46 + len(small), "wav")]
    inner = archive(("a", b"1"), ("b", b"2"))
    outer = archive(("first", b"0"), ("inner.zip", inner), ("last", b"3"))
    assert found(outer) == [(outer, "zip"), (inner, "zip")]
    streamed = archive(("a", b"1" * 50), ("b", b"2"), stream=True)
    assert streamed[6] & 8 and found(b"junk" + streamed) == [(streamed, "zip")]
    thumbnail = jpeg()
    assert found(jpeg(b"Exif" + thumbnail)) == [(jpeg(b"Exif" + thumbnail), "jpeg"), (thumbnail, "jpeg")]
    pages = ogg_page(2) + ogg_page(0) + ogg_page(4)
    assert found(b"x" + pages + b"y") == [(pages, "ogg")] and found(ogg_page(2) + ogg_page(0)) == []
    updated = PDF + b"\nxref\n0 2\nstartxref\n%d\n%%%%EOF" % (len(PDF) + 1)
    assert found(b"ab" + updated + b"cd" + PDF) == [(updated, "pdf"), (PDF, "pdf")]
    assert found(PDF[:9] + b"1 0 obj " + PDF + b" endobj\nxref\nstartxref\n%d\n%%%%EOF" % (9 + 8 + len(PDF) + 8))[1] == (PDF, "pdf")
    assert found(b"%PDF-1.4 startxref\n7\n%%EOF") == []
    linear = b"%PDF-1.4\nxref\n0 1\nstartxref\n0\n%%EOF\nxref\n0 9\nstartxref\n9\n%%EOF"
    assert found(linear) == [(linear, "pdf")]


def test_hits_equal_a_plain_search():
    r = random.Random(4)
    magic = [m for m, _, _ in media.MAGIC]
    for _ in range(60):
        blob = b"".join(r.choice([*magic, bytes([r.randint(0, 255)]), b"R", b"PK", png(), GIF]) for _ in range(r.randint(0, 40)))
        assert media.scan(blob)[0] == sum(blob.startswith(m, i) for m in magic for i in range(len(blob)))


@pytest.mark.parametrize("unit", [b"%PDF-startxref ", b"%PDF-1 obj\nxref startxref\n5\n%%EOF ", b"PK\3\4" + bytes(26), b"PK\5\6" + bytes(18), b"OggS", b"RIFF\x20\0\0\0WAVE", b"\xff\xd8\xff\xda\0\2", b"\x1f\x8b\x08\0"])
def test_scans_take_linear_time(unit):
    import time

    took = []
    for n in (100_000, 400_000):
        blob = unit * (n // len(unit))
        began = time.process_time()
        media.scan(blob)
        took.append(time.process_time() - began)
    assert took[1] <= 10 * took[0] + 0.2


def test_media_digests_round_trip(spark, empty):
    texts = dict(pairs())
    for x in media.media_digests(H.frame(spark)).collect():
        raw = (texts[x["doc_id"]] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        stored = media.store_samples(payload)
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (x["media_bytes"], x["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and x["feature"].startswith(f"wav:{len(stored)};")
    assert media.media_digests(empty).count() == 0
