"""A small table that has every odd case, and brute-force versions of the operators."""

import hashlib
import random
import re
from collections import defaultdict

DDL = "doc_id long, text string, component_id string, kept string, n_bytes string"


def odd_documents(seed=1):
    """Null and empty texts, a null id, ties, repeated rows, near and exact copies, a long text."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(2, 6))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = say(80)
    near = base.split()
    near[40] = "changed"
    shared = say(60)
    texts = [
        base, base, " ".join(near), base.upper(), "", None, "one", "two words", " \t\n ", "two words",
        say(30) + "\n" + shared + "\n" + say(20), shared + " " + say(40), say(10) + "\n\n\n\n" + shared, "ab " * 200,
        say(3000), "日本語 テキスト 🙂 " * 5, "a\nb\nc\nd\na\nb\nc\nd\nx", "x\na\nb\nc\ny", "\x00\x1f weird   space",
    ]
    rows = [(i * 3 + 1, t, "clash", "no", "x") for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, say(50), None, None, None)]


def frame(spark, rows=None):
    return spark.createDataFrame(odd_documents() if rows is None else rows, DDL)


def near_duplicates(rows, w, num, den):
    sets = {}
    for d, t in rows:
        x = (t or "").encode()
        x = bytes(c + 32 if 65 <= c <= 90 else c for c in x)
        ws = [v for v in re.split(rb"[\x20\x09-\x0d]+", x) if v]
        sets[d] = {tuple(ws[i : i + w]) for i in range(len(ws) - w + 1)} if len(ws) >= w else {tuple(ws)} if ws else set()
    at = {d: d for d in sets}

    def top(d):
        while at[d] != d:
            d = at[d]
        return d

    ids = sorted(sets, key=lambda d: (d is None, d or 0))
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)), key=lambda d: (d is None, d or 0))
                at[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


def repeated_bytes(rows, length=100):
    seen, out = {}, {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        b = (t or "").encode()
        cover = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen.setdefault(b[p : p + length], (d, p)) != (d, p):
                cover[p : p + length] = b"\1" * length
        kept = bytes(c for c, x in zip(b, cover, strict=True) if not x)
        spans = sum(1 for i in range(len(b)) if cover[i] and (i == 0 or not cover[i - 1]))
        out[d] = (len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeated_lines(rows):
    seen, out = {}, {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        lines = (t or "").split("\n")
        gone = set()
        for i in range(len(lines) - 2):
            if seen.setdefault(tuple(lines[i : i + 3]), (d, i)) != (d, i):
                gone |= {i, i + 1, i + 2}
        out[d] = (len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        n = int(c) * (2 if i % 2 else 1)
        total += n if n < 10 else n - 9
    return total % 10 == 0


def pii(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15],
    ]


def secrets(text):
    either = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_") + "?[kK][eE][yY]"
    return [
        [m.span() for m in re.finditer(rf"""({either})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6],
        [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20],
        [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24],
    ]


def smith_waterman(a, b, match=2, mismatch=-1, gap=-1):
    h, best = defaultdict(int), 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch), h[i - 1, j] + gap, h[i, j - 1] + gap)
            best = max(best, h[i, j])
    return best


