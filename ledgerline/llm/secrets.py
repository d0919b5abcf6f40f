"""Secrets: plain patterns, and a character convolutional network over every other candidate.

Base spans always stay. Every other run of 8 or more secret-like characters is a candidate, unless it is
one plain word (letters of one case, or capitalised); where base spans cover parts of a run, each part
left over is one for itself. A small network written in numpy reads the candidate with its surrounding
context and gives a logit: learned character vectors, one convolution, pooled inside and outside the
candidate. Candidates longer than the network's window are read whole, in overlapping windows, and
the greatest probability counts.

It is trained on labelled findings: a seeded generator's secrets and harmless strings in typical
contexts, among them short ones, of which only those that the context names are secrets, and windows of
long runs with and without a secret; and of the corpus itself at most SAMPLE base findings and as many
candidates that a plain rule calls harmless (numbers, addresses, hosts, joined words), those least by
hash. On a held-out fifth the logits are calibrated, and the threshold is the highest that keeps the
required recall there on the generator's secrets, on each kind of them alike; short candidates have a
threshold of their own. Base findings of the corpus have no say in it, as they stay whatever the network
says; the recall on those held out is measured as base_recall.

Cases: null and empty texts have no spans; an empty table gives an empty result; positions are code
points; long texts are taken whole; repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import documents, materialize, schema_of, slices

KINDS = ("assign", "access", "hex")
#: Corpus findings used in training at most, and the recall to keep on held-out findings.
SAMPLE, RECALL = 2000, 0.95
#: Characters read before, of and after a candidate's window, and from one window to the next.
BEFORE, INSIDE, AFTER, STEP = 20, 44, 8, 22
WIDTH, VECTOR, KERNEL, FILTERS = BEFORE + INSIDE + AFTER, 12, 5, 24

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs that aren't one plain word, and what makes a run one.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?!(?:[A-Z]?[a-z]+|[A-Z]+)[.=-]*(?![A-Za-z0-9+/_.=-]))[A-Za-z0-9+/_.=-]{8,}")
_WORD = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+)\Z")
_DIGIT, _LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
#: Numbers and what is written with them, addresses and hosts, words joined by one sign each.
_HARMLESS = re.compile(r"[0-9]+(?:[.:/_-][0-9]+)*\Z|(?:[A-Za-z0-9-]+\.)+(?:com|org|net|edu|gov|io)\Z|(?:[A-Z]?[a-z]+|[A-Z]+)(?:[./_=-](?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,4}))+\Z")
#: Characters of a candidate at least, and of one that isn't short.
LEAST, SHORT = 8, 16


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans by kind, in the order of KINDS."""
    assign = [m.span() for m in _ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    access = [m.span() for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    return [assign, access, [m.span() for m in _HEX.finditer(text)]]


def candidates(text: str, taken: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """Secret-like runs, without what only ends them and without the spans that are taken."""
    out, taken, at = [], sorted(taken), 0
    for m in _RUN.finditer(text):
        begin, pieces = m.start(), []
        while at < len(taken) and taken[at][0] < m.end():
            pieces.append((begin, taken[at][0]))
            begin = max(begin, taken[at][1])
            if taken[at][1] > m.end():  # it may reach into the next run
                break
            at += 1
        for s, e in [*pieces, (begin, m.end())]:
            run = text[s:e].rstrip(".=-") if e - s >= LEAST else ""
            if len(run) >= LEAST and not _WORD.match(run):
                out.append((s, s + len(run)))
    return out


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Character codes of a window in context: 0 for nothing, 1 beyond ASCII, then by code."""
    before = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0")
    inside = text[start : min(end, start + INSIDE)].ljust(INSIDE, "\0")
    after = text[end : end + AFTER].ljust(AFTER, "\0")
    codes = np.array([ord(c) for c in before + inside + after])
    return np.where(codes == 0, 0, np.where((codes < 32) | (codes > 126), 1, codes - 30)).astype(np.uint8)


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """The windows of a candidate: itself, or for a long one windows that overlap up to its end."""
    return [(s, s + INSIDE) for s in range(start, end - INSIDE, STEP)] + [(max(start, end - INSIDE), end)]


def encode_all(text: str, start: int, end: int) -> bytes:
    """The codes of all windows of a candidate, one after the other."""
    return b"".join(encode(text, s, e).tobytes() for s, e in windows(start, end))


class Network:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        self.p = {"vec": r.normal(0, 0.3, (97, VECTOR)), "conv": r.normal(0, 0.15, (KERNEL * VECTOR, FILTERS)), "bias": np.zeros(FILTERS), "out": r.normal(0, 0.2, 3 * FILTERS), "b": np.zeros(1)}
        self.scale, self.shift, self.threshold, self.short_threshold = 1.0, 0.0, 0.5, 0.5
        at = np.arange(WIDTH - KERNEL + 1) + KERNEL // 2
        self.inner = (at >= BEFORE) & (at < BEFORE + INSIDE)

    def _forward(self, codes: np.ndarray):
        p = self.p
        x = p["vec"][codes] * (codes > 0)[:, :, None]
        cols = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(codes), -1, KERNEL * VECTOR)
        h = np.maximum(cols @ p["conv"] + p["bias"], 0)
        inner, outer = h[:, self.inner], h[:, ~self.inner]
        pooled = np.concatenate([inner.max(1), inner.mean(1), outer.max(1)], axis=1)
        return x, cols, h, inner, outer, pooled, pooled @ p["out"] + p["b"]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i : i + 256])[-1] for i in range(0, len(codes), 256)]) if len(codes) else np.zeros(0)

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(codes) + self.shift, -50, 50)))

    def greatest(self, found: list[bytes]) -> np.ndarray:
        """For each candidate, as encode_all() gives it, the greatest probability of its windows."""
        codes = np.frombuffer(b"".join(found), np.uint8).reshape(-1, WIDTH)
        sizes = np.array([len(c) // WIDTH for c in found])
        return np.maximum.reduceat(self.probability(codes), np.cumsum(sizes) - sizes) if found else np.zeros(0)

    def _gradients(self, codes: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        _, cols, h, inner, outer, pooled, z = self._forward(codes)
        dz = (1 / (1 + np.exp(-z)) - y) / len(y)
        dpool = dz[:, None] * p["out"]
        dh = np.zeros_like(h)
        di, do = np.zeros_like(inner), np.zeros_like(outer)
        rows, filters = np.arange(len(y))[:, None], np.arange(FILTERS)
        di[rows, inner.argmax(1), filters] += dpool[:, :FILTERS]
        di += dpool[:, None, FILTERS : 2 * FILTERS] / inner.shape[1]
        do[rows, outer.argmax(1), filters] += dpool[:, 2 * FILTERS :]
        dh[:, self.inner], dh[:, ~self.inner] = di, do
        dh *= h > 0
        flat = dh.reshape(-1, FILTERS)
        dcols = (flat @ p["conv"].T).reshape(len(y), -1, KERNEL, VECTOR)
        dx = np.zeros((len(y), WIDTH, VECTOR))
        for k in range(KERNEL):
            dx[:, k : k + dcols.shape[1]] += dcols[:, :, k]
        dvec = np.zeros_like(p["vec"])
        np.add.at(dvec, codes.ravel(), (dx * (codes > 0)[:, :, None]).reshape(-1, VECTOR))
        return {"vec": dvec, "conv": cols.reshape(-1, KERNEL * VECTOR).T @ flat, "bias": flat.sum(0), "out": pooled.T @ dz, "b": dz.sum(keepdims=True)}

    def fit(self, codes: np.ndarray, y: np.ndarray, epochs: int = 8, seed: int = 5, kinds: np.ndarray | None = None) -> Network:
        """Train on four fifths, calibrate and set the threshold on the rest: the highest that keeps the
        recall on each of the kinds from 0 on, kind 2 being short candidates, which have their own. Kinds
        below 0 are what the network doesn't decide (-1) or what only a rule calls harmless (-2)."""
        kinds = np.zeros(len(y), np.int64) if kinds is None else kinds
        r = np.random.default_rng(seed)
        order = r.permutation(len(y))
        held, used = order[: len(y) // 5], order[len(y) // 5 :]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t = 0
        for _ in range(epochs):
            r.shuffle(used)
            for i in range(0, len(used), 64):
                t += 1
                for k, g in self._gradients(codes[used[i : i + 64]], y[used[i : i + 64]]).items():
                    m[k], s[k] = 0.9 * m[k] + 0.1 * g, 0.999 * s[k] + 0.001 * g * g
                    self.p[k] -= 0.004 * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)
        z, target = self.logits(codes[held]), y[held]
        for _ in range(200):  # calibration: a logistic fit of the logits, held back towards the identity
            e = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -50, 50))) - target
            self.scale -= 0.05 * ((e * z).mean() + 0.05 * (self.scale - 1))
            self.shift -= 0.05 * (e.mean() + 0.05 * self.shift)
        said, good = self.probability(codes[held]), {}
        for k in np.unique(kinds[kinds >= 0]).tolist():
            if len(found := np.sort(said[(target == 1) & (kinds[held] == k)])):
                good[k] = found
        least = lambda own: min((float(g[int((1 - RECALL) * len(g))]) for k, g in good.items() if own(k)), default=0.5)
        self.threshold, self.short_threshold = least(lambda k: k != 2), least(lambda k: k == 2)
        self.recall = min((float((g >= (self.short_threshold if k == 2 else self.threshold)).mean()) for k, g in good.items()), default=1.0)
        base = said[(target == 1) & (kinds[held] == -1)]
        self.base_recall = float((base >= self.threshold).mean()) if len(base) else 1.0
        return self

    def accepts(self, found: list[bytes], sizes: list[int]) -> np.ndarray:
        """Which candidates, as encode_all() gives them, are secrets."""
        return self.greatest(found) >= np.where(np.array(sizes) < SHORT, self.short_threshold, self.threshold)


def findings(n: int = 2800, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Labelled findings of the generator: secrets and harmless strings, half each, in contexts."""
    r = np.random.default_rng(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda letters, k: "".join(r.choice(list(letters), k))
    words = lambda k, sep: sep.join(pick("aeiourstnlmd", int(r.integers(3, 9))) for _ in range(k))
    every = lower + lower.upper() + digits
    secrets = [
        lambda: pick("0123456789abcdef", int(r.choice([20, 32, 40, 64]))),
        lambda: pick(every + "+/", int(r.integers(24, 60))) + "=" * int(r.integers(0, 3)),
        lambda: "AKIA" + pick(lower.upper() + digits, 16),
        lambda: str(r.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"])) + pick(every, int(r.integers(20, 40))),
        lambda: "eyJ" + pick(every, 20) + "." + pick(every, 30),
        lambda: pick("0123456789ABCDEF", int(r.choice([24, 32, 40]))),
        lambda: pick(lower + lower.upper(), int(r.integers(20, 40))),
    ]
    harmless = [
        lambda: words(3, "-") + f"-{r.integers(1, 99)}",
        lambda: f"20{r.integers(10, 30)}-{r.integers(10, 13)}-{r.integers(10, 29)}T{r.integers(10, 24)}.{r.integers(10, 60)}.{r.integers(10, 60)}Z",
        lambda: f"www.{words(2, '-')}.com/{words(2, '/')}/{r.integers(1, 999)}",
        lambda: f"{words(3, '_')}_v{r.integers(1, 20)}.{r.integers(0, 20)}.{pick(lower, 3)}",
        lambda: f"{words(1, '')}{r.integers(0, 99)}.{words(2, '.')}.example.org",
        lambda: f"{pick(digits, 4)}-{pick(digits, 4)}-{pick(digits, 4)}-{pick(lower, 2)}",
        lambda: f"{words(3, '.').capitalize()}.{r.integers(1, 99)}",
        lambda: "=" * 14 + f"{words(1, '')}{r.integers(1, 9)}" + "=" * 4,
    ]
    contexts = ['key = "', "key: ", "bearer ", "export KEY=", "credentials ", "auth=", '{"id": "', "use "]
    x, y = [], []
    for i in range(n):
        secret = i % 2 == 0
        body = (secrets if secret else harmless)[int(r.integers(len(secrets if secret else harmless)))]()
        lead = str(r.choice(contexts)) if r.random() < (0.6 if secret else 0.25) else words(3, " ") + " "
        text = words(2, " ") + " " + lead + body + str(r.choice(['"', " ", "\n", ", "])) + words(2, " ")
        start = text.index(body)
        x.append(encode(text, start, start + len(body)))
        y.append(float(secret))
    return np.array(x), np.array(y)


def long_findings(n: int = 1200, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Labelled windows of the generator's long runs: paths and joined names, every second with a secret
    in it. The windows that hold most of the secret are secrets, those with nothing of it are harmless."""
    r = np.random.default_rng(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    every = lower + lower.upper() + digits
    pick = lambda letters, k: "".join(r.choice(list(letters), k))
    words = lambda k, sep: sep.join(pick("aeiourstnlmd", int(r.integers(3, 9))) for _ in range(k))
    parts = [
        lambda: words(1, ""), lambda: words(2, "-"), lambda: words(2, "_"), lambda: words(2, "."), lambda: pick(digits, int(r.integers(1, 6))),
        lambda: f"v{r.integers(1, 20)}.{r.integers(0, 20)}", lambda: f"20{r.integers(10, 30)}-{r.integers(10, 13)}-{r.integers(10, 29)}", lambda: pick(lower.upper(), 1) + pick(digits, 8),
    ]
    secrets = [lambda: pick(every, int(r.integers(24, 44))), lambda: pick("0123456789abcdef", int(r.integers(20, 24))), lambda: str(r.choice(["ghp_", "sk_live_", "glpat-"])) + pick(every, int(r.integers(20, 36)))]
    join = lambda k, sep: sep.join(parts[int(r.integers(len(parts)))]() for _ in range(k))
    x, y = [], []
    for i in range(n):
        sep = str(r.choice(["/", "/", "/", ".", "_", "-", "="]))
        front, back, body = join(int(r.integers(3, 12)), sep) + sep, "", ""
        if i % 2 == 0:
            body = secrets[int(r.integers(len(secrets)))]()
        if i % 2 or r.random() < 0.5:
            back = sep + join(int(r.integers(1, 8)), sep)
        text = words(2, " ") + " " + front + body + back + " " + words(2, " ")
        start = text.index(front)
        at = start + len(front)
        spans = windows(start, start + len(front + body + back))
        held = [min(e, at + len(body)) - max(s, at) if body else 0 for s, e in spans]
        for (s, e), h in zip(spans, held, strict=True):
            if h <= 0 or h == max(held):
                x.append(encode(text, s, e))
                y.append(float(h > 0))
    return np.array(x), np.array(y)


def short_findings(n: int = 3000, seed: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Labelled findings of 8 to 15 characters: mixed strings that the context names, a third of all; the
    same strings in plain text, numbers, codes, joined and oddly written words, which are harmless."""
    r = np.random.default_rng(seed)
    lower, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    pick = lambda letters, k: "".join(r.choice(list(letters), k))
    words = lambda k, sep: sep.join(pick("aeiourstnlmd", int(r.integers(3, 6))) for _ in range(k))

    def mixed() -> str:
        while True:
            s = pick(lower + lower.upper() + digits, int(r.integers(8, 16)))
            if _DIGIT.search(s) and re.search("[a-z]", s) and re.search("[A-Z]", s):
                return s

    harmless = [
        lambda: words(2, "-")[:15], lambda: words(2, ".")[:15], lambda: pick(digits, int(r.integers(8, 16))), lambda: ".".join(str(r.integers(1, 255)) for _ in range(4)).ljust(8, "0")[:15],
        lambda: f"20{r.integers(10, 30)}-{r.integers(10, 13)}-{r.integers(10, 29)}", lambda: f"{pick(digits, 3)}-{pick(digits, 4)}", lambda: pick(lower.upper(), 2) + pick(digits, 6),
        lambda: words(1, "").capitalize() + words(1, "").capitalize() + pick(lower, 2), lambda: pick(lower.upper(), 2) + words(2, "")[:9], lambda: f"{words(2, '')[:10]}.{pick(digits, 2)}",
        lambda: f"v{r.integers(1, 20)}.{r.integers(10, 20)}.{r.integers(100, 999)}", lambda: f"{words(1, '')}_{words(1, '')}_{r.integers(0, 99)}"[:15].ljust(8, "a"), mixed,
    ]
    names = ["pwd is ", "pwd=", "passphrase ", "pass ", "key ", "api key ", "access key: ", "credentials ", "login admin ", "bearer ", "auth ", "private key "]
    x, y = [], []
    for i in range(n):
        secret = i % 3 == 0
        body = mixed() if secret else harmless[int(r.integers(len(harmless)))]()
        lead = str(r.choice(names)) if secret else words(2, " ") + " "
        text = words(2, " ") + " " + lead + body + str(r.choice([" ", "\n", ", ", ". "])) + words(2, " ")
        start = text.rindex(body, 0, len(text))
        x.append(encode(text, start, start + len(body)))
        y.append(float(secret))
    return np.array(x), np.array(y)


def trained(own: np.ndarray, harmless: np.ndarray | None = None) -> Network:
    """A network trained on the generator's findings, the codes of base findings and those of candidates
    that are harmless by rule."""
    harmless = np.zeros((0, WIDTH), np.uint8) if harmless is None else harmless
    sets = [findings(), long_findings(), short_findings(), (own, np.ones(len(own))), (harmless, np.zeros(len(harmless)))]
    kinds = np.repeat([0, 1, 2, -1, -2], [len(y) for _, y in sets])
    return Network().fit(*(np.concatenate(both) for both in zip(*sets, strict=True)), kinds=kinds)


_FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("label", pa.int32()), ("codes", pa.binary())]))


def _propose(docs: DataFrame) -> DataFrame:
    """Base spans, and candidates (kind 3) in what they leave over, each with its characters and what is
    known of it: 1 a secret, 0 harmless by rule, -1 nothing."""
    schema = schema_of(("doc_id", pa.int64()), ("found", _FOUND))

    def of_base(text: str, kind: int, s: int, e: int) -> dict:
        at, known = s, 1
        if kind == 0:  # the value alone, if it has what secrets have
            value = _ASSIGN.match(text, s, e)[2]
            at, known = e - len(value), 1 if len(value) >= LEAST and _DIGIT.search(value) and _LETTER.search(value) else -1
        return {"kind": kind, "start": s, "end": e, "label": known, "codes": encode_all(text, at, e)}

    def one(text: str) -> list[dict]:
        base = [(k, s, e) for k, spans in enumerate(base_spans(text)) for s, e in spans]
        more = candidates(text, [(a, b) for _, a, b in base])
        return [of_base(text, *x) for x in base] + [{"kind": 3, "start": s, "end": e, "label": 0 if _HARMLESS.match(text[s:e]) else -1, "codes": encode_all(text, s, e)} for s, e in more]

    def run(batches):
        for part in slices(batches):
            yield pa.record_batch([part.column(0), pa.array([one(t) for t in part.column(1).to_pylist()], _FOUND)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, found array<struct<kind:int,start:long,end:long,label:int,codes:binary>>")


def _spell(spans: list[tuple[int, int, str]]) -> str:
    order = {k: i for i, k in enumerate((*KINDS, "model"))}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], order[x[2]])))


def _labelled(found: DataFrame, label: int) -> np.ndarray:
    """The first windows of at most SAMPLE findings with a label, those least by hash."""
    each = found.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*").filter(F.col("label") == label)
    rows = each.select(F.substring("codes", 1, WIDTH).alias("codes"), F.xxhash64("doc_id", "start", "kind").alias("o")).orderBy("o", "codes").limit(SAMPLE).collect()
    return np.array([np.frombuffer(r["codes"], np.uint8) for r in rows], np.uint8).reshape(-1, WIDTH)


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex and base_sha256 of the base spans, and spans, all spans as
    kind:start:end. Spans that the network adds are of kind model; n_added counts them."""
    found = materialize(_propose(documents(df, id_col, text_col)), "candidates")
    network = trained(_labelled(found, 1), _labelled(found, 0))
    schema = schema_of(("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()))

    def run(batches):
        for part in slices(batches):
            lists = part.column(1).to_pylist()
            open_ = [r for rows in lists for r in rows if r["kind"] == 3]
            said = iter(network.accepts([r["codes"] for r in open_], [r["end"] - r["start"] for r in open_]))
            out = []
            for rows in lists:
                base = [(r["start"], r["end"], KINDS[r["kind"]]) for r in rows if r["kind"] < 3]
                added = [(r["start"], r["end"], "model") for r in rows if r["kind"] == 3 and next(said)]
                out.append((*(sum(k == name for _, _, k in base) for name in KINDS), hashlib.sha256(_spell(base).encode()).hexdigest(), _spell(base + added), len(added)))
            columns = list(zip(*out, strict=True))
            yield pa.record_batch([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return found.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")
