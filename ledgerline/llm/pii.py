"""Personal data by weak supervision.

Plain patterns find the base spans, which always stay. Looser patterns propose further candidates
(written-out addresses, other separators, numbers without a plus sign). Five labelers - pattern,
shape, gazetteer, context words, surroundings - each vote yes, no or nothing on every candidate; what
says nothing by its absence votes nothing.
Expectation-maximisation over the counts of all vote patterns in the corpus estimates how reliable
each labeler is for each kind, which gives every pattern a probability. A logistic model over hashed
features of the span and its surroundings is trained on those probabilities, on at most SAMPLE
candidates (those least by hash), and decides which of the looser candidates become spans.

Cases: null and empty texts have no spans; an empty table, or one without candidates, gives base
results only; positions are code points; long texts are taken whole, in time linear in their length;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import documents, materialize, schema_of, slices

KINDS = ("email", "ip", "card", "phone")
#: Candidates the span classifier is trained on at most, and the probability from which it adds one.
SAMPLE, ACCEPT = 20_000, 0.9
#: How often a labeler is taken to be right beforehand.
BELIEF = 0.85
FEATURES = 512

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

_LOOSE = [
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z0-9-]++)+"), re.compile(r"\(at\)|\[at\]| at [A-Za-z0-9-]+ ?(?:dot|\(dot|\[dot) ")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])|(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])"), re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]|\[\.\]")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[. _/][0-9]{4}){3}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])"), _DIGIT),
    ("phone", re.compile(r"(?<![0-9+(])(?:00[1-9][0-9]{0,2}[ .-])?\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])"), _DIGIT),
]
_SPELT = re.compile(r"\(at\)|\[at\]|dot[ )\]]")
# Gazetteers.
RESERVED = tuple("0. 127. 255. 10. 192.168. 0[ 127[ 255[ 10[".split())
ENDINGS = frozenset("com org net edu gov int info biz io dev app de fr es it uk us eu ch at be nl pl se no fi dk pt ru cn jp in br ca au".split())
ISSUERS = tuple("4 51 52 53 54 55 34 37 6011 65 35 36 38 30".split())
PERSONAL = frozenset("mail email e-mail contact kontakt phone tel telephone telefon mobile fax card visa mastercard amex karte carte tarjeta payment credit ip address adresse host login".split())
TECHNICAL = frozenset("version v isbn issn page pages id number no chapter order invoice build release line figure table".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans by kind, in the order of KINDS."""
    email, ip, card, phone = [], [], [], []
    at, after = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > after and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            email.append((begin, m.end()))
            after = m.end()
            at = text.find("@", after)
        else:
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        ip = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:4] or 0) <= 255 for p in m[0].split("."))]
        card = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            phone = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return [email, ip, card, phone]


def _clear(spans: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of spans in order, those that overlap none of those taken, in one sweep."""
    out, at, reach, taken = [], 0, 0, sorted(taken)
    for s, e in spans:
        while at < len(taken) and taken[at][0] < e:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= s:
            out.append((s, e))
    return out


def candidates(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) of base and loose spans; loose ones overlap nothing."""
    out = [(k, s, e, True) for k, spans in enumerate(base_spans(text)) for s, e in spans]
    for kind, pattern, hint in _LOOSE:
        if hint.search(text):
            found = _clear([m.span() for m in pattern.finditer(text)], [(s, e) for _, s, e, _ in out])
            out += [(KINDS.index(kind), s, e, False) for s, e in found]
    return out


def votes(text: str, kind: int, start: int, end: int, base: bool) -> tuple[int, ...]:
    """2 yes, 1 no, 0 nothing, of: pattern, shape, gazetteer, context, surroundings."""
    span, digits = text[start:end], _digits(text[start:end])
    name = KINDS[kind]
    yes = lambda x: 2 if x else 1
    if name == "email":
        shape = 1 if len(span) > 254 else 2 if _SPELT.search(span) or "@" in span else 0
        gazetteer = yes(re.split(r"[^A-Za-z]+", span.lower().rstrip(")]"))[-1] in ENDINGS)
    elif name == "ip":
        groups = re.split(r"[.\[\]:]+", span)
        shape = yes(len(groups) == 8 or len(groups) == 4 and all(g.isdigit() and int(g[:4]) <= 255 for g in groups))
        gazetteer = 1 if span.startswith(RESERVED) else 0
    elif name == "card":
        shape = yes(13 <= len(digits) <= 19 and luhn(digits))
        gazetteer = yes(digits.startswith(ISSUERS))
    else:
        shape = yes(9 <= len(digits) <= 15)
        gazetteer = 2 if span.startswith(("+", "00", "(")) else 0
    near = set(re.findall(r"[^\W\d_][\w-]*", text[max(0, start - 40) : start].lower()))
    context = 2 if near & PERSONAL else 1 if near & TECHNICAL else 0
    beside = text[max(0, start - 1) : start] + text[end : end + 1]
    around = 1 if any(c.isdigit() or c in "_/=#" for c in beside) else 0
    return (2 if base else 0, shape, gazetteer, context, around)


def features(text: str, kind: int, start: int, end: int) -> list[int]:
    """Hashed features of a span and its surroundings."""
    span = text[start:end]
    shape = re.sub(r"[0-9]+", "9", re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", span)))
    names = [f"k{kind}", f"s{kind}{shape}", f"n{kind}{len(_digits(span))}", f"l{kind}{min(len(span) // 4, 12)}", f"c{kind}{luhn(_digits(span) or '1')}"]
    names += [f"g{shape[i : i + 3]}" for i in range(len(shape) - 2)]
    names += [f"w{w}" for w in re.findall(r"\w+", text[max(0, start - 30) : start].lower())[-3:]]
    return sorted({zlib.crc32(n.encode()) % FEATURES for n in names})


def reliabilities(counts: dict[tuple[int, tuple[int, ...]], int], rounds: int = 50) -> dict[tuple[int, tuple[int, ...]], float]:
    """Expectation-maximisation: the probability that a candidate of a kind with these votes is personal
    data. Votes of nothing carry no evidence."""
    out = {}
    for kind in {k for k, _ in counts}:
        rows = [(v, n) for (k, v), n in counts.items() if k == kind]
        seen, weight = np.array([v for v, _ in rows]), np.array([n for _, n in rows], float)
        said, yes = seen > 0, seen == 2
        p = (yes.sum(1) + 0.5) / (said.sum(1) + 1)
        for _ in range(rounds):
            prior = min(max((weight * p).sum() / weight.sum(), 0.02), 0.98)
            good = np.log(prior) * np.ones(len(p))
            bad = np.log(1 - prior) * np.ones(len(p))
            for j in range(seen.shape[1]):
                m = said[:, j]
                # what a labeler is taken for beforehand counts as much as a fifth of what it has voted on
                held = 5 + weight[m].sum() / 5
                hit = np.clip(((weight * p)[m & yes[:, j]].sum() + BELIEF * held) / ((weight * p)[m].sum() + held), 0.5, 0.999)
                miss = np.clip(((weight * (1 - p))[m & ~yes[:, j]].sum() + BELIEF * held) / ((weight * (1 - p))[m].sum() + held), 0.5, 0.999)
                good += np.where(m, np.log(np.where(yes[:, j], hit, 1 - hit)), 0)
                bad += np.where(m, np.log(np.where(yes[:, j], 1 - miss, miss)), 0)
            p = 1 / (1 + np.exp(np.clip(bad - good, -50, 50)))
        out |= {(kind, tuple(v)): float(x) for (v, _), x in zip(rows, p, strict=True)}
    return out


def train(rows: list[list[int]], targets: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Weights of a logistic model on hashed features, the intercept last."""
    x = np.zeros((len(rows), FEATURES + 1), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    x[:, -1] = 1
    w, m, v = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), np.zeros(FEATURES + 1)
    for t in range(1, rounds + 1):
        g = x.T @ (1 / (1 + np.exp(-(x @ w))) - targets) / len(rows) + 1e-4 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


_FOUND = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))
_FOUND_DDL = "array<struct<kind:int,start:long,end:long,base:boolean,votes:string,features:array<int>>>"


def _propose(docs: DataFrame) -> DataFrame:
    schema = schema_of(("doc_id", pa.int64()), ("found", _FOUND))

    def one(text: str) -> list[dict]:
        return [{"kind": k, "start": s, "end": e, "base": b, "votes": "".join(map(str, votes(text, k, s, e, b))), "features": features(text, k, s, e)} for k, s, e, b in candidates(text)]

    def run(batches):
        for part in slices(batches):
            yield pa.record_batch([part.column(0), pa.array([one(t) for t in part.column(1).to_pylist()], _FOUND)], schema=schema)

    return docs.mapInArrow(run, f"doc_id long, found {_FOUND_DDL}")


def _spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def personal_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone and base_sha256 of the base spans, and spans, all spans as
    kind:start:end. The counts are of base spans; n_added counts the others."""
    found = materialize(_propose(documents(df, id_col, text_col)), "candidates")
    each = found.select("doc_id", F.explode("found").alias("c")).select("doc_id", "c.*")
    counts = {(r["kind"], tuple(map(int, r["votes"]))): r["n"] for r in each.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect()}  # at most 4 * 3^5 rows
    weights = None
    if counts:
        sure = reliabilities(counts)
        picked = each.select("kind", "votes", "features", F.xxhash64("doc_id", "start").alias("o")).orderBy("o", "kind", "votes").limit(SAMPLE).collect()
        weights = train([r["features"] for r in picked], np.array([sure[r["kind"], tuple(map(int, r["votes"]))] for r in picked]))
    schema = schema_of(("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()))

    def one(rows: list[dict]) -> tuple:
        base = [(r["kind"], r["start"], r["end"]) for r in rows if r["base"]]
        added = [(r["kind"], r["start"], r["end"]) for r in rows if not r["base"] and 1 / (1 + np.exp(-(weights[r["features"]].sum() + weights[-1]))) >= ACCEPT]
        return *(sum(k == i for k, _, _ in base) for i in range(4)), hashlib.sha256(_spell(base).encode()).hexdigest(), _spell(base + added), len(added)

    def run(batches):
        for part in slices(batches):
            columns = list(zip(*(one(r) for r in part.column(1).to_pylist()), strict=True))
            yield pa.record_batch([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")
