"""Quality by importance resampling.

Two generative models over hashed n-grams are counted: that of raw text over all documents, that of
target text over documents labelled good (at most SAMPLE of them, those least by hash). A document's
log weight is the sum, over its n-grams, of the log ratio of the two models. Documents are drawn in
proportion to their weights, without replacement, by Gumbel top-k: a Gumbel number is added to each
log weight, and the k greatest stay. k is what independent draws would keep: the sum over documents
of the chance that a Gumbel number lifts them over a floor, which lies so that of documents as likely in
target as in raw text one in a million goes.

The ratios are of models that take n-grams for independent, so their scale is off. It is fitted on labels
held out of the target, good and bad: log weights are divided by the temperature under which the chance
of staying tells the two apart best.

N-grams: words without case and the punctuation around them, each by two hashes of which the less
telling ratio counts, so that a harmless word which shares one bucket with a bad one isn't held against
a text; pairs of words; unusual punctuation; a word repeated at once. Each n-gram counts once per
document, so that one which repeats itself doesn't outweigh many. Ratios are smoothed, and shrunk by
their significance: a bucket whose counts chance explains says nothing.

Cases: null and empty texts have weight 0 and stay; without labels all stay; rows repeating an id and
text share one fate; ties stay together; long texts are read whole; an empty table gives an empty
result. The operator that filters keeps all columns.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import U, claim, materialize, mix64, slices

#: Target documents and held-out labels at most; buckets of words (twice) and of pairs.
SAMPLE, HELD, WORDS, PAIRS = 20_000, 5_000, 1 << 17, 1 << 15
#: The share of documents of weight one that may go, and so the floor to be lifted over.
LOST = 1e-6
FLOOR = -float(np.log(-np.log(LOST)))
#: Log ratios are moved this far towards 0, as small ones add up over a long text.
SMALL = 0.5
#: The likelihood-ratio statistic that chance alone is taken to reach; one in about 2,000 buckets does.
CHANCE = 12.0
MEMO = 300_000
_AROUND = string.punctuation + "«»„“”‘’…–—¿¡"
_USUAL = frozenset(["", ".", ",", "?", "!", ":", ";", '"', "'", "-", ")", "("])
BUCKETS = 2 * WORDS + 2 * PAIRS


class _Chunks(dict):
    """Of a chunk of text: 32 bits of its word's hash, and above them those of unusual punctuation."""

    def __missing__(self, chunk: str) -> int:
        word = chunk.strip(_AROUND)
        at = chunk.find(word) if word else len(chunk)
        marks = [m for m in (chunk[:at], chunk[at + len(word) :]) if m not in _USUAL]
        value = xxhash.xxh32_intdigest(word.lower()) if word else 0
        for m in marks[-1:]:
            value |= (xxhash.xxh32_intdigest(m) | 1) << 32
        self[chunk] = value
        return value


_chunks = _Chunks()


def _buckets(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: the two buckets of each word or mark, and the two of each pair."""
    claim("quality", _chunks.clear)
    if len(_chunks) > MEMO:
        _chunks.clear()
    parts = text.split()
    both = np.fromiter(map(_chunks.__getitem__, parts), U, len(parts))
    word, mark = both & U(0xFFFFFFFF), both >> U(32)
    mark = mark[mark > 0]
    one = mix64(np.concatenate([word[word > 0], mark + U(1 << 40)]))
    left, right = word[:-1], word[1:]
    pair = mix64(np.where(left == right, U(1), left * U(0x9E3779B97F4A7C15) + right))
    return (one & U(WORDS - 1)).astype(np.int64), (one >> U(40) & U(WORDS - 1)).astype(np.int64) + WORDS, (pair & U(PAIRS - 1)).astype(np.int64) + 2 * WORDS, (pair >> U(40) & U(PAIRS - 1)).astype(np.int64) + 2 * WORDS + PAIRS


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Smoothed log ratios of bucket frequencies, shrunk to 0 where they aren't significant or small."""
    out = np.zeros(BUCKETS)
    for begin, end in ((0, WORDS), (WORDS, 2 * WORDS), (2 * WORDS, 2 * WORDS + PAIRS), (2 * WORDS + PAIRS, BUCKETS)):
        r, t = raw[begin:end].astype(float), target[begin:end].astype(float)
        if not t.sum():
            continue
        e = r * (t.sum() / r.sum())
        g = 2 * (np.where(t > 0, t * np.log(np.maximum(t, 1) / np.maximum(e, 1e-9)), 0) - (t - e))
        shrink = np.maximum(0, 1 - CHANCE / np.maximum(g, 1e-9))
        ratio = np.log((t + 1) / (e + 1)) * shrink
        out[begin:end] = np.sign(ratio) * np.maximum(np.abs(ratio) - SMALL, 0)
    return out


def log_weight(text: str, ratios: np.ndarray) -> float:
    a, b, c, d = _buckets(text)
    total = 0.0
    for i, j in ((a, b), (c, d)):
        i, first = np.unique(i, return_index=True)
        x, y = ratios[i], ratios[j[first]]
        total += float(np.where(np.sign(x) == np.sign(y), np.where(np.abs(x) < np.abs(y), x, y), 0).sum())
    return total


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, dict[int, bool]]:
    """The log ratio of each bucket, and the labels held out (a fifth, by hash), good or not. Raw counts are
    over all rows of df."""
    said = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("i"), F.expr("quality = 1 and coalesce(toxic, 0) = 0").alias("good"))
    said = said.groupBy("i").agg(F.min("good").alias("good")).withColumn("h", F.xxhash64("i"))
    least = lambda df, n: df.orderBy("h", "i").limit(n).collect()
    wanted = frozenset(r["i"] for r in least(said.filter("good and pmod(h, 5) != 0"), SAMPLE))
    held = {r["i"]: r["good"] for r in least(said.filter("pmod(h, 5) = 0"), HELD)}

    def run(batches):
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for part in slices(batches):
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                at = np.unique(np.concatenate(_buckets(text or "")))
                raw[at] += 1
                if doc in wanted:
                    target[at] += 1
        at = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["b", "r", "t"])

    rows = df.select(df[id_col].cast("long"), df[text_col].cast("string")).mapInArrow(run, "b long, r long, t long").groupBy("b").agg(F.sum("r").alias("r"), F.sum("t").alias("t"))
    counts = rows.toPandas()  # one row per bucket, of a fixed number
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    raw[counts["b"]], target[counts["b"]] = counts["r"], counts["t"]
    return log_ratios(raw, target), held


def temperature(weights: np.ndarray, good: np.ndarray) -> float:
    """The temperature under which good documents stay and others go with the greatest likelihood, held back
    towards 1, the ratio as it is: a factor of two away costs as much as every hundredth document being
    one natural unit less likely."""
    scales = np.exp(np.linspace(np.log(0.1), np.log(20), 200))
    said = np.zeros(len(scales))
    for i, a in enumerate(scales):
        rate = np.exp(np.minimum(a * weights - FLOOR, 50))  # stays with chance 1 - exp(-rate)
        said[i] = np.where(good, np.log(np.maximum(-np.expm1(-rate), 1e-12)), -rate.clip(max=25)).sum() - np.log2(a) ** 2 * len(weights) / 100
    return float(1 / scales[int(said.argmax())]) if len(weights) else 1.0


def _scored(df: DataFrame, ratios: np.ndarray, held: dict[int, bool], id_col: str, text_col: str, keep: list[str], name: str, seed: int) -> DataFrame:
    """The columns keep of df, with the log weight, a Gumbel number and the held-out label."""
    fields = {f.name: f.dataType for f in df.schema}
    text = "_text"
    while text in keep:
        text += "_"
    doc = df[id_col].cast("long").alias(text + "i")
    source = df.select(*(df[c] for c in keep), F.coalesce(df[text_col].cast("string"), F.lit("")).alias(text), F.xxhash64(F.lit(seed), df[id_col], df[text_col]).alias(text + "h"), doc)

    def run(batches):
        n = len(keep)
        for part in slices(batches):
            weights = np.array([log_weight(t, ratios) for t in part.column(n).to_pylist()])
            u = (mix64(part.column(n + 1).to_numpy().view(U)) >> U(11)).astype(float) + 0.5
            good = [held.get(i) for i in part.column(n + 2).to_pylist()]
            columns = [part.column(i) for i in range(n)] + [pa.array(weights), pa.array(-np.log(-np.log(u / 2**53))), pa.array(good, pa.bool_())]
            yield pa.record_batch(columns, names=[*keep, name + "w", name + "g", name + "y"])

    ddl = ", ".join(f"`{c}` {fields[c].simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{ddl}, {name}w double, {name}g double, {name}y boolean")


def kth_greatest(keys: DataFrame, column: str, k: int, most: int = 4096) -> float:
    """The exact k-th greatest value, by counting in ever narrower ranges; at most `most` values, or
    counts, come to the driver at once."""
    low, high = keys.agg(F.min(column), F.max(column)).first()
    while True:
        inside = keys.filter(F.col(column).between(low, high))
        width = (high - low) / most
        if width <= 0 or low + width == low:
            return low
        bins = {r["b"]: r["n"] for r in inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(most - 1)).alias("b")).agg(F.count("*").alias("n")).collect()}
        if sum(bins.values()) <= most:
            return sorted((r[0] for r in inside.select(column).collect()), reverse=True)[k - 1]
        for b in sorted(bins, reverse=True):
            if k <= bins[b]:
                break
            k -= bins[b]
        edge = inside.filter(F.least(F.floor((F.col(column) - low) / width), F.lit(most - 1)) == b).agg(F.min(column), F.max(column)).first()
        low, high = edge
        if low == high:
            return low


def resample(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, seed: int = 3) -> DataFrame:
    """The rows that stay, with the columns keep (all of df's unless given), log_weight and key; these
    two have _ in front while such columns exist."""
    keep = list(df.columns) if keep is None else keep
    ratios, held = fit(df, labels, id_col, text_col)
    name = "_"
    while any(c.startswith(name) for c in keep):
        name += "_"
    scored = materialize(_scored(df, ratios, held, id_col, text_col, keep, name, seed), "scored")
    w, gumbel, label, key = (name + c for c in "wgyk")
    # one row per label held out, and of rows that repeat an id no more than a label's share
    told = scored.filter(F.col(label).isNotNull()).select(w, label).limit(4 * HELD).toPandas()
    heat = temperature(told[w].to_numpy(float), told[label].to_numpy(bool))
    calm = F.col(w) / heat
    scored = scored.withColumn(key, calm + F.col(gumbel))
    chance = 1 - F.exp(-F.exp(F.least(calm - F.lit(FLOOR), F.lit(700.0))))
    n, expected = scored.agg(F.count("*"), F.sum(chance)).first()
    k = min(n, round(expected or 0))
    if n == 0:
        stays = scored
    elif k == 0:
        stays = scored.filter(F.lit(False))
    else:
        stays = scored.filter(F.col(key) >= kth_greatest(scored.select(key), key, k))
    free = lambda c: c if c not in keep else free("_" + c)
    return stays.drop(gumbel, label).withColumnsRenamed({w: free("log_weight"), key: free("key")})
