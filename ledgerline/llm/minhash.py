"""Near-duplicate documents: MinHash bands propose, odd sketches sift, full sets confirm.

A document's set is that of its distinct w-word shingles, as 64-bit hashes. Equal sets form one class,
and only classes are compared. K MinHash samples of a class are used twice. Bands of r samples each
put it into buckets. All K are folded into an odd sketch, a bitmap in which each sample flips one
bit; the population count of two sketches' XOR gives the size of the samples' symmetric difference,
hence the similarity, which at high similarities is sharper than comparing as many bits of the
samples themselves. Pairs whose estimate is far below the threshold are dropped, the others confirmed
on the full sets.

No bucket is expanded into all its pairs. First each member is paired with two hubs of its bucket
(members least by key and by a hash of bucket and key, found by pre-aggregated minima); confirmed pairs
are links, and links make components. Then buckets that still hold more than one component are finished:
the members outside the bucket's main component are set against all members, block by block, and pairs
of different components that pass finer odd sketches, made of more samples for these members alone, are
confirmed too. A bucket with very many members outside is first parted by bands of more of the finer
samples, which members of similar texts still share. Pairs within a component need no look. So every
link between candidates of any band is found or implied, for buckets of any size, and no block outgrows
a task.

With similarity s a band matches with probability s^r; at 0.85, r = 4 and 24 bands a link has no
bucket in common with probability 2e-8, at 0.8 and 32 bands 5e-8. The further bands of crowded buckets
miss one with 1e-7 at most (at 0.8 in the second level: 6e-6). The sketch cut lies five standard
deviations below the threshold.

Cases: null and empty texts, and texts without words, have n_shingles 0, are linked with nothing and
are kept; with fewer words than w the whole sequence is the one shingle; rows repeating a document id
are one document for linking; a null id has a null component unless linked, and is kept; texts of any
length are taken whole; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import U, claim, documents, materialize, mix64, release, schema_of, slices
from ledgerline.llm.graph import components

#: Word hashes a worker keeps; emptied beyond it.
MEMO = 400_000
#: Samples, and bits of an odd sketch; and of the finer one for crowded buckets.
SAMPLES, BITS = 128, 512
FINE_SAMPLES, FINE_BITS = 2048, 8192
ROWS = 4
#: Members of a bucket in one block; members outside the main component beyond which a bucket is parted,
#: as all its blocks together would be larger; by bands of how many of the finer samples, level after
#: level; and the share of links that the bands of a level may miss.
BLOCK, CROWDED = 256, 16_384
LEVELS, MISSED = (8, 12), 1e-7
#: Standard deviations below the threshold at which sketches drop a pair.
SPREAD = 5


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_words = _Hashes()


def shingles(text: str, w: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the w-word shingles of a text, A-Z lower-cased, words parted
    by ASCII white space."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, U)
    claim("minhash", _words.clear)
    if len(_words) > MEMO:
        _words.clear()
    if len(words) < w:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], U)
    h = np.fromiter(map(_words.__getitem__, words), U, len(words))
    n = len(h) - w + 1
    out = np.zeros(n, U)
    for j in range(w):
        out += mix64(h[j : j + n] + U((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * U(2 * j + 3)
    return np.unique(mix64(out))


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = mix64(np.arange(1, 2 * n + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    return (base[:n] >> U(32)).astype(np.uint32), (base[n:] >> U(32)).astype(np.uint32) | np.uint32(1)


def samples(sets: list[np.ndarray], n: int = SAMPLES) -> np.ndarray:
    """n MinHash samples of non-empty sets, one row each."""
    flip, times = _seeds(n)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    flat = (np.concatenate(sets) >> U(32)).astype(np.uint32)
    work, out = np.empty_like(flat), np.empty((len(sets), n), np.uint32)
    for k in range(n):
        np.bitwise_xor(flat, flip[k], out=work)
        np.multiply(work, times[k], out=work)
        out[:, k] = np.minimum.reduceat(work, starts)
    return out


def odd_sketches(mins: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmaps of rows of samples, as signed 64-bit words."""
    n = len(mins)
    bit = mix64(mins.astype(U) + (np.arange(mins.shape[1], dtype=U) << U(32))) % U(bits)
    at = np.arange(n)[:, None] * bits + bit.astype(np.int64)
    odd = (np.bincount(at.ravel(), minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(n, bits), axis=1).view(np.int64)


def band_keys(mins: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    m = mins[:, : bands * rows].astype(U).reshape(len(mins), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U), m.shape[:2]).copy()
    for j in range(rows):
        key = mix64(key * U(0x9E3779B97F4A7C15) + m[:, :, j])
    return key.view(np.int64)


def further_bands(similarity: float, rows: int) -> int:
    """As many bands of so many finer samples as miss no more than MISSED of the links, if there are."""
    return min(math.ceil(math.log(MISSED) / math.log1p(-(similarity**rows))), FINE_SAMPLES // rows)


def most_bits(similarity: float, samples_: int = SAMPLES, bits: int = BITS) -> int:
    """The XOR population count to expect SPREAD standard deviations below a similarity. The deviation
    is that of the samples and, much smaller, that of flips which meet in one bit."""
    apart = 2 * samples_ * (1 - similarity)
    apart += SPREAD * math.sqrt(4 * samples_ * similarity * (1 - similarity) + apart**2 / bits)
    return math.ceil(bits / 2 * (1 - math.exp(-2 * apart / bits)))


_SIGS = schema_of(("doc_id", pa.int64()), ("salt", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())))


def signatures(docs: DataFrame, w: int, bands: int) -> DataFrame:
    def run(batches):
        for part in slices(batches):
            sets = [shingles(t, w) for t in part.column(2).to_pylist()]
            full = [s for s in sets if len(s)]
            mins = samples(full) if full else np.zeros((0, SAMPLES), np.uint32)
            keyed, sketched = iter(band_keys(mins, bands)), iter(odd_sketches(mins)) if full else iter(())
            rows = [(len(s), xxhash.xxh3_128_digest(s.tobytes()), next(keyed), next(sketched)) if len(s) else (0, None, None, None) for s in sets]
            columns = list(zip(*rows, strict=True))
            yield pa.record_batch([part.column(0), part.column(1), *(pa.array(c, f.type) for c, f in zip(columns, list(_SIGS)[2:], strict=True))], schema=_SIGS)

    return docs.select("doc_id", "salt", "text").mapInArrow(run, "doc_id long, salt long, n_shingles long, key binary, bands array<long>, sketch array<long>")


_LINKS = schema_of(("a", pa.binary()), ("b", pa.binary()))


def _confirm(pairs: DataFrame, texts: DataFrame, w: int, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those with den * intersection >= num * union, on full sets."""
    left = texts.select(F.col("key").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("key").alias("b"), F.col("text").alias("tb"))

    def run(batches):
        recent: OrderedDict[bytes, np.ndarray] = OrderedDict()
        held = 0

        def of(key: bytes, text: str) -> np.ndarray:
            nonlocal held
            if key in recent:
                recent.move_to_end(key)
                return recent[key]
            recent[key] = found = shingles(text, w)
            held += len(found)
            while held > 2_000_000 and len(recent) > 1:
                held -= len(recent.popitem(last=False)[1])
            return found

        for part in slices(batches):
            a, b, ta, tb = (part.column(n).to_pylist() for n in ("a", "b", "ta", "tb"))
            keep = []
            for i in range(part.num_rows):
                x, y = of(a[i], ta[i]), of(b[i], tb[i])
                lo, hi = sorted((len(x), len(y)))
                if den * lo < num * hi:
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                if den * both >= num * (lo + hi - both):
                    keep.append(i)
            yield pa.record_batch([pa.array([a[i] for i in keep], pa.binary()), pa.array([b[i] for i in keep], pa.binary())], schema=_LINKS)

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and text of the classes wanted (key, doc_id, salt)."""
    side = wanted.select("key", F.col("doc_id").alias("of"), F.col("salt").alias("as"))
    found = docs.join(side, docs["doc_id"].eqNullSafe(side["of"]) & (docs["salt"] == side["as"]))
    return found.groupBy("key").agg(F.min("text").alias("text"))


def _sampled(texts: DataFrame, w: int, make, name: str, kind: str) -> DataFrame:
    """key and what make() gives for the finer samples of each text."""

    def run(batches):
        for part in slices(batches, rows=128):
            mins = samples([shingles(t, w) for t in part.column(1).to_pylist()], FINE_SAMPLES)
            yield pa.record_batch([part.column(0), make(mins)], names=["key", name])

    return texts.select("key", "text").mapInArrow(run, f"key binary, {name} {kind}")


def _later(shared: DataFrame, labels: DataFrame, classes: DataFrame, texts: DataFrame, w: int, similarity: float) -> DataFrame:
    """Candidate pairs (a, b) of different components, from buckets that hold several; a written table.
    Buckets with more than CROWDED members outside their main component are parted by further bands, level
    after level; what is crowded still after the last is set against one another in blocks all the same.
    Pairs that several buckets hold come from one of them."""
    named = lambda df: df.join(labels.withColumnRenamed("label", "l"), "key", "left").withColumn("label", F.coalesce("l", "key")).drop("l")
    found, held, bands = [], [], classes.select("key", "bands")
    member = named(shared)
    for rows in (*LEVELS, None):
        sizes = member.groupBy("band", "label").agg(F.count("*").alias("n"))
        buckets = sizes.groupBy("band").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("size"), F.count("*").alias("labels"), (F.sum("n") - F.max("n")).alias("others")).filter("labels > 1").drop("labels")
        mixed = materialize(member.join(buckets, "band"), "mixed")
        fine = _sampled(texts.join(mixed.select("key").distinct(), "key"), w, lambda m: pa.array([s.tobytes() for s in odd_sketches(m, FINE_BITS)], pa.binary()), "fine", "binary")
        about = materialize(bands.join(fine, "key"), "fine")
        small = mixed.filter(F.col("others") <= CROWDED) if rows else mixed
        found.append(materialize(_compared(small, about, similarity), "near"))
        release(about, *held)
        crowded = mixed.filter(F.col("others") > CROWDED).select("key").distinct()
        if rows is None or crowded.isEmpty():
            release(mixed)
            break
        count = further_bands(similarity, rows)
        further = _sampled(texts.join(crowded, "key"), w, lambda m, rows=rows, count=count: pa.array(list(band_keys(m, count, rows)), pa.list_(pa.int64())), "bands", "array<bigint>")
        # labels are joined before the members of buckets are dealt out
        parted = materialize(named(further), "bands")
        bands, member = parted.select("key", "bands"), parted.select("key", "label", F.explode("bands").alias("band"))
        release(mixed)
        held = [parted]
    out = materialize(reduce(DataFrame.union, found).distinct(), "later")
    release(*found)
    return out


def _compared(mixed: DataFrame, about: DataFrame, similarity: float) -> DataFrame:
    """Members outside a bucket's main component against all its members, block by block. The finer
    sketches decide, so that few pairs below the threshold are left to confirm."""
    most = most_bits(similarity, FINE_SAMPLES, FINE_BITS)
    full = mixed.join(about, "key")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("key"), blocks)
    rest = ["key", "label", (F.col("label") == F.col("main")).alias("main"), "bands", "fine"]
    right = full.select("band", own.cast("long").alias("block"), F.lit(False).alias("outside"), *rest)
    left = full.filter(F.col("label") != F.col("main")).select("band", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))).alias("block"), F.lit(True).alias("outside"), *rest)
    parts = int(mixed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = right.unionByName(left).repartition(parts, "band", "block").sortWithinPartitions("band", "block", "outside")

    def compare(block: pa.Table) -> tuple[list[bytes], list[bytes]]:
        out: tuple[list[bytes], list[bytes]] = ([], [])
        outside = block.column("outside").to_numpy()
        n = int(np.count_nonzero(~outside))
        if n == 0 or n == len(outside):
            return out
        keys, names = block.column("key").to_pylist(), block.column("label").to_pylist()
        number = {label: i for i, label in enumerate(dict.fromkeys(names))}
        labels = np.array([number[x] for x in names])
        main = block.column("main").to_numpy()[:n]
        sketches = np.frombuffer(b"".join(block.column("fine").to_pylist()), U).reshape(len(keys), -1)
        bands = block.column("bands").combine_chunks().flatten().to_numpy().reshape(len(keys), -1)
        mine = int(np.flatnonzero(bands[0] == block.column("band")[0].as_py())[0])
        for r in range(n, len(keys)):
            # a pair is looked at in the first band it shares
            open_ = np.flatnonzero((labels[:n] != labels[r]) & ~(bands[:n, :mine] == bands[r, :mine]).any(axis=1))
            near = open_[np.bitwise_count(sketches[open_] ^ sketches[r]).sum(axis=1) <= most]
            for i in near.tolist():
                if main[i] or keys[r] < keys[i]:
                    a, b = sorted((keys[r], keys[i]))
                    out[0].append(a)
                    out[1].append(b)
        return out

    def run(batches):
        held: list[pa.RecordBatch] = []

        def done():
            a, b = compare(pa.Table.from_batches(held))
            return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=_LINKS)

        for batch in batches:
            band, block = batch.column("band").to_numpy(), batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero((np.diff(band) != 0) | (np.diff(block) != 0)) + 1).tolist(), batch.num_rows]
            for i, j in zip(edges, edges[1:], strict=False):
                if held and (held[0].column("band")[0].as_py(), held[0].column("block")[0].as_py()) != (band[i], block[i]):
                    yield done()
                    held = []
                held.append(batch.slice(i, j - i))
        if held:
            yield done()

    return dealt.mapInArrow(run, "a binary, b binary")


def near_duplicates(df: DataFrame, w: int = 5, num: int = 80, den: int = 100, bands: int = 32, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links, its own included) and
    kept (whether that is its own), one row per row of df. Links: den * intersection >= num * union."""
    docs = documents(df, id_col, text_col).withColumn("salt", F.xxhash64("text"))
    sigs = materialize(signatures(docs, w, bands), "signatures")
    # a class is represented by the text of its least row
    least = F.min_by("salt", F.struct(F.col("doc_id").isNull(), "doc_id", "salt"))
    classes = materialize(sigs.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), least.alias("salt"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "classes")
    most = most_bits(num / den)

    members = classes.select("key", F.explode("bands").alias("band"))
    crowded = members.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band")
    shared = materialize(members.join(crowded, "band"), "shared")
    # the buckets of one large group each have a hub of their own, and all a common one
    hubs = shared.groupBy("band").agg(F.min("key").alias("common"), F.min_by("key", F.xxhash64("band", "key")).alias("own"))
    star = shared.join(hubs, "band").select("key", F.explode(F.array_distinct(F.array("common", "own"))).alias("hub"))
    star = star.filter("key != hub").select(F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")).distinct()
    sketch = classes.select("key", "sketch")
    word = lambda i: F.bit_count(F.get("sa", F.lit(i)).bitwiseXOR(F.get("sb", F.lit(i))))
    far = sum((word(i) for i in range(1, BITS // 64)), word(0))
    sifted = star.join(sketch.toDF("a", "sa"), "a").join(sketch.toDF("b", "sb"), "b").filter(far <= most).select("a", "b")
    sifted = materialize(sifted, "pairs")
    wanted = shared.select("key").distinct().join(classes.select("key", "doc_id", "salt"), "key")
    texts = materialize(_texts(docs, wanted), "texts")
    links = materialize(_confirm(sifted, texts, w, num, den), "links")
    release(sifted)
    labels = components(links)
    release(links)
    later = _later(shared, labels, classes, texts, w, num / den)
    release(shared)
    rest = materialize(_confirm(later, texts, w, num, den), "links")
    release(later, texts)
    of = classes.select("key", "doc_id").join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    wider = None
    if not rest.isEmpty():
        # these links join components, so only the components' labels go through the rounds again
        ends = rest.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
        ends = ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).filter("a != b").distinct()
        wider = components(ends)
        of = of.join(wider.toDF("label", "wider"), "label", "left").select("key", "doc_id", F.coalesce("wider", "label").alias("label"))
    of = materialize(of, "components")
    release(rest, labels, classes, *([wider] if wider else []))

    least = of.groupBy("label").agg(F.min("doc_id").alias("component"))
    found = of.join(least, "label").select("key", "component")
    out = sigs.select("doc_id", "n_shingles", "key").join(found, "key", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"))
    out = materialize(out, "near")
    release(sigs, of)
    return out


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of df whose document is the smallest of its group, with all columns."""
    kept = near_duplicates(df, id_col=id_col, text_col=text_col, **how).filter("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return df.join(kept, df[id_col].eqNullSafe(kept["_kept"]), "left_semi")
