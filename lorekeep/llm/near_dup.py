"""Near-duplicates by MinHash bands, odd sketches and an exact check.

A document's shingles are hashed to 64 bits and sampled by MinHash: least values of several hash functions, in
bands, give candidates. The least values of one hash function (a bottom-k MinHash sample) are folded into a
parity bitmap (an odd sketch: each sample flips one bit), and the population count of two bitmaps' XOR
estimates a high similarity closely: it never exceeds the samples in which two documents differ, so that with
all shingles in the sample no link can fail the test, and beyond that a margin is added. What passes is
compared on full sets. Documents with one set are one node, and links are joined to components.

Every bucket is first a star around its least node: pairs grow with its members. After these links are
joined, only members of different components of a bucket still need a comparison; they are held against each
other in blocks, on bitmaps, and only pairs that pass are written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.shared import apart, components, drop, materialize, maybe_in, ship

#: Bands and samples a band: a pair at a similarity of 0.8 is missed with a probability of 5e-8.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Samples of a sketch, its bits, and the standard deviations by which a sample or a sketch may mislead.
KEPT, BITS, SIGMAS = 1024, 1024, 6
#: Members of a bucket that are compared at once.
BLOCK = 64
#: Shingles that are sampled at once, and words remembered.
STEP, REMEMBERED = 1024, 500_000

_random = np.random.Generator(np.random.PCG64(20))
_odd = lambda n: _random.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE, SCALE, SHIFT, BAND = _odd(64), _odd(SAMPLES), _odd(SAMPLES), _odd(SAMPLES).reshape(BANDS, ROWS)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_words = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; a shorter text is one run, an empty one none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    width = min(width, len(words))
    runs = len(words) - width + 1
    total = hashes[:runs] * PLACE[0]
    for j in range(1, width):
        total = total + hashes[j : j + runs] * PLACE[j]
    return np.unique(_mix(total + np.uint64(width)))


def samples(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), STEP):
        part = shingles[k : k + STEP, None] * SCALE
        part += SHIFT
        np.minimum(least, part.min(axis=0), out=least)
    return least


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The odd sketch of the KEPT least hashes: each flips the bit that its low bits name."""
    bits = (shingles[:KEPT] % np.uint64(BITS)).astype(np.int64)
    return np.packbits((np.bincount(bits, minlength=BITS) & 1).astype(np.uint8)).view(np.int64)


def buckets(least: np.ndarray) -> np.ndarray:
    return _mix((least.reshape(BANDS, ROWS) * BAND).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def estimated(bits, maths):  # noqa: ANN001, ANN201
    """How many samples two sketches differ in, by the bits in which they do: -BITS/2 ln(1 - 2 bits / BITS); for columns or arrays, by maths."""
    return maths.log(maths.greatest(1 - bits * (2 / BITS), maths.lit(1 / BITS))) * (-BITS / 2)


def passes(bits, n_a, n_b, percent: int, maths):  # noqa: ANN001, ANN201
    """Whether sketches of sets of n_a and n_b shingles that differ in so many bits may be of linked sets.

    Of the shared shingles, at least percent / (100 + percent) of both sizes, those below the larger set's last sample
    are in both samples. Which they are is chance only where the larger set has more than KEPT.
    """
    large = maths.greatest(n_a, n_b)
    kept = maths.least(large, maths.lit(KEPT))
    share = maths.least((n_a + n_b) * (percent / (100 + percent)) / large, maths.lit(1.0))
    most = maths.least(n_a, maths.lit(KEPT)) + maths.least(n_b, maths.lit(KEPT)) - kept * share * 2
    sampled = maths.least(maths.greatest(large - KEPT, maths.lit(0)), maths.lit(1))
    drawn = sampled * (kept * share * (1 - share) + 1) * 4  # variance: a shared sample more or less counts twice
    kept_odd = maths.exp(most * (-2 / BITS))
    folded = (1 - kept_odd * kept_odd) * (BITS / 4) / (kept_odd * kept_odd)  # variance of the estimate by collisions
    sure = bits <= most + maths.sqrt(drawn) * SIGMAS + 1e-6
    return sure & (estimated(bits, maths) <= most + maths.sqrt(drawn + folded) * SIGMAS + 1)


class Arrays:
    """The functions that passes() needs, for arrays."""

    least, greatest, sqrt, log, exp = np.minimum, np.maximum, np.sqrt, np.log, np.exp

    @staticmethod
    def lit(x: float) -> float:
        return x


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_a, set_b, sketch, buckets): a 128-bit digest of the set, its sketch and bucket keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digest, drawn, keys, ends = [], [], [], [], [0]
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), width)
                n.append(len(found))
                digest.append(xxhash.xxh3_128_digest(found.tobytes()))
                if len(found):
                    least = samples(found)
                    drawn.append(sketch(found))
                    keys.append(buckets(least))
                ends.append(len(keys))
            pair = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            lists = lambda parts, each: pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32) * each), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), lists(drawn, BITS // 64), lists(keys, BANDS)],
                ["doc_id", "n_shingles", "set_a", "set_b", "sketch", "buckets"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(sign, "doc_id long, n_shingles long, set_a long, set_b long, sketch array<long>, buckets array<long>")


def alike(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) whose sizes and sketches allow the similarity."""
    side = lambda x: nodes.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    bits = F.expr("aggregate(zip_with(s_a, s_b, (x, y) -> bit_count(x ^ y)), 0, (t, x) -> t + x)")
    fits = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(fits & passes(bits, F.col("n_a"), F.col("n_b"), percent, F)).select("a", "b").distinct()


def confirmed(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those pairs (a, b) whose full sets are similar."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    nodes = materialize(nodes, "involved")
    texts = docs.select(F.col("doc_id").cast("long"), "text").where(maybe_in("doc_id", nodes))
    texts = materialize(texts.join(nodes, "doc_id", "left_semi"), "texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            keep = []
            for a, b, left, right in zip(*(batch.column(c) for c in ("a", "b", "text_a", "text_b")), strict=True):
                if (left := left.as_py()) != last:
                    last, held = left, shingle_set(left, width)
                other = shingle_set(right.as_py(), width)
                both = len(np.intersect1d(held, other, assume_unique=True))
                if both and 100 * both >= percent * (len(held) + len(other) - both):
                    keep.append((a.as_py(), b.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in keep], pa.int64()) for k in (0, 1)], ["a", "b"])

    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}"))
    found = materialize(pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long").distinct(), "links")
    drop(texts)
    return found


def crossing(members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one bucket and different components that sizes and sketches allow.

    members: (key, doc_id, n_shingles, sketch) of buckets with several nodes; labels: (node, root). Comparisons grow
    with the square of those members of a bucket that are in one size class and in different components.
    """
    # Linked sets differ in size by 100 / percent at most: they lie in one size class or in two next to each other.
    steps = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(-math.log(percent / 100) + 1e-9)).cast("int")
    classed = members.withColumn("class", F.explode(F.array(steps, steps + 1))).withColumn("key", F.xxhash64("key", "class")).drop("class")
    rooted = classed.join(labels, F.col("doc_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "doc_id")).drop("node")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("key", F.expr(f"int(ceil(n / {BLOCK}))").alias("blocks"))
    held = rooted.join(apart(mixed), "key").withColumn("block", F.expr("int(pmod(xxhash64(doc_id), blocks))"))
    # A block holds about BLOCK members: their number decides how many blocks a bucket has. Dealt out by block,
    # or a bucket's rows would stay together where they were joined.
    held = held.repartition("key", "block").groupBy("key", "blocks", "block").agg(F.collect_list(F.struct("doc_id", "root", "n_shingles", "sketch")).alias("m"))
    ends = held.withColumn("o", F.explode(F.expr("sequence(0, blocks - 1)"))).select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "m", "block")
    first = ends.where("block = i").select("key", "i", "j", F.col("m").alias("x"))
    second = ends.where("block = j").select("key", "i", "j", F.col("m").alias("y"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(cell: pa.StructArray) -> tuple[np.ndarray, ...]:
            column = lambda name: cell.field(name).to_numpy(zero_copy_only=False)
            return column("doc_id"), column("root"), column("n_shingles"), cell.field("sketch").flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)

        for batch in batches:
            out = [np.empty((0, 2), np.int64)]
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                (a, ra, na, sa), (b, rb, nb, sb) = parts(x.values), parts(y.values)
                differ = np.bitwise_count(sa[:, None, :] ^ sb[None, :, :]).sum(axis=2, dtype=np.int32)
                na, nb = na[:, None].astype(np.float64), nb[None, :].astype(np.float64)
                fits = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
                i, j = np.nonzero((ra[:, None] != rb[None, :]) & fits & passes(differ.astype(np.float64), na, nb, percent, Arrays))
                out.append(np.stack([np.minimum(a[i], b[j]), np.maximum(a[i], b[j])], axis=1))
            every = np.unique(np.concatenate(out), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(every[:, k].copy()) for k in (0, 1)], ["a", "b"])

    pairs = first.join(second, ["key", "i", "j"]).select("x", "y").mapInArrow(compare, "a long, b long")
    return pairs.where("a < b").distinct()


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are runs without white space, lower-cased for A-Z; sets are of `width` words; documents whose sets
    share at least `percent` of their union are linked. component_id: the least doc_id that links reach.

    Nulls and empty texts have an empty set and link with nothing. Rows that share a doc_id count as one
    document, each with its own n_shingles. Rows with a null doc_id take the id of an equal set, if any, and
    are kept only where there is none. Copies are one node, never pairs. Empty table: empty result; other
    columns of docs are not read.
    """
    ship(docs.sparkSession)
    signed = materialize(signatures(docs, width), "signatures")
    sets = signed.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("leader"))
    led = apart(sets.where("leader IS NOT NULL"))
    nodes = signed.join(led.withColumnsRenamed({"set_a": "a_", "set_b": "b_"}), (F.col("doc_id") == F.col("leader")) & (F.col("set_a") == F.col("a_")) & (F.col("set_b") == F.col("b_"))).select("doc_id", "n_shingles", "sketch", "buckets")
    nodes = materialize(nodes.distinct(), "nodes")
    keyed = nodes.select("doc_id", F.explode("buckets").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "pivot")
    shared = apart(shared)
    members = materialize(keyed.join(shared, "key"), "members")
    stars = members.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = confirmed(materialize(alike(stars, nodes, percent), "pairs"), docs, width, percent)
    labels = components(links)
    more = crossing(members.select("key", "doc_id").join(nodes.select("doc_id", "n_shingles", "sketch"), "doc_id"), labels, percent)
    bridges = confirmed(materialize(more, "pairs"), docs, width, percent)
    joined = components(labels.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(bridges))
    drop(members)
    drop(nodes)
    out = signed.select("doc_id", "n_shingles", "set_a", "set_b").join(led, ["set_a", "set_b"], "left").join(joined, F.col("leader") == F.col("node"), "left")
    out = out.withColumn("component_id", F.coalesce("root", "leader", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
