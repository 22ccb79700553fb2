"""Near-duplicate groups by MinHash bands, odd sketches and exact checks on full shingle sets.

Every text has ``SAMPLES`` MinHash values over its distinct five-word shingles.  They are
used twice: ``BANDS`` bands of them propose candidates, and all of them are folded into a
parity bitmap of ``SKETCH_BITS`` bits.  The number of ones in the XOR of two bitmaps
estimates the similarity well where it is high, so a proposed pair is dropped on its
bitmaps alone unless its estimate comes within five standard deviations of the bound.  What
is left is decided on the full sets.

Texts of equal sets are one class and stand for each other.  First every class is checked
against the best connected class it meets in any band and passes the bitmaps with; those links
give groups.  Then only bands that hold classes of different groups are looked at again, with
sketches of ``FINE_SAMPLES`` values in ``FINE_BITS`` bits for the classes that are left, and their
pairs across groups are checked.  So a group of many thousand near copies costs
about one check a class, and no pair of classes that meet in a band goes unchecked unless
they are in one group already.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.membership import bitmap_of, cannot_be_in, may_be_in
from ..session import materialize
from . import common
from .components import components
from .linking import group_links

WORDS, PERCENT = 5, 75
# a pair at 0.75 misses all bands with (1 - 0.75**4) ** 40 < 3e-7
BANDS, ROWS = 40, 4
SAMPLES = BANDS * ROWS
SKETCH_BITS, SKETCH_LONGS = 512, 8
FINE_SAMPLES, FINE_BITS = 2048, 4096
DEVIATIONS = 5
PERMUTE_CELLS = 1 << 18


def most_differing_bits(percent: int = PERCENT, samples: int = SAMPLES, bits: int = SKETCH_BITS) -> int:
    """Ones in the XOR of two sketches that a pair at the bound practically never exceeds.

    About (1 - J) * samples values differ, give or take a binomial deviation, and each of them
    flips a bit in either sketch; bits hit an even number of times are not seen, which
    adds the deviation of odd boxes among balls thrown.
    """
    j = percent / 100
    flips = 2 * (1 - j) * samples
    expected = bits / 2 * (1 - math.exp(-2 * flips / bits))
    by_samples = 2 * (samples * j * (1 - j)) ** 0.5 * math.exp(-2 * flips / bits)
    by_boxes = (bits / 4 * (1 - (1 + 4 * flips / bits) * math.exp(-4 * flips / bits))) ** 0.5
    return math.ceil(expected + DEVIATIONS * math.hypot(by_samples, by_boxes) + 1)


def _permutations(samples: int):
    rng = np.random.Generator(np.random.PCG64(samples))
    return (rng.integers(0, 2**31, samples) * 2 + 1).astype(np.uint32), rng.integers(0, 2**32, samples).astype(np.uint32)


def distinct_shingles(hasher: common.WordHasher, texts: list[bytes], width: int = WORDS):
    """(sorted distinct shingle hashes text by text, number per text)."""
    words, count, *_ = hasher.words(texts)
    value, owner = common.shingle_hashes(words, count, width)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.bincount(owner[fresh], minlength=len(texts))


def _signatures(value: np.ndarray, size: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """The minima of all permutations for each text; every text must have shingles."""
    a, b = _permutations(samples)
    x = (value >> np.uint64(32)).astype(np.uint32) ^ value.astype(np.uint32)
    ends = np.cumsum(size)
    out = np.empty((len(size), samples), dtype=np.uint32)
    at = 0
    while at < len(size):  # texts in blocks that stay in the cache; a long one is a block of its own
        first = ends[at] - size[at]
        to = max(at + 1, int(np.searchsorted(ends, first + PERMUTE_CELLS, side="right")))
        part = x[first : ends[to - 1]]
        starts = (ends[at:to] - size[at:to] - first).astype(np.int64)
        for k in range(samples):
            out[at:to, k] = np.minimum.reduceat(part * a[k] + b[k], starts)
        at = to
    return out


def fold(minima: np.ndarray, bits: int) -> np.ndarray:
    """Odd sketches: the parity of how many (permutation, minimum) pairs fall on each bit."""
    rows, samples = minima.shape
    out = np.zeros((rows, bits // 64), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(samples):
            bit = common.mix(minima[:, k].astype(np.uint64) * np.uint64(2 * samples + 1) + np.uint64(k)) % np.uint64(bits)
            out[np.arange(rows), (bit >> np.uint64(6)).astype(np.int64)] ^= np.uint64(1) << (bit & np.uint64(63))
    return out


def fine_sketches(ids: DataFrame, docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(rep) -> (rep, fine): large odd sketches of the texts of these ids."""

    def batches(stream):
        hasher = common.WordHasher()
        for batch in stream:
            at = 0
            for texts in common.byte_blocks(bytes(t.as_buffer()) for t in batch.column("text")):
                value, size = distinct_shingles(hasher, texts, width)
                full = np.flatnonzero(size)
                sketch = fold(_signatures(value, size[full], FINE_SAMPLES), FINE_BITS)
                offsets = pa.array(np.arange(len(full) + 1, dtype=np.int32) * (FINE_BITS // 64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)).take(pa.array(full)), pa.ListArray.from_arrays(offsets, pa.array(sketch.reshape(-1).view(np.int64)))],
                    names=["rep", "fine"],
                )
                at += len(texts)

    texts = _texts(ids.withColumnRenamed("rep", "doc_id"), docs)
    schema = T.StructType([T.StructField("rep", docs.schema["doc_id"].dataType), T.StructField("fine", T.ArrayType(T.LongType()))])
    return texts.mapInArrow(batches, schema)


def _alike_fine(percent: int) -> Column:
    ones = F.aggregate(F.zip_with("x.fine", "y.fine", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)
    return ones <= most_differing_bits(percent, FINE_SAMPLES, FINE_BITS)


def _texts(named: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text as bytes) of the ids of ``named``, one row each."""
    wanted = may_be_in(docs, F.xxhash64("doc_id"), bitmap_of(named, F.xxhash64("doc_id")))
    texts = wanted.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).dropDuplicates(["doc_id"])
    return texts.join(named, "doc_id", "left_semi")


def sign(docs: DataFrame, width: int = WORDS) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_shingles, set_a, set_b, bands, s0..s7).

    ``set_a`` and ``set_b`` are order-free sums over the set and tell sets apart; ``bands`` are
    the band keys, empty for an empty set, and s0.. the words of the odd sketch.
    """
    names = [f"s{i}" for i in range(SKETCH_LONGS)]
    schema = T.StructType([
        docs.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("n_shingles", "set_a", "set_b")],
        T.StructField("bands", T.ArrayType(T.LongType())), *[T.StructField(n, T.LongType()) for n in names],
    ])

    def batches(stream):
        hasher = common.WordHasher()
        for batch in stream:
            at = 0
            for texts in common.byte_blocks(bytes(t.as_buffer()) if t.is_valid else b"" for t in batch.column("text")):
                yield _sign_block(hasher, batch.column("doc_id").slice(at, len(texts)), texts)
                at += len(texts)

    def _sign_block(hasher, ids, texts):
        value, size = distinct_shingles(hasher, texts, width)
        full = np.flatnonzero(size)
        sums = np.zeros((2, len(texts)), dtype=np.uint64)
        bands = np.zeros((len(full), BANDS), dtype=np.uint64)
        sketch = np.zeros((len(texts), SKETCH_LONGS), dtype=np.uint64)
        if len(full):
            starts = (np.cumsum(size) - size)[full]
            with np.errstate(over="ignore"):
                sums[0, full] = np.add.reduceat(common.mix(value), starts)
                sums[1, full] = np.add.reduceat(common.mix(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
                minima = _signatures(value, size[full]).astype(np.uint64)
                for k in range(ROWS):
                    bands = common.mix(bands * np.uint64(31) + minima[:, k::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64))
            sketch[full] = fold(minima, SKETCH_BITS)
        offsets = np.zeros(len(texts) + 1, dtype=np.int32)
        offsets[1:] = np.cumsum(np.where(size > 0, BANDS, 0))
        return pa.RecordBatch.from_arrays(
            [ids, pa.array(size.astype(np.int64)), pa.array(sums[0].view(np.int64)), pa.array(sums[1].view(np.int64)),
             pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.reshape(-1).view(np.int64))),
             *[pa.array(np.ascontiguousarray(sketch[:, i]).view(np.int64)) for i in range(SKETCH_LONGS)]],
            names=["doc_id", "n_shingles", "set_a", "set_b", "bands", *names],
        )

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(batches, schema)


_SKETCH = [f"s{i}" for i in range(SKETCH_LONGS)]


def _alike(percent: int) -> Column:
    """Whether sizes and sketches of the sides ``x`` and ``y`` allow the similarity."""
    bits = sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in _SKETCH), F.lit(0))
    n, m = F.col("x.n_shingles"), F.col("y.n_shingles")
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (bits <= most_differing_bits(percent))


def confirm(pairs: DataFrame, docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of ids whose full shingle sets are as similar as ``percent``."""
    named = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    texts = materialize(_texts(named, docs), "near-texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb"))

    def batches(stream):
        hasher = common.WordHasher()
        for batch in stream:
            keep, at = [], 0
            both = (bytes(x.as_buffer()) for ab in zip(batch.column("ta"), batch.column("tb")) for x in ab)
            left_over: list[bytes] = []
            for block in common.byte_blocks(both):
                block = left_over + block
                left_over = block[len(block) // 2 * 2 :]
                block = block[: len(block) // 2 * 2]
                value, size = distinct_shingles(hasher, block, width)
                ends = np.cumsum(size)
                for i in range(0, len(block), 2):
                    x, y = (value[ends[j] - size[j] : ends[j]] for j in (i, i + 1))
                    common_size = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common_size >= percent * (len(x) + len(y) - common_size) and len(x) > 0)
                at += len(block)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return materialize(joined.mapInArrow(batches, joined.select("a", "b").schema), "near-links")


def near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, n_shingles, component_id, kept), one row for every row.

    ``component_id`` is the smallest id reachable over links, ``kept`` tells whether it is the
    row's own.  NULL and empty texts have no shingles and no link.  A row without an id takes
    no part: it keeps a NULL component and is kept.  Repeated rows share their id's result.
    An id with different texts is in the groups of all of them.
    """
    common.small_batches(docs.sparkSession)
    signed = materialize(sign(docs, width), "near-signed")
    own = ["n_shingles", "set_a", "set_b"]
    classes = materialize(
        signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
        .groupBy(*own).agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("bands", *_SKETCH)]),
        "near-classes",
    )
    links = group_links(classes, ["n_shingles", *_SKETCH], _alike(percent), lambda pairs: confirm(pairs, docs, width, percent),
                        lambda ids: fine_sketches(ids, docs, width), _alike_fine(percent))
    # ids with several texts tie their classes together
    several = signed.where("n_shingles > 0").join(classes.select(*own, "rep"), own).select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    ties = several.join(classes.select(F.col("rep").alias("b")).distinct(), "b", "left_semi")
    groups = components(links.unionByName(ties.select("a", "b")), "near")
    known = classes.select(*own, F.col("rep").alias("node")).join(groups, "node", "left").select(*own, F.coalesce("component", "node").alias("_group"))
    placed = signed.select("doc_id", *own).join(known, own, "left")
    least = F.least("_group", "doc_id")
    return placed.select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce(least, "doc_id")).alias("component_id"),
        (F.col("doc_id").isNull() | (F.coalesce(least, "doc_id") == F.col("doc_id"))).alias("kept"),
    )


def drop_near_duplicates(docs: DataFrame, width: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group, the one of the smallest id; all columns stay.

    Of rows that share an id one stays.  Rows without an id stay.  Rows whose id the bitmap of
    dropped and repeated ids rules out pass without a shuffle.
    """
    found = materialize(near_duplicates(docs, width, percent).where("doc_id is not null"), "near-groups")
    dropped = found.where("not kept").select("doc_id").distinct()
    repeated = found.groupBy("doc_id").count().where("count > 1").select("doc_id")
    named = bitmap_of(dropped.unionByName(repeated), F.xxhash64("doc_id"))
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    rest = may_be_in(docs, key, named).join(dropped, "doc_id", "left_anti").dropDuplicates(["doc_id"])
    return cannot_be_in(docs, key, named).unionByName(rest.select(*docs.columns))
