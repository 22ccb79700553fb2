"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed byte n-grams that occur in it, A-Z lower-cased.  Each
feature that is present has the value of its log-count ratio between toxic and other
training texts; logistic regression with an L2 penalty weighs them.  The model is fitted on a
sample of labelled rows of at most ``FIT_ROWS`` rows a class, chosen by a hash of their id; it is
a table of ``BUCKETS`` buckets and ``FEATURES`` weights, whatever the size of the corpus.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize
from .common import _fixed_words, add_to_batch, byte_blocks, mix, small_batches, with_columns

SIZES = (3, 5)
BUCKETS = 1 << 18
FEATURES = 1024
FIT_ROWS = 8_000  # of either class
SMOOTHING, PENALTY, STEPS = 1.0, 1.0, 120
EVIDENCE = 4.0  # standard errors between the classes' shares that a feature must show
BLOCK_BYTES = 1 << 20


def grams(texts: list[bytes]):
    """(bucket, text number) of every n-gram of every text, repeats included."""
    values = _fixed_words(77, 256)
    for upper in range(65, 91):
        values[upper] = values[upper + 32]
    # a space on either side lets a gram see where the text begins and ends
    joined = np.frombuffer(b"".join(b" " + t + b" " for t in texts), dtype=np.uint8)
    length = np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), length)
    code = values[joined]
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15 | 1)
        for size in SIZES:
            n = len(joined) - size + 1
            if n <= 0:
                continue
            value = np.zeros(n, dtype=np.uint64)
            for k in range(size):
                value = value * base + code[k : k + n]
            inside = owner[:n] == owner[size - 1 :]
            bucket = (mix(value + np.uint64(size)) >> np.uint64(64 - 18)).astype(np.int32)
            buckets.append(bucket[inside])
            owners.append(owner[:n][inside])
    if not buckets:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    return np.concatenate(buckets), np.concatenate(owners)


def _present(texts: list[bytes], lookup: np.ndarray):
    """(text number, feature) once for every feature of ``lookup`` that a text has."""
    bucket, owner = grams(texts)
    feature = lookup[bucket]
    known = feature >= 0
    pairs = np.unique(owner[known].astype(np.int64) * FEATURES + feature[known])
    return pairs // FEATURES, pairs % FEATURES


@dataclass
class Model:
    """Feature number of each bucket (-1: none), weight of each feature, and bias."""

    lookup: np.ndarray
    weight: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        owner, feature = _present(texts, self.lookup)
        total = np.bincount(owner, weights=self.weight[feature], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -500, 500)))


def training_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[DataFrame, dict[int, int]]:
    """(labelled texts of at most ``rows`` rows a class, number of labelled rows of each class).

    The ids of the sample are few enough to be broadcast by their stated bound.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    mark = F.xxhash64("doc_id")
    parts = [known.where(F.col("toxic") == c).orderBy(mark, "doc_id").limit(rows) for c in (0, 1)]
    ids = materialize(parts[0].unionByName(parts[1]), "toxicity-ids")
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(ids), "doc_id")
    return materialize(chosen, "toxicity-sample"), counts


def _sum_blocks(sample: DataFrame) -> np.ndarray:
    """For both classes, the number of sample texts that have each bucket."""
    slices = 64

    def count(stream):
        total = np.zeros((2, BUCKETS), dtype=np.int64)
        for batch in stream:
            toxic = np.asarray(batch.column("toxic"))
            at = 0
            for texts in byte_blocks((bytes(t.as_buffer()) for t in batch.column("text")), BLOCK_BYTES):
                bucket, owner = grams(texts)
                seen = np.unique(owner.astype(np.int64) * BUCKETS + bucket)
                side = toxic[at : at + len(texts)][seen // BUCKETS]
                for c in (0, 1):
                    total[c] += np.bincount(seen[side == c] % BUCKETS, minlength=BUCKETS)
                at += len(texts)
        parts = np.split(total.reshape(-1), slices)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int32()), pa.array([p.astype("<i8").tobytes() for p in parts], pa.binary())], names=["slice", "counts"])

    def add(key, group):
        total = sum(np.frombuffer(x.as_buffer(), "<i8") for x in group.column("counts"))
        return pa.table({"slice": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    parts = sample.mapInArrow(count, "slice int, counts binary").groupBy("slice").applyInArrow(add, "slice int, counts binary")
    found = {r["slice"]: np.frombuffer(r["counts"], "<i8") for r in parts.collect()}  # BUCKETS numbers a class
    if not found:
        return np.zeros((2, BUCKETS), dtype=np.int64)
    return np.concatenate([found[i] for i in range(slices)]).reshape(2, BUCKETS)


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """The classifier; without labels of both classes every score is the share of toxic labels, or 0."""
    small_batches(docs.sparkSession)
    sample, counts = training_sample(docs, labels, rows)
    lookup = np.full(BUCKETS, -1, dtype=np.int32)
    if not counts.get(0) or not counts.get(1):
        share = 1.0 if counts.get(1) else 0.0
        return Model(lookup, np.zeros(1), 500.0 if share else -500.0)
    have = _sum_blocks(sample)
    size = [max(1, r) for r in (sample.where(F.col("toxic") == c).count() for c in (0, 1))]
    p, q = (have[1] + SMOOTHING) / (size[1] + 2 * SMOOTHING), (have[0] + SMOOTHING) / (size[0] + 2 * SMOOTHING)
    ratio = np.log(p) - np.log(q)
    evidence = np.abs(p - q) / np.sqrt(p * (1 - p) / size[1] + q * (1 - q) / size[0])
    chosen = np.argsort(-evidence, kind="stable")[:FEATURES]
    chosen = chosen[evidence[chosen] >= EVIDENCE]
    lookup[chosen] = np.arange(len(chosen))
    scale = ratio[chosen]

    def features(stream):
        for batch in stream:
            texts = [bytes(t.as_buffer()) for t in batch.column("text")]
            out, at = [], 0
            for block in byte_blocks(iter(texts), BLOCK_BYTES):
                owner, feature = _present(block, lookup)
                out += [f.astype("<i4").tobytes() for f in np.split(feature, np.searchsorted(owner, np.arange(1, len(block))))]
                at += len(block)
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(out, pa.binary())], names=["toxic", "features"])

    # at most 2 * FIT_ROWS rows of at most FEATURES numbers
    found = sample.mapInArrow(features, "toxic int, features binary").collect()
    lists = [np.frombuffer(r["features"], "<i4") for r in found]
    label = np.array([r["toxic"] for r in found], dtype=float)
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    feature = np.concatenate(lists) if lists else np.zeros(0, np.int32)
    weight, bias = _logistic(owner, feature, scale[feature], label, len(scale))
    # the sample has other shares of the classes than all labelled rows
    bias += np.log(counts[1] / counts[0]) - np.log(max(label.sum(), 1) / max(len(label) - label.sum(), 1))
    return Model(lookup, weight * scale, float(bias))


def _logistic(owner, feature, value, label, width):
    """Weights and bias by gradient steps of adaptive length."""
    rows = len(label)
    w, b = np.zeros(width), 0.0
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, STEPS + 1):
        score = np.bincount(owner, weights=value * w[feature], minlength=rows) + b
        error = 1 / (1 + np.exp(-np.clip(score, -500, 500))) - label
        slope = np.append(np.bincount(feature, weights=value * error[owner], minlength=width) + PENALTY * w, error.sum()) / rows
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope * slope
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: the probability that ``text`` is toxic.

    NULL and empty texts get the model's score of no features; equal texts get equal scores.
    """
    small_batches(docs.sparkSession)
    lookup, weight, bias = model.lookup, model.weight, model.bias

    def batches(stream):
        judge = Model(lookup, weight, bias)
        for batch in stream:
            found = []
            for texts in byte_blocks((bytes(t.as_buffer()) if t.is_valid else b"" for t in batch.column(text).cast(pa.binary())), BLOCK_BYTES):
                found.append(judge.scores(texts))
            yield add_to_batch(batch, **{out: pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())})

    return docs.mapInArrow(batches, with_columns(docs, **{out: T.DoubleType()}))
