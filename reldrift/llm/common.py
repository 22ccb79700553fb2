"""Helpers the operators share: tables, Arrow batches, ragged arrays and word hashes."""

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_BLOCK_BYTES = 1 << 20  # texts are hashed together up to about this many bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Python workers get texts in smaller batches than Spark's default, unless the cluster sets a number."""
    if spark.sparkContext.getConf().get(BATCH_ROWS) is None:
        spark.conf.set(BATCH_ROWS, rows)


def fold(remainders: int, column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``remainders``; a missing id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % remainders


def with_columns(df: DataFrame, **added: T.DataType) -> T.StructType:
    """The schema of ``df`` with columns added behind, or replaced if the name is taken."""
    kept = [f for f in df.schema.fields if f.name not in added]
    return T.StructType([*kept, *[T.StructField(n, t, True) for n, t in added.items()]])


def add_to_batch(batch: pa.RecordBatch, **added: pa.Array) -> pa.RecordBatch:
    """An Arrow batch with columns added behind, or replaced if the name is taken."""
    kept = [n for n in batch.schema.names if n not in added]
    names = [*kept, *added]
    return pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *added.values()], names=names)


def ragged_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of all elements of the runs [start, start + length), one run after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    shift = starts - (ends - lengths)
    return np.repeat(shift, lengths) + np.arange(total, dtype=np.int64)


def byte_blocks(texts, limit: int = WORD_BLOCK_BYTES):
    """Lists of consecutive texts as bytes, each list about ``limit`` bytes (one text at least).

    At the end the memory held beyond need is given back.
    """
    block, size = [], 0
    for text in texts:
        data = b"" if text is None else text
        if block and size + len(data) > limit:
            yield block
            block, size = [], 0
        block.append(data)
        size += len(data)
    if block:
        yield block
    give_back()


def give_back() -> None:
    """Give unused memory back to the system: a Python worker is kept for later stages, beside which its heap counts."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def _fixed_words(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 2**64 - 1, n, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


class WordHasher:
    """Words of texts as 64-bit hashes, without a Python object per word.

    A word is a run of bytes other than space and \\x09-\\x0D, with A-Z lower-cased.  Its
    hash comes from differences of prefix sums of sum(value(byte) * base**i) modulo 2**64,
    with a fixed random value for every byte, shifted to the word's start and mixed.
    """

    _BASE = 0x9E3779B97F4A7C15 | 1

    def __init__(self):
        values = _fixed_words(20240607, 256)
        for upper in range(65, 91):
            values[upper] = values[upper + 32]
        self._value = values
        space = np.zeros(256, dtype=bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        self._space = space
        self._inverse_base = np.uint64(pow(self._BASE, -1, 2**64))
        self._power = self._inverse = np.ones(1, dtype=np.uint64)

    def _powers(self, n: int) -> None:
        if len(self._power) >= n:
            return
        for name, factor in (("_power", self._BASE), ("_inverse", self._inverse_base)):
            steps = np.full(n + 1, factor, dtype=np.uint64)
            steps[0] = 1
            setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def words(self, texts: list[bytes]):
        """(hashes, words per text, first byte, end byte, joined bytes) of all words of ``texts``, in order."""
        joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        text_end = np.cumsum(lengths + 1)
        inside = ~self._space[joined]
        change = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        start, end = change[0::2], change[1::2]
        self._powers(len(joined) + 1)
        with np.errstate(over="ignore"):
            prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self._value[joined] * self._power[: len(joined)], dtype=np.uint64)])
            raw = (prefix[end] - prefix[start]) * self._inverse[start]
        count = np.diff(np.concatenate([[0], np.searchsorted(start, text_end)]))
        return mix(raw), count, start, end, joined


def shingle_hashes(words: np.ndarray, count: np.ndarray, width: int):
    """(hashes, owner) of the ``width``-word shingles of texts given as word hashes.

    A text of fewer words, but one at least, is one shingle of all its words; a text
    without words has none.
    """
    n = len(words)
    base = np.uint64(0xD6E8FEB86659FD93)
    first = np.cumsum(count) - count
    whole = np.maximum(count - width + 1, 0)
    starts = ragged_index(first, whole)
    owner = np.repeat(np.arange(len(count)), whole)
    with np.errstate(over="ignore"):
        value = np.zeros(len(starts), dtype=np.uint64)
        for k in range(width):
            value = value * base + words[np.minimum(starts + k, max(n - 1, 0))] if n else value
        value = mix(value + np.uint64(width))
        short = np.flatnonzero((count > 0) & (count < width))
        few = np.zeros(len(short), dtype=np.uint64)
        for k in range(width - 1):
            more = count[short] > k
            at = np.minimum(first[short] + k, max(n - 1, 0))
            few = np.where(more, few * base + words[at], few) if n else few
        few = mix(few + count[short].astype(np.uint64))
    return np.concatenate([value, few]), np.concatenate([owner, short])
