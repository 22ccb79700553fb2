"""MinHash fingerprints of whole texts over byte shingles, and links between like ones.

``PERMUTATIONS`` universal hash permutations run over the hashed ``WIDTH``-byte shingles of a
text in numpy; the lower sixteen bits of each minimum (the upper ones are near 0 in
long texts), in hex, are the fingerprint.  A text
shorter than a shingle is one shingle; an empty text has the fingerprint of no shingles.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.membership import bitmap_of, may_be_in
from ..session import materialize
from . import common
from .components import components
from .linking import group_links

WIDTH, PERMUTATIONS = 8, 64
BANDS, ROWS = 32, 4  # bands are drawn from the permutations with a stride, each in two bands
PERMUTE_CELLS, BLOCK_BYTES = 1 << 17, 1 << 20
PERCENT, DEVIATIONS = 75, 5
EMPTY = "0" * (4 * PERMUTATIONS)


def shingles(texts: list[bytes], width: int = WIDTH):
    """(32-bit shingle hashes text by text, number per text), repeats included."""
    code = common._fixed_words(9, 256)[np.frombuffer(b"".join(texts), dtype=np.uint8)]
    length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    start = np.cumsum(length) - length
    size = np.where(length > 0, np.maximum(length - width + 1, 1), 0)
    n = max(len(code) - width + 1, 0)
    value = np.zeros(n, dtype=np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15 | 1)
    with np.errstate(over="ignore"):
        for k in range(width):
            value = value * base + code[k : k + n]
        hashed = np.zeros(len(code) + 1, dtype=np.uint64)
        hashed[:n] = common.mix(value)
        out = hashed[common.ragged_index(start, size)]
        ends = np.cumsum(size)
        for i in np.flatnonzero((length > 0) & (length < width)):
            few = np.uint64(length[i])
            for c in code[start[i] : start[i] + length[i]]:
                few = few * base + c
            out[ends[i] - 1] = common.mix(np.array([few]))[0]
    return (out >> np.uint64(32)).astype(np.uint32), size


def minima(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The least value of every permutation for every text; the largest number where there is none."""
    rng = np.random.Generator(np.random.PCG64(17))
    a = (rng.integers(0, 2**31, PERMUTATIONS) * 2 + 1).astype(np.uint32)
    b = rng.integers(0, 2**32, PERMUTATIONS).astype(np.uint32)
    out = np.full((len(size), PERMUTATIONS), np.uint32(2**32 - 1), dtype=np.uint32)
    full = np.flatnonzero(size)
    ends = np.cumsum(size[full])
    at = 0
    scratch = np.empty(0, dtype=np.uint32)
    while at < len(full):
        first = ends[at] - size[full[at]]
        to = max(at + 1, int(np.searchsorted(ends, first + PERMUTE_CELLS, side="right")))
        part = value[first : ends[to - 1]]
        if len(scratch) < len(part):
            scratch = np.empty(len(part), dtype=np.uint32)
        held = scratch[: len(part)]
        starts = (ends[at:to] - size[full[at:to]] - first).astype(np.int64)
        for k in range(PERMUTATIONS):
            np.multiply(part, a[k], out=held)
            np.add(held, b[k], out=held)
            out[full[at:to], k] = np.minimum.reduceat(held, starts)
        at = to
    return out


def _lanes(texts: list[bytes]):
    value, size = shingles(texts)
    return (minima(value, size) & np.uint32(0xFFFF)).astype(">u2"), size > 0


def _string(lanes: np.ndarray, full: bool) -> str:
    return lanes.tobytes().hex() if full else EMPTY


def _like(x, x_full, y, y_full) -> float:
    if not (x_full and y_full):
        return 1.0 if not (x_full or y_full) else 0.0
    return float((x == y).mean())


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with ``out``; NULL counts as empty, equal texts have equal fingerprints."""

    def batches(stream):
        for batch in stream:
            found = []
            for texts in common.byte_blocks((bytes(t.as_buffer()) if t.is_valid else b"" for t in batch.column(text).cast(pa.binary())), BLOCK_BYTES):
                lanes, full = _lanes(texts)
                found += [_string(x, f) for x, f in zip(lanes, full)]
            yield common.add_to_batch(batch, **{out: pa.array(found, pa.string())})

    return docs.mapInArrow(batches, common.with_columns(docs, **{out: T.StringType()}))


def likeness(x: Column, y: Column) -> Column:
    """Share of equal permutations of two fingerprints: an estimate of the similarity of their sets."""
    equal = F.filter(F.sequence(F.lit(0), F.lit(PERMUTATIONS - 1)), lambda i: F.substring(x, i * 4 + 1, F.lit(4)) == F.substring(y, i * 4 + 1, F.lit(4)))
    return F.when((x == EMPTY) | (y == EMPTY), (x == y).cast("double")).otherwise(F.size(equal) / PERMUTATIONS)


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _judge(texts: list[str], following: list[str], known=None):
    """Result columns for texts and the texts that follow them; ``known``: lanes of both, if at hand."""
    edited = [(t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode() for t, n in zip(texts, following)]
    (own, full), (nxt, nxt_full) = known or (_lanes([t.encode() for t in texts]), _lanes([n.encode() for n in following]))
    new, new_full = _lanes(edited)
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
        pa.array([_string(x, f) for x, f in zip(own, full)], pa.string()),
        pa.array([_string(x, f) for x, f in zip(new, new_full)], pa.string()),
        pa.array([_like(*v) for v in zip(own, full, new, new_full)], pa.float64()),
        pa.array([_like(*v) for v in zip(own, full, nxt, nxt_full)], pa.float64()),
    ]


_NAMES = [c.split()[0] for c in _RESULT.split(", ")]


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> fingerprints of every text and of its edited text, and their likeness.

    The edited text is the first half of the text (the longer one) and the first half as
    many code points of the next document by descending id; after the last one comes the
    first.  NULL texts count as empty; rows without an id come last; of rows with one id
    the order is that of a hash of their text.  A single document is its own next one.

    Texts are dealt out by ranges of ids, once.  A partition's last text has its next one in
    another partition, so the ends are written with their texts, two a partition, and joined.
    """
    common.small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType
    whole = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranged = whole.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([
        T.StructField("doc_id", id_type), *T._parse_datatype_string(_RESULT).fields,
        T.StructField("part", T.IntegerType()), T.StructField("head", T.StringType()), T.StructField("tail", T.StringType()),
    ])

    def rows(ids, columns, part, head=None, tail=None):
        n = len(ids)
        more = [pa.array([part] * n, pa.int32()), pa.array([head] * n, pa.string()), pa.array([tail] * n, pa.string())]
        return pa.RecordBatch.from_arrays([ids, *columns, *more], names=["doc_id", *_NAMES, "part", "head", "tail"])

    def batches(stream):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
        last_id = last_text = last_lanes = None
        for batch in stream:
            at = 0
            column = batch.column("doc_id")
            for block in common.byte_blocks((bytes(t.as_buffer()) for t in batch.column("text")), BLOCK_BYTES):
                texts, (lanes, full) = [b.decode() for b in block], _lanes(block)
                ids = column.slice(at, len(block))
                at += len(block)
                if last_text is None:
                    yield rows(pa.nulls(1, column.type), empty, part, head=texts[0])
                else:
                    texts.insert(0, last_text)
                    lanes, full = np.concatenate([last_lanes[0], lanes]), np.concatenate([last_lanes[1], full])
                    ids = pa.concat_arrays([last_id, ids])
                n = len(texts) - 1
                if n:
                    known = (lanes[:-1], full[:-1]), (lanes[1:], full[1:])
                    yield rows(ids.slice(0, n), _judge(texts[:-1], texts[1:], known), part)
                last_id, last_text, last_lanes = ids.slice(n, 1), texts[-1], (lanes[-1:], full[-1:])
        if last_text is not None:
            yield rows(last_id, empty, part, tail=last_text)

    done = materialize(ranged.withColumn("text", F.col("text").cast("binary")).mapInArrow(batches, schema), "fingerprints")
    heads = done.where(F.col("head").isNotNull()).select("part", "head")
    # as many numbers as partitions hold rows
    parts = [r["part"] for r in heads.select("part").orderBy("part").collect()]
    follows = done.sparkSession.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    ends = (
        done.where(F.col("tail").isNotNull()).select("doc_id", "part", "tail").join(follows, "part")
        .join(heads.withColumnRenamed("part", "next_part"), "next_part").select("doc_id", "tail", "head")
    )
    closing = T.StructType(schema.fields[:7])

    def close(stream):
        for batch in stream:
            found = _judge(batch.column("tail").to_pylist(), batch.column("head").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found], names=["doc_id", *_NAMES])

    inner = done.where(F.col("head").isNull() & F.col("tail").isNull()).select("doc_id", *_NAMES)
    return inner.unionByName(ends.mapInArrow(close, closing))


def confirm(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs (a, b) of ids whose sets of shingles have at least this similarity."""
    named = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    wanted = may_be_in(docs, F.xxhash64("doc_id"), bitmap_of(named, F.xxhash64("doc_id")))
    texts = wanted.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null")
    texts = materialize(texts.join(named, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "fingerprint-texts")
    joined = (
        pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    )

    def batches(stream):
        for batch in stream:
            keep = []
            for x, y in zip(batch.column("ta"), batch.column("tb")):
                one, two = (np.unique(shingles([bytes(t.as_buffer())])[0]) for t in (x, y))
                both = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * both >= percent * (len(one) + len(two) - both) and len(one) > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return materialize(joined.mapInArrow(batches, joined.select("a", "b").schema), "fingerprint-links")


def similar_documents(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, text) -> (doc_id, fingerprint, component_id): groups linked by shingle similarity.

    Bands of permutations join fingerprints in Spark, and the similarity of proposed pairs is
    verified on their whole texts.  Equal fingerprints are one class.  Empty texts and rows
    without an id are alone; ids are taken to be unique.
    """
    printed = materialize(fingerprints(docs.select("doc_id", "text")).select("doc_id", "fingerprint"), "fingerprints")
    known = printed.where((F.col("fingerprint") != EMPTY) & F.col("doc_id").isNotNull())
    lanes = [[(i + k * step) % PERMUTATIONS for k in range(ROWS)] for i, step in [(i * 4, 1) for i in range(16)] + [(i, 16) for i in range(16)]]
    bands = F.array(*[F.xxhash64(F.lit(n), *[F.substring("fingerprint", lane * 4 + 1, 4) for lane in band]) for n, band in enumerate(lanes)])
    classes = materialize(known.groupBy("fingerprint").agg(F.min("doc_id").alias("rep")).withColumn("bands", bands), "fingerprint-classes")
    j = percent / 100
    least = j - DEVIATIONS * (j * (1 - j) / PERMUTATIONS) ** 0.5
    alike = likeness(F.col("x.fingerprint"), F.col("y.fingerprint")) >= least
    groups = components(group_links(classes, ["fingerprint"], alike, lambda pairs: confirm(pairs, docs, percent)), "fingerprint")
    placed = classes.select("fingerprint", F.col("rep").alias("node")).join(groups, "node", "left")
    of = placed.select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    return printed.join(of, "fingerprint", "left").select(
        "doc_id", "fingerprint", F.coalesce(F.when(F.col("doc_id").isNotNull(), F.col("component_id")), "doc_id").alias("component_id")
    )
