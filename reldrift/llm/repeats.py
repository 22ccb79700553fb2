"""Removal of byte strings that documents share, by hash-compared suffix sorting.

A byte goes if a ``SPAN``-byte string over it also starts in a document of smaller id.  Any
two equal strings of that length have the same least ``GRAM``-byte hash inside, so it is
enough to look at these anchors, about one in fourteen bytes:

1. Every task cuts its texts' anchors and keeps, of those with equal surroundings (all
   strings of ``SPAN`` bytes through the anchor), the one of the smallest document.  The
   others are covered.  What is left is dealt out by anchor, packed, without text.
2. A bucket covers the larger documents of equal surroundings, and asks for the bytes around
   an anchor only where surroundings differ and documents do.
3. For those the suffixes from the anchor on are sorted: prefix polynomial hashes and a binary
   search give the common extension of two suffixes, so a comparison takes a logarithmic number
   of steps, and a merge sort needs no more than comparisons.  Neighbours' common lengths
   are verified on the bytes.  Runs of neighbours that share ``SPAN - o`` bytes, together
   with equal ``o`` bytes on the left, are equal strings; the larger documents are covered.
4. The covered stretches of a document are joined and cut out of its bytes.

Texts without a covered byte are never shuffled as long as a bitmap of fixed size tells.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.membership import bitmap_of, cannot_be_in, may_be_in
from ..session import materialize
from . import common

SPAN, GRAM = 50, 24
SIDE = SPAN - GRAM  # bytes left of an anchor that a string through it can reach
CHUNK_BYTES, CHUNK_DOCS = 2 << 20, 60_000
BUCKET_BYTES = 12 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


class Prefixes:
    """Prefix polynomial hashes of a byte string: the hash of any stretch in constant time."""

    _power = _inverse = np.ones(1, dtype=np.uint64)

    def __init__(self, data: np.ndarray, seed: int = 31):
        n = len(data) + 1
        if len(Prefixes._power) < n:
            for name, factor in (("_power", _BASE), ("_inverse", pow(_BASE, -1, 2**64))):
                steps = np.full(n, factor, dtype=np.uint64)
                steps[0] = 1
                setattr(Prefixes, name, np.cumprod(steps, dtype=np.uint64))
        self.sums = np.zeros(n, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(common._fixed_words(seed, 256)[data] * Prefixes._power[: n - 1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[end] - self.sums[start]) * Prefixes._inverse[start]


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """Least (or largest) of every ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        values = least(values[: len(values) - have], values[have:])
        have *= 2
    return least(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def anchors(data: np.ndarray, start: np.ndarray, end: np.ndarray, prefixes: Prefixes):
    """(places, hashes) of the grams that are the least of some ``SPAN`` bytes of one text."""
    n = len(data)
    if n < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - GRAM + 1)
    gram = common.mix(prefixes.of(at, at + GRAM)) | np.uint64(1)
    least = _sliding(gram, SIDE + 1, np.minimum)
    limit = np.repeat(end, end - start)
    least[np.arange(n - SPAN + 1) + SPAN > limit[: n - SPAN + 1]] = 0
    zeros = np.zeros(SIDE, dtype=np.uint64)
    chosen = _sliding(np.concatenate([zeros, least, zeros]), SIDE + 1, np.maximum)
    place = np.flatnonzero(chosen == gram)
    return place, gram[place]


def suffix_order(prefixes: Prefixes, data: np.ndarray, start: np.ndarray, end: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of the suffixes ``data[start:end]`` by group and then bytes, by merge sort.

    Runs of doubling length are merged all at once: the rank of every suffix in the other run
    is found by binary search with hash-compared suffixes.
    """
    n = len(start)
    order = np.argsort(group, kind="stable")
    run = 1
    places = np.arange(n)
    while run < n:
        pair = places // (2 * run) * (2 * run)
        first = places - pair < run
        low = np.where(first, np.minimum(pair + run, n), pair)
        high = np.where(first, np.minimum(pair + 2 * run, n), np.minimum(pair + run, n))
        other = low.copy()
        own = order[places]
        # runs of different groups are in order already; only places that can move are searched
        lo, hi = low.copy(), high.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) // 2
            x, y = own[live], order[mid]
            less = _before(prefixes, data, start, end, group, y, x, first[live])
            lo[live] = np.where(less, mid + 1, lo[live])
            hi[live] = np.where(less, hi[live], mid)
            live = live[lo[live] < hi[live]]
        rank = lo - other
        target = np.where(first, places + rank, places - run + rank)
        merged = np.empty(n, dtype=order.dtype)
        merged[target] = own
        order, run = merged, run * 2
    return order


def _before(prefixes, data, start, end, group, y, x, strict):
    """Whether suffix y comes before x; equal ones do unless ``strict``."""
    same = group[y] == group[x]
    out = group[y] < group[x]
    i = np.flatnonzero(same)
    if len(i):
        a, b = y[i], x[i]
        shared = common_extension(prefixes, start[a], end[a], start[b], end[b])
        a_next = np.where(start[a] + shared < end[a], data[np.minimum(start[a] + shared, len(data) - 1)].astype(np.int64), -1)
        b_next = np.where(start[b] + shared < end[b], data[np.minimum(start[b] + shared, len(data) - 1)].astype(np.int64), -1)
        out[i] = np.where(a_next == b_next, ~strict[i], a_next < b_next)
    return out


def common_extension(prefixes: Prefixes, a, a_end, b, b_end) -> np.ndarray:
    """Length of the common beginning of pairs of stretches, by binary search on hashes."""
    low, high = np.zeros(len(a), dtype=np.int64), np.minimum(a_end - a, b_end - b)
    while (low < high).any():
        mid = (low + high + 1) // 2
        equal = prefixes.of(a, a + mid) == prefixes.of(b, b + mid)
        low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
    return low


def verified(data: np.ndarray, a, b, length) -> np.ndarray:
    """The common lengths, cut back where the bytes differ after all."""
    out = length.copy()
    for k in range(int(length.max()) if len(length) else 0):
        wrong = (k < out) & (data[np.minimum(a + k, len(data) - 1)] != data[np.minimum(b + k, len(data) - 1)])
        out[wrong] = k
    return out


def covered_by_suffixes(data, at, left, size, doc, group):
    """For contexts with ``left`` bytes before their anchor, (context, first, end) relative to it.

    ``at`` is where a context begins in ``data``; equal ``group`` means equal anchor hash.
    """
    prefixes = Prefixes(data)
    anchor, end = at + left, at + size
    order = suffix_order(prefixes, data, anchor, end, group)
    x, y = order[:-1], order[1:]
    shared = np.where(group[x] == group[y], common_extension(prefixes, anchor[x], end[x], anchor[y], end[y]), -1)
    shared = np.where(shared > 0, verified(data, anchor[x], anchor[y], np.maximum(shared, 0)), shared)
    found = []
    for o in range(SIDE + 1):
        run = np.zeros(len(order), dtype=np.int64)
        run[1:] = np.cumsum(shared < SPAN - o)
        fits = (left[order] >= o) & (end[order] - anchor[order] >= SPAN - o)
        member, of = order[fits], run[fits]
        if not len(member):
            continue
        side = prefixes.of(anchor[member] - o, anchor[member])
        by = np.lexsort((doc[member], side, of))
        member, of, side = member[by], of[by], side[by]
        head = np.ones(len(member), dtype=bool)
        head[1:] = (of[1:] != of[:-1]) | (side[1:] != side[:-1])
        first = member[np.flatnonzero(head)[np.cumsum(head) - 1]]
        hit = doc[member] > doc[first]
        if hit.any():
            m, f = member[hit], first[hit]
            right = np.ones(len(m), dtype=bool)
            for k in range(1, o + 1):  # the left side was compared by hash
                right &= data[anchor[m] - k] == data[anchor[f] - k]
            found.append((m[right], np.full(right.sum(), -o), np.full(right.sum(), SPAN - o)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(3))


_REPLY = "doc_id long, full binary, ask binary"
_BLOCK = "bucket long, ids binary, ordinal binary, place binary, anchor binary, around binary"
_ASK = np.dtype([("place", "<u4"), ("key", "<u8")])


def _cut(docs: DataFrame, buckets: int) -> DataFrame:
    """Anchors of all texts in packed blocks by bucket; bucket < 0 holds places covered inside a task."""

    def rows(number, ids, texts):
        length = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        end = np.cumsum(length)
        start = end - length
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        prefixes = Prefixes(data)
        place, gram = anchors(data, start, end, prefixes)
        owner = np.searchsorted(start, place, side="right") - 1
        low, high = np.maximum(start[owner], place - SIDE), np.minimum(end[owner], place + SPAN)
        with np.errstate(over="ignore"):
            around = common.mix(prefixes.of(low, high) + ((place - low) * 256 + (high - low)).astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(16)
        order = np.lexsort((ids[owner], around, gram))
        g, w, d = gram[order], around[order], ids[owner[order]]
        head = np.ones(len(order), dtype=bool)
        head[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
        least = d[np.flatnonzero(head)[np.cumsum(head) - 1]] if len(d) else d
        keep = np.zeros(len(order), dtype=bool)
        keep[order] = d == least
        bucket = ((gram & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.int64)
        bucket[~keep] = -1
        by = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.append(True, bucket[by][1:] != bucket[by][:-1])) if len(by) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(by)]):
            some = by[lo:hi]
            present, ordinal = np.unique(owner[some], return_inverse=True)
            b = int(bucket[some[0]])
            yield (
                b if b >= 0 else -1 - number, np.diff(ids[present], prepend=0).astype("<i8").tobytes(), ordinal.astype("<u2").tobytes(),
                (place[some] - start[owner[some]]).astype("<u4").tobytes(), (gram[some] >> np.uint64(32)).astype("<u4").tobytes(),
                b"" if b < 0 else (around[some] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (around[some] >> np.uint64(32)).astype("<u2").tobytes(),
            )

    def batches(stream):
        from pyspark import TaskContext

        number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
        kinds = [pa.int64(), *[pa.binary()] * 5]
        names = [c.split()[0] for c in _BLOCK.split(", ")]

        def flush():
            out = list(rows(number, np.array(ids, dtype=np.int64), texts))
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=names)

        for batch in stream:
            for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                data = bytes(t.as_buffer())
                if texts and (size + len(data) > CHUNK_BYTES or len(texts) >= CHUNK_DOCS):
                    yield flush()
                    number, ids, texts, size = number + 1, [], [], 0
                ids.append(i), texts.append(data)
                size += len(data)
        if texts:
            yield flush()

    return docs.mapInArrow(batches, _BLOCK)


def _replies(blocks: DataFrame, buckets: int) -> DataFrame:
    """Places of anchors by document: covered ones, and ones whose surroundings are asked for."""

    def answer(key, group):
        bucket = key[0].as_py()
        doc, place, anchor, around = [], [], [], []
        for i in range(group.num_rows):
            cell = {c: group.column(c)[i].as_buffer() for c in ("ids", "ordinal", "place", "anchor", "around")}
            ids = np.cumsum(np.frombuffer(cell["ids"], "<i8"))
            ordinal = np.frombuffer(cell["ordinal"], "<u2")
            doc.append(ids[ordinal])
            place.append(np.frombuffer(cell["place"], "<u4"))
            anchor.append(np.frombuffer(cell["anchor"], "<u4"))
            if bucket >= 0:
                n = len(ordinal)
                low, high = np.frombuffer(cell["around"], "<u4", count=n), np.frombuffer(cell["around"], "<u2", offset=4 * n)
                around.append(low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32)))
        doc, place, anchor = np.concatenate(doc), np.concatenate(place), np.concatenate(anchor)
        if bucket < 0:
            return _reply(doc, place, anchor.astype(np.uint64), np.ones(len(doc), bool))
        around = np.concatenate(around)
        order = np.lexsort((doc, around, anchor))
        doc, place, anchor, around = doc[order], place[order], anchor[order], around[order]
        new_anchor = np.append(True, anchor[1:] != anchor[:-1])
        new_class = new_anchor | np.append(True, around[1:] != around[:-1])
        least = doc[np.flatnonzero(new_class)[np.cumsum(new_class) - 1]]
        full = doc > least
        group_of = np.cumsum(new_anchor) - 1
        heads = np.flatnonzero(new_anchor)
        low, high = np.minimum.reduceat(least, heads), np.maximum.reduceat(least, heads)
        ask = ~full & (low != high)[group_of]
        some = full | ask
        return _reply(doc[some], place[some], anchor[some].astype(np.uint64) * np.uint64(buckets) + np.uint64(bucket), full[some])

    def _reply(doc, place, key, full):
        """One row for each part of the documents, whatever their number."""
        part = (common.mix(doc.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        head = np.flatnonzero(np.append(True, part[order][1:] != part[order][:-1])) if len(part) else np.zeros(0, np.int64)
        rows = [order[lo:hi] for lo, hi in zip(head, np.append(head[1:], len(part)))]
        columns = {"part": pa.array(part[[r[0] for r in rows]] if rows else [], pa.int64())}
        for name, values in (("doc", doc.astype("<i8")), ("place", place.astype("<u4")), ("key", key.astype("<u8")), ("full", full.astype("u1"))):
            columns[name] = pa.array([values[r].tobytes() for r in rows], pa.binary())
        return pa.table(columns)

    def by_document(_, group):
        kinds = {"doc": "<i8", "place": "<u4", "key": "<u8", "full": "u1"}
        col = {c: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group.column(c)]) for c, kind in kinds.items()}
        order = np.argsort(col["doc"], kind="stable")
        doc, place, key, full = (col[c][order] for c in kinds)
        full = full.astype(bool)
        head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        covers, asks = [], []
        for lo, hi in zip(head, np.append(head[1:], len(doc))):
            f = full[lo:hi]
            covers.append(place[lo:hi][f].astype("<u4").tobytes() if f.any() else None)
            rows = np.empty(int((~f).sum()), dtype=_ASK)
            rows["place"], rows["key"] = place[lo:hi][~f], key[lo:hi][~f]
            asks.append(rows.tobytes() if len(rows) else None)
        return pa.table({"doc_id": pa.array(doc[head], pa.int64()), "full": pa.array(covers, pa.binary()), "ask": pa.array(asks, pa.binary())})

    parts = blocks.groupBy("bucket").applyInArrow(answer, "part long, doc binary, place binary, key binary, full binary")
    return parts.groupBy("part").applyInArrow(by_document, _REPLY)


def _sorted_covers(asked: DataFrame, docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, cover): stretches covered around the anchors whose surroundings were asked for."""
    wanted = asked.groupBy("doc_id").agg(F.collect_list("ask").alias("asks"))
    given = may_be_in(docs, F.xxhash64("doc_id"), bitmap_of(asked, F.xxhash64("doc_id"))).join(wanted, "doc_id")
    block = "bucket long, data binary, `left` binary, size binary, doc binary, place binary, key binary"
    names = ["bucket", "data", "left", "size", "doc", "place", "key"]

    def contexts(stream):
        for batch in stream:
            parts = []
            for i, text, asks in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("asks")):
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                rows = np.frombuffer(b"".join(asks.as_py()), dtype=_ASK)
                rows = rows[rows["place"].astype(np.int64) + GRAM <= len(data)]
                place = rows["place"].astype(np.int64)
                low, high = np.maximum(place - SIDE, 0), np.minimum(place + SPAN, len(data))
                parts.append((data[common.ragged_index(low, high - low)], place - low, high - low, np.full(len(rows), i), place, rows["key"]))
            data, left, size, doc, place, key = (np.concatenate([p[k] for p in parts]) for k in range(6)) if parts else [np.zeros(0, np.int64)] * 6
            at = np.cumsum(size) - size
            bucket = (common.mix(key.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            out = []
            for b in np.unique(bucket):
                i = np.flatnonzero(bucket == b)
                cells = (data[common.ragged_index(at[i], size[i])].astype("u1"), left[i].astype("u1"), size[i].astype("u1"), doc[i].astype("<i8"), place[i].astype("<u4"), key[i].astype("<u8"))
                out.append((int(b), *[c.tobytes() for c in cells]))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if k == 0 else pa.binary()) for k in range(7)], names=names)

    def sort(key, group):
        kinds = {"data": "u1", "left": "u1", "size": "u1", "doc": "<i8", "place": "<u4", "key": "<u8"}
        col = {c: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in group.column(c)]) for c, kind in kinds.items()}
        left, size, place = (col[c].astype(np.int64) for c in ("left", "size", "place"))
        member, first, end = covered_by_suffixes(col["data"], np.cumsum(size) - size, left, size, col["doc"], col["key"])
        doc, lo, hi = col["doc"][member], place[member] + first, place[member] + end
        order = np.lexsort((lo, doc))
        doc, both = doc[order], np.stack([lo[order], hi[order]], axis=1).astype("<u4")
        head = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        cells = [both[a:b].tobytes() for a, b in zip(head, np.append(head[1:], len(doc)))]
        return pa.table({"doc_id": pa.array(doc[head], pa.int64()), "cover": pa.array(cells, pa.binary())})

    return given.select("doc_id", "text", "asks").mapInArrow(contexts, block).groupBy("bucket").applyInArrow(sort, "doc_id long, cover binary")


def _runs(length: int, full: list[bytes], cover: list[bytes]) -> np.ndarray:
    """Maximal covered stretches, as rows (start, end)."""
    at = np.frombuffer(b"".join(full), "<u4").astype(np.int64)
    pairs = [np.stack([at - SIDE, at + SPAN], axis=1), np.frombuffer(b"".join(cover), "<u4").astype(np.int64).reshape(-1, 2)]
    pairs = np.clip(np.concatenate(pairs), 0, length)
    change = np.bincount(pairs[:, 0], minlength=length + 1) - np.bincount(pairs[:, 1], minlength=length + 1)
    inside = np.cumsum(change) > 0
    return np.flatnonzero(np.diff(np.concatenate([[False], inside]).astype(np.int8))).reshape(-1, 2)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_bytes, removed, kept): a row for each row.

    ``removed`` are the maximal stretches (start, end) in bytes that go, ``kept`` the bytes that
    stay.  NULL texts count as empty.  A row without an id neither loses bytes nor takes
    them from others.  An id stands for one text: repeated rows are the same document.
    """
    common.small_batches(docs.sparkSession)
    given = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    known = given.where(F.col("doc_id").isNotNull())
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(12, -(-total // BUCKET_BYTES))
    long_enough = known.where(F.octet_length("text") >= SPAN)
    replies = materialize(_replies(_cut(long_enough, buckets), buckets), "repeats-places")
    asked = replies.where(F.col("ask").isNotNull()).select("doc_id", "ask")
    sorted_ = materialize(_sorted_covers(asked, long_enough, buckets), "repeats-sorted")
    parts = replies.where(F.col("full").isNotNull()).select("doc_id", "full", F.lit(None).cast("binary").alias("cover"))
    parts = parts.unionByName(sorted_.select("doc_id", F.lit(None).cast("binary").alias("full"), "cover"))
    held = bitmap_of(parts, F.xxhash64("doc_id"))
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    by_doc = parts.groupBy("doc_id").agg(F.collect_list("full").alias("full"), F.collect_list("cover").alias("cover"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    untouched = cannot_be_in(given, key, held).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("removed"), F.col("text").alias("kept"))
    schema = T.StructType([
        docs.schema["doc_id"], T.StructField("n_bytes", T.LongType()),
        untouched.schema["removed"], T.StructField("kept", T.BinaryType()),
    ])

    def batches(stream):
        for batch in stream:
            removed, kept, sizes = [], [], []
            for text, full, cover in zip(batch.column("text"), batch.column("full"), batch.column("cover")):
                data = np.frombuffer(text.as_buffer(), dtype=np.uint8)
                runs = _runs(len(data), full.as_py() or [], cover.as_py() or [])
                stay = np.ones(len(data), dtype=bool)
                stay[common.ragged_index(runs[:, 0], runs[:, 1] - runs[:, 0])] = False
                removed.append([{"start": int(a), "end": int(b)} for a, b in runs])
                kept.append(data[stay].tobytes())
                sizes.append(len(data))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "removed", "kept"],
            )

    touched = may_be_in(given, key, held).join(by_doc, "doc_id", "left").select("doc_id", "text", "full", "cover")
    return untouched.unionByName(touched.mapInArrow(batches, schema))
