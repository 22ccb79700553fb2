"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary.

Pieces are merged as rows of padded numpy matrices, bucketed by length: in every round each
row merges its leftmost pair of lowest rank, found by a hashed pair lookup, and is compacted
by one place.  A row without such a pair leaves the matrix.  Distinct pieces are merged once
per batch and remembered up to a bound, so the cost follows the distinct pieces.
"""

import base64
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_to_batch, byte_blocks, give_back, ragged_index, small_batches, with_columns

NONE = np.iinfo(np.int32).max
BUCKETS = (2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128, 192, 256, 512)
MATRIX_CELLS = 1 << 18       # cells of one matrix at most
REMEMBERED_PIECES = 100_000  # pieces kept between blocks of a task
BATCH_BYTES = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


class PairTable:
    """Hash table from (left id, right id) to the id of their merge, probed for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        bits = max(4, int(2 * len(left)).bit_length())
        self._mask, self._shift = (1 << bits) - 1, np.uint64(64 - bits)
        self._key = np.full(1 << bits, -1, dtype=np.int64)
        self._value = np.full(1 << bits, NONE, dtype=np.int32)
        keys = (left.astype(np.int64) << 32) | right
        waiting, slot = np.arange(len(keys)), self._slot(keys)
        while len(waiting):
            free = self._key[slot] < 0
            taken, place = waiting[free], slot[free]
            self._key[place] = keys[taken]  # of several at one place the last one stays
            won = self._key[slot] == keys[waiting]
            self._value[slot[won]] = merged[waiting[won]]
            waiting, slot = waiting[~won], (slot[~won] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, NONE where the pair has no merge; an id below 0 merges with nothing."""
        keys = (left.astype(np.int64) << 32) | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = np.iinfo(np.int64).max
        slot = self._slot(keys)
        stored = self._key[slot]
        out = np.where(stored == keys, self._value[slot], NONE)
        open_ = np.flatnonzero((stored != keys) & (stored >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self._mask
            stored = self._key[slot[open_]]
            hit = stored == keys[open_]
            out[open_[hit]] = self._value[slot[open_[hit]]]
            open_ = open_[~hit & (stored >= 0)]
        return out


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Decoder:
    """The byte strings of a vocabulary, one behind the other."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_length = np.fromiter(map(len, tokens), dtype=np.int64, count=size)
        self.token_start = np.cumsum(self.token_length) - self.token_length
        self.token_bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        return self.token_bytes[ragged_index(self.token_start[ids], self.token_length[ids])].tobytes()


class Codec(Decoder):
    """A vocabulary of byte strings whose ids are their merge ranks."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = _ranks(path)
        super().__init__(self.ranks)
        self.find_pieces = regex.compile(pattern).findall
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.table = PairTable(*(np.array(x, dtype=np.int32) for x in (left, right, merged)))
        self.forget()

    def forget(self) -> None:
        self.pieces = _Pieces()
        self.piece_start = np.zeros(0, dtype=np.int64)
        self.piece_length = np.zeros(0, dtype=np.int64)
        self.piece_ids = np.zeros(0, dtype=np.int32)

    # -- encoding

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.pieces) > REMEMBERED_PIECES:
            self.forget()
        number = self.pieces.__getitem__
        found = []
        for text in texts:
            pieces = self.find_pieces(text)
            found.append(np.fromiter(map(number, pieces), dtype=np.int64, count=len(pieces)))
        self._learn()
        out = []
        for numbers in found:
            at = ragged_index(self.piece_start[numbers], self.piece_length[numbers])
            out.append(self.piece_ids[at])
        return out

    def _learn(self) -> None:
        """Encode the pieces met for the first time."""
        new, self.pieces.new = self.pieces.new, []
        if not new:
            return
        ids, length = self.encode_pieces([p.encode() for p in new])
        start = len(self.piece_ids) + np.cumsum(length) - length
        self.piece_start = np.concatenate([self.piece_start, start])
        self.piece_length = np.concatenate([self.piece_length, length])
        self.piece_ids = np.concatenate([self.piece_ids, ids])

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, ids per piece)."""
        rank = np.fromiter((self.ranks.get(p, -1) for p in pieces), dtype=np.int32, count=len(pieces))
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        whole = np.flatnonzero(rank >= 0)
        blocks = [(whole, np.ones(len(whole), dtype=np.int64), rank[whole])]  # owners, lengths, ids
        for i in np.flatnonzero((rank < 0) & (size > BUCKETS[-1])):
            ids = self._merge_long(pieces[i])
            blocks.append((np.array([i]), np.array([len(ids)]), ids))
        bucket = np.where((rank < 0) & (size <= BUCKETS[-1]), np.searchsorted(BUCKETS, size), -1)
        for b in np.unique(bucket[bucket >= 0]):
            members = np.flatnonzero(bucket == b)
            rows = max(1, MATRIX_CELLS // BUCKETS[b])
            for at in range(0, len(members), rows):
                self._merge_rows(pieces, members[at : at + rows], BUCKETS[b], blocks)
        owner, length = (np.concatenate([block[k] for block in blocks]) for k in (0, 1))
        start = np.cumsum(length) - length
        order = np.argsort(owner)
        ids = np.concatenate([block[2] for block in blocks])
        return ids[ragged_index(start[order], length[order])], length[order]

    def _merge_rows(self, pieces, owner, width, blocks) -> None:
        data = np.frombuffer(b"".join(pieces[i] for i in owner), dtype=np.uint8)
        length = np.fromiter((len(pieces[i]) for i in owner), dtype=np.int64, count=len(owner))
        ids = np.full((len(owner), width), -1, dtype=np.int32)
        ids[np.arange(width) < length[:, None]] = self.byte_id[data]
        rank = self.table.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while len(ids):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(ids), dtype=np.int64)
            row = np.arange(len(ids))
            best = rank[row, at] if rank.shape[1] else np.full(len(ids), NONE)
            done = best == NONE
            if done.any():
                ready, n = ids[done], length[done]
                blocks.append((owner[done], n, ready[np.arange(ready.shape[1]) < n[:, None]]))
                keep = ~done
                owner, ids, rank, length, at, best = (x[keep] for x in (owner, ids, rank, length, at, best))
                row = np.arange(len(ids))
            if not len(ids):
                break
            ids[row, at] = best
            places = np.arange(ids.shape[1])
            ids = ids[places != at[:, None] + 1].reshape(len(ids), -1)
            rank = rank[places[:-1] != at[:, None]].reshape(len(ids), -1)
            length -= 1
            before, after = at > 0, at < ids.shape[1] - 1
            rank[row[before], at[before] - 1] = self.table.find(ids[row[before], at[before] - 1], ids[row[before], at[before]])
            rank[row[after], at[after]] = self.table.find(ids[row[after], at[after]], ids[row[after], at[after] + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for a piece too long for a matrix row, by a heap of (rank, place)."""
        ids = [int(i) for i in self.byte_id[np.frombuffer(piece, dtype=np.uint8)]]
        start, end = list(range(len(ids))), list(range(1, len(ids) + 1))
        left, right = list(range(-1, len(ids) - 1)), [*range(1, len(ids)), -1]
        ranks = self.ranks
        heap = [(r, i, i + 2) for i in range(len(ids) - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * len(ids)
        while heap:
            rank, i, stop = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or end[j] != stop:
                continue
            ids[i], end[i], alive[j] = rank, stop, False
            right[i] = right[j]
            if right[i] >= 0:
                left[right[i]] = i
                r = ranks.get(piece[start[i] : end[right[i]]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[right[i]]))
            k = left[i]
            if k >= 0 and (r := ranks.get(piece[start[k] : stop])) is not None:
                heapq.heappush(heap, (r, k, stop))
        return np.array([x for x, a in zip(ids, alive) if a], dtype=np.int32)


class _Pieces(dict):
    """Numbers pieces in order of first sight and lists those not encoded yet."""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, piece):
        self.new.append(piece)
        number = self[piece] = len(self)
        return number


def encode(docs: DataFrame, text: str = "text", out: str = "token_ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add ``out``: the ids of ``text`` as little-endian unsigned 32-bit integers in one binary value.

    A NULL text counts as empty and has no ids.  All other columns pass through; a column
    already called ``out`` is replaced.  Rows are independent, so repeats stay repeats.
    """
    small_batches(docs.sparkSession)
    path, pattern = path or default_path(), pattern or default_pattern()

    def batches(stream):
        codec = Codec(path, pattern)
        for batch in stream:
            ids = []
            for block in byte_blocks((t.as_buffer() if t.is_valid else None for t in batch.column(text).cast(pa.binary())), BATCH_BYTES):
                texts = [bytes(b).decode("utf-8", "replace") for b in block]
                ids += [i.astype("<u4").tobytes() for i in codec.encode_batch(texts)]
            yield add_to_batch(batch, **{out: pa.array(ids, type=pa.binary())})
            batch = ids = texts = block = None
            give_back()
        del codec
        give_back()

    return docs.mapInArrow(batches, with_columns(docs, **{out: T.BinaryType()}))


def decode(encoded: DataFrame, ids: str = "token_ids", out: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Add ``out``: the bytes that ``ids`` stand for; NULL ids decode to no bytes.

    Needs the tokens only, not the tables of merges, so its worker is small beside that of
    :func:`encode`; the ``pattern`` plays no part.
    """
    path = path or default_path()

    def batches(stream):
        codec = Decoder(_ranks(path))
        for batch in stream:
            found = (np.frombuffer(x.as_buffer(), dtype="<u4") if x.is_valid else np.zeros(0, "<u4") for x in batch.column(ids))
            yield add_to_batch(batch, **{out: pa.array([codec.decode(x.astype(np.int64)) for x in found], type=pa.binary())})
            batch = found = None
            give_back()
        del codec
        give_back()

    return encoded.mapInArrow(batches, with_columns(encoded, **{out: T.BinaryType()}))


def token_count(ids: str = "token_ids"):
    return (F.octet_length(ids) / 4).cast("long")
