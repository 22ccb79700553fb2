"""A hierarchical Pitman-Yor language model over words, seated by Gibbs sampling in Spark.

Three levels of restaurants predict a word.  Every word of the training texts has, as a
context, a restaurant of its own; its parent is the restaurant of the context's last
character, which is also the context of words at the start of a text.  The parent of
all classes is the root, and the root's is uniform over the vocabulary and one unknown word.
Dishes are partitioned by word, and everything that is known of a word is in one bucket row.

The customers and tables of classes and of the ``COMMON`` most frequent contexts are a short
vector.  Those of all other contexts, the rare ones, which grow with the corpus, are a
partitioned table: contexts have homes, buckets send what they seat to the home of each
context and get the sums back.  Frequent or rare, a context's restaurant obeys the same law.

A sweep seats the customers of every dish anew, given where all others sit: c customers have
t tables with odds S(c, t) * prod over k < t of (strength + discount * (other tables + k)) *
(the parent's probability of the dish), where S counts the seatings (generalised Stirling
numbers).  Drawing t from these odds is one Gibbs step for all customers of the dish at
once.  A dish with one customer has one table, so in a sweep only rare contexts with other dishes
are told and asked for.  The tables are the customers of the parent.  Within a sweep the totals of restaurants and the parents'
probabilities are those of the sweep before, so that buckets are independent; after it the
totals are summed in Spark.  Predictions are averaged over the last ``KEPT`` sweeps.

Text is cut by whitespace into words, A-Z lower-cased, and ends with an end token.  Words are
told apart by 64-bit hashes (two among a thousand million share one with odds of 1 in 40).
"""

import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import hadoop_path, materialize
from . import common

SHARE = 1024  # words of 1 / SHARE of the tokens or more have buckets of their own
COMMON, NEAR = 60_000, 8192  # contexts whose totals are a vector; those in which frequent words are scored where they stand
SWEEPS, KEPT = 4, 2
STRENGTH = (10.0, 5.0, 5.0)  # root, classes, contexts
BUCKET_TOKENS = 1_000_000
COUNTED_TOKENS, SEATED_TOKENS = 250_000, 1_000_000  # tokens a task holds before it hands them on
CHUNK_DOCS, CHUNK_TOKENS = 60_000, 1_000_000
END = np.uint64(0x5851F42D4C957F2D)
SEED = 11


class Tokens:
    """Words of a batch with the restaurant each is predicted in."""

    def __init__(self, contexts=None, context_class=None, classes=None):
        self.hasher = common.WordHasher()
        self.contexts, self.context_class, self.classes = contexts, context_class, classes

    def cut(self, texts: list[bytes]):
        """(hash, text number, last code point) of all tokens; an end token has code point -1."""
        words, count, start, end, joined = self.hasher.words(texts)
        last = joined[end - 1].astype(np.int64) if len(end) else np.zeros(0, np.int64)
        wide = np.flatnonzero(last >= 128)  # put the bytes of the last character together
        if len(wide):
            at = end[wide] - 1
            value, weight = np.zeros(len(wide), np.int64), 0
            open_ = np.ones(len(wide), bool)
            for _ in range(4):
                byte = joined[np.maximum(at, 0)].astype(np.int64)
                value = np.where(open_, value + (byte << weight), value)
                open_ &= (byte & 0xC0) == 0x80
                at, weight = at - 1, weight + 8
            last[wide] = value
        upper = (last >= 65) & (last <= 90)
        last[upper] += 32
        texts_n = len(texts)
        place = np.arange(len(words)) + np.repeat(np.arange(texts_n), count)
        total = len(words) + texts_n
        token = np.full(total, END, dtype=np.uint64)
        token[place] = words
        owner = np.repeat(np.arange(texts_n), count + 1)
        char = np.full(total, -1, dtype=np.int64)
        char[place] = last
        return token, owner, char

    def rooms(self, words: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The restaurant after each word, by its last character.

        It is a common context's number, or behind them a class's; after a rare context it is
        the number of its class.
        """
        n = len(self.contexts)
        # classes are sorted code points; -1 (the start of a text) is one of them, 0 stands for characters never seen
        at = np.minimum(np.searchsorted(self.classes, chars), len(self.classes) - 1)
        room = n + np.where(self.classes[at] == chars, at, np.searchsorted(self.classes, 0))
        if n:
            at = np.minimum(np.searchsorted(self.contexts, words), n - 1)
            room = np.where(self.contexts[at] == words, at, room)
        return room.astype(np.int64)

    def seated(self, token: np.ndarray, char: np.ndarray):
        """(distinct words, the room after each, each token's number among them, the number of the word before it)."""
        words, number = np.unique(token, return_inverse=True)
        last = np.empty(len(words), char.dtype)
        last[number] = char
        before = np.append(np.searchsorted(words, END), number[:-1])  # texts end with an end, which is before the next one
        return words, self.rooms(words, last), number, before


def _blocks(batch):
    return common.byte_blocks(bytes(t.as_buffer()) if t.is_valid else b"" for t in batch.column("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, last, n): the hash of every token of ``docs``, its last character and its count."""

    def batches(stream):
        cutter = Tokens()

        def counted(parts):
            word = np.concatenate([p[0] for p in parts])
            value, first, where = np.unique(word, return_index=True, return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([p[2] for p in parts])).astype(np.int64)
            return value, np.concatenate([p[1] for p in parts])[first], n

        held, size = [], 0
        for batch in stream:
            for texts in _blocks(batch):
                token, _, char = cutter.cut(texts)
                held.append((token, char, np.ones(len(token), np.int64)))
                size += len(token)
                if size >= COUNTED_TOKENS:
                    yield _count_rows(counted(held))
                    held, size = [], 0
        if held:
            yield _count_rows(counted(held))

    parts = _binary(docs).mapInArrow(batches, "word long, last long, n long")
    return parts.groupBy("word").agg(F.first("last").alias("last"), F.sum("n").alias("n"))


def _count_rows(counted):
    word, last, n = counted
    return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(last), pa.array(n)], names=["word", "last", "n"])


def _binary(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("text").cast("binary").alias("text"))


class Shape:
    """The restaurants of a model and the totals of a corpus."""

    def __init__(self, counts: DataFrame):
        total = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
        self.tokens, self.vocabulary = int(total["n"] or 0), int(total["v"])
        often = counts.where(F.col("last") != -1).orderBy(F.desc("n"), "word").limit(COMMON).collect()
        ends = counts.select("last").distinct().collect()  # no more than there are characters
        self.classes = np.array(sorted({-1, 0, *[r["last"] for r in ends]}), dtype=np.int64)
        words = np.array([r["word"] for r in often], dtype=np.int64).view(np.uint64)
        order = np.argsort(words)
        self.contexts = words[order]
        #: The common contexts beside which frequent words are scored where they stand.
        self.near = np.sort(np.argsort(order)[:NEAR])
        last = np.array([r["last"] for r in often], dtype=np.int64)[order]
        at = np.minimum(np.searchsorted(self.classes, last), len(self.classes) - 1)
        self.context_class = np.where(self.classes[at] == last, at, np.searchsorted(self.classes, 0)).astype(np.int64)
        #: The class of every restaurant, contexts first.
        self.class_of = np.concatenate([self.context_class, np.arange(len(self.classes))])
        #: Words scored where they stand: the frequent ones and the end.
        hot = {int(np.int64(r["word"]).view(np.uint64)): r["n"] for r in often if r["n"] * SHARE >= self.tokens}
        hot[int(END)] = sum(r["n"] for r in counts.where(F.col("last") == -1).collect())
        self.frequent = np.array(sorted(hot), dtype=np.uint64)
        self.frequent_count = np.array([hot[int(w)] for w in self.frequent], dtype=np.int64)
        self.buckets = max(12, -(-self.tokens // BUCKET_TOKENS))
        self.homes = max(12, self.buckets // 16)
        #: The number of parts in which the texts of a frequent word are scored.
        self.parts = 1 + self.frequent_count // (4 * BUCKET_TOKENS)
        #: Rooms fit into two bytes unless there are very many characters.
        self.room_type = "<u2" if self.rooms < 1 << 16 else "<i4"
        self.discount = (0.5, 0.5, 0.5)

    @property
    def rooms(self) -> int:
        return len(self.class_of)

    @property
    def all_buckets(self) -> int:
        return self.buckets + len(self.frequent)

    def bucket(self, words: np.ndarray) -> np.ndarray:
        """Frequent words have buckets of their own, behind the others."""
        at, hot = _find(self.frequent, words, np.ones(len(words), bool))
        return np.where(hot, self.buckets + at, (common.mix(words) % np.uint64(self.buckets)).astype(np.int64))

    def home(self, contexts: np.ndarray) -> np.ndarray:
        return (common.mix(contexts) % np.uint64(self.homes)).astype(np.int64)

    def is_rare(self, room: np.ndarray) -> np.ndarray:
        """Whether words of this room stand after a rare context: all classes but that of the start of a text."""
        start = len(self.contexts) + int(np.searchsorted(self.classes, -1))
        return (room >= len(self.contexts)) & (room != start)

    def tokens_of(self) -> Tokens:
        return Tokens(self.contexts, self.context_class, self.classes)


class Seating:
    """The dishes of one bucket and where their customers sit, but for those of one customer in a context.

    Those have one table for good, and are but customers of their class dish in ``single1``.
    """

    def __init__(self, shape: Shape, key1, single1, room2, up2, c2, up3, at3, c3):
        self.shape, self.key1, self.single1 = shape, key1, single1
        self.word1, self.class1 = key1 // len(shape.classes), key1 % len(shape.classes)
        self.room2, self.up2, self.c2, self.up3, self.at3, self.c3 = room2, up2, c2, up3, at3, c3

    def split(self, seats: np.ndarray):
        """Tables of common contexts, classes, the root and rare contexts."""
        a, b, c = len(self.c2), len(self.c2) + len(self.key1), len(seats) - len(self.c3)
        return [x.astype(np.int64) for x in (seats[:a], seats[a:b], seats[b:c], seats[c:])]

    def customers(self, t2, t1, t0, t3):
        n = len(self.key1)
        c1 = self.single1 + (np.bincount(self.up2, weights=t2, minlength=n) + np.bincount(self.up3, weights=t3, minlength=n)).astype(np.int64)
        c0 = np.bincount(self.word1, weights=t1, minlength=len(t0)).astype(np.int64)
        return c1, c0

    def totals(self, seats) -> np.ndarray:
        """Of common contexts the tables beyond one a dish, customers and tables of classes and the root."""
        t2, t1, t0, t3 = self.split(seats)
        c1, c0 = self.customers(t2, t1, t0, t3)
        contexts, classes = len(self.shape.contexts), len(self.shape.classes)
        parts = [np.bincount(self.room2, weights=t2 - 1, minlength=contexts)]
        parts += [np.bincount(self.class1, weights=x, minlength=classes) for x in (c1, t1)]
        return np.concatenate([*parts, [c0.sum(), t0.sum()]])

    def probabilities(self, seats, totals):
        """The predictive probability of the root and class dishes."""
        d0, d1, _ = self.shape.discount
        rest = _Totals(self.shape, totals)
        t2, t1, t0, t3 = self.split(seats)
        c1, c0 = self.customers(t2, t1, t0, t3)
        uniform = 1 / (self.shape.vocabulary + 1)
        p0 = (c0 - d0 * t0 + (STRENGTH[0] + d0 * rest.t0) * uniform) / (STRENGTH[0] + rest.c0)
        p1 = (c1 - d1 * t1 + (STRENGTH[1] + d1 * rest.t1[self.class1]) * p0[self.word1]) / (STRENGTH[1] + rest.c1[self.class1])
        return p0, p1

    def sweep(self, seats, totals, others, rng) -> np.ndarray:
        """``others``: the tables of each rare dish's restaurant but for its own."""
        d0, d1, d2 = self.shape.discount
        rest = _Totals(self.shape, totals)
        p0, p1 = self.probabilities(seats, totals)
        t2, t1, t0, t3 = self.split(seats)
        parent = p1[self.up2]
        t2 = seat(self.c2, (STRENGTH[2] + d2 * (rest.t2[self.room2] - t2)) * parent, d2 * parent, d2, rng)
        parent = p1[self.up3]
        t3 = seat(self.c3, (STRENGTH[2] + d2 * others) * parent, d2 * parent, d2, rng)
        c1, _ = self.customers(t2, t1, t0, t3)
        parent = p0[self.word1]
        t1 = seat(c1, (STRENGTH[1] + d1 * (rest.t1[self.class1] - t1)) * parent, d1 * parent, d1, rng)
        _, c0 = self.customers(t2, t1, t0, t3)
        uniform = 1 / (self.shape.vocabulary + 1)
        t0 = seat(c0, (STRENGTH[0] + d0 * (rest.t0 - t0)) * uniform, np.full(len(c0), d0 * uniform), d0, rng)
        return np.concatenate([t2, t1, t0, t3]).astype(np.int32)


class Dishes(Seating):
    """All dishes of one bucket.

    ``key`` holds those of common contexts and of the start of a text; ``rare_key``, ``rare``
    and ``rare_n`` those of rare contexts: word and class, context, customers.
    """

    def __init__(self, shape: Shape, words: np.ndarray, key: np.ndarray, n: np.ndarray, rare_key=None, rare=None, rare_n=None):
        none = np.zeros(0, np.int64)
        rare_key, rare, rare_n = (none, none.view(np.uint64), none) if rare is None else (rare_key, rare, rare_n)
        self.words, self.rare, self.rare_n = words, rare, rare_n
        word, room = np.concatenate([key, rare_key]) // shape.rooms, np.concatenate([key, rare_key]) % shape.rooms
        key1, up = np.unique(word * len(shape.classes) + shape.class_of[room], return_inverse=True)
        plain, rooms = len(key), room[: len(key)]
        own, start = rooms < len(shape.contexts), rooms >= len(shape.contexts)
        self.key2, self.n2, self.word3 = key[own], n[own], word[plain:]
        # customers of class dishes: all at the start of a text, and one for each dish of one customer
        single1 = np.bincount(up, weights=np.concatenate([np.where(own, n < 2, n), rare_n < 2]), minlength=len(key1)).astype(np.int64)
        self.many2, self.many3 = own & (n > 1), rare_n > 1
        self.contexts3, at3 = np.unique(rare[self.many3], return_inverse=True)
        super().__init__(shape, key1, single1, rooms[self.many2], up[:plain][self.many2], n[self.many2], up[plain:][self.many3], at3, rare_n[self.many3])
        self.fixed = [np.bincount(rooms[own], weights=x, minlength=len(shape.contexts)) for x in (n[own], np.ones(int(own.sum())))]
        self.all_few = [float((n[own] == k).sum() + (rare_n == k).sum()) for k in (1, 2)]
        self.count = np.bincount(word, weights=np.concatenate([n, rare_n]), minlength=len(words)).astype(np.int64)
        self.many2 = self.many2[own]
        self._known = self._tables = self._pairs = None

    def start(self) -> np.ndarray:
        return np.ones(len(self.c2) + len(self.key1) + len(self.words) + len(self.c3), dtype=np.int32)

    def first_totals(self, seats) -> np.ndarray:
        """Customers and dishes of common contexts, ``totals``, then dishes with one and with two customers by level."""
        t2, t1, t0, t3 = self.split(seats)
        c1, c0 = self.customers(t2, t1, t0, t3)
        few = [[float((c == k).sum()) for k in (1, 2)] for c in (c0, c1)]
        return np.concatenate([*self.fixed, self.totals(seats), *few, self.all_few])

    def tables(self, kept):
        """Tables of all dishes of common and of rare contexts, for each sweep."""
        if self._tables is None:
            self._tables = []
            for seats in kept:
                t2, _, _, t3 = self.split(seats)
                all2, all3 = np.ones(len(self.key2)), np.ones(len(self.rare))
                all2[self.many2], all3[self.many3] = t2, t3
                self._tables.append((all2, all3))
        return self._tables

    def parents(self, word: np.ndarray, group: np.ndarray, kept: list[np.ndarray], totals: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of words (numbers here, -1 if unknown) in classes, for each sweep.

        The sweeps must be the same ones in every call: what they give for whole dishes is kept.
        """
        if self._known is None:
            self._known = [self.probabilities(seats, sums) for seats, sums in zip(kept, totals)]
        shape = self.shape
        known = word >= 0
        at1, has1 = _find(self.key1, word * len(shape.classes) + group, known)
        d0, d1, _ = shape.discount
        out = []
        for sums, (p0, p1) in zip(totals, self._known):
            rest = _Totals(shape, sums)
            unknown = (STRENGTH[0] + d0 * rest.t0) / (shape.vocabulary + 1) / (STRENGTH[0] + rest.c0)
            root = np.full(len(word), unknown)
            if len(p0):
                root = np.where(known, p0[np.maximum(word, 0)], unknown)
            p = (STRENGTH[1] + d1 * rest.t1[group]) * root / (STRENGTH[1] + rest.c1[group])
            out.append(np.where(has1, p1[at1], p) if len(p1) else p)
        return out

    def predict(self, word: np.ndarray, room: np.ndarray, kept: list[np.ndarray], totals: list[np.ndarray]) -> np.ndarray:
        """Probability of words in common contexts, or in classes, averaged over sweeps."""
        shape = self.shape
        contexts = len(shape.contexts)
        own = room < contexts
        at2, has2 = _find(self.key2, word * shape.rooms + room, (word >= 0) & own)
        d2 = shape.discount[2]
        out = np.zeros(len(word))
        for (t2, _), sums, p in zip(self.tables(kept), totals, self.parents(word, shape.class_of[room], kept, totals)):
            rest = _Totals(shape, sums)
            if contexts:
                r = np.where(own, room, 0)
                have = np.where(has2, self.n2[at2] - d2 * t2[at2], 0.0) if len(t2) else 0.0
                p = np.where(own, (have + (STRENGTH[2] + d2 * rest.t2[r]) * p) / (STRENGTH[2] + rest.c2[r]), p)
            out += p
        return out / len(kept)

    def predict_rare(self, words, word, room, context, kept, totals, contexts, sums):
        """(probability, parents' probabilities, whether the context has a dish here) of words after rare contexts.

        ``contexts`` are those that have dishes here, ``sums`` their customers and, for each
        sweep, tables; the first result holds for them only.
        """
        d2 = self.shape.discount[2]
        if self._pairs is None:
            pair = _pair(self.words[self.word3], self.rare)
            order = np.argsort(pair)
            self._pairs = pair[order], order
        at, has = _find(self._pairs[0], _pair(words, context), word >= 0)
        where, here = _find(contexts, context, np.ones(len(context), bool))
        parents = self.parents(word, self.shape.class_of[room], kept, totals)
        out = np.zeros(len(word))
        if len(contexts):
            pair = self._pairs[1][at]
            for (_, t3), tables, p in zip(self.tables(kept), sums[1:], parents):
                have = np.where(has, self.rare_n[pair] - d2 * t3[pair], 0.0)
                out += (have + (STRENGTH[2] + d2 * tables[where]) * p) / (STRENGTH[2] + sums[0][where])
        return out / len(kept), parents, here


def _pair(words, contexts):
    with np.errstate(over="ignore"):
        return common.mix(words * np.uint64(0x9E3779B97F4A7C15) + contexts)


class _Totals:
    def __init__(self, shape: Shape, totals: np.ndarray):
        n, k = len(shape.contexts), len(shape.classes)
        self.c2, self.t2, self.c1, self.t1 = totals[:n], totals[n : 2 * n], totals[2 * n : 2 * n + k], totals[2 * n + k : 2 * n + 2 * k]
        self.c0, self.t0 = totals[2 * n + 2 * k], totals[2 * n + 2 * k + 1]


def _find(sorted_keys, keys, wanted):
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, wanted & (sorted_keys[at] == keys)


EXACT = 1024  # dishes of up to so many customers are drawn from exact weights
_stirling: dict[float, list[np.ndarray]] = {}


def stirling(discount: float) -> list[np.ndarray]:
    """Row c: the logarithms of the generalised Stirling numbers S(c, t) for t = 1..c, up to ``EXACT`` customers."""
    if discount not in _stirling:
        rows = [np.zeros(0), np.zeros(1)]
        for c in range(1, EXACT):
            row, t = rows[-1], np.arange(1, c + 1)
            stay = np.append(row + np.log(c - discount * t), -np.inf)
            rows.append(np.logaddexp(stay, np.append(-np.inf, row)))
        _stirling[discount] = rows
    return _stirling[discount]


def seat(customers, base, slope, discount, rng) -> np.ndarray:
    """Draw the tables of many dishes given all that sits elsewhere.

    c customers of one dish have t tables with odds S(c, t) * prod over k < t of
    (base + slope * k): all seatings of them are drawn anew at once, which is one Gibbs step
    for the dish.  Up to ``EXACT`` customers the odds are taken as they are.  Beyond that their
    form for large c is used: t - 1 is negative binomial as long as t is far below
    c ** discount, else t is normal around the saddle point of the odds.
    """
    out = np.ones(len(customers), dtype=np.int64)
    order = np.argsort(customers, kind="stable")
    counts, first = np.unique(customers[order], return_index=True)
    rows = stirling(discount) if len(counts) and counts[-1] > 1 else None
    for c, lo, hi in zip(counts, first, np.append(first[1:], len(order))):
        if c < 2:
            continue
        if c > EXACT:
            break
        step = max(1, (1 << 20) // int(c))
        for at in range(lo, hi, step):  # blocks of bounded size
            some = order[at : min(at + step, hi)]
            odds = rows[c] + np.cumsum(np.log(base[some, None] + slope[some, None] * np.arange(c)), axis=1)
            share = np.cumsum(np.exp(odds - odds.max(axis=1, keepdims=True)), axis=1)
            out[some] = 1 + (share < rng.random((len(some), 1)) * share[:, -1:]).sum(axis=1)
    many = order[np.searchsorted(customers[order], EXACT, side="right") :]
    if len(many):
        out[many] = _seat_many(customers[many].astype(float), base[many], slope[many], discount, rng)
    return out


def _seat_many(c, base, slope, d, rng) -> np.ndarray:
    """Tables of dishes with many customers; u = 1 - x at the saddle point of x**-c * (1 - (1 - x)**d)**t."""
    def tables(u):
        return c * -np.expm1(d * np.log(u)) / ((1 - u) * d * u ** (d - 1))

    low, high = np.full(len(c), -80.0), np.full(len(c), np.log1p(-1e-12))  # bounds of log u
    for _ in range(80):
        middle = (low + high) / 2
        u = np.exp(middle)
        t = tables(u)
        more = (base + slope * t) * -np.expm1(d * middle) > d * t  # the odds still rise with t
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    u = np.exp((low + high) / 2)
    t = tables(u)
    # the curvature of the log odds, by the slope of its derivative between two neighbouring points
    step = np.exp(1e-4)
    near = tables(u * step)
    grade = lambda v, n: np.log(base + slope * n) + np.log(-np.expm1(d * np.log(v)) / (d * n))
    bend = -(grade(u * step, near) - grade(u, t)) / (near - t)
    normal = np.rint(t + 0.5 + rng.standard_normal(len(c)) / np.sqrt(np.maximum(bend, 1e-300)))
    few = 1 + rng.negative_binomial((base + slope) / slope, 1 - np.minimum(slope / d, 1 - 1e-12))
    return np.clip(np.where(t > 0.3 * c**d, normal, few), 1, c).astype(np.int64)


_PAIRS = ("words", "size", "room", "n", "rare_size", "rare_room", "rare", "rare_n")
_SEATING = ("key1", "single1", "room2", "up2", "c2", "up3", "at3", "c3")
_MOVING = ("contexts3", "dishes3", "seats", "kept", "totals")


def _schema(cells) -> str:
    return "bucket int, " + ", ".join(f"`{c}` binary" for c in cells)


def _packed(n: np.ndarray) -> bytes:
    """Counts in a byte each, those of 255 and more behind them once more."""
    return np.minimum(n, 255).astype("u1").tobytes() + n[n >= 255].astype("<i8").tobytes()


def _unpacked(cell: bytes, size: int) -> np.ndarray:
    n = np.frombuffer(cell, "u1", size).astype(np.int64)
    n[n == 255] = np.frombuffer(cell, "<i8", offset=size)
    return n


def _pairs_of(shape: Shape, words, key, n, rare_key, rare, rare_n) -> dict:
    """The cells of a bucket's dishes: for each word how many there are, then their rooms."""
    cells = {"words": words, "rare": rare}
    for part, k, m in (("", key, n), ("rare_", rare_key, rare_n)):
        cells[part + "size"] = np.bincount(k // shape.rooms, minlength=len(words)).astype("<i4")
        cells[part + "room"], cells[part + "n"] = (k % shape.rooms).astype(shape.room_type), _packed(m)
    return {c: cells[c] for c in _PAIRS}


def _load(shape: Shape, row: dict) -> Dishes:
    words, cells = np.frombuffer(row["words"], "<u8"), []
    for part in ("", "rare_"):
        size, room = np.frombuffer(row[part + "size"], "<i4"), np.frombuffer(row[part + "room"], shape.room_type)
        cells += [np.repeat(np.arange(len(words)), size) * shape.rooms + room, _unpacked(row[part + "n"], len(room))]
    return Dishes(shape, words, *cells[:3], np.frombuffer(row["rare"], "<u8"), cells[3])


def _load_seating(shape: Shape, row: dict) -> Seating:
    kinds = {"key1": "<i8", "single1": "<i8", "room2": "<i4", "up2": "<i4", "c2": "<i8", "up3": "<i4", "at3": "<i4", "c3": "<i8"}
    return Seating(shape, *[np.frombuffer(row[c], kind) for c, kind in kinds.items()])


def _row(batch, i: int) -> dict:
    return {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def _state_batch(bucket, cells: dict):
    """One row; its cells are bytes or arrays."""
    values = [pa.array([x.tobytes() if isinstance(x, np.ndarray) else x], pa.binary()) for x in cells.values()]
    return pa.Table.from_arrays([pa.array([bucket], pa.int32()), *values], schema=pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in cells]]))


def _runs(*keys):
    """The first places of the runs of equal keys."""
    first = np.ones(len(keys[0]), bool)
    first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(first)


def _customers(docs: DataFrame, shape: Shape) -> DataFrame:
    """The dishes of all buckets with every dish of a restaurant at one table."""

    def pairs(stream):
        cutter = shape.tokens_of()
        held, size = [], 0

        def rows():
            nonlocal held, size
            words, rooms, number, before = cutter.seated(*(np.concatenate([h[k] for h in held]) for k in range(2)))
            held, size = [], 0
            pair = np.sort(number << 32 | before)
            start = _runs(pair)
            n = np.diff(np.append(start, len(pair)))
            number, before = pair[start] >> 32, pair[start] & 0xFFFFFFFF
            bucket = shape.bucket(words)[number]
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(shape.all_buckets + 1))
            found = [(b, order[cuts[b] : cuts[b + 1]]) for b in range(shape.all_buckets) if cuts[b] < cuts[b + 1]]
            rare = shape.is_rare(rooms)
            blobs = []
            for _, at in found:
                value, size_of = np.unique(number[at], return_counts=True)
                left = before[at]
                blobs.append((words[value], size_of.astype("<i4"), rooms[left].astype(shape.room_type), words[left[rare[left]]], _packed(n[at])))
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in found], pa.int32()), *[pa.array([bytes(x[k]) for x in blobs], pa.binary()) for k in range(5)]],
                names=["bucket", "words", "size", "room", "rare", "n"],
            )

        for batch in stream:
            for texts in _blocks(batch):
                token, _, char = cutter.cut(texts)
                held.append((token, char.astype(np.int32) if char.max() < 1 << 31 else char))
                size += len(token)
                if size >= SEATED_TOKENS:
                    yield rows()
        if held:
            yield rows()

    def merge(key, group):
        word, room, before, n = [], [], [], []
        for w, s, r, x, c in zip(*(group.column(k) for k in ("words", "size", "room", "rare", "n"))):
            word.append(np.repeat(np.frombuffer(w.as_buffer(), "<u8"), np.frombuffer(s.as_buffer(), "<i4")))
            room.append(np.frombuffer(r.as_buffer(), shape.room_type).astype(np.int32))
            before.append(_contexts(shape, room[-1], np.frombuffer(x.as_buffer(), "<u8")))
            n.append(_unpacked(c.as_buffer(), len(room[-1])))
        word, room, before, n = (np.concatenate(x) for x in (word, room, before, n))
        order = np.lexsort((before, word))
        word, room, before, n = word[order], room[order], before[order], n[order]
        start = _runs(word, before)
        count = np.add.reduceat(n, start)
        words, number = np.unique(word[start], return_inverse=True)
        pair, before = number * shape.rooms + room[start], before[start]
        rare = shape.is_rare(room[start])
        # dishes of common contexts ascend by number, as contexts do by hash; the start of a text is behind them
        plain = np.flatnonzero(~rare)
        plain = plain[np.argsort(pair[plain], kind="stable")]
        cells = _pairs_of(shape, words, pair[plain], count[plain], pair[rare], before[rare], count[rare])
        dishes = Dishes(shape, words, pair[plain], count[plain], pair[rare], before[rare], count[rare])
        return _state_batch(key[0].as_py(), {**cells, "totals": dishes.first_totals(dishes.start())})

    blobs = _binary(docs).mapInArrow(pairs, "bucket int, words binary, size binary, room binary, rare binary, n binary")
    return materialize(blobs.groupBy("bucket").applyInArrow(merge, _schema((*_PAIRS, "totals"))), "hpylm-start")


def _contexts(shape: Shape, room, rare):
    """The hashes of the contexts of rooms: of common ones by their number, of rare ones as given in order."""
    out = np.full(len(room), END, dtype=np.uint64)
    own = room < len(shape.contexts)
    out[own] = shape.contexts[room[own]]
    out[shape.is_rare(room)] = rare
    return out


_TOLD = "home int, bucket int, asked int, contexts binary, sums binary"


def _told_rows(shape: Shape, bucket: int, contexts, sums, asked):
    """What a bucket tells each home: contexts and their sums; those asked for come first."""
    home = shape.home(contexts)
    found = np.unique(home)
    order = np.argsort(~asked, kind="stable")
    parts = [order[home[order] == h] for h in found]
    return pa.RecordBatch.from_arrays([
        pa.array(found, pa.int32()), pa.array(np.full(len(found), bucket), pa.int32()), pa.array([int(asked[at].sum()) for at in parts], pa.int32()),
        pa.array([contexts[at].tobytes() for at in parts], pa.binary()), pa.array([sums[:, at].astype("<i8").tobytes() for at in parts], pa.binary()),
    ], names=["home", "bucket", "asked", "contexts", "sums"])


def _told_dishes(state: DataFrame, shape: Shape, kept: int | None) -> DataFrame:
    """Dishes of all rare contexts, asked for by buckets in which they vary; or, for the kept sweeps, customers and dishes, asked for by all."""

    def batches(stream):
        for batch in stream:
            for i in range(batch.num_rows):
                row = _row(batch, i)
                contexts, at = np.unique(np.frombuffer(row["rare"], "<u8"), return_inverse=True)
                n = _unpacked(row["rare_n"], len(at))
                sums = [np.bincount(at, minlength=len(contexts))]
                if kept is None:
                    asked = np.bincount(at, weights=n > 1, minlength=len(contexts)) > 0
                else:
                    asked = np.ones(len(contexts), bool)
                    sums = [np.bincount(at, weights=n, minlength=len(contexts)), *sums, *np.zeros((kept, len(contexts)))]
                if len(contexts):
                    yield _told_rows(shape, row["bucket"], contexts, np.array(sums), asked)

    return state.select("bucket", "rare", "rare_n").mapInArrow(batches, _TOLD)


def _told_tables(state: DataFrame, shape: Shape, kept: bool) -> DataFrame:
    """Tables beyond one a dish of the rare contexts that vary in a bucket: of the last sweep, asked for, or of all kept ones."""
    cell = "kept" if kept else "seats"

    def batches(stream):
        for batch in stream:
            for i in range(batch.num_rows):
                row = _row(batch, i)
                contexts, at = np.frombuffer(row["contexts3"], "<u8"), np.frombuffer(row["at3"], "<i4")
                if not len(contexts):
                    continue
                size = int(row["size"])
                seats = [np.frombuffer(row[cell][k : k + size], "<i4")[-len(at) :] for k in range(0, len(row[cell]), size)]
                sums = [np.bincount(at, weights=t - 1, minlength=len(contexts)) for t in seats]
                if kept:
                    sums = [*np.zeros((2, len(contexts))), *sums]
                yield _told_rows(shape, row["bucket"], contexts, np.array(sums), np.full(len(contexts), not kept))

    return state.select("bucket", "contexts3", "at3", cell, F.length("seats").alias("size")).mapInArrow(batches, _TOLD)


def _answers(told: DataFrame) -> DataFrame:
    """The sums of all buckets, for each bucket as it asked; and under bucket -1 for all contexts of a home."""

    def add(key, group):
        lists = [np.frombuffer(c.as_buffer(), "<u8") for c in group.column("contexts")]
        values = [np.frombuffer(s.as_buffer(), "<i8").reshape(-1, len(c)) for s, c in zip(group.column("sums"), lists)]
        contexts, at = np.unique(np.concatenate(lists), return_inverse=True)
        sums = np.array([np.bincount(at, weights=v, minlength=len(contexts)) for v in np.concatenate(values, axis=1)]).astype("<i8")
        asked, starts = group.column("asked").to_pylist(), np.cumsum([0, *map(len, lists)])
        rows = [(b, b"", sums[:, at[lo : lo + k]].tobytes()) for b, k, lo in zip(group.column("bucket").to_pylist(), asked, starts) if k]
        rows.append((-1, contexts.tobytes(), sums.tobytes()))
        return pa.table({
            "home": pa.array([key[0].as_py()] * len(rows), pa.int32()), "bucket": pa.array([r[0] for r in rows], pa.int32()),
            "contexts": pa.array([r[1] for r in rows], pa.binary()), "sums": pa.array([r[2] for r in rows], pa.binary()),
        })

    return told.groupBy("home").applyInArrow(add, "home int, bucket int, contexts binary, sums binary")


def _heard(shape: Shape, contexts, answers, values: int) -> np.ndarray:
    """Sums by context from the rows that all homes sent."""
    out = np.zeros((values, len(contexts)), np.int64)
    home = shape.home(contexts)
    for h, sums in zip(answers.column("home").to_pylist(), answers.column("sums")):
        if h is not None:
            out[:, home == h] = np.frombuffer(sums.as_buffer(), "<i8").reshape(values, -1)
    return out


def _next(df: DataFrame, label: str, *before: DataFrame) -> DataFrame:
    """Write a state and drop the tables it takes the place of."""
    _clean(df.sparkSession)
    done = materialize(df, label)
    for old in before:
        _drop(old)
    return done


def _drop(table: DataFrame) -> None:
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path, files = hadoop_path(table.sparkSession, folder)
        files.delete(path, True)


def _clean(spark) -> None:
    """Spark drops the files of a shuffle when the driver's JVM has collected its plan."""
    gc.collect()
    spark._jvm.System.gc()


def _sum_totals(state: DataFrame, width: int) -> np.ndarray:
    """The totals of all buckets, added up in tasks; a few vectors reach the driver."""

    def local(stream):
        total = np.zeros(width)
        for batch in stream:
            for t in batch.column("totals"):
                total += np.frombuffer(t.as_buffer(), "<f8")
        from pyspark import TaskContext

        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 16], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "totals"])

    def add(key, group):
        total = sum(np.frombuffer(t.as_buffer(), "<f8") for t in group.column("totals"))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "totals": pa.array([total.tobytes()], pa.binary())})

    parts = state.select("totals").mapInArrow(local, "part int, totals binary").groupBy("part").applyInArrow(add, "part int, totals binary")
    return sum((np.frombuffer(r["totals"], "<f8") for r in parts.collect()), np.zeros(width))


class Model:
    """A trained model: its restaurants, the totals of the kept sweeps, the bucket rows and the rare contexts by home."""

    def __init__(self, shape: Shape, totals: list[np.ndarray], state: DataFrame, homes: DataFrame):
        self.shape, self.totals, self.state, self.homes = shape, totals, state, homes


def train(docs: DataFrame, sweeps: int = SWEEPS, kept: int = KEPT) -> Model:
    """Learn from ``text`` of all rows of ``docs``; NULL counts as empty, repeated rows count again."""
    common.small_batches(docs.sparkSession)
    counts = materialize(word_counts(docs), "hpylm-words")
    shape = Shape(counts)
    pairs = _customers(docs, shape)
    _drop(counts)
    contexts, width = len(shape.contexts), len(shape.contexts) + 2 * len(shape.classes) + 2
    first = _sum_totals(pairs, 2 * contexts + width + 6)
    customers, dishes, now, few = np.split(first, [contexts, 2 * contexts, 2 * contexts + width])
    shape.discount = tuple(float(np.clip(few[2 * k] / max(few[2 * k] + 2 * few[2 * k + 1], 1), 0.1, 0.95)) for k in range(3))

    def whole(now):
        return np.concatenate([customers, dishes + now[:contexts], now[contexts:]])

    state, totals, remembered = pairs.select("bucket", *_PAIRS), whole(now), []
    told = _told_dishes(pairs, shape, None)
    for turn in range(sweeps):
        swept = _sweep(state, _answers(told).where("bucket >= 0"), shape, totals, turn, keep=turn >= sweeps - kept)
        state = _next(swept, f"hpylm-sweep-{turn}", *([state] if turn else []))
        told = _told_tables(state, shape, kept=False)
        totals = whole(_sum_totals(state, width))
        if turn >= sweeps - kept:
            remembered.append(totals)
    told = _told_dishes(pairs, shape, kept).unionAll(_told_tables(state, shape, kept=True))
    homes = _next(_answers(told), "hpylm-homes")
    done = _next(_finished(pairs, state, homes, shape, kept), "hpylm-model", pairs, state)
    rare = _next(homes.where("bucket < 0").select("home", "contexts", "sums"), "hpylm-rare", homes)
    return Model(shape, remembered, done, rare)


def _first_seating(shape: Shape, row: dict) -> dict:
    """Every dish of a restaurant at one table."""
    dishes = _load(shape, row)
    row = {c: getattr(dishes, c) for c in _SEATING}
    row.update({c: row[c].astype("<i4") for c in ("room2", "up2", "up3", "at3")})
    return {**row, "contexts3": dishes.contexts3, "dishes3": b"", "seats": dishes.start(), "kept": b"", "totals": b""}


def _sweep(state: DataFrame, answers: DataFrame, shape: Shape, totals: np.ndarray, turn: int, keep: bool) -> DataFrame:
    cells = _SEATING + _MOVING

    def seated(key, left, right):
        row = {c: left.column(c)[0].as_py() for c in left.schema.names[1:]}
        bucket = key[0].as_py()
        if not turn:
            row = _first_seating(shape, row)
        seating = _load_seating(shape, row)
        heard = _heard(shape, np.frombuffer(row["contexts3"], "<u8"), right, 1)[0]
        if not turn:  # nobody has more than one table a dish
            row["dishes3"], tables = heard, heard
        else:
            tables = heard + np.frombuffer(row["dishes3"], "<i8")
        rng = np.random.Generator(np.random.PCG64([SEED, turn, bucket]))
        seats = np.frombuffer(row["seats"], "<i4")
        seats = seating.sweep(seats, totals, tables[seating.at3] - seating.split(seats)[3], rng)
        row.update(seats=seats, kept=row["kept"] + seats.tobytes() if keep else row["kept"], totals=seating.totals(seats))
        out = _state_batch(bucket, row)
        row = seating = seats = None
        common.give_back()
        return out

    return state.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(seated, _schema(cells))


def _finished(pairs: DataFrame, state: DataFrame, homes: DataFrame, shape: Shape, kept: int) -> DataFrame:
    """All dishes, the seats of the kept sweeps, and the customers and tables of each bucket's rare contexts."""
    cells = _PAIRS + ("kept", "sums")

    def joined(key, left, right):
        row = {c: left.column(c)[0].as_py() for c in _PAIRS}
        heard = _heard(shape, np.unique(np.frombuffer(row["rare"], "<u8")), right, 2 + kept)
        seats = [c for h, c in zip(right.column("home").to_pylist(), right.column("contexts")) if h is None]
        return _state_batch(key[0].as_py(), {**row, "kept": _packed(np.frombuffer(seats[0].as_buffer(), "<i4")), "sums": _packed(np.concatenate([heard[:1], heard[1] + heard[2:]]).ravel())})

    seats = state.select(F.lit(None).cast("int").alias("home"), "bucket", F.col("kept").alias("contexts"), F.lit(b"").alias("sums"))
    others = homes.where("bucket >= 0").unionAll(seats)
    return pairs.select("bucket", *_PAIRS).groupBy("bucket").cogroup(others.groupBy("bucket")).applyInArrow(joined, _schema(cells))


def _kept(dishes: Dishes, row: dict, n: int) -> list[np.ndarray]:
    return np.split(_unpacked(row["kept"], n * len(dishes.start())), n)


def _frequent(model: Model):
    """log10 probability of each frequent word in each near context, or 0 where it has not been seen."""
    shape, totals = model.shape, model.totals

    def batches(stream):
        for batch in stream:
            for i in range(batch.num_rows):
                row = _row(batch, i)
                dishes = _load(shape, row)
                p = dishes.predict(np.zeros(len(shape.near), np.int64), shape.near, _kept(dishes, row, len(totals)), totals)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["bucket"] - shape.buckets], pa.int32()), pa.array([np.log10(p).tobytes()], pa.binary())], names=["word", "p"]
                )
                row = dishes = p = None
                common.give_back()

    table = np.zeros((len(shape.frequent), len(shape.near)))
    hot = model.state.where(F.col("bucket") >= shape.buckets)
    for row in hot.mapInArrow(batches, "word int, p binary").collect():
        table[row["word"]] = np.frombuffer(row["p"], "<f8")
    return table


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, text) -> (doc_id, n_tokens, n_known, train_tokens, base_score, score), a row for each row.

    ``score`` is the model's log10 probability of the text and its end, ``base_score`` that of
    add-one counts.  Frequent words in near contexts are scored where the text is read; the others
    go to the bucket of their word, packed by chunks of documents, and a few numbers a
    document come back (a very frequent word has copies of its bucket).  Words after a rare context
    that has no dish in the bucket go on to that context's home.  NULL texts count as empty
    and have an end token only.  ``doc_id`` must be an integer; it may be NULL or repeated.
    """
    shape, totals = model.shape, model.totals
    table = _frequent(model)
    near = np.full(shape.rooms, -1)
    near[shape.near] = np.arange(len(shape.near))
    spread = "bucket long, chunk long, words binary, size binary, room binary, doc binary, n binary, rare binary"

    def blocks(stream):
        from pyspark import TaskContext

        cutter, task = shape.tokens_of(), TaskContext.get().partitionId()
        number, ids, held, size = 0, [], [], 0

        def flush():
            nonlocal number, ids, held, size
            chunk = (task << 32) | number
            token, char, doc = (np.concatenate([x[k] for x in held]) for k in range(3))
            held = []
            words, rooms, word, before = cutter.seated(token, char)
            n, tokens = len(ids), np.bincount(doc, minlength=len(ids))
            token = char = None
            place, hot = _find(shape.frequent, words, np.ones(len(words), bool))
            local = hot[word] & (near[rooms] >= 0)[before]
            w, d = word[local], doc[local]
            logs = np.bincount(d, weights=np.log10(shape.frequent_count[place] + 1.0)[w], minlength=n)
            score_ = np.bincount(d, weights=table[place[w], near[rooms][before[local]]], minlength=n)
            known = np.bincount(d, minlength=n)
            out = _rest_rows(words, rooms, word[~local], before[~local], doc[~local], chunk)
            missing = np.array([i is None for i in ids])
            plain = np.array([0 if i is None else i for i in ids], dtype="<i8")
            cells = [plain.tobytes(), missing.tobytes(), tokens.astype("<i8").tobytes(), np.concatenate([logs, score_]).tobytes(), known.astype("<i8").tobytes(), b""]
            out.append((-1 - chunk, chunk, *cells))  # a group of its own
            number, ids, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()), *[pa.array([r[k] for r in out], pa.binary()) for k in range(2, 8)]],
                names=["bucket", "chunk", "words", "size", "room", "doc", "n", "rare"],
            )

        def _rest_rows(words, rooms, word, before, doc, chunk):
            bucket = shape.bucket(words)
            order = np.lexsort((words, bucket))  # words by bucket
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            pairs, pair = np.unique(rank[word] << 32 | before, return_inverse=True)
            row = np.sort(pair << 16 | doc)  # a chunk has no more texts than two bytes count
            start = _runs(row)
            n = np.diff(np.append(start, len(row)))
            doc, pair = (row[start] & 0xFFFF).astype("<u2"), pairs[row[start] >> 16]
            word, before = order[pair >> 32], pair & 0xFFFFFFFF
            cuts = np.searchsorted(bucket[word], np.arange(shape.all_buckets + 1))
            room, rare = rooms.astype(shape.room_type)[before], shape.is_rare(rooms)[before]
            rows = []
            for b in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
                lo, hi = cuts[b], cuts[b + 1]
                head = _runs(word[lo:hi])
                count = np.diff(np.append(head, hi - lo))
                part = int(common.mix(np.array([chunk], np.uint64))[0]) % int(shape.parts[b - shape.buckets]) if b >= shape.buckets else 0
                rows.append((part << 32 | b, chunk, words[word[lo:hi][head]].tobytes(), count.astype("<i4").tobytes(), room[lo:hi].tobytes(), doc[lo:hi].tobytes(),
                             _packed(n[lo:hi]), words[before[lo:hi][rare[lo:hi]]].tobytes()))
            return rows

        for batch in stream:
            at = 0
            column = batch.column("doc_id")
            for texts in _blocks(batch):
                block_ids = column.slice(at, len(texts)).to_pylist()
                at += len(texts)
                for lo in range(0, len(texts), CHUNK_DOCS):
                    some = texts[lo : lo + CHUNK_DOCS]
                    if ids and len(ids) + len(some) > CHUNK_DOCS:
                        yield flush()
                    token, owner, char = cutter.cut(some)
                    held.append((token, char, owner + len(ids)))
                    ids += block_ids[lo : lo + CHUNK_DOCS]
                    size += len(token)
                    if size >= CHUNK_TOKENS:
                        yield flush()
        if ids:
            yield flush()

    names = ["home", "chunk", "ids", "missing", "tokens", "logs", "known", "rare"]
    judged_schema = "home int, chunk long, " + ", ".join(f"{c} binary" for c in names[2:])

    def judged_rows(out):
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        return pa.table({name: pa.array([r[k] for r in out], kind) for k, (name, kind) in enumerate(zip(names, kinds))})

    def judge(key, left, right):
        bucket = key[0].as_py()
        out, far = [], []
        dishes = kept = sums = None
        if right.num_rows:
            row = _row(right, 0)
            dishes = _load(shape, row)
            kept = _kept(dishes, row, len(totals))
            contexts = np.unique(dishes.rare)
            sums = _unpacked(row["sums"], (1 + len(totals)) * len(contexts)).reshape(1 + len(totals), -1)
        elif bucket >= 0:
            dishes = Dishes(shape, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            kept, contexts, sums = [dishes.start()] * len(totals), dishes.rare, np.zeros((1 + len(totals), 0), np.int64)
        for i in range(left.num_rows):
            cells = {c: left.column(c)[i] for c in left.schema.names}
            if bucket < 0:
                out.append([None, cells["chunk"].as_py(), *[cells[c].as_py() for c in ("words", "size", "room", "doc", "n")], b""])
                continue
            words, size = np.frombuffer(cells["words"].as_buffer(), "<u8"), np.frombuffer(cells["size"].as_buffer(), "<i4")
            room, doc = (np.frombuffer(cells[c].as_buffer(), kind).astype(np.int64) for c, kind in (("room", shape.room_type), ("doc", "<u2")))
            n = _unpacked(cells["n"].as_buffer(), len(doc))
            at, has = _find(dishes.words, words, np.ones(len(words), bool))
            word = np.repeat(np.where(has, at, -1), size)
            seen = dishes.count[np.maximum(word, 0)] * (word >= 0) if len(dishes.count) else np.zeros(len(word), np.int64)
            rare = np.flatnonzero(shape.is_rare(room))
            plain = np.ones(len(room), bool)
            plain[rare] = False
            p = np.ones(len(room))
            p[plain] = dishes.predict(word[plain], room[plain], kept, totals)
            if len(rare):
                before = np.frombuffer(cells["rare"].as_buffer(), "<u8")
                p[rare], parents, here = dishes.predict_rare(np.repeat(words, size)[rare], word[rare], room[rare], before, kept, totals, contexts, sums)
                away = rare[~here]
                p[away] = 1
                far.append((np.full(len(away), cells["chunk"].as_py()), doc[away], n[away], before[~here], *[x[~here] for x in parents]))
            p = np.log10(p)
            docs_, where = np.unique(doc, return_inverse=True)
            logs = [np.bincount(where, weights=n * x) for x in (np.log10(seen + 1.0), p)]
            known = np.bincount(where, weights=n * (seen > 0)).astype("<i8")
            out.append([None, cells["chunk"].as_py(), docs_.astype("<u2").tobytes(), b"", b"", np.concatenate(logs).tobytes(), known.tobytes(), b""])
        if far:
            chunk, doc, n, before, *parents = (np.concatenate(x) for x in zip(*far))
            home = shape.home(before)
            for h in np.unique(home).tolist():
                some = home == h
                out.append([h, None, doc[some].astype("<u2").tobytes(), b"", chunk[some].astype("<i8").tobytes(),
                            np.array([x[some] for x in parents]).tobytes(), n[some].astype("<i8").tobytes(), before[some].tobytes()])
        dishes = kept = row = far = None
        common.give_back()
        return judged_rows(out)

    def judge_far(key, left, right):
        """Words that have no dish in their rare context, by its home; a context nobody told of is an empty restaurant."""
        contexts = np.concatenate([np.frombuffer(c.as_buffer(), "<u8") for c in right.column("contexts")] or [np.zeros(0, np.uint64)])
        values = 2 + len(totals)  # customers, dishes, and tables beyond them for each sweep
        sums = np.concatenate([np.frombuffer(c.as_buffer(), "<i8").reshape(values, -1) for c in right.column("sums")] or [np.zeros((values, 0))], axis=1)
        out = []
        for i in range(left.num_rows):
            kinds = {"tokens": "<i8", "ids": "<u2", "known": "<i8", "rare": "<u8"}
            chunk, doc, n, before = (np.frombuffer(left.column(c)[i].as_buffer(), kind) for c, kind in kinds.items())
            parents = np.frombuffer(left.column("logs")[i].as_buffer(), "<f8").reshape(len(totals), -1)
            at, has = _find(contexts, before, np.ones(len(before), bool))
            p = np.zeros(len(before))
            for k, parent in enumerate(parents):
                more = (STRENGTH[2] + shape.discount[2] * (sums[1] + sums[2 + k])[at]) / (STRENGTH[2] + sums[0][at]) if len(contexts) else 1.0
                p += np.where(has, more, 1.0) * parent
            out.append((chunk, doc, n * np.log10(p / len(totals))))
        if not out:
            return judged_rows([])
        chunk, doc, logs = (np.concatenate(x) for x in zip(*out))
        order = np.lexsort((doc, chunk))
        chunk, doc, logs = chunk[order], doc[order], logs[order]
        start = _runs(chunk, doc)
        chunk, doc, logs = chunk[start], doc[start], np.add.reduceat(logs, start)
        cuts = np.append(_runs(chunk), len(chunk))
        return judged_rows([
            [None, int(chunk[lo]), doc[lo:hi].tobytes(), b"", b"", np.concatenate([np.zeros(hi - lo), logs[lo:hi]]).tobytes(), np.zeros(hi - lo, "<i8").tobytes(), b""]
            for lo, hi in zip(cuts, cuts[1:])
        ])

    def finish(key, group):
        ids = missing = None
        parts = []
        for i in range(group.num_rows):
            cells = {c: group.column(c)[i].as_buffer() for c in ("ids", "missing", "tokens", "logs", "known")}
            if len(cells["tokens"]):
                ids, missing, tokens = np.frombuffer(cells["ids"], "<i8"), np.frombuffer(cells["missing"], bool), np.frombuffer(cells["tokens"], "<i8")
                own = (np.arange(len(ids)), cells)
                parts.insert(0, own)
            else:
                parts.append((np.frombuffer(cells["ids"], "<u2").astype(np.int64), cells))
        logs, score_, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for doc, cells in parts:
            two = np.frombuffer(cells["logs"], "<f8").reshape(2, -1)
            np.add.at(logs, doc, two[0])
            np.add.at(score_, doc, two[1])
            np.add.at(known, doc, np.frombuffer(cells["known"], "<i8"))
        base = logs - tokens * np.log10(shape.tokens + shape.vocabulary + 1)
        n = len(ids)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64(), mask=missing), "n_tokens": pa.array(tokens, pa.int64()), "n_known": pa.array(known),
            "train_tokens": pa.array(np.full(n, shape.tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(score_),
        })

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    packed = given.mapInArrow(blocks, spread)
    place = F.col("bucket").cast("long")
    if shape.parts.max(initial=1) > 1:
        parts = F.array(*[F.lit(int(k)) for k in shape.parts])
        copies = F.when(place >= shape.buckets, F.get(parts, F.col("bucket") - shape.buckets)).otherwise(1)
        place = F.explode(F.transform(F.sequence(F.lit(0), copies - 1), lambda k: F.shiftleft(k.cast("long"), 32) + place))
    state = model.state.withColumn("bucket", place).groupBy("bucket")
    judged = _next(packed.groupBy("bucket").cogroup(state).applyInArrow(judge, judged_schema), "hpylm-judged")
    near_rows, far = judged.where("home IS NULL"), judged.where("home IS NOT NULL")
    if not far.isEmpty():
        far = far.groupBy("home").cogroup(model.homes.groupBy("home")).applyInArrow(judge_far, judged_schema)
    _clean(docs.sparkSession)
    result = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return near_rows.unionAll(far).groupBy("chunk").applyInArrow(finish, result)
