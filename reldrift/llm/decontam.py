"""Benchmark decontamination by spaced seeds, in Spark expressions.

A seed is a mask over neighbouring words: the marked words are hashed, the others may
differ.  Seeds of all benchmark texts are joined with seeds at every word of every
document; a hit gives a document, a benchmark text and the offset between them.  The words
of both are then compared at that offset, each against its counterpart, so substituted
words count as differences and nothing more.  A document leaks a benchmark text if at one
offset half of the benchmark's words, eight at least, are equal, or ``LOCAL_EQUAL`` of
some ``LOCAL_WORDS`` neighbouring words.  A benchmark text of fewer than eight words must
be there in full.

Wherever half of n >= 16 words are equal, or eight of fewer, one of the masks has all its
marked words among them: most equal words without a hit are under half for every n of 16
to 31 (and under eight below), and longer texts fall into such pieces.  So a hit is sure
up to a share of one half substituted, however the substitutions lie, which is the rule.

A seed can only be a benchmark seed if its first two marked words, its opening, are those of
one.  The masks have four distances between these two, so a word has four openings for
eighteen seeds: a bitmap of the benchmark's openings is asked first, and seeds are hashed
where it says yes.  Another lets only those seeds to the join that some benchmark seed may
equal, so the shuffle carries hits and not words.  Both have a fixed size.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.membership import bitmap_of, cannot_be_in, may_be_in
from ..session import materialize
from .secret_scan import row_key

MASKS = (
    "1111", "10111", "11011", "11101", "101011", "101101", "110011", "110101", "111001", "1010011", "10010011",
    "11000011", "100100011", "100100101", "101000101", "1000100011", "1010000101", "1100001001",
)
SHARE, LEAST = 0.5, 8
SEED_BITS, OPENING_BITS = 24, 22
LOCAL_WORDS, LOCAL_EQUAL = 40, 30


def words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def word_hashes(words_: Column | str) -> Column:
    return F.transform(words_, lambda w: F.xxhash64(w))


def _masks(masks: list[str]) -> Column:
    """The masks as an array of structs: number, length and the marked places after the first."""
    marked = [[i for i, m in enumerate(mask) if m == "1"][1:] for mask in masks]
    width = max(map(len, marked))
    return F.array(*[
        F.struct(
            F.lit(int(mask, 2)).alias("mask"), F.lit(len(mask)).alias("span"),
            *[F.lit(at[i] if i < len(at) else None).cast("int").alias(f"m{i}") for i in range(width)],
        )
        for mask, at in zip(masks, marked)
    ])


def _seed(masks: list[str], mask: Column, hashes: Column, at: Column) -> Column:
    """Hash of the words ``mask`` marks from place ``at``; NULL where the mask goes beyond the text."""
    width = max(m.count("1") for m in masks) - 1
    marked = [F.get(hashes, at + mask[f"m{i}"]) for i in range(width)]
    return F.when(at + mask["span"] <= F.size(hashes), F.xxhash64(mask["mask"], F.get(hashes, at), *marked))


def _opening(gap: Column, hashes: Column, at: Column) -> Column:
    """Hash of the first two marked words of the masks with ``gap`` places from one to the other."""
    return F.xxhash64(gap, F.get(hashes, at), F.get(hashes, at + gap))


def _gap() -> Column:
    """Places from the first marked word of the mask ``m`` to the second; 0 if it has one only."""
    return F.coalesce("m.m0", F.lit(0))


def benchmark_seeds(items: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """((item_id, words), (seed, opening, item, at, n_words), masks in use); texts without a word are left out.

    Items are told apart by id and words, so repeated rows count once.
    """
    cut = items.select("item_id", words(F.coalesce("text", F.lit(""))).alias("item_words")).where(F.size("item_words") > 0).distinct()
    cut = materialize(cut.withColumn("item", F.xxhash64("item_id", F.array_join("item_words", " "))), "decontam-items")
    few = [r["n"] for r in cut.select(F.size("item_words").alias("n")).where(F.col("n") < LEAST).distinct().orderBy("n").collect()]
    masks = list(dict.fromkeys([*MASKS, *["1" * n for n in few]]))
    n = F.size("item_words")
    at = cut.select("item", word_hashes("item_words").alias("hashes"), F.explode(F.sequence(F.lit(0), n - 1)).alias("at"))
    at = at.select("*", F.explode(_masks(masks)).alias("m"))
    n = F.size("hashes")
    # a short text has the mask of its own length only, and only short texts have such masks
    own = F.when(n < LEAST, F.col("m.mask") + 1 == F.pow(F.lit(2), n)).otherwise(F.col("m.mask").isin(*[int(m, 2) for m in MASKS]))
    opening = _opening(_gap(), F.col("hashes"), F.col("at")).alias("opening")
    seeds = at.where(own).select("item", "at", n.alias("n_words"), _seed(masks, F.col("m"), F.col("hashes"), F.col("at")).alias("seed"), opening)
    return cut, materialize(seeds.where("seed is not null"), "decontam-seeds"), masks


def find_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """(_row, doc_id, item_id, n_equal, n_words, at): the benchmark texts each document leaks.

    ``at`` is the word of the document where the benchmark text would begin, below 0 if it
    begins before it; of several offsets the one with most equal words counts.  NULL and
    empty texts leak nothing; repeated documents are listed once, with one ``_row``.
    """
    keyed = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("_t"))
    keyed = keyed.select("doc_id", row_key(keyed, "_t").alias("_row"), "_t")
    cut, seeds, masks = benchmark_seeds(items)
    held, begun = bitmap_of(seeds, F.col("seed"), SEED_BITS), bitmap_of(seeds, F.col("opening"), OPENING_BITS)
    hashed = keyed.select("_row", word_hashes(words(F.col("_t"))).alias("hashes")).where(F.size("hashes") > 0)
    at = hashed.select("_row", "hashes", F.explode(F.sequence(F.lit(0), F.size("hashes") - 1)).alias("p"))
    gaps = sorted({max(mask.find("1", 1), 0) for mask in masks})
    openings = F.array(*[_opening(F.lit(gap), F.col("hashes"), F.col("p")) for gap in gaps])
    opened = may_be_in(at.select("_row", "hashes", "p", F.posexplode(openings).alias("g", "opening")), F.col("opening"), begun, OPENING_BITS)
    # masks are data, and every seed is exploded: it is computed once, and the code is as small as for one mask
    masked = opened.select("_row", "hashes", "p", "g", F.explode(_masks(masks)).alias("m"))
    masked = masked.where(_gap() == F.get(F.array(*[F.lit(gap) for gap in gaps]), F.col("g")))
    each = masked.select("_row", "p", F.explode(F.array(_seed(masks, F.col("m"), F.col("hashes"), F.col("p")))).alias("seed"))
    found = may_be_in(each.where(F.col("seed").isNotNull()), F.col("seed"), held, SEED_BITS)
    hits = found.join(seeds, "seed").select("_row", "item", "n_words", (F.col("p") - F.col("at")).alias("offset")).distinct()
    hits = materialize(hits, "decontam-hits")
    # texts are narrower than their words, so they are cut once more behind the shuffle; of the
    # words only the window a benchmark text would fill goes on
    again = may_be_in(keyed, F.col("_row.a"), bitmap_of(hits, F.col("_row.a")))
    again = again.dropDuplicates(["_row"]).join(hits.groupBy("_row").agg(F.collect_list(F.struct("item", "offset", "n_words")).alias("hits")), "_row")
    pairs = again.select("_row", "doc_id", words(F.col("_t")).alias("words"), "hits")
    pairs = pairs.select("_row", "doc_id", "words", F.explode("hits").alias("h"))
    begin = F.greatest(F.col("h.offset"), F.lit(0))
    window = F.slice("words", begin + 1, F.col("h.n_words")).alias("window")
    pairs = pairs.select("_row", "doc_id", "h.item", "h.offset", (F.col("h.offset") - begin).alias("shift"), window).join(cut, "item")
    n = F.size("item_words")
    equal = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("window", i + F.col("shift")) == F.get("item_words", i))

    # the places are in order, so LOCAL_EQUAL of them stand close where the last is near the first
    close = F.zip_with("equal", F.slice("equal", LOCAL_EQUAL, F.size("equal")), lambda a, b: b - a < LOCAL_WORDS)
    judged = pairs.withColumn("equal", equal).withColumn("n_equal", F.size("equal"))
    enough = (F.col("n_equal") >= F.greatest(F.ceil(n * SHARE), F.least(F.lit(LEAST), n))) | F.exists(close, lambda x: F.coalesce(x, F.lit(False)))
    leaks = judged.where(enough).groupBy("_row", "doc_id", "item_id").agg(
        F.max(F.struct("n_equal", (-F.col("offset")).alias("back"), n.alias("n_words"))).alias("best")
    )
    return leaks.select("_row", "doc_id", "item_id", F.col("best.n_equal").cast("long").alias("n_equal"), F.col("best.n_words").cast("long").alias("n_words"), (-F.col("best.back")).cast("long").alias("at"))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the documents that leak a benchmark text; all columns stay as they are.

    Documents the leaks' bitmap rules out pass without a shuffle; the others are joined.
    """
    leaked = materialize(find_leaks(docs, items, text).select("_row").distinct(), "decontam-leaks")
    with_key = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    with_key = with_key.withColumn("__row", row_key(with_key, "__t")).drop("__t")
    named = bitmap_of(leaked, F.col("_row.a"))
    clean = cannot_be_in(with_key, F.col("__row.a"), named)
    rest = may_be_in(with_key, F.col("__row.a"), named).join(leaked.withColumnRenamed("_row", "__row"), "__row", "left_anti")
    return clean.select(*docs.columns).unionByName(rest.select(*docs.columns))
