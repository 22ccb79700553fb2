"""How far the word frequencies of a language's sources lie apart.

Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased: one
``bytes.translate`` lowers letters and blanks every other ASCII byte, ``bytes.split`` cuts,
and a ``Counter`` per document gives frequencies (its values) and document counts (its
keys).  A task adds documents of one group up and hands them on every ``HELD`` entries, so
its memory does not grow with its split; Spark sums the sparse counts.

A language keeps the terms of at least ``LEAST_DOCUMENTS`` of its documents.  A group is a
(lang, source) that occurs, with or without terms; it gives each of the V kept terms

    p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)),

N its occurrences of kept terms.  All arithmetic is in whole numbers.  Nulls count as '';
repeated rows count as often as they occur; an empty table gives no row; columns other than
text, lang and source are not read.

Terms a group does not hold share one p, so only held terms are rows.  The distance of two
sources is summed over blocks of terms: a task has a block as a matrix of some ``CELLS``
numbers (one term at least) and gives a partial sum for ``CELLS`` pairs of sources at most.
The pairs themselves are the result: S sources have S * (S - 1) of them.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

LEAST_DOCUMENTS = 30
UNIT, PRIOR = 1_000_000_000, 5
TOP = 50
HELD = 200_000  # entries a task adds up before it hands them on
CELLS = 1 << 16

# fixed values: the bytes of a term, upper-case letters lowered, all else a separator
SEPARATED = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def _count_batches(batches):
    held: dict[tuple, tuple[Counter, Counter]] = {}
    entries = 0

    def out():
        rows = [
            (lang, source, term, n, documents[term])
            for (lang, source), (occurrences, documents) in held.items()
            for term, n in occurrences.items()
        ]
        columns = list(zip(*rows)) if rows else [[]] * 5
        kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
        arrays[2] = arrays[2].cast(pa.string())
        return pa.RecordBatch.from_arrays(arrays, names=["lang", "source", "term", "n", "docs"])

    for batch in batches:
        for lang, source, text in zip(*[batch.column(c) for c in ("lang", "source", "text")]):
            lang, source, text = lang.as_py(), source.as_py(), text.as_py()
            found = Counter((text or b"").translate(SEPARATED).split())
            found[b""] = 0  # the document itself, so that a group without terms is known
            occurrences, documents = held.setdefault((lang, source), (Counter(), Counter()))
            entries -= len(occurrences)
            occurrences.update(found)
            documents.update(found.keys())
            entries += len(occurrences)
            if entries >= HELD:
                yield out()
                held.clear()
                entries = 0
    yield out()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of every term of every group.

    The empty term stands for the group itself.
    """
    given = docs.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")],
        F.col("text").cast("binary").alias("text"),
    )
    counted = given.mapInArrow(_count_batches, _COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """p, in decimals: the product outgrows 64 bits on large corpora."""
    wide = (F.lit(UNIT).cast("decimal(12,0)") * (count + PRIOR).cast("decimal(19,0)")).cast("decimal(38,0)")
    return F.call_function("div", wide, (total + terms * PRIOR).cast("decimal(38,0)")) + 1


class Audit:
    """Kept terms and groups of ``docs``, written once; parts of the report are read from them."""

    def __init__(self, docs: DataFrame, least: int = LEAST_DOCUMENTS):
        counts = materialize(term_counts(docs), "audit-counts")
        per_lang = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs"))
        terms = materialize(per_lang.where(F.col("docs") >= least).drop("docs"), "audit-terms")
        langs = terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
        kept = counts.where("term <> ''").drop("docs").join(terms, ["lang", "term"])
        self.kept = materialize(kept, "audit-kept")
        totals = self.kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = counts.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left")
        groups = groups.fillna(0, ["terms", "total_lang", "total"])
        absent = F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms")))
        #: (lang, source, terms, total_lang, total, absent): ``absent`` is the p of a term without occurrences
        self.groups = materialize(groups.withColumn("absent", absent), "audit-groups")

    def terms_above(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value, rank): terms a source uses more than its language does."""
        p = _share(F.col("n"), F.col("total"), F.col("terms"))
        q = _share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
        above = self.kept.join(self.groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value"))
        return _ranked(above.where("value > 0")).where(F.col("rank") <= top)

    def distances(self) -> DataFrame:
        """(lang, source, item, value, rank): every other source of the language by distance."""
        sizes = self.groups.groupBy("lang").agg(F.count("*").alias("sources"), F.max("terms").alias("terms"))
        sizes = sizes.where("terms > 0").select(
            "lang",
            F.ceil(F.col("sources") * F.col("terms") / CELLS).alias("blocks"),
            F.ceil(F.col("sources") * F.col("sources") / CELLS).alias("stripes"),
        )
        up_to = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
        groups = (
            self.groups.select("lang", "source", "absent").join(sizes, "lang")
            .select("*", F.explode(up_to("blocks")).alias("block"))
            .select("lang", "block", F.explode(up_to("stripes")).alias("stripe"), "source", "absent", "stripes")
        )
        shares = self.kept.join(self.groups.select("lang", "source", "terms", "total"), ["lang", "source"]).join(sizes, "lang")
        entries = shares.select(
            "lang", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), F.explode(up_to("stripes")).alias("stripe"),
            "source", "term", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        )
        key = ("lang", "block", "stripe")
        parts = entries.groupBy(*key).cogroup(groups.groupBy(*key)).applyInArrow(_block_distances, "lang string, a string, b string, value bigint")
        sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
        both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
        known = sums.select("lang", both.alias("_p"), "value").select("lang", "_p.source", "_p.item", "value")
        # a language without kept terms has pairs as well, all at distance 0
        bare = self.groups.where("terms = 0").select("lang", "source")
        pairs = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
        return _ranked(known.unionByName(pairs.withColumn("value", F.lit(0).cast("long"))))

    def report(self, top: int = TOP) -> DataFrame:
        """Both parts: (lang, source, part, item, value, rank)."""
        parts = [self.distances().withColumn("part", F.lit("pair")), self.terms_above(top).withColumn("part", F.lit("term"))]
        return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def _block_distances(entries: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of |p - q| over the terms of a block, for the pairs whose first source is of this stripe."""
    names = groups.column("source").to_pylist()
    order = sorted(range(len(names)), key=lambda i: names[i].encode())
    names = [names[i] for i in order]
    place = {name: i for i, name in enumerate(names)}
    terms = entries.column("term").combine_chunks().dictionary_encode()
    p = np.empty((len(names), len(terms.dictionary)), dtype=np.int64)
    p[:] = groups.column("absent").to_numpy()[order][:, None]
    rows = np.fromiter((place[s] for s in entries.column("source").to_pylist()), np.int64, len(entries))
    p[rows, terms.indices.to_numpy()] = entries.column("p").to_numpy()
    stripe, stripes = groups.column("stripe")[0].as_py(), groups.column("stripes")[0].as_py()
    first = np.arange(stripe, max(len(names) - 1, 0), stripes)
    sums = [np.abs(p[i + 1 :] - p[i]).sum(axis=1) for i in first]
    a = np.repeat(first, [len(s) for s in sums]) if sums else np.zeros(0, np.int64)
    b = np.concatenate([np.arange(i + 1, len(names)) for i in first]) if sums else a
    texts = pa.array(names, pa.string())
    lang = pa.array([groups.column("lang")[0].as_py()] * len(a), pa.string())
    value = np.concatenate(sums) if sums else a
    return pa.table({"lang": lang, "a": texts.take(pa.array(a)), "b": texts.take(pa.array(b)), "value": pa.array(value, pa.int64())})
