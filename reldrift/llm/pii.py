"""Personal data: base patterns, wider candidate generators, and boosted trees that judge them.

Base spans (e-mail, IP address, payment card, phone) are always reported.  High-recall
generators propose further, overlapping candidates.  Boosted trees learn from all candidates
of the corpus in which formats and contexts the values are real.  Their label is evidence
apart from the base patterns and from the features: an e-mail or IP address that is valid
once [at] and [dot] are undone, a card number with a right check sum, a telephone number
after a word that says so (that word is no feature of telephone numbers).  Candidates are
counted by feature cell in Spark, so fitting sees every row but handles only the cells,
whose number is bounded by the feature ranges.  Per kind, a threshold is calibrated on
held-out rows; a candidate above it that overlaps no base span and is valid itself is added.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .secret_scan import redact_rows, row_key
from .spans import add_matches, joined, of_kind, only

KINDS = ("email", "ip", "card", "phone")
# possessive runs and fixed starts find what the plain patterns find, in one pass over a long run
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,5}(?:(?:[.:]|\x20?[\[(](?:dot|\.)[\])]\x20?)[0-9]{1,5}){3,5}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)?\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,14}(?![0-9])",
}
#: Feature -> the number of values it can take, from 0 upwards.
FEATURES = {"kind": 4, "digits": 21, "groups": 8, "mark": 6, "lead": 3, "left": 4, "right": 4, "word": 5}
TREES, RATE, LEAST_WEIGHT, PRECISION = 40, 0.3, 5.0, 0.98
WORDS = ("mail", "phone|tel|call|mobile|fax", "card|visa|credit|payment|iban", r"\bip\b|addr|host|server")


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum of payment cards."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        twice = d * 2
        return total + F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return (n > 0) & (F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0)


def _valid(kind: str):
    """The check a match of a base pattern must pass."""
    if kind == "ip":
        # leading zeros aside, a part above 255 has more than three digits or is above as a number
        def too_large(part: Column) -> Column:
            plain = F.regexp_replace(part, "^0+", "")
            return (F.length(plain) > 3) | (F.coalesce(F.left(plain, F.lit(3)).try_cast("int"), F.lit(0)) > 255)

        return lambda s: ~F.exists(F.split(s["match"], r"\."), too_large)
    if kind == "card":
        return lambda s: F.length(digits_only(s["match"])).between(16, 19) & luhn(digits_only(s["match"]))
    if kind == "phone":
        return lambda s: F.length(digits_only(s["match"])).between(8, 15)
    return lambda s: F.lit(True)


def _real(kind: str, s: Column) -> tuple[Column, Column]:
    """(valid, label) of a wide candidate: whether its normalised value is right, and the evidence to learn from."""
    if kind in ("email", "ip"):
        plain = F.regexp_replace(F.regexp_replace(s["match"], r"\x20?[\[(]at[\])]\x20?", "@"), r"\x20?[\[(](?:dot|\.)[\])]\x20?", ".")
        if kind == "ip":
            valid = plain.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.|$)){4}$") & ~plain.endswith(".")
        else:
            name, label = r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*", r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?"
            valid = plain.rlike(rf"^{name}@(?:{label}\.)+[A-Za-z]{{2,24}}$")
        return valid, valid
    digits = digits_only(s["match"])
    if kind == "card":
        valid = F.length(digits).between(13, 19) & luhn(digits)
        return valid, valid
    valid = F.length(digits).between(8, 15)
    return valid, valid & F.lower(s["before"]).rlike(WORDS[1])


def _features(s: Column, rank: int) -> Column:
    """Format and context of a candidate as small integers; see FEATURES for their ranges."""
    match, digits = s["match"], digits_only(s["match"])
    before = F.lower(s["before"])
    word = F.lit(0)
    for i, pattern in enumerate(WORDS):
        word = F.when(before.rlike(pattern), i + 1).otherwise(word)
    if KINDS[rank] == "phone":
        word = F.lit(0)  # it is the label's evidence

    def neighbour(text: Column) -> Column:
        return F.when(text == "", 0).when(text.rlike(r"\s"), 1).when(text.rlike("[A-Za-z0-9]"), 2).otherwise(3)

    dotted = match.contains(".") if KINDS[rank] in ("card", "phone") else F.lit(False)
    mark = F.when(match.contains("["), 4).when(match.contains("("), 3).when(match.contains("-"), 2).when(match.contains(" "), 1).when(dotted, 5).otherwise(0)
    return F.struct(
        F.lit(rank).alias("kind"),
        F.least(F.length(digits), F.lit(20)).alias("digits"),
        F.least(F.size(F.split(match, "[^0-9A-Za-z]+")), F.lit(7)).alias("groups"),
        mark.alias("mark"),
        F.when(match.startswith("+"), 1).when(match.startswith("0"), 2).otherwise(0).alias("lead"),
        neighbour(F.right(s["before"], F.lit(1))).alias("left"),
        neighbour(F.left(s["after"], F.lit(1))).alias("right"),
        word.alias("word"),
    )


def find_candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns but the text, with ``_row``, ``_held``, ``base`` and ``candidates`` (spans with features)."""
    keyed = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    keyed = keyed.withColumn("_row", row_key(keyed, "_text")).withColumn("_held", F.col("_row.b") % 5 == 0)
    names = {f"_b_{k}": p for k, p in BASE.items()} | {f"_w_{k}": p for k, p in WIDE.items()}
    found = add_matches(keyed, "_text", names)
    base = [of_kind(F.filter(f"_b_{k}", _valid(k)), k, i) for i, k in enumerate(KINDS)]
    found = found.withColumn("base", F.array_sort(F.concat(*base)))

    def candidate(kind: str, rank: int):
        return lambda s: F.struct(
            s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"),
            _features(s, rank).alias("f"),
            _real(kind, s)[0].alias("valid"), _real(kind, s)[1].alias("label"),
            F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])).alias("taken"),
        )

    wide = [F.transform(f"_w_{k}", candidate(k, i)) for i, k in enumerate(KINDS)]
    kept = [c for c in docs.columns if c != text]
    return found.select(*kept, "_row", "_held", "base", F.concat(*wide).alias("candidates"))


class Boosted:
    """Depth-two regression trees on small integer features, boosted for logistic loss."""

    def __init__(self, cells: list[tuple[dict, float, float]]):
        """``cells``: (features, rows, rows with label 1) of the training rows."""
        self.trees, self.names = [], list(FEATURES)
        total, ones = sum(c[1] for c in cells), sum(c[2] for c in cells)
        self.bias = math.log((ones + 1) / (total - ones + 1))
        score = [self.bias] * len(cells)
        for _ in range(TREES if cells else 0):
            slope, bend = [], []
            for (_, n, k), s in zip(cells, score):
                p = 1 / (1 + math.exp(-s))
                slope.append(k - n * p)
                bend.append(n * p * (1 - p) + 1e-6)
            everything = list(range(len(cells)))
            split = self._split(cells, everything, slope, bend)
            if split is None:
                break
            name, cut = split
            tree = []
            for side in (True, False):
                rows = [i for i in everything if (cells[i][0][name] <= cut) == side]
                lower = self._split(cells, rows, slope, bend)
                leaves = [rows] if lower is None else [[i for i in rows if (cells[i][0][lower[0]] <= lower[1]) == s] for s in (True, False)]
                values = [RATE * sum(slope[i] for i in leaf) / (sum(bend[i] for i in leaf) + 1) for leaf in leaves]
                for leaf, value in zip(leaves, values):
                    for i in leaf:
                        score[i] += value
                tree.append((lower, values))
            self.trees.append((split, tree))

    def _split(self, cells, rows, slope, bend):
        best, found = 1e-9, None
        all_g, all_h = sum(slope[i] for i in rows), sum(bend[i] for i in rows)
        for name in self.names:
            g, h, n = {}, {}, {}
            for i in rows:
                v = cells[i][0][name]
                g[v], h[v], n[v] = g.get(v, 0) + slope[i], h.get(v, 0) + bend[i], n.get(v, 0) + cells[i][1]
            left_g = left_h = left_n = 0.0
            right_n = sum(n.values())
            for v in sorted(g)[:-1]:
                left_g, left_h, left_n, right_n = left_g + g[v], left_h + h[v], left_n + n[v], right_n - n[v]
                if min(left_n, right_n) < LEAST_WEIGHT:
                    continue
                gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
                if gain > best:
                    best, found = gain, (name, v)
        return found

    def score(self, f: dict) -> float:
        s = self.bias
        for (name, cut), sides in self.trees:
            lower, values = sides[0] if f[name] <= cut else sides[1]
            s += values[0] if lower is None or f[lower[0]] <= lower[1] else values[1]
        return s

    def column(self, f: Column) -> Column:
        """The same score as a Spark expression on the feature struct."""
        outputs = [F.lit(self.bias)]
        for (name, cut), sides in self.trees:
            leaf = [
                F.lit(values[0]) if lower is None else F.when(f[lower[0]] <= lower[1], values[0]).otherwise(values[1])
                for lower, values in sides
            ]
            outputs.append(F.when(f[name] <= cut, leaf[0]).otherwise(leaf[1]))
        return F.aggregate(F.array(*outputs), F.lit(0.0), lambda total, x: total + x)


def lower_bound(right: int, rows: int) -> float:
    """The share that ``right`` of ``rows`` proves, at one-sided 95 % (Wilson)."""
    if not rows:
        return 0.0
    z, p = 1.645, right / rows
    return (p + z * z / (2 * rows) - z * math.sqrt(p * (1 - p) / rows + z * z / (4 * rows * rows))) / (1 + z * z / rows)


def fit(candidates: DataFrame, precision: float = PRECISION) -> tuple[Boosted, dict[int, float]]:
    """The trees, and for each kind the lowest score whose held-out precision is surely enough.

    The rows no base span overlaps, which alone can be added, must have that share as well.
    A kind without such a score gets no threshold: none of its candidates is added.
    """
    counted = (
        candidates.groupBy("_held", *[F.col(f"c.f.{n}").alias(n) for n in FEATURES])
        .agg(F.count("*").alias("n"), F.sum(F.col("c.label").cast("long")).alias("k"),
             F.sum((~F.col("c.taken")).cast("long")).alias("free"), F.sum((~F.col("c.taken") & F.col("c.label")).cast("long")).alias("free_k"))
        .orderBy("_held", *FEATURES)
        .collect()  # at most as many rows as there are feature cells
    )
    cells = [({n: r[n] for n in FEATURES}, float(r["n"]), float(r["k"])) for r in counted if not r["_held"]]
    model = Boosted(cells)
    thresholds: dict[int, float] = {}
    for rank in range(len(KINDS)):
        held = sorted(((model.score({n: r[n] for n in FEATURES}), r["n"], r["k"], r["free"], r["free_k"]) for r in counted if r["_held"] and r["kind"] == rank), reverse=True)
        rows = right = free = free_right = 0
        for i, (score, n, k, f, fk) in enumerate(held):
            rows, right, free, free_right = rows + n, right + k, free + f, free_right + fk
            last = i + 1 == len(held) or held[i + 1][0] < score
            if last and lower_bound(right, rows) >= precision and free_right >= precision * free:
                thresholds[rank] = score
    return model, thresholds


def added_spans(found: DataFrame) -> DataFrame:
    """(_row, added): candidates the trees accept that overlap no base span."""
    rows = found.select("_row", "_held", F.explode("candidates").alias("c"))
    model, thresholds = fit(rows)
    least = F.array(*[F.lit(thresholds.get(rank, math.inf) - 1e-9) for rank in range(len(KINDS))])
    kept = rows.where(~F.col("c.taken") & F.col("c.valid")).where(model.column(F.col("c.f")) >= F.get(least, F.col("c.rank")))
    span = F.struct("c.start", "c.rank", "c.kind", "c.end")
    return kept.select("_row", span.alias("s")).distinct().groupBy("_row").agg(F.collect_list("s").alias("added"))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with ``base`` and ``spans``, sorted by start and kind.

    A NULL text counts as empty; an empty text has no spans; repeated rows get equal spans;
    an empty table gives an empty one.  Columns called ``base`` or ``spans`` are replaced.
    """
    docs = docs.drop("base", "spans", "candidates", "added", "_row", "_held")
    found = materialize(find_candidates(docs, text), "pii-candidates")
    done = found.join(added_spans(found), "_row", "left")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    spans = F.array_sort(F.concat("base", F.coalesce("added", none)))
    return done.withColumn("spans", spans).drop("_row", "_held", "candidates", "added")


def redact_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by its kind in brackets; NULL stays NULL."""
    keyed = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    keyed = keyed.withColumn("__row", row_key(keyed, "__t")).drop("__t")
    narrow = docs.select(*[c for c in ("doc_id", text) if c in docs.columns])
    found = materialize(find_candidates(narrow, text).select("_row", "_held", "base", "candidates"), "pii-candidates")
    none = F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    spans = F.array_sort(F.concat("base", F.coalesce("added", none)))
    told = found.join(added_spans(found), "_row", "left").select(F.col("_row").alias("__row"), spans.alias("__spans"))
    told = told.where(F.size("__spans") > 0).dropDuplicates(["__row"])
    return redact_rows(keyed, materialize(told, "pii-spans"), docs.columns, text)


def report(scanned: DataFrame) -> DataFrame:
    """Counts per kind, the digest of the base spans by kind and start, and all spans likewise."""
    def by_kind(spans: str) -> Column:
        return F.flatten(F.array(*[only(spans, k) for k in KINDS]))

    count = [F.size(only("base", k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return scanned.select("doc_id", *count, F.sha2(joined(by_kind("base")), 256).alias("base_sha256"), joined(by_kind("spans")).alias("spans"))
