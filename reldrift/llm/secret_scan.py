"""Secret scanning: strong patterns, and weak parts that count only beside their complement.

Strong spans (an assignment to a secret's name, an access id, a long hex string) are always
reported.  Weak parts (a login or short access id; a short assigned secret, short hex
string, value of a key's name or run of mixed case and digits; an address) are reported only
when an identifier and a secret stand in one scope; an address joins them when it is in the
scope of a linked secret.  Two spans are in one scope if they are within ``REACH`` code points
of each other and nothing that ends a record stands between them: a blank line, or the
border between two objects.  The interval join runs on (row, block of ``REACH`` code points):
spans of a pattern don't overlap and have a least length, so a block holds few of them and
no block's pairs grow with the data.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.membership import bitmap_of, cannot_be_in, may_be_in
from ..session import materialize
from .spans import add_matches, joined, of_kind, only, redact

REACH = 200
BORDER = r"\n[\x20\t\r]*\n|\}\s*,?\s*\{"

_NAMES = "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]"
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
STRONG = {
    "assign": ASSIGN,
    # a run that is too short holds no longer one, so the least length can stand in the pattern
    "access": "AKIA[A-Z0-9]{12,}",
    "hex": "[0-9a-f]{32,}",
}
WEAK = {
    "ident": r"""(?<![A-Za-z])(?i:user(?:_?name)?|login|client_?id|account(?:_?name)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}+|AKIA[A-Z0-9]{4,11}(?![A-Z0-9])""",
    "weak": "(?<![0-9a-f])[0-9a-f]{16,31}(?![0-9a-f])",
    "endpoint": r"""[A-Za-z][A-Za-z0-9+]{1,15}://[^\s"'<>]{3,}|(?<![A-Za-z])(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:-]{3,}""",
}
#: Reported as weak: values of key names that ``ASSIGN`` doesn't take, and unassigned runs of
#: lower and upper case and digits, each of whose looks ahead passes a run once.
KEYS = {
    "keyed": r"""(?i:access_?key|account_?key|shared_?key|master_?key|storage_?key|auth_?key|private_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_-]{8,}+={0,2}""",
    "mixed": "(?<![A-Za-z0-9+/_-])(?=[A-Z0-9+/_-]*+[a-z])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}",
}
RANK = {kind: i for i, kind in enumerate((*STRONG, *WEAK))}
SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def _value_length(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2))


def find_parts(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """All columns but the text, with ``_row``, ``base`` (strong spans), ``parts`` (weak ones) and ``_scopes``.

    ``_scopes`` has all of them with the place their scope ends: at the first border behind
    a span, ``reach`` behind it at the latest.
    """
    keyed = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    keyed = keyed.withColumn("_row", row_key(keyed, "_text"))
    found = add_matches(keyed, "_text", {f"_m_of_{k}": p for k, p in (STRONG | WEAK | KEYS).items()})
    matched = {k: F.col(f"_m_of_{k}") for k in (*STRONG, *WEAK, *KEYS)}
    spans = {k: of_kind(matched[k], k, RANK[k]) for k in (*STRONG, *WEAK)}
    spans["assign"] = of_kind(F.filter(matched["assign"], lambda s: _value_length(s["match"]) >= 8), "assign", RANK["assign"])
    short = of_kind(F.filter(matched["assign"], lambda s: _value_length(s["match"]).between(4, 7)), "weak", RANK["weak"])
    base = F.array_sort(F.concat(*[spans[k] for k in STRONG]))
    named = of_kind(matched["keyed"], "weak", RANK["weak"])
    # a run inside an assigned value or a login is no part of its own
    mixed = F.filter(of_kind(matched["mixed"], "weak", RANK["weak"]), lambda m: ~F.exists(
        F.concat(matched["keyed"], matched["ident"]), lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))
    parts = F.array_sort(F.concat(*[spans[k] for k in WEAK], short, named, mixed))

    def scoped(s: Column) -> Column:
        border = F.regexp_instr(F.substring(F.col("_text"), s["end"] + 1, F.lit(reach)), F.lit(BORDER))
        return F.struct(s.alias("s"), (s["end"] + F.when(border > 0, border - 1).otherwise(reach)).alias("till"))

    kept = [c for c in docs.columns if c != text]
    told = found.select(*kept, "_row", "_text", base.alias("base"), parts.alias("parts"))
    scopes = F.when(F.size("parts") > 0, F.transform(F.concat("base", "parts"), scoped))
    return told.withColumn("_scopes", scopes).drop("_text")


def row_key(df: DataFrame, text: str) -> Column:
    """A key of a row by its id, if it has one, and its text; equal rows share it."""
    ids = [F.col("doc_id")] if "doc_id" in df.columns else []
    return F.struct(F.xxhash64(*ids, text).alias("a"), F.crc32(F.col(text).cast("binary")).alias("b"))


def _near(left: DataFrame, right: DataFrame, reach: int) -> DataFrame:
    """Pairs of spans of one row that are in one scope: (_row, l, r), each with the place its scope ends."""
    blocks = F.sequence(F.floor((F.col("s.start") - reach) / reach), F.floor((F.col("s.end") + reach) / reach))
    wide = left.select("_row", F.struct("s", "till").alias("l"), F.explode(blocks).alias("_block"))
    narrow = right.select("_row", F.struct("s", "till").alias("r"), F.floor(F.col("s.start") / reach).alias("_block"))
    # the scope of the span in front must reach the one behind, which may also begin inside it
    together = F.when(F.col("l.s.start") <= F.col("r.s.start"), F.col("r.s.start") <= F.col("l.till")).otherwise(F.col("l.s.start") <= F.col("r.till"))
    return wide.join(narrow, ["_row", "_block"]).where(together).select("_row", "l", "r")


def link_parts(found: DataFrame, reach: int = REACH) -> DataFrame:
    """(_row, linked): the weak spans of each row that a complement makes reportable."""
    every = found.where(F.col("_scopes").isNotNull()).select("_row", "base", F.explode("_scopes").alias("_s"))
    every = every.select("_row", "base", "_s.s", "_s.till")
    kind = F.col("s.kind")
    base = every.where(kind.isin(*STRONG)).drop("base").distinct()
    free = ~F.exists("base", lambda b: (b["start"] < F.col("s.end")) & (F.col("s.start") < b["end"]))
    parts = every.where(kind.isin(*WEAK) & free).drop("base").distinct()
    idents = parts.where(kind == "ident").unionByName(base.where(kind == "access"))
    secrets = parts.where(kind == "weak").unionByName(base.where(kind.isin("assign", "hex")))
    pairs = _near(idents, secrets, reach)
    endpoints = parts.where(kind == "endpoint")
    joined_by = pairs.select("_row", "r.s", "r.till").distinct()
    addresses = _near(joined_by, endpoints, reach).select("_row", F.col("r.s").alias("s"))
    told = pairs.select("_row", F.explode(F.array("l.s", "r.s")).alias("s")).unionByName(addresses)
    weak = told.where(F.col("s.kind").isin(*WEAK)).distinct()
    return weak.groupBy("_row").agg(F.collect_list("s").alias("linked"))


def scan(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """Every row of ``docs`` without its text, with ``base`` and ``spans``, sorted by start.

    A NULL text counts as empty; an empty text has no spans; repeated rows get equal spans.
    Columns called ``base``, ``spans`` or ``parts`` are replaced.
    """
    docs = docs.drop("base", "spans", "parts", "_row", "linked", "_scopes")
    found = materialize(find_parts(docs, text, reach), "secret-parts")
    linked = link_parts(found, reach)
    done = found.join(linked, "_row", "left")
    spans = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(SPAN))))
    return done.withColumn("spans", spans).drop("_row", "parts", "linked", "_scopes")


def redact_secrets(docs: DataFrame, text: str = "text", reach: int = REACH) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced by its kind in brackets.

    Rows without a secret keep their text and pass without a shuffle; a NULL text stays NULL.
    """
    keyed = docs.withColumn("__t", F.coalesce(F.col(text), F.lit("")))
    keyed = keyed.withColumn("__row", row_key(keyed, "__t")).drop("__t")
    narrow = docs.select(*[c for c in ("doc_id", text) if c in docs.columns])
    found = materialize(find_parts(narrow, text, reach).select("_row", "base", "_scopes").distinct(), "secret-parts")
    spans = F.array_sort(F.concat("base", F.coalesce("linked", F.array().cast(SPAN))))
    told = found.join(link_parts(found, reach), "_row", "left").select(F.col("_row").alias("__row"), spans.alias("__spans"))
    return redact_rows(keyed, materialize(told.where(F.size("__spans") > 0), "secret-spans"), docs.columns, text)


def redact_rows(keyed: DataFrame, told: DataFrame, columns: list[str], text: str) -> DataFrame:
    """Rows with ``__row`` and their spans -> rows with the spans redacted; rows no span belongs to pass by."""
    named = bitmap_of(told, F.col("__row.a"))
    redacted = may_be_in(keyed, F.col("__row.a"), named).join(told, "__row", "left").withColumn(
        text, F.when(F.col("__spans").isNotNull(), redact(F.col(text), F.col("__spans"))).otherwise(F.col(text))
    )
    return cannot_be_in(keyed, F.col("__row.a"), named).select(*columns).unionByName(redacted.select(*columns))


def report(scanned: DataFrame) -> DataFrame:
    """Counts per strong kind, the digest of the strong spans, and all spans as one string."""
    count = [F.size(only("base", k)).cast("long").alias(f"n_{k}") for k in STRONG]
    return scanned.select("doc_id", *count, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
