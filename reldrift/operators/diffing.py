"""What is in the new release and not in the previous one, as signals and findings."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.severity import severity
from ..functions.urls import is_payload_url, is_raw_ip_url
from ..schemas import PAIR, RELEASE
from .ordering import with_previous


def release_pairs(releases: DataFrame, order: str = "release_seq") -> DataFrame:
    """Each release with the release before it; a first release has no pair."""
    with_prev = with_previous(
        releases.select(*RELEASE, order),
        keys=("ecosystem", "name"),
        order_by=(order,),
        value="version",
        out="prev_version",
    )
    return with_prev.where(F.col("prev_version").isNotNull()).select(*PAIR, order)


def new_tokens(tokens: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tokens of the new release that the previous release does not hold; pairs must be unique.

    Repeats survive: this is a membership test, not a set difference.  A previous
    release without any token leaves everything new.  The join key holds the release
    and the token, so a package with many releases is spread out, and a release with
    one token repeated everywhere is the streamed side, which skew handling can split.
    """
    old = tokens.select(
        "ecosystem", "name", F.col("version").alias("prev_version"), "kind", "token"
    ).distinct()
    new = tokens.join(pairs.select(*PAIR), list(RELEASE))
    return new.join(
        old, ["ecosystem", "name", "prev_version", "kind", "token"], "left_anti"
    )


def evidence(new: DataFrame) -> DataFrame:
    """New tokens -> one row per piece of evidence, ordered within (pair, kind) by file_ord, pos.

    The long form of the result: nothing is gathered per release, so its size per
    release is unlimited.  Risky words appear once per pair, at their first place.
    """
    is_word = F.col("kind") == "import"
    columns = [*PAIR, "kind", "file_ord", "pos", "token"]
    words = (
        new.where(is_word)
        .groupBy(*PAIR, "kind", "token")
        .agg(F.min(F.struct("file_ord", "pos")).alias("_at"))
        .select(*PAIR, "kind", "_at.file_ord", "_at.pos", "token")
    )
    return new.where(~is_word).select(*columns).unionByName(words)


def token_weight(kind: Column, token: Column) -> Column:
    """Weight a piece of evidence gives to its signal; the largest one counts."""
    escalated = (kind == "url") & (is_raw_ip_url(token) | is_payload_url(token))
    base = F
    for name, (_, _, _, weight) in P.SIGNALS.items():
        base = base.when(kind == name, weight)
    return F.when(escalated, P.URL_PAYLOAD_WEIGHT).otherwise(base.otherwise(0))


_ITEM = ("file_ord", "pos", "token")


def _kind_weights() -> list[Column]:
    return [
        F.max(F.when(F.col("kind") == kind, F.col("_weight"))).alias(f"_{kind}_weight")
        for kind in P.SIGNALS
    ]


def _total_weight() -> Column:
    total = F.lit(0)
    for kind in P.SIGNALS:
        total = total + F.coalesce(F.col(f"_{kind}_weight"), F.lit(0))
    return total


def _weighed(new: DataFrame) -> DataFrame:
    return new.withColumn("_weight", token_weight(F.col("kind"), F.col("token")))


def score_releases(new: DataFrame) -> DataFrame:
    """New tokens -> (pair, signals, total_weight, severity), gathering no lists.

    One shuffle of four small maxima per pair, combined before it.
    """
    present = [F.col(f"_{kind}_weight").isNotNull().cast("int") for kind in P.SIGNALS]
    count = present[0] + present[1] + present[2] + present[3]
    return (
        _weighed(new)
        .groupBy(*PAIR)
        .agg(*_kind_weights())
        .select(
            *PAIR,
            count.alias("signals"),
            _total_weight().alias("total_weight"),
            severity(_total_weight()).alias("severity"),
        )
    )


def summaries(new: DataFrame) -> DataFrame:
    """New tokens -> (pair, severity, signals), where a signal has kind, description and weight.

    A finding without its evidence: four maxima per pair, whatever the release holds.
    """
    grouped = _weighed(new).groupBy(*PAIR).agg(*_kind_weights())
    found = F.array(*[
        F.when(
            F.col(f"_{kind}_weight").isNotNull(),
            F.struct(F.lit(name).alias("kind"), F.lit(text).alias("description"), F.col(f"_{kind}_weight").alias("weight")),
        )
        for kind, (_, name, text, _) in P.SIGNALS.items()
    ])
    return grouped.select(*PAIR, severity(_total_weight()).alias("severity"), F.filter(found, lambda s: s.isNotNull()).alias("signals"))


def find(new: DataFrame) -> DataFrame:
    """New tokens -> one scored finding per release pair, with all its evidence nested.

    A row holds the evidence of its release; :func:`score_releases` and :func:`evidence` give the
    same result as narrow and as long rows and gather nothing.
    One shuffle on the pair.  Risky words are a closed list, so their first places are
    minima and no list is gathered for them.
    """
    item = F.struct(*_ITEM)
    lists = [
        F.collect_list(F.when(F.col("kind") == kind, item)).alias(f"_{kind}")
        for kind in P.SIGNALS
        if kind != "import"
    ]
    first_places = [
        F.min(F.when((F.col("kind") == "import") & (F.col("token") == word), item)).alias(f"_word_{i}")
        for i, word in enumerate(P.RISKY_WORDS)
    ]
    words = F.array(*[F.col(f"_word_{i}") for i in range(len(P.RISKY_WORDS))])
    grouped = (
        _weighed(new)
        .groupBy(*PAIR)
        .agg(*_kind_weights(), *lists, *first_places)
        .withColumn("_import", F.filter(words, lambda w: w.isNotNull()))
    )
    in_order = {
        kind: F.transform(F.sort_array(F.col(f"_{kind}")), lambda i: i["token"]) for kind in P.SIGNALS
    }
    return _findings(grouped, in_order)


def _findings(grouped: DataFrame, evidence_of: dict[str, Column]) -> DataFrame:
    """Grouped weights and evidence per kind -> severity and signals, in the fixed order of kinds."""
    found = F.array(*[_signal(kind, evidence_of[kind]) for kind in P.SIGNALS])
    return grouped.select(
        *PAIR,
        severity(_total_weight()).alias("severity"),
        F.filter(found, lambda s: s.isNotNull()).alias("signals"),
    )


def _signal(kind: str, evidence_list: Column) -> Column:
    _, signal_kind, description, _ = P.SIGNALS[kind]
    return F.when(
        F.col(f"_{kind}_weight").isNotNull(),
        F.struct(
            F.lit(signal_kind).alias("kind"),
            F.lit(description).alias("description"),
            evidence_list.alias("evidence"),
            F.col(f"_{kind}_weight").alias("weight"),
        ),
    )


def signals(findings: DataFrame) -> DataFrame:
    """One row per signal of each finding."""
    return findings.select(*PAIR, F.explode("signals").alias("s")).select(
        *PAIR, "s.kind", "s.description", "s.evidence", "s.weight"
    )
