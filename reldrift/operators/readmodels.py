"""Read models over findings and last-seen versions: recent lists, statistics, feed, JSON."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import patterns as P
from ..functions.severity import severity_label
from ..schemas import PAIR, SIGNAL


def effective_limit(limit: int, bounds: tuple[int, int]) -> int:
    """An unusable limit is replaced by the default, not clamped to the largest."""
    default, largest = bounds
    return default if limit <= 0 or limit > largest else limit


def recent_findings(findings: DataFrame, limit: int = 0) -> DataFrame:
    """Newest findings first; equal times are ordered by the release."""
    return findings.orderBy(F.desc("analyzed_at"), *PAIR).limit(
        effective_limit(limit, P.RECENT_FINDINGS)
    )


def recent_activity(watched: DataFrame, limit: int = 0) -> DataFrame:
    """Most recently changed packages first; equal times are ordered by the package."""
    return (
        watched.orderBy(F.desc("updated_at"), "ecosystem", "name")
        .limit(effective_limit(limit, P.RECENT_ACTIVITY))
        .select("ecosystem", "name", F.col("last_version").alias("version"))
    )


def statistics(watched: DataFrame, scan_log: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: packages watched, versions scanned, findings stored."""
    names = ("packages_watched", "versions_scanned", "findings_total")
    counts = []
    for i, source in enumerate((watched, scan_log, findings)):
        count = source.groupBy().agg(F.count("*").alias("n"))
        counts.append(count.select(*[(F.col("n") if i == j else F.lit(0)).cast("long").alias(c) for j, c in enumerate(names)]))
    together = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return together.groupBy().agg(*[F.sum(c).alias(c) for c in names])


# --- feed -----------------------------------------------------------------


def feed_title() -> Column:
    return F.concat(
        F.lit("["), severity_label(F.col("severity")), F.lit("] "),
        "ecosystem", F.lit("/"), "name", F.lit(" "), "version",
        F.lit(" (was "), "prev_version", F.lit(") — "),
        F.size("signals").cast("string"), F.lit(" signal(s)"),
    )


def feed_description() -> Column:
    def sentence(s: Column) -> Column:
        evidence = F.when(
            F.size(s["evidence"]) > 0,
            F.concat(F.lit(" ("), F.array_join(s["evidence"], ", "), F.lit(")")),
        ).otherwise("")
        return F.concat(s["kind"], F.lit(": "), s["description"], evidence, F.lit(". "))

    text = F.concat(
        F.lit("Severity: "), severity_label(F.col("severity")), F.lit(". "),
        F.array_join(F.transform("signals", sentence), ""),
    )
    return F.trim(text)


def feed_items(findings: DataFrame, site: str, tag: str) -> DataFrame:
    """One feed item per finding.  Times are written in the session zone, which must be UTC.

    ``site`` is the link of every item; ``tag`` starts the item identifiers
    (``tag:<tag>:...``).
    """
    return findings.select(
        feed_title().alias("title"),
        F.lit(site).alias("link"),
        feed_description().alias("description"),
        F.col("ecosystem").alias("category"),
        F.date_format("analyzed_at", "EEE, dd MMM yyyy HH:mm:ss Z").alias("pub_date"),
        F.concat(
            F.lit(f"tag:{tag}:"), "ecosystem", F.lit("/"), "name", F.lit("@"), "version", F.lit(":"),
            F.unix_seconds(F.col("analyzed_at").cast("timestamp")).cast("string"),
        ).alias("guid"),
    )


def newest_feed(findings: DataFrame, site: str, tag: str) -> DataFrame:
    """Feed items of the newest findings, newest first."""
    return feed_items(recent_findings(findings), site, tag)


# --- JSON -------------------------------------------------------------------


def signals_to_json(signals: Column) -> Column:
    return F.to_json(signals)


def signals_from_json(text: Column) -> Column:
    return F.from_json(text, T.ArrayType(SIGNAL))


def findings_json(findings: DataFrame) -> DataFrame:
    """One JSON document per finding; the package's source_url is always empty."""
    package = F.struct("ecosystem", "name", "version", F.lit("").alias("source_url"))
    time = F.regexp_replace(
        F.date_format("analyzed_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), r"\.?0+Z\z", "Z"
    )
    document = F.struct(
        package.alias("package"), "prev_version", "signals", "severity", time.alias("analyzed_at")
    )
    return findings.select(*PAIR, F.to_json(document).alias("json"))
