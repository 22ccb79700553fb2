"""The composite jobs: detect changes, unpack, diff, score, publish, and list building."""

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import patterns as P
from ..functions.comments import strip_comments
from ..operators import changes, diffing, ranking, readmodels, registry, tokens
from ..operators.split_hooks import join_split_hooks
from ..session import materialize, work_folder
from ..sources import allowlists, archive_tokens, archives, tables
from ..sources.lastseen import LastSeen


def detect_changes(
    docs: DataFrame, last_seen: Callable[[DataFrame], DataFrame], now: datetime, allowlist: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """One poll cycle: (release pairs, rows to set in the last-seen table).

    ``docs`` holds landed registry documents; of several of one package the last one landed
    counts.  ``last_seen`` gives the last-seen rows of the packages it is asked for.  Documents
    are parsed where they are read; only those of changed packages are shuffled, for their
    archive addresses.
    """
    latest = changes.newest_latest(docs)
    if allowlist is not None:
        latest = changes.restrict_to_watchlist(latest, allowlist)
    latest = materialize(latest, "latest")
    looked = materialize(changes.look_up_last_seen(latest, last_seen(latest)), "looked-up")
    changed = changes.changed_only(looked)
    pairs = registry.resolve_changes(changes.documents_of(docs, changed))
    return pairs, changes.moved(looked, now)


def unpacked_tokens(packed: DataFrame) -> DataFrame:
    """(source_url, source_path or content) archives -> evidence candidates per archive, written.

    Long rows (file texts) never leave the task that unpacked them.  Rows of kind 'verdict',
    at least one per archive, have a NULL token and tell of its status.  An archive in which
    a file ends inside an install hook is opened once more for the files around.
    """
    given = "content" if "content" in packed.columns else "source_path"
    packed = packed.select("source_url", given)

    def texts(archives_: DataFrame) -> DataFrame:
        files = archives.unpack(archives_)
        return files.withColumn("content", strip_comments(F.col("path"), F.col("content"))).drop("path", "source_path")

    verdict = F.struct(F.lit(archive_tokens.VERDICT).alias("kind"), F.array(F.lit(None).cast("string")).alias("found"))
    found = F.array(verdict, *tokens.tokens_by_kind(F.col("content"), tails=True))
    rest = ["source_url", "archive_status", "file_ord"]
    rows = texts(packed).select(*rest, F.explode(found).alias("k")).select(
        *rest, F.col("k.kind").alias("kind"), F.posexplode("k.found").alias("pos", "token")
    )
    rows = rows.withColumn("kind", tokens.kind_of(F.col("kind"), F.col("token")))
    is_verdict = F.col("kind") == archive_tokens.VERDICT
    rows = materialize(rows.where(is_verdict | tokens.may_signal(F.col("kind"), F.col("token"))), "archive-tokens")

    def some(named: DataFrame) -> DataFrame:
        return texts(packed.join(named, "source_url", "left_semi")).where(F.col("file_ord").isNotNull())

    return join_split_hooks(rows, some, ["source_url"])


@dataclass
class Diff:
    """What a diff of release pairs yields."""

    analysed: DataFrame    # pairs that were compared, clean or not
    new_tokens: DataFrame  # evidence candidates found in the new release only, written


def diff_pairs(pairs: DataFrame, token_table: DataFrame) -> Diff:
    """Compare both sides of each pair through the token table of their archives.

    A pair with a damaged archive on either side is left out.  An address that is
    empty or has no archive is an empty text: then everything on the other side is new.
    """
    failed = (
        token_table.where(F.col("archive_status") == archives.ERROR).select("source_url").distinct()
    )
    analysed = materialize(
        pairs.join(failed, "source_url", "left_anti")
        .join(failed.withColumnRenamed("source_url", "prev_source_url"), "prev_source_url", "left_anti")
        .distinct(),
        "analysed",
    )
    new_side = analysed.select(*S.RELEASE, "source_url")
    old_side = analysed.select(
        "ecosystem", "name", F.col("prev_version").alias("version"),
        F.col("prev_source_url").alias("source_url"),
    )
    sides = new_side.unionByName(old_side).where(F.col("source_url") != "").distinct()
    found = token_table.where(F.col("token").isNotNull()).drop("archive_status")
    by_release = materialize(sides.join(found, "source_url").drop("source_url"), "release-tokens")
    compared = analysed.select(*S.PAIR)
    return Diff(compared, materialize(diffing.new_tokens(by_release, compared), "new-tokens"))


def findings_of(new_tokens: DataFrame, now: datetime) -> DataFrame:
    """Scored findings of one cycle; releases without a signal do not appear."""
    return diffing.find(new_tokens).withColumn("analyzed_at", F.lit(now).cast("timestamp"))


def newest_findings_of(new_tokens: DataFrame, analyzed_at: Column, limit: int = 0) -> DataFrame:
    """The newest findings, picked on narrow scored rows; evidence is nested for those few only.

    At most 200 are picked, so their names may be broadcast.
    """
    scored = diffing.score_releases(new_tokens).select(*S.PAIR, analyzed_at.alias("analyzed_at"))
    picked = readmodels.recent_findings(scored, limit).select(*S.PAIR)
    some = new_tokens.join(F.broadcast(picked), list(S.PAIR), "left_semi")
    return readmodels.recent_findings(diffing.find(some).withColumn("analyzed_at", analyzed_at), limit)


def publish(diff: Diff, root: str, cycle: str, now: datetime, first_sights: int = 0) -> None:
    """Store the findings, their evidence in long form, the scan log and the counters of one cycle."""
    spark = diff.analysed.sparkSession
    stamp = F.lit(now).cast("timestamp")
    tables.write_findings(diff.new_tokens, stamp, root, cycle)
    tables.write_cycle(diff.analysed.withColumn("analyzed_at", stamp), root, "scan_log", cycle)
    found = diff.new_tokens.select(*S.PAIR).distinct().count()
    tables.write_counters(spark, root, cycle, first_sights, diff.analysed.count(), found)


def run_cycle(
    spark: SparkSession,
    root: str,
    cycle: str,
    previous_cycle: str | None,
    docs: DataFrame,
    packed: DataFrame,
    now: datetime,
    allowlist: DataFrame | None = None,
) -> None:
    """One whole cycle: documents and archives in, state tables out.

    ``packed`` names landed archives: the address documents use (source_url), the file
    (source_path) and, to deal them out by bytes, its ``length``; only archives of the cycle's
    pairs are opened, and of those only the ones no earlier cycle has opened.  Cycle names
    must ascend as texts.  The last-seen rows are written last, so a cycle that dies half-way
    is repeated in full and no change is lost.  Intermediate tables stand below
    ``<root>/_work`` and go when the cycle ends.
    """
    with work_folder(spark, f"{root}/_work/cycle={cycle}"):
        watched = LastSeen(spark, root)

        def last_seen(packages: DataFrame) -> DataFrame:
            return watched.look_up(packages, previous_cycle) if previous_cycle else spark.createDataFrame([], S.WATCHED)

        pairs, moved = detect_changes(docs, last_seen, now, allowlist)
        pairs = materialize(pairs, "pairs")
        found = archive_tokens.tokens_of(spark, root, cycle, packed, pairs, unpacked_tokens)
        moved = materialize(moved, "moved")
        first_sights = moved.join(last_seen(moved), list(changes.KEY), "left_anti").count()
        publish(diff_pairs(pairs, found), root, cycle, now, first_sights)
        watched.record(moved, cycle)


def build_lists(packages: DataFrame, folder: str, limit: int = P.LIST_SIZE) -> None:
    """Popularity ranking -> one watch list per ecosystem."""
    allowlists.write_allowlists(ranking.top_names(packages, limit), folder)
