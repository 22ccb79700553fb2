"""Version changes over a poll log, and the last-seen table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import membership, registry
from .ordering import with_previous

KEY = ("ecosystem", "name")


def with_last_seen(polls: DataFrame) -> DataFrame:
    """Each poll with the version of the poll before it (NULL at first sight)."""
    return with_previous(
        polls,
        keys=KEY,
        order_by=("polled_at", "event_id"),
        value="latest",
        out="prev_version",
    )


def version_changes(polls: DataFrame) -> DataFrame:
    """Polls that saw another version than the poll before: any difference, not only newer."""
    seen = with_last_seen(polls)
    return seen.where(F.col("latest") != F.col("prev_version")).select(
        *KEY, F.col("latest").alias("version"), "prev_version", "polled_at", "event_id"
    )


def first_seen(polls: DataFrame) -> DataFrame:
    """The first poll of each package: recorded, never compared."""
    return (
        polls.groupBy(*KEY)
        .agg(F.min_by(F.struct("latest", "polled_at", "event_id"), F.struct("polled_at", "event_id")).alias("f"))
        .select(*KEY, F.col("f.latest").alias("version"), "f.polled_at", "f.event_id")
    )


def watched_versions(polls: DataFrame) -> DataFrame:
    """Last version of each package and the time it was last set.

    The time moves only when the version changes, so it is the newest poll among the
    first sights and the changes.
    """
    moved = with_last_seen(polls).where(
        F.col("prev_version").isNull() | (F.col("latest") != F.col("prev_version"))
    )
    newest = F.max(F.struct("polled_at", "event_id", "latest")).alias("m")
    return moved.groupBy(*KEY).agg(newest).select(
        *KEY, F.col("m.latest").alias("last_version"), F.col("m.polled_at").alias("updated_at")
    )


def look_up_last_seen(latest: DataFrame, watched: DataFrame) -> DataFrame:
    """Add ``last_seen`` to (ecosystem, name, ...) rows; '' means never seen."""
    known = watched.select(*KEY, F.col("last_version").alias("last_seen"))
    return latest.join(known, list(KEY), "left").withColumn(
        "last_seen", F.coalesce("last_seen", F.lit(""))
    )


def changed_only(latest_with_last_seen: DataFrame) -> DataFrame:
    """Keep rows whose version differs from a version seen before."""
    return latest_with_last_seen.where(
        (F.col("latest") != F.col("last_seen")) & (F.col("last_seen") != "")
    )


def body_digest() -> Column:
    """Tells the documents of a package apart without carrying them."""
    return F.sha2("body", 256)


def newest_latest(docs: DataFrame) -> DataFrame:
    """(ecosystem, name, latest, digest) of the newest landed document of each package.

    That is the one that landed last, or the one of the greatest digest in a tie; documents
    without ``landed_at`` count as landed first.  Bodies are parsed where they are read and
    only narrow rows are shuffled.  Packages whose newest document is unusable are left out.
    """
    landed = F.col("landed_at") if "landed_at" in docs.columns else F.lit(None).cast("timestamp")
    narrow = registry.outcomes(docs).select(*KEY, F.struct(landed.alias("landed_at"), body_digest().alias("digest"), "latest").alias("_d"))
    newest = narrow.groupBy(*KEY).agg(F.max("_d").alias("_d"))
    return newest.where(F.col("_d.latest") != "").select(*KEY, "_d.latest", "_d.digest")


def documents_of(docs: DataFrame, packages: DataFrame) -> DataFrame:
    """The rows of ``packages`` (ecosystem, name, digest, ...) with the bodies their digests name.

    A bitmap of the digests rules out all other documents where they are read, so only
    bodies that are asked for reach the join.
    """
    keyed = docs.select(*KEY, "body", body_digest().alias("digest"))
    address = F.xxhash64(*KEY, "digest")
    near = membership.may_be_in(keyed, address, membership.bitmap_of(packages, address))
    return near.dropDuplicates([*KEY, "digest"]).join(packages, [*KEY, "digest"]).drop("digest")


def moved(latest_with_last_seen: DataFrame, now) -> DataFrame:
    """What a poll changes in the last-seen table: first sights and other versions, with the time."""
    new = F.col("latest") != F.col("last_seen")
    return latest_with_last_seen.where(new).select(
        *KEY, F.col("latest").alias("last_version"), F.lit(now).cast("timestamp").alias("updated_at")
    )


def upsert_watched(watched: DataFrame, latest: DataFrame, now) -> DataFrame:
    """The last-seen table after a poll: unchanged packages keep their row and time.

    ``latest`` holds at most one row per package.
    """
    polled = latest.select(*KEY, F.col("latest").alias("_new"))
    old = watched.select(*KEY, "last_version", "updated_at")
    moved = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("last_version"))
    return old.join(polled, list(KEY), "full").select(
        *KEY,
        F.when(moved, F.col("_new")).otherwise(F.col("last_version")).alias("last_version"),
        F.when(moved, F.lit(now).cast("timestamp")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def restrict_to_watchlist(rows: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Only listed packages are polled; the list side is broadcast when Spark finds it small."""
    return rows.join(allowlist.select(*KEY), list(KEY), "left_semi")
