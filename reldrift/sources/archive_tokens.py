"""Evidence candidates by archive address, kept from cycle to cycle.

An archive does not change under its address, so a cycle opens only archives that no cycle
before it has opened and found sound.  Tokens are appended below
``<root>/archive_tokens/cycle=<cycle>/kind=<kind>``; rows of kind 'verdict' tell which
addresses a cycle opened, and with what outcome.  Cycle names must ascend as texts.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archives
from .tables import read_table, write_cycle

VERDICT = "verdict"
_STORED = "source_url string, archive_status string, file_ord int, pos int, token string, cycle string, kind string"


def read_tokens(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/archive_tokens", _STORED)


def opened(spark: SparkSession, root: str, before: str) -> DataFrame:
    """(source_url, cycle): the archives found sound or empty by cycles before this one, with the newest such cycle."""
    verdicts = read_tokens(spark, root).where((F.col("kind") == VERDICT) & (F.col("cycle") < before))
    sound = verdicts.where(F.col("archive_status") != archives.ERROR)
    return sound.groupBy("source_url").agg(F.max("cycle").alias("cycle"))


def outcomes(spark: SparkSession, root: str) -> DataFrame:
    """(source_url, cycle, archive_status) of every archive a cycle has opened."""
    verdicts = read_tokens(spark, root).where(F.col("kind") == VERDICT)
    return verdicts.select("source_url", "cycle", "archive_status").distinct()


def rejected(spark: SparkSession, root: str) -> DataFrame:
    """The archives that were opened and are damaged, or of no known format, with the reason."""
    reason = F.when(F.col("archive_status") == archives.ERROR, "damaged archive").when(F.col("archive_status") == archives.EMPTY, "unknown format")
    return outcomes(spark, root).select("source_url", "cycle", reason.alias("reason")).where(F.col("reason").isNotNull())


def tokens_of(
    spark: SparkSession, root: str, cycle: str, packed: DataFrame, pairs: DataFrame, unpack: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The tokens of all archives that ``pairs`` name; those never opened are unpacked now and kept.

    ``packed`` lists landed archives by address; an address that is not listed has no rows.
    """
    named = pairs.select(F.explode(F.array("source_url", "prev_source_url")).alias("source_url")).distinct()
    known = opened(spark, root, cycle).join(named, "source_url", "left_semi")
    fresh = packed.join(named, "source_url", "left_semi").join(known, "source_url", "left_anti")
    if "length" in fresh.columns:
        fresh = archives.by_bytes(fresh)
    write_cycle(unpack(fresh), root, "archive_tokens", cycle, "kind")
    cycles = [r["cycle"] for r in known.select("cycle").distinct().collect()]  # one short name per cycle at most
    stored = read_tokens(spark, root)
    old = stored.where(F.col("cycle").isin(*cycles)).join(known, ["source_url", "cycle"], "left_semi") if cycles else stored.limit(0)
    return old.unionByName(stored.where(F.col("cycle") == cycle)).drop("cycle")
