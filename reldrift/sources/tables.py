"""State tables as parquet folders: findings, their evidence, scan log and counters.

Findings and evidence stand in a folder per day and, below it, per cycle, so the newest are
found by opening days from the newest back.  A finding is a narrow row; its evidence is
stored in long form under its id and nested only for those that are read.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import patterns as P
from ..operators import diffing
from ..operators.readmodels import effective_limit, recent_findings
from ..session import hadoop_path
from .lastseen import LastSeen


def with_finding_id(findings: DataFrame) -> DataFrame:
    """Add a stable id: the same release pair diffed at the same time has the same id."""
    key = F.to_json(F.struct(*S.PAIR, F.unix_micros(F.col("analyzed_at").cast("timestamp")).alias("at")))
    return findings.withColumn("id", F.sha2(key, 256))


def read_table(spark: SparkSession, path: str, schema, base: str | None = None) -> DataFrame:
    """A parquet folder, empty if it is missing."""
    try:
        reader = spark.read.schema(schema)
        return (reader.option("basePath", base) if base else reader).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _cycle_path(root: str, table: str, cycle: str) -> str:
    return f"{root}/{table}/cycle={cycle}"


def write_cycle(df: DataFrame, root: str, table: str, cycle: str, *partition_by: str) -> None:
    """Write one cycle's rows of an append-only table.

    The cycle owns its folder, so a repeated cycle replaces its own rows and no
    others: a rerun neither loses nor doubles anything.
    """
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(_cycle_path(root, table, cycle))


# --- findings and evidence ----------------------------------------------------------

_DAY = "analyzed_date"
_SUMMARY = T.StructType([
    *[T.StructField(c, T.StringType()) for c in S.PAIR],
    T.StructField("severity", T.IntegerType()),
    T.StructField("signals", T.ArrayType(T.StructType([f for f in S.SIGNAL.fields if f.name != "evidence"]))),
    T.StructField("analyzed_at", T.TimestampType()),
    T.StructField("id", T.StringType()),
])
_EVIDENCE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("file_ord", T.IntegerType()),
    T.StructField("pos", T.IntegerType()), T.StructField("token", T.StringType()),
])


def _write_dated(df: DataFrame, root: str, table: str, cycle: str) -> None:
    """One folder per day and cycle; what an earlier run of the cycle left is removed first, on any day."""
    path, files = hadoop_path(df.sparkSession, f"{root}/{table}/*/cycle={cycle}")
    for old in files.globStatus(path) or []:
        files.delete(old.getPath(), True)
    dated = df.withColumn(_DAY, F.to_date("analyzed_at")).withColumn("cycle", F.lit(cycle))
    dated.write.mode("append").partitionBy(_DAY, "cycle").parquet(f"{root}/{table}")


def write_findings(new_tokens: DataFrame, analyzed_at: Column, root: str, cycle: str) -> None:
    """Findings as narrow rows and their evidence in long form, both under the finding's id."""
    stamp = analyzed_at.cast("timestamp")
    _write_dated(with_finding_id(diffing.summaries(new_tokens).withColumn("analyzed_at", stamp)), root, "findings", cycle)
    rows = with_finding_id(diffing.evidence(new_tokens).withColumn("analyzed_at", stamp))
    _write_dated(rows.select(*_EVIDENCE.names, "analyzed_at"), root, "evidence", cycle)


def _dated(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(_DAY, T.DateType()), T.StructField("cycle", T.StringType())])


def read_summaries(spark: SparkSession, root: str) -> DataFrame:
    """All findings without their evidence; a condition on ``analyzed_date`` prunes folders."""
    return read_table(spark, f"{root}/findings", _dated(_SUMMARY)).drop("cycle")


def read_evidence(spark: SparkSession, root: str) -> DataFrame:
    """(id, kind, file_ord, pos, token, analyzed_date) of all findings."""
    return read_table(spark, f"{root}/evidence", _dated(_EVIDENCE)).drop("cycle")


def nest(summaries: DataFrame, evidence: DataFrame) -> DataFrame:
    """Findings whose signals hold their evidence in order: one row gets all of a release's."""
    names = F.create_map(*[F.lit(x) for name, signal in P.SIGNALS.items() for x in (name, signal[1])])
    placed = F.sort_array(F.collect_list(F.struct("file_ord", "pos", "token")))
    by_kind = evidence.groupBy("id", "kind").agg(F.transform(placed, lambda e: e["token"]).alias("tokens"))
    together = F.map_from_entries(F.collect_list(F.struct(names[F.col("kind")].alias("kind"), "tokens")))
    nested = by_kind.groupBy("id").agg(together.alias("_evidence"))
    signal = lambda s: F.struct(s["kind"], s["description"], F.try_element_at("_evidence", s["kind"]).alias("evidence"), s["weight"])
    return summaries.join(nested, "id", "left").withColumn("signals", F.transform("signals", signal)).select(
        *[c for c in summaries.columns if c != "id"], "id"
    )


def read_findings(spark: SparkSession, root: str) -> DataFrame:
    """All stored findings with their evidence."""
    return nest(read_summaries(spark, root), read_evidence(spark, root).drop(_DAY))


def _days(spark: SparkSession, root: str) -> list[str]:
    """The day folders of the findings, newest first."""
    path, files = hadoop_path(spark, f"{root}/findings/{_DAY}=*")
    return sorted((f.getPath().getName() for f in files.globStatus(path) or []), reverse=True)


def recent_stored_findings(spark: SparkSession, root: str, limit: int = 0) -> DataFrame:
    """Newest stored findings, newest first.

    Days are opened from the newest back until they hold enough, so what is read does not
    grow with the history.  Evidence is read for the chosen few (at most 200, so they may be
    broadcast) and from their days only.
    """
    wanted, found, days = effective_limit(limit, P.RECENT_FINDINGS), 0, []
    for day in _days(spark, root):
        days.append(day)
        found += read_table(spark, f"{root}/findings/{day}", _dated(_SUMMARY), f"{root}/findings").count()
        if found >= wanted:
            break
    if not days:
        return read_findings(spark, root)
    opened = lambda table, schema: spark.read.schema(_dated(schema)).option("basePath", f"{root}/{table}").parquet(
        *[f"{root}/{table}/{day}" for day in days]
    ).drop("cycle")
    newest = recent_findings(opened("findings", _SUMMARY), limit)
    evidence = opened("evidence", _EVIDENCE).drop(_DAY).join(F.broadcast(newest.select("id")), "id", "left_semi")
    return recent_findings(nest(newest, evidence), limit)


# --- scan log and counters ------------------------------------------------------------


def read_scan_log(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, f"{root}/scan_log", S.SCAN_LOG).drop("cycle")


_COUNTERS = "packages_watched long, versions_scanned long, findings_total long"


def write_counters(spark: SparkSession, root: str, cycle: str, packages: int, versions: int, findings: int) -> None:
    """What a cycle adds to the statistics: one row."""
    row = spark.createDataFrame([(packages, versions, findings)], _COUNTERS)
    write_cycle(row.coalesce(1), root, "counters", cycle)


def read_statistics(spark: SparkSession, root: str) -> DataFrame:
    """One row: packages watched, versions scanned, findings stored; a sum over the cycles' counters."""
    counters = read_table(spark, f"{root}/counters", _COUNTERS)
    return counters.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("packages_watched", "versions_scanned", "findings_total")])


def read_watched(spark: SparkSession, root: str, cycle: str | None) -> DataFrame:
    """The last-seen table as a cycle left it; no cycle means nothing was seen yet."""
    return LastSeen(spark, root).snapshot(cycle) if cycle else spark.createDataFrame([], S.WATCHED)
