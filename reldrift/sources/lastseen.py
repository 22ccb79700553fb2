"""The last-seen table as runs: a cycle writes the packages it moved, and merges runs of like size.

``<root>/watched/run=<first>..<last>..<rows>/bucket=<n>`` holds, for every package moved in the
cycles first to last, its newest row; it has so many rows at most.  A cycle adds the run of
itself; as long as the run before is no larger than what was just written, both become one.  So a table of n packages is some
log(n) runs, a row is rewritten log(n) times however long the history is, and the largest
run, which holds most packages, is left alone while cycles move few.

The table as of a cycle is a chain of runs, from the newest back; the newest row of a package
counts.  Cycle names must ascend as texts.  Repeating the newest cycle replaces the runs
that end with it; the runs of the cycle before it are kept for that, older ones are dropped.
"""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..session import hadoop_path

KEY = ("ecosystem", "name")
BUCKETS = 16

_STORED = T.StructType([*S.WATCHED.fields, T.StructField("run", T.StringType()), T.StructField("bucket", T.IntegerType())])


class Run(NamedTuple):
    """The cycles a run covers, and the rows it has at most."""

    first: str
    last: str
    rows: int


class LastSeen:
    """The table below ``root``; ``buckets`` must stay the same for a table."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, f"{root}/watched", buckets

    # --- runs ------------------------------------------------------------------

    def _runs(self) -> list[Run]:
        """Every run that was written to its end."""
        path, files = hadoop_path(self.spark, self.folder)
        if not files.exists(path):
            return []
        names = [f.getPath().getName() for f in files.listStatus(path)]
        done = [n for n in names if n.startswith("run=") and files.exists(hadoop_path(self.spark, f"{self.folder}/{n}/_SUCCESS")[0])]
        cut = [n.removeprefix("run=").split("..") for n in done]
        return [Run(first, last, int(rows)) for first, last, rows in cut]

    def chain(self, as_of: str | None = None) -> list[Run]:
        """The runs that make the table as of a cycle (the newest if None), newest first; of those that end alike the longest."""
        runs = [r for r in self._runs() if as_of is None or r.last <= as_of]
        found = []
        while runs:
            last = max(r.last for r in runs)
            found.append(min(r for r in runs if r.last == last))
            runs = [r for r in runs if r.last < found[-1].first]
        return found

    def _path(self, run: Run) -> str:
        return f"{self.folder}/run={run.first}..{run.last}..{run.rows}"

    def _drop(self, run: Run) -> None:
        path, files = hadoop_path(self.spark, self._path(run))
        files.delete(path, True)

    # --- reading ---------------------------------------------------------------

    def _bucket(self):
        return F.pmod(F.xxhash64(*KEY), F.lit(self.buckets)).cast("int")

    def _read(self, runs: list[Run], buckets: list[int] | None = None) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], S.WATCHED)
        rows = self.spark.read.schema(_STORED).option("basePath", self.folder).parquet(*map(self._path, runs))
        if buckets is not None:
            rows = rows.where(F.col("bucket").isin(*buckets))
        if len(runs) == 1:
            return rows.select(*S.WATCHED.names)
        newest = F.max_by(F.struct("last_version", "updated_at"), F.split("run", r"\.\.")[1]).alias("_w")
        return rows.groupBy(*KEY).agg(newest).select(*KEY, "_w.last_version", "_w.updated_at")

    def snapshot(self, as_of: str | None = None) -> DataFrame:
        """The whole table: one row per package."""
        return self._read(self.chain(as_of))

    def look_up(self, keys: DataFrame, as_of: str | None = None) -> DataFrame:
        """The rows of the packages of ``keys``; only the buckets they fall into are opened."""
        asked = keys.select(*KEY).distinct()
        buckets = [r["b"] for r in asked.select(self._bucket().alias("b")).distinct().collect()]  # at most `buckets`
        return self._read(self.chain(as_of), buckets).join(asked, list(KEY), "left_semi")

    # --- writing ---------------------------------------------------------------

    def _write(self, rows: DataFrame, run: Run) -> None:
        rows.select(*S.WATCHED.names, self._bucket().alias("bucket")).repartition("bucket").write.mode("overwrite").partitionBy(
            "bucket"
        ).parquet(self._path(run))

    def record(self, moved: DataFrame, cycle: str) -> None:
        """Write what a cycle moved, one row per package, and merge runs of like size.

        ``moved`` is read twice, so it should be a written table.
        """
        if ".." in cycle:
            raise ValueError("the name of a cycle holds no two dots")
        for run in self._runs():
            if run.last == cycle:
                self._drop(run)
        self._write(moved, Run(cycle, cycle, moved.count()))
        chain = self.chain(cycle)
        rows, merged = chain[0].rows, 1
        while merged < len(chain) and chain[merged].rows <= rows:
            rows, merged = rows + chain[merged].rows, merged + 1
        if merged > 1:
            self._write(self._read(chain[:merged]), Run(chain[merged - 1].first, cycle, rows))
        before = max((r.last for r in self._runs() if r.last < cycle), default=None)
        kept = {*self.chain(cycle), *(self.chain(before) if before else [])}
        for run in self._runs():
            if run.last <= cycle and run not in kept:
                self._drop(run)
