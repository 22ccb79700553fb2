"""Watch lists: one JSON array of names per ecosystem, in order of popularity."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "ecosystem string, rank int, name string"


def read_allowlists(spark: SparkSession, folder: str) -> DataFrame:
    """(ecosystem, rank, name) from ``<folder>/<ecosystem>.json``; rank starts at 1.

    A file that is no JSON array of strings counts as an empty list, and so does a
    missing folder.
    """
    try:
        files = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], _SCHEMA)
    ecosystem = F.regexp_extract(F.col("_metadata.file_name"), r"\A(.*)\.json\z", 1)
    names = F.from_json("value", "array<string>")
    return files.select(ecosystem.alias("ecosystem"), F.posexplode(names).alias("pos", "name")).select(
        "ecosystem", (F.col("pos") + 1).alias("rank"), "name"
    )


def allowlist_documents(top: DataFrame) -> DataFrame:
    """(ecosystem, rank, name) -> (ecosystem, value): the list as an indented JSON array.

    The input is a top-N list, so the gathered array has at most N names.
    """
    ordered = F.sort_array(F.collect_list(F.struct("rank", "name")))
    quoted = F.transform(
        ordered, lambda r: F.regexp_extract(F.to_json(F.array(r["name"])), r"\A\[([\s\S]*)\]\z", 1)
    )
    return top.groupBy("ecosystem").agg(
        F.concat(F.lit("[\n "), F.array_join(quoted, ",\n "), F.lit("\n]")).alias("value")
    )


def write_allowlists(top: DataFrame, folder: str) -> None:
    """One text file per ecosystem, below ``<folder>/ecosystem=<ecosystem>``."""
    allowlist_documents(top).repartition("ecosystem").write.mode("overwrite").partitionBy(
        "ecosystem"
    ).text(folder)


def read_written_allowlists(spark: SparkSession, folder: str) -> DataFrame:
    """Read back what :func:`write_allowlists` wrote."""
    files = spark.read.text(folder, wholetext=True)
    return files.select("ecosystem", F.posexplode(F.from_json("value", "array<string>")).alias("pos", "name")).select(
        "ecosystem", (F.col("pos") + 1).alias("rank"), "name"
    )
