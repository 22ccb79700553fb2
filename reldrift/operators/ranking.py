"""Top names per ecosystem by popularity."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P


def top_names(ranking: DataFrame, limit: int = P.LIST_SIZE) -> DataFrame:
    """(ecosystem, name, dependents, part_key) -> (ecosystem, rank, name), rank 1..limit.

    Most dependents first, ties by key; empty names are skipped and a repeated name
    counts once, at its best place.  The rank filter is applied inside each task
    before the shuffle, so an ecosystem sends at most ``limit`` rows per task.
    """
    best = (
        ranking.where(F.col("name") != "")
        .groupBy("ecosystem", "name")
        .agg(F.max(F.struct("dependents", (-F.col("part_key")).alias("order"))).alias("_best"))
        .select("ecosystem", "name", "_best.dependents", "_best.order")
    )
    place = Window.partitionBy("ecosystem").orderBy(F.desc("dependents"), F.desc("order"))
    return (
        best.withColumn("rank", F.row_number().over(place))
        .where(F.col("rank") <= limit)
        .select("ecosystem", "rank", "name")
    )
