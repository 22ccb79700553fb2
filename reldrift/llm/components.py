"""Connected components of an edge table, in Spark joins."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(a, b) links -> (node, component): the smallest node reachable, for every node of a link.

    Each round takes the smallest label among a node and its neighbours and then the label
    of that label, so a chain shrinks by more than half; every round is written, and it ends
    when no label changes.  Hot nodes are met by partial aggregation.
    """
    both = materialize(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(),
        f"{label}-links",
    )
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), f"{label}-0")
    turn = 0
    while True:
        turn += 1
        told = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("seen"))
        least = labels.join(told, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "seen").alias("component"))
        least = materialize(least, f"{label}-least-{turn}")
        of = least.select(F.col("node").alias("component"), F.col("component").alias("further"))
        labels = materialize(
            least.join(of, "component", "left").select("node", "old", F.coalesce("further", "component").alias("component")), f"{label}-{turn}"
        )
        moved = labels.where("component <> old").isEmpty()
        labels = labels.select("node", "component")
        if moved:
            return labels
