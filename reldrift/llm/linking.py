"""Confirmed links between classes that share a band, without all pairs of a band."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .components import components


def group_links(
    classes: DataFrame, judged: list[str], alike: Column, confirm: Callable[[DataFrame], DataFrame],
    refine: Callable[[DataFrame], DataFrame] | None = None, alike_refined: Column | None = None,
) -> DataFrame:
    """(rep, bands, judged columns) -> links (a, b) that give the groups of all confirmed pairs.

    ``alike`` judges the sides ``x`` and ``y`` on their judged columns; ``confirm`` keeps of
    pairs (a, b) those that are links.  Twice, every class is confirmed against one hub: of
    the hubs of its bands, the class of another group that is alike and meets most classes.
    A text that was copied meets more of its copies than they meet each other, so a group of
    copies is found by one check a class.  Then the bands that still hold classes of
    different groups give their pairs across groups, so no alike pair goes unchecked.
    There ``refine`` may add columns to the classes left, by (rep), that ``alike_refined`` judges.
    """
    banded = classes.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("met")).where("met > 1")
    members = materialize(banded.join(shared, "key"), "near-members")
    weight = members.groupBy("rep").agg(F.sum("met").alias("weight"))
    side = classes.select("rep", "bands", *judged).join(weight, "rep")
    grouped = materialize(side.withColumn("g", F.col("rep")), "near-grouped")
    links = None
    for turn in range(2):
        placed = materialize(members.select("key", "rep").join(grouped.select("rep", "g", "weight"), "rep"), f"near-placed-{turn}")
        hubs = placed.groupBy("key").agg(F.max(F.struct("weight", "rep", "g")).alias("h"), F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi")
        starred = placed.join(hubs, "key").where(F.col("g") != F.col("h.g")).select("rep", F.col("h.rep").alias("hub")).distinct().alias("p")
        x, y = grouped.alias("x"), grouped.alias("y")
        best = F.max(F.struct("y.weight", "y.rep")).alias("best")
        one = (
            starred.join(x, F.col("p.rep") == F.col("x.rep")).join(y, F.col("p.hub") == F.col("y.rep")).where(alike)
            .groupBy(F.col("p.rep").alias("b")).agg(best).select(F.col("best.rep").alias("a"), "b")
        )
        found = confirm(materialize(one, f"near-star-{turn}"))
        links = found if links is None else links.unionByName(found)
        groups = components(links, f"near-groups-{turn}")
        moved = side.join(groups, side["rep"] == groups["node"], "left").select(*side.columns, F.coalesce("component", "rep").alias("g"))
        grouped = materialize(moved, f"near-grouped-{turn}")
    placed = materialize(members.select("key", "rep").join(grouped.select("rep", "g"), "rep"), "near-placed")
    mixed = placed.groupBy("key").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo <> hi").select("key")
    open_ = materialize(placed.join(mixed, "key").select("key", "rep").join(grouped, "rep"), "near-open")
    both = (F.col("x.key") == F.col("y.key")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.g") != F.col("y.g"))
    # a pair that meets in several bands is judged and given out in one of them
    both = both & (F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.key")) & alike
    if refine is not None:
        open_ = open_.join(materialize(refine(open_.select("rep").distinct()), "near-refined"), "rep")
        both = both & alike_refined
    x, y = open_.alias("x"), open_.alias("y")
    across = (
        x.join(y, both)
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    )
    return links.unionByName(confirm(materialize(across, "near-across")))
