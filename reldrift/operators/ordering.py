"""Previous value, number and running total in order, safe for keys that hold a large share of the rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def _ranged(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` dealt out by ranges of ``order``, whose bounds follow the data, and written with the number of their range."""
    return materialize(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranged")


def with_previous(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], value: str, out: str) -> DataFrame:
    """``lag(value)`` per key, without sending a whole key to one task.

    Rows are dealt out by ranges of (key, order).  A row is compared with its predecessor
    inside (key, range); the first row of a range takes the value of the last row of the
    range before it if that has the same key.  Those values are one row per range, so they
    are broadcast whatever the keys.  Rows without a key, a place or a value stand for no
    release and are left out; :func:`without_place` lists them.
    """
    ranged = _ranged(df.where(_placed(keys, order_by, value)), [*keys, *order_by])
    place = F.struct(*keys, *order_by)
    ends = ranged.groupBy("_range").agg(F.max(F.struct(place.alias("place"), F.col(value).alias("value"))).alias("last"), F.min(F.struct(*keys)).alias("first"))
    # one row per range: as many as tasks wrote them
    before = F.lag("last").over(Window.orderBy("_range"))
    carried = ends.select("_range", "first", before.alias("before"))
    same = F.lit(True)
    for key in keys:
        same = same & (F.col(f"before.place.{key}") == F.col(f"first.{key}"))
    carried = carried.where(same).select("_range", *[F.col(f"first.{k}").alias(k) for k in keys], F.col("before.value").alias("_carried"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order_by)
    return (
        ranged.withColumn("_inside", F.lag(value).over(inside))
        .join(F.broadcast(carried), [*keys, "_range"], "left")
        .withColumn(out, F.coalesce("_inside", "_carried"))
        .drop("_range", "_inside", "_carried")
    )


def with_running_total(df: DataFrame, order_by: Sequence[str], amount: str, out: str) -> DataFrame:
    """The sum of ``amount`` over all rows before each row; no task gets all rows.

    A range sums its own rows; the sums of the ranges before it, one number per range, are
    broadcast.
    """
    ranged = _ranged(df, order_by)
    whole = ranged.groupBy("_range").agg(F.sum(amount).alias("_sum"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.select("_range", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
        .join(F.broadcast(before), "_range")
        .withColumn(out, F.col("_before") + F.col("_inside"))
        .drop("_range", "_inside", "_before")
    )


def without_place(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], value: str) -> DataFrame:
    """The rows :func:`with_previous` leaves out."""
    return df.where(~_placed(keys, order_by, value))


def _placed(keys: Sequence[str], order_by: Sequence[str], value: str) -> Column:
    known = F.lit(True)
    for column in (*keys, order_by[0], value):
        known = known & F.col(column).isNotNull()
    return known
