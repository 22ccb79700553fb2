import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from reldrift.operators import changes
from reldrift.operators.ordering import with_previous, without_place

START = datetime(2024, 1, 1)
POLLS = "ecosystem string, name string, latest string, polled_at timestamp_ntz, event_id bigint"


def polls(spark, rows):
    return spark.createDataFrame(
        [("npm", name, version, START + timedelta(hours=h), i) for i, (name, version, h) in enumerate(rows)], POLLS
    )


@pytest.mark.parametrize("ranges", ["1", "7", "40"])
def test_previous_value_equals_lag_with_a_hot_key(spark, ranges):
    rng = random.Random(ranges)
    rows = []
    for seq in rng.sample(range(5000), 1500):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 60)}"
        rows.append((key, seq, rng.choice("abc")))
    df = spark.createDataFrame(rows, "k string, seq bigint, v string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mine = with_previous(df, ["k"], ["seq"], "v", "prev").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    plain = df.withColumn("prev", F.lag("v").over(Window.partitionBy("k").orderBy("seq")))
    assert sorted((r.k, r.seq, r.v, r.prev or "") for r in mine) == sorted((r.k, r.seq, r.v, r.prev or "") for r in plain.collect())


def test_one_package_of_one_day_is_dealt_out_evenly(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(20_000).select(F.when(F.col("id") % 10 == 0, F.col("id").cast("string")).otherwise("hot").alias("k"), F.col("id").alias("seq"), F.lit("v").alias("v"))
        ranged = df.repartitionByRange(8, "k", "seq").groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(r["count"] for r in ranged) <= 2 * 20_000 / len(ranged)


def test_rows_without_key_place_or_value_are_listed(spark):
    df = spark.createDataFrame([("a", 1, "x"), (None, 2, "x"), ("a", None, "x"), ("a", 3, None)], "k string, seq bigint, v string")
    assert with_previous(df, ["k"], ["seq"], "v", "prev").count() == 1
    assert without_place(df, ["k"], ["seq"], "v").count() == 3


def test_any_difference_is_a_change_and_first_sight_is_none(spark):
    df = polls(spark, [("p", "1", 0), ("p", "1", 1), ("p", "2", 2), ("p", "1", 60), ("q", "9", 0)])
    rows = changes.version_changes(df).orderBy("event_id").collect()
    assert [(r.name, r.prev_version, r.version) for r in rows] == [("p", "1", "2"), ("p", "2", "1")]
    assert sorted((r.name, r.version) for r in changes.first_seen(df).collect()) == [("p", "1"), ("q", "9")]


def test_equal_times_are_ordered_by_event(spark):
    df = polls(spark, [("p", "1", 0), ("p", "2", 5), ("p", "3", 5)])
    rows = changes.version_changes(df).orderBy("event_id").collect()
    assert [(r.prev_version, r.version) for r in rows] == [("1", "2"), ("2", "3")]
    assert changes.watched_versions(df).first().last_version == "3"


def test_last_seen_time_moves_only_on_change(spark):
    df = polls(spark, [("p", "1", 0), ("p", "2", 30), ("p", "2", 90), ("q", "5", 3), ("q", "5", 99)])
    rows = {r.name: r for r in changes.watched_versions(df).collect()}
    assert (rows["p"].last_version, rows["p"].updated_at) == ("2", START + timedelta(hours=30))
    assert (rows["q"].last_version, rows["q"].updated_at) == ("5", START + timedelta(hours=3))


def test_lookup_filter_and_upsert(spark):
    old = datetime(2024, 1, 1, tzinfo=timezone.utc)
    now = datetime(2024, 3, 1, tzinfo=timezone.utc)
    watched = spark.createDataFrame(
        [("npm", "same", "1", old), ("npm", "moved", "1", old), ("npm", "gone", "7", old)],
        "ecosystem string, name string, last_version string, updated_at timestamp",
    )
    latest = spark.createDataFrame(
        [("npm", "same", "1"), ("npm", "moved", "0.9"), ("npm", "new", "3")], "ecosystem string, name string, latest string"
    )
    looked = changes.look_up_last_seen(latest, watched)
    assert {r.name: r.last_seen for r in looked.collect()} == {"same": "1", "moved": "1", "new": ""}
    assert [r.name for r in changes.changed_only(looked).collect()] == ["moved"]
    after = changes.upsert_watched(watched, latest, now)
    micros = F.unix_micros("updated_at")
    rows = {r.name: (r.last_version, r.at == int(now.timestamp() * 1e6))
            for r in after.select("name", "last_version", micros.alias("at")).collect()}
    assert rows == {"same": ("1", False), "moved": ("0.9", True), "gone": ("7", False), "new": ("3", True)}


def test_watchlist_keeps_listed_packages_only_and_once(spark):
    rows = spark.createDataFrame([("npm", "a"), ("pypi", "a"), ("npm", "b")], "ecosystem string, name string")
    listed = spark.createDataFrame([("npm", 1, "a"), ("npm", 2, "a")], "ecosystem string, rank int, name string")
    assert [tuple(r) for r in changes.restrict_to_watchlist(rows, listed).collect()] == [("npm", "a")]
