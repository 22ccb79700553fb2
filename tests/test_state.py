"""The last-seen runs, the bitmap filter, and the stateful form of change detection."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reldrift.operators import changes, membership
from reldrift.operators.ordering import with_running_total
from reldrift.sources.lastseen import LastSeen, Run
from reldrift.streaming import changes as stream

START = datetime(2024, 1, 1)
ROWS = "ecosystem string, name string, last_version string, updated_at timestamp"


def moved(spark, names, version):
    return spark.createDataFrame([("npm", n, version, START + timedelta(hours=int(version))) for n in names], ROWS)


def state(df):
    return {r.name: r.last_version for r in df.collect()}


@pytest.fixture(scope="module")
def history(spark, tmp_path_factory):
    """A table of 400 packages and 13 cycles that move few of them, and what it should be after each."""
    table = LastSeen(spark, str(tmp_path_factory.mktemp("runs")), buckets=4)
    rng, known, after, written = random.Random(3), {}, {}, {}
    for cycle in range(14):
        names = [f"p{i}" for i in (range(400) if cycle == 0 else sorted(rng.sample(range(420), 6)))]
        before = set(table._runs())
        table.record(moved(spark, names, str(cycle)), f"{cycle:03}")
        known = known | {n: str(cycle) for n in names}
        after[f"{cycle:03}"] = known
        written[f"{cycle:03}"] = sum(r.rows for r in set(table._runs()) - before)
    return table, after, written


def test_runs_are_merged_and_the_newest_row_counts(history):
    table, after, _ = history
    assert state(table.snapshot()) == after["013"] and len(table.chain()) < 6
    assert state(table.snapshot("012")) == after["012"]  # kept for a repetition of the newest cycle
    assert table.chain("000") == [] or state(table.snapshot("000")) == after["000"]


def test_a_cycle_writes_what_it_moved(history):
    """The large first run is not rewritten by cycles that move few packages."""
    table, _, written = history
    assert table.chain()[-1] == ("000", "000", 400)
    assert max(rows for cycle, rows in written.items() if cycle != "000") < 100


def test_look_up_opens_the_buckets_of_its_keys(spark, history):
    table, after, _ = history
    keys = spark.createDataFrame([("npm", "p7"), ("npm", "p7"), ("npm", "absent"), ("pypi", "p7")], "ecosystem string, name string")
    found = table.look_up(keys, "013")
    assert [(r.name, r.last_version) for r in found.collect()] == [("p7", after["013"]["p7"])]
    one = table.look_up(keys.limit(1), "013")
    assert "bucket#" in one._jdf.queryExecution().executedPlan().toString()


def test_a_repeated_cycle_replaces_its_runs(spark, tmp_path):
    table = LastSeen(spark, str(tmp_path), buckets=2)
    for cycle in "1234":
        table.record(moved(spark, ["a", f"b{cycle}"], cycle), cycle)
    table.record(moved(spark, ["c"], "9"), "4")
    assert state(table.snapshot()) == {"a": "3", "b1": "1", "b2": "2", "b3": "3", "c": "9"}
    assert state(table.snapshot("3")) == {"a": "3", "b1": "1", "b2": "2", "b3": "3"}


def test_a_run_that_was_not_finished_does_not_count(spark, tmp_path):
    from pathlib import Path

    table = LastSeen(spark, str(tmp_path), buckets=2)
    table.record(moved(spark, ["a"], "1"), "1")
    table._write(moved(spark, ["a"], "5"), Run("2", "2", 1))
    (Path(table.folder) / "run=2..2..1" / "_SUCCESS").unlink()
    assert state(table.snapshot()) == {"a": "1"}
    table.record(moved(spark, ["a"], "2"), "2")
    assert state(table.snapshot()) == {"a": "2"}


def test_empty_tables(spark, tmp_path):
    table = LastSeen(spark, str(tmp_path))
    assert table.snapshot().count() == 0 and table.look_up(moved(spark, ["a"], "1")).count() == 0
    table.record(moved(spark, ["a"], "1").limit(0), "1")
    assert table.snapshot("1").count() == 0


@pytest.mark.parametrize("bits", [10, 22])
def test_the_bitmap_lets_every_key_pass(spark, bits):
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 7 != 0, F.xxhash64("id")).alias("h"))
    keys = rows.where("id < 100")
    bitmap = membership.bitmap_of(keys, F.col("h"), bits)
    near, far = membership.may_be_in(rows, F.col("h"), bitmap, bits), membership.cannot_be_in(rows, F.col("h"), bitmap, bits)
    passed = {r.id for r in near.collect()}
    assert passed >= {i for i in range(100) if i % 7} and near.count() + far.count() == 20_000
    assert len(passed) < (200 if bits == 22 else 19_000) and not any(i % 7 == 0 for i in passed)
    none = membership.bitmap_of(keys.limit(0), F.col("h"), bits)
    assert membership.may_be_in(rows, F.col("h"), none, bits).count() == 0
    assert len(near._jdf.queryExecution().toString()) < 20_000  # the bits are no part of a plan


def test_bodies_are_ruled_out_before_the_shuffle(spark):
    """Only documents of changed packages reach the exchange of the bodies."""
    docs = spark.range(4000).select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), "id").alias("name"), F.repeat(F.col("id").cast("string"), 50).alias("body"))
    changed = docs.where("name in ('p17', 'p3999')").select("ecosystem", "name", changes.body_digest().alias("digest"), F.lit("2").alias("latest"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = changes.documents_of(docs, changed)
        assert sorted(r.name for r in found.collect()) == ["p17", "p3999"]
        text = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.splitlines()
    semi = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    body = [i for i, line in enumerate(lines) if "Exchange" in line and "hashpartitioning" in line and i < semi]
    assert body  # every exchange of bodies stands above the filter
    assert not [line for line in lines[semi + 1 :] if "Exchange hashpartitioning" in line and "body" in line]


def test_running_total(spark):
    rows = [(i * 37 % 500, i % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, n int")
    found = {r.k: r.before for r in with_running_total(df, ["k"], "n", "before").collect()}
    total, expected = 0, {}
    for k, n in sorted(rows):
        expected[k], total = total, total + n
    assert found == expected


POLLS = "ecosystem string, name string, latest string, polled_at timestamp_ntz, event_id bigint"


def streamed(spark, source, out):
    polls = spark.readStream.schema(POLLS).option("maxFilesPerTrigger", 1).parquet(source)
    query = (
        stream.stream_version_changes(polls).writeStream.format("parquet").option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return sorted((r.name, r.version, r.prev_version, r.polled_at, r.event_id) for r in spark.read.parquet(f"{out}/rows").collect())


def expected_changes(df):
    return sorted((r.name, r.version, r.prev_version, r.polled_at, r.event_id) for r in changes.version_changes(df).collect())


def test_polls_beyond_what_is_held_are_taken_in_order(spark, tmp_path, monkeypatch):
    """Stretches of all sizes: years apart, in one microsecond, and shuffled."""
    monkeypatch.setattr(stream, "HOLD", 40)
    rng = random.Random(5)
    spots = [0, 5, 10**6, 10**6 + 1, 10**13, 10**13 + 70_000_000, 3 * 10**14]
    rows = [("npm", "hot", rng.choice("abc"), START + timedelta(microseconds=rng.choice(spots) + rng.choice([0, 0, rng.randint(0, 10**9)])), i) for i in range(1500)]
    rows += [("npm", f"p{i % 5}", rng.choice("ab"), START + timedelta(minutes=i), 5000 + i) for i in range(60)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, POLLS)
    df.coalesce(1).write.parquet(str(tmp_path / "polls"))
    assert streamed(spark, str(tmp_path / "polls"), str(tmp_path)) == expected_changes(df)


def test_a_million_polls_of_one_package_in_one_batch(spark, tmp_path):
    polls = spark.range(1_000_000).select(
        F.lit("npm").alias("ecosystem"), F.lit("hot").alias("name"), (F.col("id") / 1000).cast("long").cast("string").alias("latest"),
        (F.lit(START) + F.expr("make_dt_interval(0, 0, 0, cast(id as decimal(18,6)))")).cast("timestamp_ntz").alias("polled_at"), F.col("id").alias("event_id"),
    )
    polls.orderBy(F.xxhash64("event_id")).coalesce(1).write.parquet(str(tmp_path / "polls"))
    found = streamed(spark, str(tmp_path / "polls"), str(tmp_path))
    assert [(int(v), int(p)) for _, v, p, _, _ in sorted(found, key=lambda r: r[4])] == [(i + 1, i) for i in range(999)]


def test_the_stateful_form_names_the_store_it_needs(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    try:
        with pytest.raises(ValueError, match="RocksDB"):
            stream.stream_version_changes(spark.range(1).selectExpr("'a' ecosystem", "'b' name"))
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
