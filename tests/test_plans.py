"""Plan shapes that matter at scale."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from reldrift.operators import changes, diffing, ranking, readmodels, tokens
from crosscheck import derived

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    """The plan as adaptive execution settled it; runs the very frame it reads."""
    df._jdf.collectToPython()
    return plan(df)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_tokens_are_cut_in_one_pass_without_a_shuffle(spark):
    files = spark.createDataFrame([], "ecosystem string, name string, version string, file_ord int, path string, content string, other string")
    text = plan(tokens.release_tokens(files))
    assert "Exchange" not in text and "Union" not in text
    assert text.count("regexp_replace(") == 2  # one per language, both in one projection
    assert "content" not in text.splitlines()[0]


def test_path_filter_runs_before_the_text_is_touched(spark):
    text = plan(tokens.release_tokens(derived.release_files(spark, SF)))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text
    assert text.index("regexp_replace(") < text.index("Filter ((lower(substring_index(path")


def test_previous_value_is_taken_inside_ranges_of_the_key(spark, no_broadcast):
    text = final_plan(changes.version_changes(derived.polls(spark, SF)))
    assert re.search(r"hashpartitioning\((ecosystem#\d+, )?name#\d+, _range#\d+", text)


def test_difference_is_an_anti_join_on_release_and_token(spark, no_broadcast):
    found = tokens.release_tokens(derived.release_files(spark, SF))
    pairs = diffing.release_pairs(derived.releases(spark, SF))
    text = plan(diffing.new_tokens(found, pairs))
    (join,) = [line for line in text.splitlines() if "LeftAnti" in line]
    assert "SortMergeJoin" in join and "prev_version#" in join and "token#" in join
    assert "Cartesian" not in text and "NestedLoop" not in text


def test_a_hot_token_is_split_between_tasks(spark, no_broadcast):
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        # one release repeats one address in most rows
        rows = spark.range(0, 60_000, 1, 8).select(
            F.lit("npm").alias("ecosystem"), F.lit("p").alias("name"),
            F.when(F.col("id") % 50 == 0, "1").otherwise("2").alias("version"),
            F.lit("url").alias("kind"), F.col("id").cast("int").alias("file_ord"), F.lit(0).alias("pos"),
            F.when(F.col("id") % 3 == 0, F.concat(F.lit("https://u.io/"), F.col("id"))).otherwise("https://hot.io/").alias("token"),
        ).where("NOT (version = '1' AND token = 'https://hot.io/')")
        pairs = spark.createDataFrame([("npm", "p", "2", "1")], "ecosystem string, name string, version string, prev_version string")
        new = diffing.new_tokens(rows, pairs).groupBy("file_ord").count()
        assert "skew=true" in final_plan(new)
        assert new.count() == rows.where("version = '2'").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ranking_cuts_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(ranking.top_names(derived.package_ranking(spark, SF)))


def test_recent_lists_take_the_top_without_a_full_sort(spark):
    text = plan(readmodels.recent_activity(changes.watched_versions(derived.polls(spark, SF))))
    assert "TakeOrderedAndProject" in text
