"""Whole cycles: landed documents and archives in, state tables out; batch and stream."""

import io
import json
import tarfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from reldrift.operators import diffing, readmodels, tokens
from reldrift.plans import jobs
from reldrift.session import materialize
from reldrift.sources import allowlists, archive_tokens, tables
from reldrift.streaming.changes import stream_changes_by_batch, stream_version_changes
from reldrift.streaming.findings import stream_findings

T1 = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)
T2 = T1 + timedelta(minutes=30)


def npm_doc(name, latest, versions):
    return json.dumps({
        "dist-tags": {"latest": latest},
        "versions": {v: {"dist": {"tarball": f"mem://{name}-{v}"}} for v in versions},
    })


def tgz(text):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w:gz") as archive:
        data = text.encode()
        info = tarfile.TarInfo("package/index.js")
        info.size = len(data)
        archive.addfile(info, io.BytesIO(data))
    return bytearray(buffer.getvalue())


def docs(spark, latest):
    rows = [("npm", name, npm_doc(name, v, ["1", v])) for name, v in latest.items()]
    return spark.createDataFrame(rows, "ecosystem string, name string, body string")


ARCHIVES = {
    "mem://bad-1": tgz("let a"),
    "mem://bad-2": tgz('let a; require("child_process"); fetch("http://9.9.9.9/x") // https://comment.io'),
    "mem://good-1": tgz("let a"),
    "mem://good-2": tgz("let a, b"),
    "mem://torn-1": tgz("let a"),
    "mem://torn-2": bytearray(b"\x1f\x8b\x08" + b"\0" * 40),
    "mem://fresh-2": tgz("eval(x)"),
}


@pytest.fixture(scope="module")
def packed(spark):
    return spark.createDataFrame(list(ARCHIVES.items()), "source_url string, content binary")


@pytest.fixture(scope="module")
def root(spark, packed, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("state"))
    names = ["bad", "good", "torn", "still", "fresh"]
    listed = spark.createDataFrame([("npm", i, n) for i, n in enumerate(names)], "ecosystem string, rank int, name string")
    first = {n: "1" for n in [*names, "unlisted"]}
    jobs.run_cycle(spark, root, "1", None, docs(spark, first), packed, T1, listed)
    second = {n: "2" for n in ["bad", "good", "torn", "fresh", "unlisted"]} | {"still": "1"}
    for _ in range(2):  # a repeated cycle changes nothing
        jobs.run_cycle(spark, root, "2", "1", docs(spark, second), packed, T2, listed)
    return root


def test_first_cycle_only_records(spark, root):
    assert tables.read_watched(spark, root, "1").count() == 5
    assert spark.read.parquet(f"{root}/scan_log/cycle=1").count() == 0


def test_findings_of_the_second_cycle(spark, root):
    rows = {r.name: r for r in tables.read_findings(spark, root).collect()}
    # the previous archive of "fresh" never landed: an empty text, so its word is new
    assert sorted(rows) == ["bad", "fresh"]
    bad = rows["bad"]
    assert (bad.severity, bad.version, bad.prev_version) == (4, "2", "1")
    assert [(s.kind, s.evidence) for s in bad.signals] == [
        ("new_outbound_url", ["http://9.9.9.9/x"]), ("new_dangerous_import", ["child_process"]),
    ]
    assert rows["fresh"].severity == 2


def test_scan_log_counts_clean_and_flagged_but_not_damaged(spark, root):
    assert sorted(r.name for r in tables.read_scan_log(spark, root).collect()) == ["bad", "fresh", "good"]


def test_watermark_and_statistics(spark, root):
    watched = tables.read_watched(spark, root, "2")
    versions = {r.name: r.last_version for r in watched.collect()}
    assert versions == {"bad": "2", "good": "2", "torn": "2", "fresh": "2", "still": "1"}
    stats = readmodels.statistics(watched, tables.read_scan_log(spark, root), tables.read_findings(spark, root))
    assert tuple(stats.first()) == (5, 3, 2)
    recent = [r.name for r in readmodels.recent_activity(watched, 4).collect()]
    assert recent == ["bad", "fresh", "good", "torn"]


def test_feed_and_json(spark, root):
    findings = tables.read_findings(spark, root)
    item = {r.guid: r for r in readmodels.newest_feed(findings, "https://s", "s,1").collect()}
    bad = item[f"tag:s,1:npm/bad@2:{int(T2.timestamp())}"]
    assert bad.title == "[CRITICAL] npm/bad 2 (was 1) — 2 signal(s)"
    assert bad.pub_date == "Wed, 01 May 2024 12:30:00 +0000"
    assert bad.description == (
        "Severity: CRITICAL. new_outbound_url: Package version introduced new network destination(s) (http://9.9.9.9/x). "
        "new_dangerous_import: Package version introduced imports granting code execution or network access (child_process)."
    )
    document = json.loads(readmodels.findings_json(findings.where("name = 'bad'")).first().json)
    assert document["package"] == {"ecosystem": "npm", "name": "bad", "version": "2", "source_url": ""}
    assert document["analyzed_at"] == "2024-05-01T12:30:00Z"
    assert [s["weight"] for s in document["signals"]] == [4, 3]


def test_finding_ids_are_stable_and_distinct(spark, root):
    stored = spark.read.parquet(f"{root}/findings/analyzed_date=2024-05-01/cycle=2")
    again = tables.with_finding_id(stored.drop("id"))
    assert sorted(r.id for r in stored.collect()) == sorted(r.id for r in again.collect())
    assert stored.select("id").distinct().count() == 2


@pytest.mark.parametrize("limit, used", [(0, 50), (-3, 50), (201, 50), (200, 200), (7, 7)])
def test_unusable_limits_fall_back_to_the_default(limit, used):
    assert readmodels.effective_limit(limit, (50, 200)) == used


def test_lists_round_trip_and_bad_lists_are_empty(spark, tmp_path):
    rows = [("npm", "b\"q", 3, 1), ("npm", "a", 5, 2), ("go", "x/é", 1, 3)]
    ranked = spark.createDataFrame(rows, "ecosystem string, name string, dependents bigint, part_key bigint")
    jobs.build_lists(ranked, str(tmp_path / "lists"))
    back = allowlists.read_written_allowlists(spark, str(tmp_path / "lists"))
    assert sorted(map(tuple, back.collect())) == [("go", 1, "x/é"), ("npm", 1, "a"), ("npm", 2, 'b"q')]

    flat = tmp_path / "flat"
    flat.mkdir()
    (flat / "npm.json").write_text('[\n "a",\n "b"\n]\n')
    (flat / "go.json").write_text("{not a list")
    (flat / "empty.json").write_text("")
    rows = allowlists.read_allowlists(spark, str(flat)).collect()
    assert sorted(map(tuple, rows)) == [("npm", 1, "a"), ("npm", 2, "b")]
    assert allowlists.read_allowlists(spark, str(tmp_path / "absent")).count() == 0


def test_newest_stored_findings(spark, root):
    assert [r.name for r in tables.recent_stored_findings(spark, root, 1).collect()] == ["bad"]
    assert [r.name for r in tables.recent_stored_findings(spark, root).collect()] == ["bad", "fresh"]


@pytest.mark.parametrize("form", ["stateful", "by batch"])
def test_stream_of_polls_over_several_batches_equals_the_batch(spark, tmp_path, form):
    from reldrift.operators.changes import version_changes, watched_versions

    schema = "ecosystem string, name string, latest string, polled_at timestamp_ntz, event_id bigint"
    start = datetime(2024, 1, 1)
    rows = [("npm", f"p{i % 7}", f"v{(i * i) % 5}", start + timedelta(minutes=i), i) for i in range(300)]
    source = tmp_path / "polls"
    for part in range(3):  # landed one after the other
        piece = rows[part * 100 : (part + 1) * 100]
        spark.createDataFrame(piece, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        if form == "by batch":
            query = stream_changes_by_batch(stream, str(tmp_path), str(tmp_path / "checkpoint"))
        else:
            query = (
                stream_version_changes(stream).writeStream.format("parquet").option("path", str(tmp_path / "changes"))
                .option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
            )
        query.awaitTermination()
    columns = ["name", "version", "prev_version", "event_id"]
    streamed = spark.read.parquet(str(tmp_path / "changes")).select(*columns).collect()
    whole = spark.createDataFrame(rows, schema)
    batch = version_changes(whole).select(*columns).collect()
    assert len(batch) > 50 and sorted(streamed) == sorted(batch)
    if form == "by batch":
        micros = [F.unix_micros(F.col("updated_at").cast("timestamp")).alias("at"), "name", "last_version"]
        kept = tables.read_watched(spark, str(tmp_path), "batch-2").select(*micros).collect()
        assert sorted(kept) == sorted(watched_versions(whole).select(*micros).collect())


def test_stream_of_pairs_stores_each_finding_once(spark, packed, tmp_path):
    schema = "ecosystem string, name string, version string, source_url string, prev_version string, prev_source_url string"
    found = jobs.unpacked_tokens(packed)
    root = str(tmp_path / "state")
    for name in ("bad", "fresh"):
        pair = [("npm", name, "2", f"mem://{name}-2", "1", f"mem://{name}-1")]
        spark.createDataFrame(pair, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "pairs"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "pairs"))
        stream_findings(stream, lambda batch: found, root, str(tmp_path / "checkpoint"), lambda: T1).awaitTermination()
    assert sorted(r.name for r in tables.read_findings(spark, root).collect()) == ["bad", "fresh"]
    assert sorted(r.name for r in tables.read_scan_log(spark, root).collect()) == ["bad", "fresh"]


def test_of_several_documents_of_a_package_the_newest_counts(spark):
    watched = spark.createDataFrame([("npm", "p", "1", T1)], "ecosystem string, name string, last_version string, updated_at timestamp")
    rows = [("npm", "p", T1, npm_doc("p", "2", ["1", "2"])), ("npm", "p", T2, npm_doc("p", "3", ["1", "3"])), ("npm", "p", None, npm_doc("p", "9", ["9"]))]
    landed = spark.createDataFrame(rows, "ecosystem string, name string, landed_at timestamp, body string")
    pairs, moved = jobs.detect_changes(landed, lambda packages: watched, T2)
    assert [tuple(r) for r in pairs.collect()] == [("npm", "p", "3", "mem://p-3", "1", "mem://p-1")]
    assert [(r.name, r.last_version) for r in moved.collect()] == [("p", "3")]


def test_no_work_folder_is_left_after_a_cycle(root):
    from pathlib import Path

    assert not list((Path(root) / "_work").glob("*"))


def test_counters_add_up_and_a_repeated_cycle_counts_once(spark, root):
    assert tuple(tables.read_statistics(spark, root).head()) == (5, 3, 2)


def test_evidence_is_stored_under_the_finding(spark, root):
    ids = {r.name: r.id for r in tables.read_summaries(spark, root).collect()}
    rows = tables.read_evidence(spark, root).collect()
    assert sorted((r.kind, r.token) for r in rows if r.id == ids["bad"]) == [("import", "child_process"), ("url", "http://9.9.9.9/x")]
    assert {r.id for r in rows} == set(ids.values())


def test_an_archive_is_opened_by_one_cycle_only(spark, packed, root):
    """The token table names the cycle; damaged archives are looked at again."""
    opened = {(r.source_url, r.cycle, r.archive_status) for r in archive_tokens.outcomes(spark, root).collect()}
    assert opened == {
        ("mem://bad-1", "2", "ok"), ("mem://bad-2", "2", "ok"), ("mem://good-1", "2", "ok"), ("mem://good-2", "2", "ok"),
        ("mem://torn-1", "2", "ok"), ("mem://torn-2", "2", "error"), ("mem://fresh-2", "2", "ok"),
    }
    assert [tuple(r) for r in archive_tokens.rejected(spark, root).collect()] == [("mem://torn-2", "2", "damaged archive")]


def test_a_second_cycle_opens_new_archives_only(spark, tmp_path):
    unpacked = []

    def unpack(fresh):
        unpacked.append(sorted(r.source_url for r in fresh.collect()))
        return jobs.unpacked_tokens(fresh)

    rows = [(f"mem://p-{v}", tgz(f"eval(x{v})")) for v in (1, 2, 3)] + [("mem://torn", bytearray(b"\x1f\x8b\x08" + b"\0" * 40))]
    given = spark.createDataFrame(rows, "source_url string, content binary")
    pair = lambda new, old: spark.createDataFrame([(new, old)], "source_url string, prev_source_url string")
    root = str(tmp_path)
    named = lambda df: sorted({r.source_url for r in df.where("token is not null").collect()})
    for _ in range(2):  # a repeated cycle opens its archives again
        first = archive_tokens.tokens_of(spark, root, "1", given, pair("mem://p-2", "mem://p-1"), unpack)
        assert named(first) == ["mem://p-1", "mem://p-2"]
    second = archive_tokens.tokens_of(spark, root, "2", given, pair("mem://p-3", "mem://p-2"), unpack)
    archive_tokens.tokens_of(spark, root, "3", given, pair("mem://torn", "mem://p-3"), unpack)
    archive_tokens.tokens_of(spark, root, "4", given, pair("mem://torn", "mem://p-1"), unpack)
    assert unpacked == [["mem://p-1", "mem://p-2"]] * 2 + [["mem://p-3"], ["mem://torn"], ["mem://torn"]]
    assert named(second) == ["mem://p-2", "mem://p-3"]
    assert first.columns == second.columns and second.where("kind = 'import'").count() == 2


def test_the_newest_findings_open_the_newest_days_only(spark, tmp_path):
    """A history of a thousand cycles: what is read for the newest does not grow with it."""
    root = str(tmp_path)
    days = spark.range(1000).select(
        F.lit("npm").alias("ecosystem"), F.concat(F.lit("p"), "id").alias("name"), F.lit("2").alias("version"), F.lit("1").alias("prev_version"),
        F.lit(2).alias("severity"), F.expr("array(named_struct('kind', 'new_outbound_url', 'description', 'd', 'weight', 2))").alias("signals"),
        F.expr("timestamp'2020-01-01 12:00:00' + make_dt_interval(cast(id as int))").alias("analyzed_at"),
    )
    stored = tables.with_finding_id(days).withColumn("analyzed_date", F.to_date("analyzed_at")).withColumn("cycle", F.col("name"))
    stored.repartition(1).write.partitionBy("analyzed_date", "cycle").parquet(f"{root}/findings")
    stored.select("id", F.lit("url").alias("kind"), F.lit(0).alias("file_ord"), F.lit(0).alias("pos"), F.lit("http://x/").alias("token"), "analyzed_date", "cycle") \
        .repartition(1).write.partitionBy("analyzed_date", "cycle").parquet(f"{root}/evidence")
    newest = tables.recent_stored_findings(spark, root, 3)
    assert [r.name for r in newest.collect()] == ["p999", "p998", "p997"]
    assert newest.head().signals[0].evidence == ["http://x/"]
    assert len(newest.inputFiles()) == 6


def test_a_batch_that_dies_between_findings_and_commit_stores_each_finding_once(spark, packed, tmp_path, monkeypatch):
    schema = "ecosystem string, name string, version string, source_url string, prev_version string, prev_source_url string"
    found = materialize(jobs.unpacked_tokens(packed), "tokens")
    root, source = str(tmp_path / "state"), str(tmp_path / "pairs")
    for name in ("bad", "good", "fresh"):
        pair = [("npm", name, "2", f"mem://{name}-2", "1", f"mem://{name}-1")]
        spark.createDataFrame(pair, schema).coalesce(1).write.mode("append").parquet(source)
    write, died = tables.write_cycle, []

    def dies_once(df, root_, table, cycle, *by):
        if table == "scan_log" and cycle.endswith("2") and not died:
            died.append(cycle)
            raise RuntimeError("the machine went away")
        write(df, root_, table, cycle, *by)

    monkeypatch.setattr(tables, "write_cycle", dies_once)
    ticks = iter(T1 + timedelta(days=i) for i in range(9))  # the repeated batch runs on a later day

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = stream_findings(stream, lambda batch: found, root, str(tmp_path / "checkpoint"), lambda: next(ticks))
        query.awaitTermination()

    with pytest.raises(Exception, match="went away"):
        run()
    assert died and tables.read_findings(spark, root).count() == 2  # written, not committed
    run()
    assert sorted(r.name for r in tables.read_findings(spark, root).collect()) == ["bad", "fresh"]
    assert sorted(r.name for r in tables.read_scan_log(spark, root).collect()) == ["bad", "fresh", "good"]
    assert tuple(tables.read_statistics(spark, root).head())[1:] == (3, 2)
