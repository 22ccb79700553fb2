"""Registered queries: (spark, sf_dir) -> DataFrame over the whole given tables.

Arrays become line-separated strings and times become microseconds, so that results
compare value by value with the SQL counterparts.
"""

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reldrift.functions import entropy, paths, severity, urls
from reldrift.functions import patterns as P
from reldrift.operators import changes, diffing, ranking, readmodels, registry, tokens
from reldrift.plans import jobs
from reldrift.schemas import PAIR, RELEASE
from reldrift.session import materialize, new_path
from reldrift.sources import allowlists, archive_tokens, archives, lastseen, tables
from reldrift.streaming.changes import ROCKSDB, stream_changes_by_batch
from reldrift.streaming.changes import stream_version_changes as changes_stream
from reldrift.streaming.findings import stream_findings as findings_stream

from . import derived, packing

SITE, TAG = "https://feed.invalid", "feed.invalid,2026"
BASE_SECONDS = 1704067200  # 2024-01-01T00:00:00Z
CUT = "2024-01-15 00:00:00"


def _micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


# --- files -------------------------------------------------------------------


def scannable_files(spark, sf):
    files = derived.release_files(spark, sf)
    path = F.col("path")
    return files.select(
        "release_seq", "file_ord", "path",
        paths.is_text_file(path).alias("is_text"),
        paths.is_scannable_file(path).alias("is_scannable"),
        paths.file_language(path).alias("language"),
    )


def strip_comments(spark, sf):
    text = tokens.strip_files(tokens.scannable_files(derived.release_files(spark, sf)))
    return text.select("release_seq", "file_ord", F.col("content").alias("stripped"))


def release_text(spark, sf):
    """The whole text of each release: its pieces, joined in order."""
    return tokens.joined_text(tokens.release_text(derived.release_files(spark, sf)))


# --- tokens ------------------------------------------------------------------


def _tokens(kind):
    def query(spark, sf):
        text = tokens.strip_files(tokens.scannable_files(derived.release_files(spark, sf)))
        found = tokens.extract_tokens(text.select("release_seq", "file_ord", "content"), (kind,))
        return found.select("release_seq", "file_ord", "pos", "token")

    return query


def page_tokens(spark, sf):
    pages = derived.table(spark, sf, "pages").select("page_id", "html")
    return tokens.extract_tokens(pages, text="html").select("page_id", "kind", "pos", "token")


def url_classify(spark, sf):
    text = tokens.strip_files(tokens.scannable_files(derived.release_files(spark, sf)))
    found = tokens.extract_tokens(text.select("content"), ("url",)).select(F.col("token").alias("url"))
    seen = derived.table(spark, sf, "pages").select("url").union(found).distinct()
    url = F.col("url")
    return seen.select(
        "url",
        urls.url_host(url).alias("host"),
        urls.is_reserved_host(url).alias("is_reserved"),
        urls.is_doc_host(url).alias("is_doc"),
        urls.is_noise_url(url).alias("is_noise"),
        urls.is_payload_url(url).alias("is_payload"),
        urls.is_raw_ip_url(url).alias("is_raw_ip"),
    )


def string_entropy(spark, sf):
    docs = derived.table(spark, sf, "documents").select("doc_id", "text")
    run = docs.withColumn("run", entropy.longest_encoded_run(F.col("text")))
    return run.select(
        "doc_id",
        F.octet_length("run").cast("long").alias("run_bytes"),
        F.md5("run").alias("run_md5"),
        F.round(entropy.shannon_entropy(F.col("run")), 9).alias("run_entropy"),
        F.round(entropy.shannon_entropy(F.col("text")), 9).alias("text_entropy"),
        entropy.is_high_entropy_run(F.col("run")).alias("is_high"),
    )


def high_entropy_literals(spark, sf):
    text = tokens.strip_files(tokens.scannable_files(derived.release_files(spark, sf)))
    found = tokens.extract_tokens(text.select("release_seq", "file_ord", "content"), ("literal",))
    kept = found.where(tokens.may_signal(F.col("kind"), F.col("token")))
    return kept.select("release_seq", "file_ord", "pos", "token")


def nul_literals(spark, sf):
    """Literals of high entropy, some with a NUL, which are data and no payload."""
    blob = F.base64(F.unhex(F.concat(F.sha2("version", 256), F.expr("substring(sha2(concat('x', version), 256), 1, 48)"))))
    nul = F.when(F.col("release_seq") % 3 == 0, F.lit("\u0000")).otherwise(F.lit(""))
    rows = derived.releases(spark, sf).select("release_seq", F.concat(F.lit('"'), blob, nul, F.lit('"')).alias("content"))
    found = tokens.extract_tokens(rows, ("literal",))
    return found.select("release_seq", F.octet_length("token").cast("long").alias("bytes"), tokens.may_signal(F.col("kind"), F.col("token")).alias("signals"))


def split_hooks(spark, sf):
    """Install hooks of releases whose files break them off: some end one or several files later."""
    files = derived.broken_files(spark, sf)
    found = tokens.joined_release_tokens(files, ("hook",))
    place = F.row_number().over(Window.partitionBy(*RELEASE).orderBy("file_ord", "pos"))
    return found.select("version", place.alias("place"), "token")


# --- diff ----------------------------------------------------------------------


def release_pairs(spark, sf):
    return diffing.release_pairs(derived.releases(spark, sf)).select(*PAIR, "release_seq")


def _new_tokens(spark, sf, kinds=tuple(P.SIGNALS)) -> DataFrame:
    found = tokens.joined_release_tokens(derived.release_files(spark, sf), kinds)
    new = diffing.new_tokens(found, diffing.release_pairs(derived.releases(spark, sf)))
    return materialize(new, "new-tokens")


def _lines(column) -> Column:
    return F.array_join(column, "\n")


def _signal_rows(findings: DataFrame) -> DataFrame:
    return diffing.signals(findings).select(
        *PAIR, "kind", "description", _lines("evidence").alias("evidence"), "weight"
    )


def _new(kind):
    def query(spark, sf):
        return _signal_rows(diffing.find(_new_tokens(spark, sf, (kind,))))

    return query


def _findings(spark, sf) -> DataFrame:
    """Scored findings; the time of analysis is derived from the release."""
    return diffing.find(_new_tokens(spark, sf)).withColumn("analyzed_at", _analyzed_at())


def _analyzed_at() -> Column:
    return F.timestamp_seconds(F.regexp_extract("version", r"\A1\.([0-9]+)\z", 1).cast("long") + BASE_SECONDS)


def _newest(spark, sf) -> DataFrame:
    return jobs.newest_findings_of(_new_tokens(spark, sf), _analyzed_at(), 50)


def _flat(findings: DataFrame) -> DataFrame:
    kinds = F.transform("signals", lambda s: s["kind"])
    weights = F.aggregate("signals", F.lit(0), lambda total, s: total + s["weight"])
    evidence = F.flatten(F.transform("signals", lambda s: s["evidence"]))
    return findings.select(
        *PAIR, "severity",
        F.size("signals").cast("long").alias("signal_count"),
        weights.cast("long").alias("total_weight"),
        F.array_join(kinds, ",").alias("kinds"),
        _lines(evidence).alias("evidence"),
    )


def signals(spark, sf):
    return _signal_rows(diffing.find(_new_tokens(spark, sf)))


def findings(spark, sf):
    return _flat(_findings(spark, sf))


def evidence(spark, sf):
    return diffing.evidence(_new_tokens(spark, sf)).select(*PAIR, "kind", "file_ord", "pos", "token")


def severity_score(spark, sf):
    scored = diffing.score_releases(_new_tokens(spark, sf))
    return scored.select(
        *PAIR,
        F.col("signals").cast("long").alias("signals"),
        F.col("total_weight").cast("long").alias("total_weight"),
        "severity",
        severity.severity_label(F.col("severity")).alias("label"),
    )


# --- changes --------------------------------------------------------------------


def _change_columns(rows):
    return rows.select("ecosystem", "name", "version", "prev_version", _micros("polled_at").alias("polled_us"), "event_id")


def version_changes(spark, sf):
    return _change_columns(changes.version_changes(derived.polls(spark, sf)))


def first_seen(spark, sf):
    rows = changes.first_seen(derived.polls(spark, sf))
    return rows.select("ecosystem", "name", "version", _micros("polled_at").alias("polled_us"), "event_id")


def watched_versions(spark, sf):
    rows = changes.watched_versions(derived.polls(spark, sf))
    return rows.select("ecosystem", "name", "last_version", _micros("updated_at").alias("updated_us"))


def _cycle(spark, sf):
    """A last-seen table as of the cut, and the newest version of each package polled after it."""
    polls = derived.polls(spark, sf)
    cut = F.lit(CUT).cast("timestamp_ntz")
    watched = changes.watched_versions(polls.where(F.col("polled_at") < cut))
    newest = F.max_by("latest", F.struct("polled_at", "event_id")).alias("latest")
    latest = polls.where(F.col("polled_at") >= cut).groupBy("ecosystem", "name").agg(newest)
    return watched, latest


def last_seen_lookup(spark, sf):
    watched, latest = _cycle(spark, sf)
    return changes.look_up_last_seen(latest, watched)


def changed_since_last_seen(spark, sf):
    watched, latest = _cycle(spark, sf)
    return changes.changed_only(changes.look_up_last_seen(latest, watched))


def watched_upsert(spark, sf):
    watched, latest = _cycle(spark, sf)
    now = datetime(2024, 2, 1, tzinfo=timezone.utc)
    after = changes.upsert_watched(watched, latest, now)
    return after.select("ecosystem", "name", "last_version", _micros("updated_at").alias("updated_us"))


def watchlist_restrict(spark, sf):
    listed = derived.table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(
        F.lit("npm").alias("ecosystem"), F.col("c_custkey").cast("string").alias("name")
    )
    rows = changes.restrict_to_watchlist(derived.polls(spark, sf), listed)
    return rows.select("ecosystem", "name", "latest", "event_id")


# --- registry ---------------------------------------------------------------------


def registry_latest(spark, sf):
    rows = registry.registry_latest(derived.registry_docs(spark, sf))
    return rows.select("ecosystem", "name", "release_seq", "last_seen", "latest")


def rejected_documents(spark, sf):
    rows = registry.rejected_documents(derived.registry_docs(spark, sf))
    return rows.select("ecosystem", "name", "release_seq", "reason")


def _resolved(spark, sf):
    latest = registry.registry_latest(derived.registry_docs(spark, sf))
    return registry.resolve_changes(changes.changed_only(latest))


def artifact_lookup(spark, sf):
    return _resolved(spark, sf).where(F.col("ecosystem").isin("npm", "pypi", "cargo"))


def artifact_urls(spark, sf):
    return _resolved(spark, sf)


def detect_changes(spark, sf):
    """One poll cycle over all landed documents, several of a package among them."""
    docs = derived.registry_docs(spark, sf).withColumn("landed_at", F.timestamp_seconds("release_seq"))
    seen = docs.groupBy("ecosystem", "name").agg(F.max_by("last_seen", "release_seq").alias("last_version"))
    watched = seen.where("last_version <> ''").withColumn("updated_at", F.timestamp_seconds(F.lit(0)))
    now = datetime(2024, 2, 1, tzinfo=timezone.utc)
    pairs, _ = jobs.detect_changes(docs.select("ecosystem", "name", "landed_at", "body"), lambda packages: watched, now)
    return pairs


# --- read models --------------------------------------------------------------------


def recent_findings(spark, sf):
    return _flat(_newest(spark, sf))


def recent_activity(spark, sf):
    return readmodels.recent_activity(changes.watched_versions(derived.polls(spark, sf)), 30)


def scan_stats(spark, sf):
    return readmodels.statistics(
        changes.watched_versions(derived.polls(spark, sf)),
        diffing.release_pairs(derived.releases(spark, sf)),
        diffing.score_releases(_new_tokens(spark, sf)),
    )


def feed_items(spark, sf):
    return readmodels.feed_items(_findings(spark, sf), SITE, TAG)


def newest_feed(spark, sf):
    return readmodels.newest_feed(_newest(spark, sf), SITE, TAG)


def findings_json(spark, sf):
    """The whole document of each finding."""
    return readmodels.findings_json(_findings(spark, sf))


def signals_json_roundtrip(spark, sf):
    found = _findings(spark, sf)
    text = found.withColumn("signals", readmodels.signals_to_json(F.col("signals")))
    return _flat(text.withColumn("signals", readmodels.signals_from_json(F.col("signals"))))


# --- lists ------------------------------------------------------------------------------


def top_names(spark, sf):
    return ranking.top_names(derived.package_ranking(spark, sf))


def allowlist_scan(spark, sf):
    """Landed lists read back, one of them broken off: it counts as empty."""
    folder = new_path(spark, "landed-lists")
    whole = allowlists.allowlist_documents(ranking.top_names(derived.package_ranking(spark, sf)))
    text = F.when(F.col("ecosystem") == "nuget", F.expr("left(value, length(value) - 3)")).otherwise(F.col("value"))
    materialize(packing.land(whole.select(F.concat("ecosystem", F.lit(".json")).alias("file"), text.cast("binary").alias("content")), folder), "landed")
    return allowlists.read_allowlists(spark, folder)


def allowlist_roundtrip(spark, sf):
    folder = new_path(spark, "lists")
    jobs.build_lists(derived.package_ranking(spark, sf), folder)
    return allowlists.read_written_allowlists(spark, folder)


# --- archives, stored tables, streams -----------------------------------------------------


def archive_files(spark, sf):
    packed = packing.pack(derived.releases_with_files(spark, sf).drop("release_seq"))
    return archives.archive_files(archives.unpack(packed)).select(*RELEASE, "file_ord", "path", "content")


def _packed(spark, sf):
    """Every release packed as an archive, addressed by package and version."""
    packed = packing.pack(derived.releases_with_files(spark, sf).select(
        F.concat_ws("/", "ecosystem", "name", "version").alias("source_url"), "files"
    ))
    return packed


def _pairs_with_addresses(spark, sf):
    address = lambda version: F.concat_ws("/", "ecosystem", "name", version)
    return diffing.release_pairs(derived.releases(spark, sf)).select(
        "ecosystem", "name", "version", address("version").alias("source_url"),
        "prev_version", address("prev_version").alias("prev_source_url"),
    )


def stored_findings(spark, sf):
    """Archives -> tokens -> diff -> stored tables -> findings read back."""
    root = new_path(spark, "state")
    now = datetime(2024, 2, 1, tzinfo=timezone.utc)
    found = jobs.unpacked_tokens(_packed(spark, sf))
    jobs.publish(jobs.diff_pairs(_pairs_with_addresses(spark, sf), found), root, "one", now)
    return _flat(tables.read_findings(spark, root))


def recent_stored_findings(spark, sf):
    """The newest findings picked out of a stored table, its days opened from the newest back."""
    root = new_path(spark, "state")
    tables.write_findings(_new_tokens(spark, sf), _analyzed_at(), root, "one")
    return _flat(tables.recent_stored_findings(spark, root, 50))


def _landed(spark, given):
    """Archives landed, small ones in bundles, and the listing of them: (source_url, source_path, length).

    An archive landed twice counts once.
    """
    folder = new_path(spark, "landed")
    materialize(packing.land_archives(derived.landed_archives(given), folder), "landed-names")
    listed = archives.scan_archives(spark, folder)
    file = F.url_decode(F.substring_index("source_path", "/", -1))
    once = listed.groupBy(F.concat(F.lit("land://"), file).alias("source_url")).agg(F.max(F.struct("source_path", "length")).alias("at"))
    return once.select("at.source_path", "at.length", "source_url")


def archive_scan(spark, sf):
    """Archives read by path, dealt out by bytes: damaged ones, unknown formats and empty files among them."""
    listed = _landed(spark, derived.releases_with_files(spark, sf))
    rows = archives.unpack(archives.by_bytes(listed, 1 << 18).select("source_url", "source_path"))
    return rows.select("source_url", "archive_status", "file_ord", "path", "content")


def run_cycle(spark, sf):
    """Three whole cycles on one state: what they opened, found, counted and saw last."""
    newest = materialize(derived.newest_releases(spark, sf), "newest")
    with_files = derived.releases_with_files(spark, sf).join(newest.select("release_seq"), "release_seq", "left_semi")
    listed, root = materialize(_landed(spark, with_files), "listed"), new_path(spark, "state")
    for cycle in (1, 2, 3):
        docs = materialize(derived.cycle_documents(newest, 4 - cycle), "documents")
        now = datetime(2024, 2, cycle, tzinfo=timezone.utc)
        jobs.run_cycle(spark, root, str(cycle), str(cycle - 1) if cycle > 1 else None, docs, listed, now)
    found = tables.read_findings(spark, root)
    evidence = F.flatten(F.transform("signals", lambda s: s["evidence"]))
    parts = [
        archive_tokens.outcomes(spark, root).select(F.lit("opened").alias("part"), F.col("source_url").alias("item"), "cycle", F.col("archive_status").alias("detail")),
        archive_tokens.rejected(spark, root).select(F.lit("rejected"), "source_url", "cycle", "reason"),
        found.select(F.lit("finding"), F.concat_ws("@", "name", "version"), F.dayofmonth("analyzed_at").cast("string"),
                     F.concat_ws("\n", F.col("severity").cast("string"), "prev_version", _lines(evidence))),
        tables.read_scan_log(spark, root).select(F.lit("scanned"), F.concat_ws("@", "name", "version"), F.dayofmonth("analyzed_at").cast("string"), "prev_version"),
        tables.read_watched(spark, root, "3").select(F.lit("watched"), "name", F.dayofmonth("updated_at").cast("string"), "last_version"),
        tables.read_evidence(spark, root).groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("evidence"), "kind", F.lit(""), F.col("n").cast("string")),
        tables.read_statistics(spark, root).select(F.lit("statistics"), F.lit(""), F.lit(""), F.concat_ws(",", "packages_watched", "versions_scanned", "findings_total")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.union(part)
    return rows


def stored_scan_log(spark, sf):
    """Every compared pair is counted once, clean or flagged."""
    root = new_path(spark, "state")
    now = datetime(2024, 2, 1, tzinfo=timezone.utc)
    compared = diffing.release_pairs(derived.releases(spark, sf)).select(*PAIR)
    stamped = compared.withColumn("analyzed_at", F.lit(now).cast("timestamp"))
    tables.write_cycle(stamped, root, "scan_log", "one")
    return tables.read_scan_log(spark, root).groupBy("ecosystem").agg(F.count("*").alias("versions_scanned"))


_STREAM_PARTS = 4


def _landed_in_parts(rows: DataFrame, folder: str, parts: int):
    """A stream of ``rows``, whose column ``part`` tells the file each lands in, one file a batch."""
    for part in range(parts):  # one after the other, as the source takes files by their time
        rows.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(folder)
    schema = rows.drop("part").schema
    return rows.sparkSession.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _poll_stream(spark, folder, sf):
    polls = derived.polls(spark, sf)
    bounds = polls.agg(F.percentile_approx(F.unix_micros(F.col("polled_at").cast("timestamp")), [0.25, 0.5, 0.75]).alias("b")).head()["b"] or []
    at = F.unix_micros(F.col("polled_at").cast("timestamp"))
    part = sum([(at > F.lit(b)).cast("int") for b in bounds], F.lit(0))
    return _landed_in_parts(materialize(polls.withColumn("part", part), "polls"), folder, _STREAM_PARTS)


def stream_version_changes(spark, sf):
    """The poll log as one micro-batch through the batch operators."""
    root = new_path(spark, "stream-changes")
    events = spark.readStream.schema(derived.table(spark, sf, "events").schema)
    polls = derived.polls_of(events.option("pathGlobFilter", "events.parquet").parquet(sf))
    stream_changes_by_batch(polls, root, f"{root}/checkpoint").awaitTermination()
    return _change_columns(spark.read.parquet(f"{root}/changes"))


def stream_changes_in_batches(spark, sf):
    """Four micro-batches; the last-seen table grows by runs, which are merged."""
    root = new_path(spark, "stream-changes")
    stream_changes_by_batch(_poll_stream(spark, f"{root}/polls", sf), root, f"{root}/checkpoint").awaitTermination()
    return _change_columns(spark.read.parquet(f"{root}/changes"))


def stream_last_seen(spark, sf):
    """The last-seen table after four micro-batches, read from its runs."""
    root = new_path(spark, "stream-changes")
    stream_changes_by_batch(_poll_stream(spark, f"{root}/polls", sf), root, f"{root}/checkpoint").awaitTermination()
    rows = lastseen.LastSeen(spark, root).snapshot()
    return rows.select("ecosystem", "name", "last_version", _micros("updated_at").alias("updated_us"))


def stream_changes_stateful(spark, sf):
    """The same with the last version as operator state."""
    out = new_path(spark, "stream-changes")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    query = (
        changes_stream(_poll_stream(spark, f"{out}/polls", sf)).writeStream.format("parquet").option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return _change_columns(spark.read.parquet(f"{out}/rows"))


def stream_findings(spark, sf):
    """Release pairs as a stream of files, diffed batch by batch, read back from the store."""
    root = new_path(spark, "stream-findings")
    pairs = materialize(_pairs_with_addresses(spark, sf).withColumn("part", F.pmod(F.xxhash64("name"), F.lit(3)).cast("int")), "pairs")
    text = tokens.strip_files(tokens.scannable_files(derived.release_files(spark, sf)))
    found = tokens.extract_tokens(text.select(
        F.concat_ws("/", "ecosystem", "name", "version").alias("source_url"),
        F.lit(archives.OK).alias("archive_status"), "file_ord", "content",
    ))
    found = materialize(found.where(tokens.may_signal(F.col("kind"), F.col("token"))), "archive-tokens")
    source = _landed_in_parts(pairs, f"{root}/pairs", 3)
    query = findings_stream(source, lambda batch: found, root, f"{root}/checkpoint")
    query.awaitTermination()
    return _flat(tables.read_findings(spark, root))


QUERIES = {
    "scannable_files": scannable_files,
    "strip_comments": strip_comments,
    "release_text": release_text,
    "url_tokens": _tokens("url"),
    "import_tokens": _tokens("import"),
    "literal_tokens": _tokens("literal"),
    "hook_tokens": _tokens("hook"),
    "page_tokens": page_tokens,
    "url_classify": url_classify,
    "string_entropy": string_entropy,
    "high_entropy_literals": high_entropy_literals,
    "nul_literals": nul_literals,
    "split_hooks": split_hooks,
    "release_pairs": release_pairs,
    "new_urls": _new("url"),
    "new_imports": _new("import"),
    "new_high_entropy": _new("literal"),
    "new_hooks": _new("hook"),
    "signals": signals,
    "findings": findings,
    "evidence": evidence,
    "severity_score": severity_score,
    "version_changes": version_changes,
    "watched_versions": watched_versions,
    "first_seen": first_seen,
    "last_seen_lookup": last_seen_lookup,
    "changed_since_last_seen": changed_since_last_seen,
    "watched_upsert": watched_upsert,
    "watchlist_restrict": watchlist_restrict,
    "registry_latest": registry_latest,
    "rejected_documents": rejected_documents,
    "detect_changes": detect_changes,
    "artifact_lookup": artifact_lookup,
    "artifact_urls": artifact_urls,
    "recent_findings": recent_findings,
    "recent_activity": recent_activity,
    "scan_stats": scan_stats,
    "feed_items": feed_items,
    "newest_feed": newest_feed,
    "findings_json": findings_json,
    "signals_json_roundtrip": signals_json_roundtrip,
    "top_names": top_names,
    "allowlist_roundtrip": allowlist_roundtrip,
    "allowlist_scan": allowlist_scan,
    "archive_scan": archive_scan,
    "run_cycle": run_cycle,
    "archive_files": archive_files,
    "stored_findings": stored_findings,
    "recent_stored_findings": recent_stored_findings,
    "stored_scan_log": stored_scan_log,
    "stream_version_changes": stream_version_changes,
    "stream_changes_in_batches": stream_changes_in_batches,
    "stream_last_seen": stream_last_seen,
    "stream_changes_stateful": stream_changes_stateful,
    "stream_findings": stream_findings,
}
