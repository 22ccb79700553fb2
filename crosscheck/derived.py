"""Release tables derived from the commercial test tables.

The given tables hold no source code, so releases, files, polls, registry documents
and a popularity ranking are built from their rows: one package per customer, one
release per order.  Everything is a projection of the base rows (plus one previous
value per row for the registry documents), so it grows with them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reldrift.operators.ordering import with_previous

from . import packing


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly, some 100 000 to a task and one task a core at least.

    The derived tables grow from a few bytes per base row into file texts, and the splits of
    a file follow its row groups: some hold a million rows and others none.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, -(-df.count() // 100_000)))


_ECOSYSTEM = """
CASE {0} % 6 WHEN 0 THEN 'npm' WHEN 1 THEN 'pypi' WHEN 2 THEN 'go'
     WHEN 3 THEN 'cargo' WHEN 4 THEN 'maven' ELSE 'nuget' END
"""

_PATHS = ["src/index.js", "pkg/mod.py", "package.json", "README.md", "dist/app.js"]


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ecosystem, name, release_seq, version): one release per order."""
    return table(spark, sf_dir, "orders").select(
        F.expr(_ECOSYSTEM.format("o_custkey")).alias("ecosystem"),
        F.expr("concat('pkg-', CAST(o_custkey AS STRING))").alias("name"),
        F.col("o_orderkey").alias("release_seq"),
        F.expr("concat('1.', CAST(o_orderkey AS STRING))").alias("version"),
    )


_BLOB = "base64(unhex(concat(sha2(k, 256), substring(sha2(concat('x', k), 256), 1, 48))))"

_INDEX_JS = f"""
concat('const v = 1\\n', '// see https://c', k, '.lurk.zone/x\\n',
  CASE WHEN release_seq % 3 = 0
       THEN concat('let kit = "https://kit', CAST(release_seq % 7 AS STRING), '.parcels.zone/kit.js";\\n') ELSE '' END,
  CASE WHEN release_seq % 11 = 0
       THEN concat('send("http://198.51.100.', CAST(release_seq % 250 AS STRING), '/in")\\n') ELSE '' END,
  CASE WHEN release_seq % 5 = 0 THEN 'var w = require("worker_threads"), r = require("child_process")\\n' ELSE '' END,
  CASE WHEN release_seq % 7 = 0 THEN concat('let raw = "', {_BLOB}, '"\\n') ELSE '' END)
"""
_MOD_PY = """
concat('# https://doc.lurk.zone/\\n',
  CASE WHEN release_seq % 13 = 0 THEN 'import socket\\n' ELSE '' END,
  'home = "https://example.com/"\\n')
"""
_PACKAGE_JSON = """
concat('{"repository": "https://github.com/o/r.git"',
  CASE WHEN release_seq % 17 = 0 THEN concat(', "preinstall": "sh p', k, '.sh"') ELSE '' END, '}')
"""
_SKIPPED = "'see https://skipped.lurk.zone/a'"


def _content(file_ord: str) -> str:
    return (
        f"CASE {file_ord} WHEN 0 THEN {_INDEX_JS} WHEN 1 THEN {_MOD_PY} "
        f"WHEN 2 THEN {_PACKAGE_JSON} ELSE {_SKIPPED} END"
    )


def release_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five files per release: (ecosystem, name, release_seq, version, file_ord, path, content)."""
    paths = F.array(*[F.lit(p) for p in _PATHS])
    return (
        spread(releases(spark, sf_dir))
        .select("*", F.posexplode(paths).alias("file_ord", "path"))
        .withColumn("k", F.col("release_seq").cast("string"))
        .withColumn("content", F.expr(_content("file_ord")))
        .drop("k")
    )


def releases_with_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per release with its files as an array, ready to be packed."""
    members = [
        F.struct(F.lit(path).alias("path"), F.expr(_content(str(i))).alias("content"))
        for i, path in enumerate(_PATHS)
    ]
    return (
        spread(releases(spark, sf_dir))
        .withColumn("k", F.col("release_seq").cast("string"))
        .withColumn("files", F.array(*members))
        .drop("k")
    )


def polls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poll log: the user is the package, the event type the version seen."""
    return polls_of(table(spark, sf_dir, "events"))


def polls_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.lit("npm").alias("ecosystem"),
        F.col("user_id").cast("string").alias("name"),
        F.col("event_type").alias("latest"),
        F.col("ts").alias("polled_at"),
        "event_id",
    )


_COORDINATE = """
CASE ecosystem
  WHEN 'maven' THEN CASE WHEN release_seq % 19 = 0 THEN name ELSE concat('org.acme.', name, ':', name) END
  WHEN 'go' THEN CASE WHEN release_seq % 31 = 0 THEN concat('Example.org/', name, '/Mod')
    WHEN release_seq % 37 = 0 THEN concat('example.org/', name, '/v1')
    ELSE concat('example.org/', upper(name), '/Mod') END
  WHEN 'nuget' THEN concat('Acme.', name)
  ELSE name END
"""

# the two versions a document lists, in the registry's own shape
_BODY = """
CASE WHEN release_seq % 23 = 0 THEN '{"broken'
ELSE CASE ecosystem
  WHEN 'npm' THEN concat('{"dist-tags":{"latest":"', shown, '"},"versions":{',
    CASE WHEN release_seq % 5 = 0 THEN '' ELSE
      concat('"', prev, '":{"dist":{"tarball":"https://reg.io/', name, '-', prev, '.tgz"}},') END,
    '"', version, '":{"dist":{"tarball":"https://reg.io/', name, '-', version, '.tgz"}}}}')
  WHEN 'pypi' THEN concat('{"info":{"version":"', shown, '"},"releases":{"', prev, '":[',
    CASE WHEN release_seq % 5 = 0 THEN '' ELSE
      concat('{"url":"https://files.io/', prev, '.whl","packagetype":"bdist_wheel"}') END,
    '],"', version, '":[{"url":"https://files.io/', version, '.whl","packagetype":"bdist_wheel"},',
    '{"url":"https://files.io/', version, '.tar.gz","packagetype":"',
    CASE WHEN release_seq % 7 = 0 THEN 'bdist_egg' ELSE 'sdist' END, '"}]}}')
  WHEN 'cargo' THEN concat('{"crate":{"newest_version":"', shown, '"},"versions":[{"num":"', version,
    '","dl_path":"/api/v1/crates/', name, '/', version, '/download"}',
    CASE WHEN release_seq % 5 = 0 THEN '' ELSE
      concat(',{"num":"', prev, '","dl_path":"/api/v1/crates/', name, '/', prev, '/download"}') END, ']}')
  WHEN 'maven' THEN CASE WHEN release_seq % 29 = 0 THEN '{"response":{"docs":[]}}'
    ELSE concat('{"response":{"docs":[{"v":"', version, '"},{"v":"', prev, '"}]}}') END
  WHEN 'go' THEN concat('{"Version":"', shown, CASE WHEN shown = '' THEN '' ELSE '+incompatible' END, '"}')
  ELSE CASE WHEN release_seq % 29 = 0 THEN '{"versions":[]}'
    ELSE concat('{"versions":["', prev, '","', version, '-RC"]}') END
END END
"""


def registry_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One landed registry document per release: (ecosystem, name, release_seq, last_seen, body).

    ``last_seen`` is the version before it ('' for the first), so a document set
    holds first sights, changes, missing artifacts, empty and broken documents.
    """
    seen = with_previous(
        releases(spark, sf_dir),
        keys=("ecosystem", "name"),
        order_by=("release_seq",),
        value="version",
        out="last_seen",
    )
    return (
        seen.withColumn("last_seen", F.coalesce("last_seen", F.lit("")))
        .withColumn("prev", F.expr("CASE WHEN last_seen = '' THEN '0.0' ELSE last_seen END"))
        .withColumn("shown", F.expr("CASE WHEN release_seq % 29 = 0 THEN '' ELSE version END"))
        .select(
            "ecosystem",
            F.expr(_COORDINATE).alias("name"),
            "release_seq",
            "last_seen",
            F.expr(_BODY).alias("body"),
        )
    )


def package_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ecosystem, name, dependents, part_key): parts ranked by how often they are ordered."""
    counts = (
        table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("dependents"))
    )
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return part.join(counts, part.p_partkey == counts.l_partkey).select(
        F.expr(_ECOSYSTEM.format("p_partkey")).alias("ecosystem"),
        F.col("p_name").alias("name"),
        "dependents",
        F.col("p_partkey").alias("part_key"),
    )


#: Files as arrays of texts: what a release's files are called, and how some of them break off a hook.
_BROKEN = [
    """concat('{"a": 1, "preinstall": "x', k, '"', CASE release_seq % 4 WHEN 0 THEN concat(', "postinstall": "sh ', k)
       WHEN 1 THEN ', "install" : ' WHEN 2 THEN ', "install"' ELSE '}' END)""",
    """CASE release_seq % 5 WHEN 0 THEN 'no quote here' WHEN 1 THEN ': "b' WHEN 2 THEN '"install": "c", "preinstall": "d'
       WHEN 3 THEN concat('go on" "install": "', k) ELSE '' END""",
    """CASE release_seq % 3 WHEN 0 THEN 'end", "preinstall": "e"' WHEN 1 THEN '"install": "f' ELSE ' "g" }' END""",
    """CASE release_seq % 2 WHEN 0 THEN '" "install":"h"' ELSE 'nothing' END""",
]


def broken_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four files per release, some of which end inside an install hook."""
    texts = F.array(*[F.expr(text) for text in _BROKEN])
    keyed = spread(releases(spark, sf_dir)).withColumn("k", F.col("release_seq").cast("string"))
    path = F.concat(F.lit("f"), F.col("file_ord").cast("string"), F.lit(".json"))
    return keyed.select("*", F.posexplode(texts).alias("file_ord", "content")).withColumn("path", path).drop("k")


# --- landed archives and the documents that name them ---------------------------------

_LANDED = """
CASE WHEN release_seq % 31 = 2 THEN 'void' WHEN release_seq % 29 = 7 THEN 'unknown'
     WHEN release_seq % 23 = 5 THEN 'missing' WHEN release_seq % 19 = 3 THEN 'damaged' ELSE 'sound' END
"""


def newest_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three newest releases of each package: (name, release_seq, version, age), age 1 the newest."""
    from pyspark.sql import Window

    newest = F.row_number().over(Window.partitionBy("name").orderBy(F.desc("release_seq")))
    return releases(spark, sf_dir).select("name", "release_seq", "version", newest.alias("age")).where("age <= 3")


def landed_archives(given: DataFrame) -> DataFrame:
    """(file, content) of releases with files: sound ones, damaged ones, files of no known format and empty ones."""
    fate = given.withColumn("fate", F.expr(_LANDED)).where("fate <> 'missing'")
    packed = packing.pack(fate.select(F.concat_ws("@", "name", "version").alias("file"), "fate", "files"))
    content = (
        F.when(F.col("fate") == "void", F.lit(b""))
        .when(F.col("fate") == "unknown", F.lit(b"no archive"))
        .when(F.col("fate") == "damaged", F.overlay("content", F.lit(bytes(20)), 51))
        .otherwise(F.col("content"))
    )
    return packed.select("file", content.alias("content"))


def cycle_documents(newest: DataFrame, age: int) -> DataFrame:
    """The documents a registry lands when the release of that age is the newest."""
    known = newest.where(F.col("age") >= age)
    address = F.concat(F.lit('"'), "version", F.lit('":{"dist":{"tarball":"land://'), "name", F.lit("@"), "version", F.lit('"}}'))
    listed = known.groupBy("name").agg(
        F.array_join(F.collect_list(address), ",").alias("listed"), F.max(F.struct("release_seq", "version")).alias("last")
    )
    body = F.concat(F.lit('{"dist-tags":{"latest":"'), "last.version", F.lit('"},"versions":{'), "listed", F.lit("}}"))
    return listed.select(F.lit("npm").alias("ecosystem"), "name", body.alias("body"))
