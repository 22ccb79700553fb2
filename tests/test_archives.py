import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from reldrift.sources import archives


def tar_gz(members, damage=None):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as archive:
        for name, data in members:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
                archive.addfile(info)
            else:
                info.size = len(data)
                archive.addfile(info, io.BytesIO(data))
    raw = bytearray(buffer.getvalue())
    if damage == "header":  # the second member's header
        raw[1024 + 148] ^= 0xFF
    packed = gzip.compress(bytes(raw))
    return packed[: len(packed) // 2] if damage == "cut" else packed


def zipped(members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in members:
            archive.writestr(name, data)
    return buffer.getvalue()


MEMBERS = [("pkg/", None), ("pkg/README.md", b"no"), ("pkg/a.js", b"let a = 1"), ("pkg/dist/b.js", b"no"), ("pkg/c.py", b"x = \xff")]
# incompressible, so that a cut falls into the data
NOISE = bytes(range(256)) * 4


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("landed")
    zip_members = [(n, d or b"") for n, d in MEMBERS]
    broken_zip = bytearray(zipped([("a.js", NOISE), ("b.js", b"fine")]))
    broken_zip[40] ^= 0xFF
    unread_damage = bytearray(zipped([("dist/a.js", NOISE), ("b.js", b"fine")]))
    unread_damage[45] ^= 0xFF
    files = {
        "ok.tgz": tar_gz(MEMBERS),
        "ok.zip": zipped(zip_members),
        "bad-header.tgz": tar_gz([("a.js", b"x"), ("b.js", b"y")], "header"),
        "cut.tgz": tar_gz([("a.js", NOISE), ("b.js", NOISE[::-1])], "cut"),
        "cut.zip": zipped([("a.js", b"x")])[:-10],
        "bad.zip": bytes(broken_zip),
        "unread.zip": bytes(unread_damage),
        "not.gz": b"\x1f\x8b",
        "method.gz": b"\x1f\x8b\x07" + b"\0" * 20,
        "plain.txt": b"hello",
        "void": b"",
        "docs.zip": zipped([("README.md", b"only")]),
    }
    for name, data in files.items():
        (folder / name).write_bytes(data)
    scanned = archives.scan_archives(spark, str(folder))
    name = F.regexp_extract("source_path", r"([^/]*)\z", 1)
    return archives.unpack(scanned.select(name.alias("name"), "source_path")).collect()


def test_files_in_archive_order(landed):
    for archive in ("ok.tgz", "ok.zip"):
        rows = sorted((r.file_ord, r.path, r.content) for r in landed if r.name == archive)
        assert [r[1:] for r in rows] == [("pkg/a.js", "let a = 1"), ("pkg/c.py", "x = �")]


def test_status(landed):
    status = {r.name: r.archive_status for r in landed}
    assert status == {
        "ok.tgz": "ok", "ok.zip": "ok", "docs.zip": "ok", "unread.zip": "ok",
        "bad-header.tgz": "error", "cut.tgz": "error", "bad.zip": "error",
        "cut.zip": "empty", "not.gz": "empty", "method.gz": "empty", "plain.txt": "empty",
    }  # the scan passes over files without a byte; an absent archive is an empty text too


def test_damaged_and_empty_archives_give_no_files(landed):
    with_files = {r.name for r in landed if r.file_ord is not None}
    assert with_files == {"ok.tgz", "ok.zip", "unread.zip"}


def test_large_archives_and_members_are_read_whole(spark):
    """Sizes beyond any former bound: nothing is cut, and damage far behind is seen."""
    data = b"let a = 1\n" * 4_500_000
    row = lambda name, blob: (name, bytearray(blob))
    whole = tar_gz([("a.js", data)])
    df = spark.createDataFrame(
        [row("t", whole), row("z", zipped([("a.js", data)])), row("torn", whole[: len(whole) * 9 // 10])], "name string, content binary"
    ).repartition(3)
    rows = archives.unpack(df).select("name", "archive_status", F.length("content").alias("n")).collect()
    assert sorted(map(tuple, rows), key=str) == [("t", "ok", len(data)), ("torn", "error", None), ("z", "ok", len(data))]


def test_only_the_archives_of_the_pairs_are_opened(spark, tmp_path):
    (tmp_path / "one.tgz").write_bytes(tar_gz([("a.js", b"x")]))
    (tmp_path / "two.tgz").write_bytes(tar_gz([("a.js", b"y")]))
    listed = archives.scan_archives(spark, str(tmp_path)).withColumn("source_url", F.regexp_extract("source_path", r"([^/]*)\z", 1))
    listed = spark.createDataFrame(listed.collect(), listed.schema)
    pairs = spark.createDataFrame([("one.tgz", "")], "source_url string, prev_source_url string")
    wanted = archives.wanted_archives(listed, pairs).select("source_url", "source_path")
    (tmp_path / "two.tgz").unlink()  # opening it would fail
    (row,) = archives.unpack(wanted).collect()
    assert (row.source_url, row.archive_status, row.content) == ("one.tgz", "ok", "x")


def test_damage_behind_what_is_held_gives_no_row(spark, monkeypatch):
    monkeypatch.setattr(archives, "_HELD_CHARS", 10)
    members = [(f"{i}.js", bytes(f"let a = {i}; " * 3, "ascii")) for i in range(6)]
    whole = zipped(members)
    broken = bytearray(whole)
    broken[whole.index(b"5.js") + 8] ^= 0xFF  # the data of the last member
    df = spark.createDataFrame([("whole", bytearray(whole)), ("torn", broken), ("tar", bytearray(tar_gz(members)))], "name string, content binary")
    rows = archives.unpack(df).collect()
    for name in ("whole", "tar"):
        assert [(r.path, r.content.encode()) for r in rows if r.name == name] == members
    assert [(r.archive_status, r.file_ord) for r in rows if r.name == "torn"] == [("error", None)]


@pytest.mark.parametrize("heavy", [0, 500])
def test_tasks_get_archives_by_bytes(spark, heavy):
    """One archive of a hundred times the mean leaves the other tasks within twice their mean."""
    rows = [(f"file:/a/{i:05}", 100_000 if i == heavy else 500 + i % 1000) for i in range(1000)]
    listed = spark.createDataFrame(rows, "source_path string, length bigint")
    dealt = archives.by_bytes(listed, 20_000).withColumn("task", F.spark_partition_id())
    assert sorted(tuple(r) for r in dealt.drop("task").collect()) == rows
    light = [r.n for r in dealt.where("length < 100000").groupBy("task").agg(F.sum("length").alias("n")).collect()]
    assert len(light) > 40 and max(light) <= 2 * sum(light) / len(light)
    assert archives.by_bytes(listed.limit(0)).count() == 0


def test_archives_of_a_bundle_and_of_folders(spark, tmp_path):
    """Bundled and single archives, in folders of any depth, are listed by tasks and opened by address."""
    from crosscheck import packing

    given = {"a@1.tgz": tar_gz(MEMBERS), "b 2+c.zip": zipped([(n, d or b"") for n, d in MEMBERS]), "torn.tgz": tar_gz([("a.js", NOISE), ("b.js", NOISE)], "cut"), "void": b""}
    named = spark.createDataFrame([(k, bytearray(v)) for k, v in given.items()], "file string, content binary").coalesce(1)
    (tmp_path / "x" / "y").mkdir(parents=True)
    packing.land_archives(named, str(tmp_path / "x" / "y")).collect()
    (tmp_path / "x" / "one%.zip").write_bytes(given["b 2+c.zip"])
    (tmp_path / "_other").mkdir()
    (tmp_path / "_other" / "no.zip").write_bytes(b"no")
    assert len([f for f in (tmp_path / "x" / "y").iterdir() if not f.name.endswith(".crc")]) == 1
    name = F.url_decode(F.regexp_extract("source_path", r"([^/]*)\z", 1))
    listed = archives.scan_archives(spark, str(tmp_path)).select(name.alias("name"), "source_path", "length")
    assert {r.name: r.length for r in listed.collect()} == {**{k: len(v) for k, v in given.items() if v}, "one%.zip": len(given["b 2+c.zip"])}
    rows = [(r.name, r.archive_status, r.path) for r in archives.unpack(listed).collect()]
    sound = [(n, "ok", p) for n in ("a@1.tgz", "b 2+c.zip", "one%.zip") for p in ("pkg/a.js", "pkg/c.py")]
    assert sorted(rows, key=str) == sorted([*sound, ("torn.tgz", "error", None)], key=str)
    assert [r.length for r in archives.scan_archives(spark, str(tmp_path), "{a,z}@*").collect()] == [len(given["a@1.tgz"])]


def test_plain_archives_read_like_any():
    """The short way gives what the general readers give, or nothing; packed archives take it."""
    import random

    from crosscheck import packing

    files = [("src/é.js" if i == 3 else f"src/{i}.js", "let a = 1\n" * i) for i in range(0, 60, 12)] + [("README.md", "no")]
    rng, short = random.Random(3), 0
    for whole in (packing._tar_bytes(files), packing._zip_bytes(files), tar_gz(MEMBERS), zipped(files)):
        assert archives._plain_files(whole) in (None, list(archives._files(io.BytesIO(whole))))
        short += archives._plain_files(whole) is not None
        for _ in range(1500):
            odd = bytearray(whole)
            if rng.random() < 0.8:
                odd[rng.randrange(len(odd))] ^= 1 << rng.randrange(8)
            else:
                odd = odd[: rng.randrange(len(odd))] + bytes(rng.randrange(3))
            found = archives._plain_files(bytes(odd))
            if found is not None:
                assert found == list(archives._files(io.BytesIO(bytes(odd))))
    assert short >= 3


def test_small_stretches_do_not_make_more_tasks_than_are_of_use(spark):
    rows = [(f"file:/a/{i:05}", 500 + i % 1000) for i in range(2000)]
    listed = spark.createDataFrame(rows, "source_path string, length bigint")
    cores = spark.sparkContext.defaultParallelism
    dealt = archives.by_bytes(listed, 100)
    assert cores < dealt.rdd.getNumPartitions() <= archives._TASKS_A_CORE * cores
    sizes = [r.n for r in dealt.groupBy(F.spark_partition_id()).agg(F.sum("length").alias("n")).collect()]
    assert sum(sizes) == sum(n for _, n in rows) and max(sizes) <= 2 * sum(sizes) / len(sizes)
    assert sorted(map(tuple, dealt.collect())) == rows


def _bundled_archives(folder, given):
    from crosscheck import packing

    bundle = folder / "some.bundle"
    bundle.write_bytes(packing._bundle_bytes(list(given.items())))
    return str(bundle), [(f"{bundle}!{at:012}-{length}/{name}", given[name]) for name, at, length in archives._members(str(bundle))]


def test_archives_of_a_bundle_are_read_by_blocks(tmp_path, monkeypatch):
    import random

    monkeypatch.setattr(archives, "_BLOCK", 4096)
    rng = random.Random(5)
    given = {f"{i}.zip": rng.randbytes(rng.choice((1, 30, 700, 4095, 4096, 9000) if i % 9 == 0 else (20, 90))) for i in range(400)}
    _, addressed = _bundled_archives(tmp_path, given)
    reads = []

    class Counted:
        def __init__(self, source):
            self.source = source

        def __getattr__(self, name):
            if name == "read":
                reads.append(1)
            return getattr(self.source, name)

    def read(some):
        reads.clear()
        landed = archives._Landed()
        for address, data in some:
            if landed._source is not None and not isinstance(landed._source, Counted):
                landed._source = Counted(landed._source)
            with landed.open(address) as source:
                assert source.read() == data
        landed.close()
        return len(reads)

    assert read(addressed) < len(addressed)  # the header and the archive were read apart before
    assert read(addressed[::40]) <= 2 * len(addressed[::40])
    read(addressed[::-1])
    for _ in range(5):
        read(rng.sample(addressed, 200))


def test_listing_of_a_bundle_is_that_of_the_zip(tmp_path):
    for given in ({"a@1": b"x", "b": b"yy", "c/d": b""}, {"é": b"x", "b": b"y"}, {"a b": b"x"}, {}):
        bundle, _ = _bundled_archives(tmp_path, given)
        with zipfile.ZipFile(bundle) as listing:
            assert archives._members(bundle) == [(m.filename, m.header_offset, m.file_size) for m in listing.infolist()]
    packed = tmp_path / "packed.bundle"
    packed.write_bytes(zipped([("a.zip", NOISE * 4)]))
    with pytest.raises(ValueError, match="packed.bundle"):
        archives._members(str(packed))


def test_texts_of_a_column():
    import pyarrow as pa

    from crosscheck import packing

    for values in (["a", "", "bc"], ["é", "b"], [], ["a", None], ["x", "yz"] * 3):
        column = pa.array(values, pa.string())
        for i in range(len(values) + 1):
            assert packing._texts(column[i:]) == values[i:] and packing._texts(column[:i]) == values[:i]
