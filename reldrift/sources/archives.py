"""Release archives: landed tar.gz and zip files as rows of scannable files.

Unpacking is the one step without a Spark expression, so it runs as batches of archives in
tasks.  A task is given paths, opens the files itself and streams them, so no archive passes
through Spark as a value and files nobody asks for are not opened.  Damage anywhere spoils
the whole archive, so its files are held back until its end is reached.  What is held is
bounded: beyond it the rest is only searched for damage, and the archive is read once more,
member by member.  Archives may also come as values (``content``).

Small archives that are whole and plain, as most are, are read without the general readers'
set-up per archive; at the least oddity the general readers decide.

Many small archives may be landed together in a bundle, a zip file that stores them as they
are, called ``*.bundle``; an archive in it has an address of its own.
"""

import gzip
import io
import re
import struct
import sys
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import EXCLUDED, SOURCE_EXTENSIONS
from ..operators.ordering import with_running_total
from ..session import materialize

# tasks carry the unpacking code with them, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

OK, EMPTY, ERROR = "ok", "empty", "error"

_BROKEN = (tarfile.TarError, zipfile.BadZipFile, zlib.error, EOFError, OSError,
           NotImplementedError, RuntimeError, ValueError)
# plain values: task code must not refer to other modules of the package
_ENDINGS = tuple("." + e for e in SOURCE_EXTENSIONS)
_EXCLUDED = re.compile(EXCLUDED.replace(r"\z", r"\Z"))
_BLOCK = 1 << 20
_BATCH_ROWS, _BATCH_CHARS = 1000, 8 << 20
_HELD_CHARS = 32 << 20
_PLAIN_BYTES, _PLAIN_UNPACKED = 1 << 20, 8 << 20
_KNOWN_HEADERS = 4096
_BUNDLE = ".bundle"
_TASK_BYTES, _TASKS_A_CORE = 64 << 20, 32


def _wanted(name: str) -> bool:
    """The path rule, so members nobody reads stay packed."""
    lower = name.lower()
    return lower.endswith(_ENDINGS) and not _EXCLUDED.search(lower)


class _StrictHeader(tarfile.TarInfo):
    """A damaged header in mid-archive is an error, not the end of the archive."""

    @classmethod
    def frombuf(cls, buf, encoding, errors):
        try:
            return super().frombuf(buf, encoding, errors)
        except (tarfile.InvalidHeaderError, tarfile.TruncatedHeaderError) as e:
            raise tarfile.ReadError(str(e)) from e


def _tar_members(source):
    with tarfile.open(fileobj=gzip.GzipFile(fileobj=source), mode="r|", tarinfo=_StrictHeader) as archive:
        regular = (m for m in archive if m.type in (tarfile.REGTYPE, tarfile.AREGTYPE))
        for ordinal, member in enumerate(regular):
            if _wanted(member.name):
                yield ordinal, member.name, archive.extractfile(member)


def _zip_members(source):
    with zipfile.ZipFile(source) as archive:
        regular = (m for m in archive.infolist() if not m.is_dir())
        for ordinal, member in enumerate(regular):
            if _wanted(member.filename):
                with archive.open(member) as data:
                    yield ordinal, member.filename, data


def _reader(source):
    """The member reader for the archive's magic bytes; None for an unusable archive."""
    head = source.read(10)
    source.seek(0)
    if head[:2] == b"\x1f\x8b":
        # the format is settled by the header; damage behind it is an error
        return _tar_members if len(head) >= 10 and head[2] == 8 else None
    if head[:2] == b"PK":
        try:
            zipfile.ZipFile(source).close()
        except _BROKEN:
            return None
        source.seek(0)
        return _zip_members
    return None


def _files(source) -> Iterator[tuple]:
    """(status, file_ord, path, content) rows of an opened archive; one row without a file if none.

    A member is one value: one that no value can hold fails the job, and is never cut.
    """
    members = _reader(source)
    if members is None:
        yield EMPTY, None, None, None
        return
    held, size, whole = [], 0, True
    try:
        for ordinal, name, data in members(source):
            if size < _HELD_CHARS:
                held.append((OK, ordinal, name, _text(data)))
                size += len(held[-1][-1])
                continue
            whole = False
            while data.read(_BLOCK):
                pass
    except _BROKEN:
        yield ERROR, None, None, None
        return
    if whole:
        yield from held or [(OK, None, None, None)]
        return
    del held
    source.seek(0)
    for ordinal, name, data in members(source):
        yield OK, ordinal, name, _text(data)


def _text(data) -> str:
    return data.read().decode("utf-8", errors="replace")


def _plain_files(data: bytes, known: dict | None = None) -> list[tuple] | None:
    """The rows of :func:`_files` for a small archive without any oddity; None leaves it to the general readers.

    ``known`` keeps tar headers that were parsed: many archives hold the same ones.
    """
    if len(data) > _PLAIN_BYTES:
        return None
    try:
        members = _plain_tar(data, {} if known is None else known) if data[:3] == b"\x1f\x8b\x08" else _plain_zip(data) if data[:4] == b"PK\x03\x04" else None
    except (zlib.error, struct.error, ValueError, IndexError):
        return None
    if members is None:
        return None
    return [(OK, ordinal, name, text.decode("utf-8", errors="replace")) for ordinal, name, text in members] or [(OK, None, None, None)]


def _plain_tar(data: bytes, known: dict):
    """Wanted members of one whole gzip stream that holds a tar of regular files with short names, else None."""
    gzip_ = zlib.decompressobj(31)
    tar = gzip_.decompress(data, _PLAIN_UNPACKED)
    if not gzip_.eof or gzip_.unused_data or gzip_.unconsumed_tail:
        return None
    members, at, ordinal = [], 0, 0
    while True:
        head = tar[at : at + 512]
        if len(head) < 512:
            return None
        if head == _ZEROS:
            # an archive without members is left to the general reader, as is one with text behind its end
            return members if at and tar.endswith(bytes(len(tar) - at)) else None
        if head not in known:
            if len(known) >= _KNOWN_HEADERS:
                known.clear()
            known[head] = _plain_header(head)
        member = known[head]
        if member is None:
            return None
        path, length, wanted = member
        begin = at + 512
        at = begin + length + -length % 512
        if at > len(tar):
            return None
        if wanted:
            members.append((ordinal, path, tar[begin : begin + length]))
        ordinal += 1


def _plain_header(head: bytes):
    """(path, length, wanted) of a header of a regular file with a short name, else None."""
    name, size, checksum = head[:100].rstrip(b"\0"), head[124:136], head[148:156]
    if (
        not _PLAIN_NAME.fullmatch(name) or head[156:157] != b"0" or head[257:263] != b"ustar\0" or head[345]
        or not _OCTAL.fullmatch(size) or not _CHECKSUM.fullmatch(checksum)
        or int(checksum[:6], 8) != sum(head) - sum(checksum) + 256
    ):
        return None
    path = name.decode()
    return path, int(size[:11], 8), _wanted(path)


def _plain_zip(data: bytes):
    """Wanted members of a zip of plain entries, one behind the other and named alike in both places, else None."""
    mark, disk, first_disk, here, count, size, begin, comment = struct.unpack(_END, data[-22:])
    end = len(data) - 22
    if mark != b"PK\x05\x06" or disk or first_disk or here != count or comment or begin + size != end or data[end - 20 : end - 16] == b"PK\x06\x07":
        return None
    members, at, place = [], begin, 0
    for ordinal in range(count):
        mark, shared, remark, disk, header = struct.unpack_from(_ENTRY, data, at)
        version, flags, method, checksum, packed, length, named, extra = struct.unpack(_SHARED, shared)
        name = data[at + 46 : at + 46 + named]
        if (
            mark != b"PK\x01\x02" or version > 45 or flags or method not in (0, 8) or extra or remark or disk or header != place
            or not _PLAIN_NAME.fullmatch(name) or data[place : place + 30 + named] != b"PK\x03\x04" + shared + name
        ):
            return None
        place += 30 + named + packed
        at += 46 + named
        if place > begin or at > end:
            return None
        path = name.decode()
        if _wanted(path):
            text = data[place - packed : place]
            if method:
                raw = zlib.decompressobj(-15)
                text = raw.decompress(text, _PLAIN_UNPACKED)
                if not raw.eof or raw.unused_data or raw.unconsumed_tail:
                    return None
            if len(text) != length or zlib.crc32(text) != checksum:
                return None
            members.append((ordinal, path, text))
    return members if place == begin and at == end else None


_ZEROS = bytes(512)
_ENTRY = "<4s2x26sHH6xI"  # of a listing; its 26 bytes stand in the header before the member too
_SHARED = "<HHH4xIIIHH"
_END = "<4sHHHHIIH"
_PLAIN_NAME = re.compile(rb"[!-~]*[!-.0-~]")  # printable, and no folder
_OCTAL = re.compile(rb"[0-7]{11}[\0 ]")
_CHECKSUM = re.compile(rb"[0-7]{6}\0 ")


def _file(path: str):
    """A landed file by its address, as (file system, place), through the file system its scheme names."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Landed:
    """Opens archives by address; the bundle of the last one stays open for those beside it.

    Archives that are asked for one behind the other are read a block at a time.
    """

    def __init__(self):
        self._bundle, self._source = None, None
        self._block, self._begin, self._last = b"", 0, None

    def open(self, address: str):
        """A file of its own, or ``<bundle>!<header offset>-<length>/<name>``."""
        bundle, bundled, inside = address.rpartition(f"{_BUNDLE}!")
        if not bundled:
            system, place = _file(address)
            return system.open_input_file(place)
        if bundle != self._bundle:
            self.close()
            system, place = _file(bundle + _BUNDLE)
            self._bundle, self._source = bundle, system.open_input_file(place)
        at, length = map(int, inside.partition("/")[0].split("-"))
        name, extra = struct.unpack("<HH", self._read(at, 30)[26:])
        at += 30 + name + extra
        data = self._read(at, length)
        self._last = at + length
        return io.BytesIO(data)

    def _read(self, at: int, length: int) -> bytes:
        begin = at - self._begin
        if not 0 <= begin <= begin + length <= len(self._block):
            beside = at == self._last or 0 <= begin <= len(self._block)
            self._source.seek(at)
            if length >= _BLOCK or not beside:
                return self._source.read(length)
            self._block, self._begin, begin = self._source.read(_BLOCK), at, 0
        return self._block[begin : begin + length]

    def close(self) -> None:
        if self._source is not None:
            self._source.close()
        self._bundle = self._source = self._last = None
        self._block, self._begin = b"", 0


def unpack(archives: DataFrame) -> DataFrame:
    """(keys..., content or source_path) -> (keys..., archive_status, file_ord, path, content).

    With ``content`` the archive is the value, else the file at ``source_path`` is opened by
    the task.  Every archive gives at least one row: ``file_ord`` is NULL where it holds no
    scannable file.  Status is 'ok', 'empty' (unknown format, or not the format its first
    bytes announce: an empty text) or 'error' (damaged, or no value: no result at all).
    """
    by_value = "content" in archives.columns
    keys = [c for c in archives.columns if c != "content"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in archives.select(*keys).schema)
    schema += ", archive_status string, file_ord int, path string, content string"
    where = "content" if by_value else "source_path"

    def unpack_batches(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
        landed, known = _Landed(), {}
        for batch in batches:
            given = [batch.column(k) for k in keys]

            def frame():
                which = pa.array(at, pa.int32())
                cells = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                return pa.RecordBatch.from_arrays([*[k.take(which) for k in given], *cells], names=[*keys, "archive_status", "file_ord", "path", "content"])

            at, rows, size = [], [], 0
            for i, archive in enumerate(batch.column(where)):
                if not archive.is_valid:
                    at.append(i), rows.append((ERROR, None, None, None))
                    continue
                with io.BytesIO(archive.as_buffer()) if by_value else landed.open(archive.as_py()) as source:
                    data = source.read(_PLAIN_BYTES + 1)
                    source.seek(0)
                    for row in _plain_files(data, known) or _files(source):
                        at.append(i), rows.append(row)
                        size += len(row[-1] or "")
                        if len(rows) >= _BATCH_ROWS or size >= _BATCH_CHARS:
                            yield frame()
                            at, rows, size = [], [], 0
            if rows:
                yield frame()
        landed.close()

    return archives.mapInArrow(unpack_batches, schema)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_path, length) of every file below a folder, written.

    Folders are listed by tasks, level by level, so no list of files passes through the driver
    and no task holds more than one folder's.  Names that begin with a dot or an underscore are
    passed over, as Spark's readers do.
    """

    def entries(batches):
        import pyarrow as pa
        from urllib.parse import quote

        from pyarrow import fs

        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                system, place = _file(folder)
                prefix = folder.rstrip("/") if "://" in folder or folder.startswith("file:") else "file://" + quote(folder.rstrip("/"))
                found = [f for f in system.get_file_info(fs.FileSelector(place)) if not f.base_name.startswith((".", "_"))]
                for lo in range(0, len(found), 10_000):
                    some = found[lo : lo + 10_000]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([f"{prefix}/{quote(f.base_name)}" for f in some], pa.string()),
                        pa.array([f.size if f.type == fs.FileType.File else None for f in some], pa.int64()),
                    ], names=["source_path", "length"])

    folders, levels = spark.createDataFrame([(path,)], "folder string"), []
    while True:
        levels.append(materialize(folders.mapInArrow(entries, "source_path string, length bigint"), "listed"))
        folders = levels[-1].where(F.col("length").isNull()).select(F.col("source_path").alias("folder"))
        if folders.isEmpty():
            break
        folders = folders.repartition(spark.sparkContext.defaultParallelism)
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    return files.where(F.col("length").isNotNull())


def _members(bundle: str) -> list[tuple[str, int, int]]:
    """(name, header offset, length) of what a bundle holds; an odd listing is left to Python's reader."""
    system, place = _file(bundle)
    with system.open_input_file(place) as source:
        size = source.size()
        source.seek(max(size - 22, 0))
        last = source.read(22)
        if len(last) == 22:
            mark, disk, first_disk, here, count, listed, begin, remark = struct.unpack(_END, last)
            if mark == b"PK\x05\x06" and not (disk or first_disk or remark) and here == count < 0xFFFF and begin + listed + 22 == size:
                source.seek(begin)
                members = _plain_listing(source.read(listed), count)
                if members is not None:
                    return members
        source.seek(0)
        with zipfile.ZipFile(source) as listing:
            members = listing.infolist()
    if any(m.compress_type != zipfile.ZIP_STORED for m in members):
        raise ValueError(f"{bundle} does not store its archives as they are")
    return [(m.filename, m.header_offset, m.file_size) for m in members]


def _plain_listing(listing: bytes, count: int):
    """The stored members of a listing whose names are plain, else None."""
    members, at = [], 0
    for _ in range(count):
        if at + 46 > len(listing):
            return None
        mark, shared, remark, disk, header = struct.unpack_from(_ENTRY, listing, at)
        version, flags, method, _, packed, length, named, extra = struct.unpack(_SHARED, shared)
        name = listing[at + 46 : at + 46 + named]
        if mark != b"PK\x01\x02" or version > 45 or flags or method or extra or remark or disk or packed != length or not _PLAIN_NAME.fullmatch(name):
            return None
        members.append((name.decode(), header, length))
        at += 46 + named
    return members if at == len(listing) else None


def _bundled(bundles: DataFrame) -> DataFrame:
    """(source_path, length) of the archives in bundles; a bundle's listing is read, and no archive."""

    def entries(batches):
        import pyarrow as pa
        from urllib.parse import quote

        for batch in batches:
            for bundle in batch.column("source_path").to_pylist():
                members = _members(bundle)
                yield pa.RecordBatch.from_arrays([
                    pa.array([f"{bundle}!{header:012}-{length}/{quote(name, safe='')}" for name, header, length in members], pa.string()),
                    pa.array([length for _, _, length in members], pa.int64()),
                ], names=["source_path", "length"])

    return bundles.mapInArrow(entries, "source_path string, length bigint")


def scan_archives(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Archives below a folder, bundled ones among them: (source_path, length).

    No archive's content is read; empty ones are passed over.
    """
    files = list_files(spark, path)
    is_bundle = F.col("source_path").endswith(_BUNDLE)
    bundles = files.where(is_bundle).repartition(spark.sparkContext.defaultParallelism)
    found = files.where(~is_bundle).unionByName(_bundled(bundles)).where(F.col("length") > 0)
    if glob == "*":
        return found
    pattern = spark._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().pattern()
    name = F.url_decode(F.replace(F.substring_index("source_path", "/", -1), F.lit("+"), F.lit("%2B")))
    return found.where(name.rlike(rf"\A(?:{pattern})\z"))


def by_bytes(archives: DataFrame, task_bytes: int = _TASK_BYTES) -> DataFrame:
    """Deal listed archives out to tasks by their bytes instead of their number.

    The archives, laid end to end in the order of their paths, are cut every ``task_bytes``;
    one that is larger than that keeps a task busy, and no other archive waits behind it but
    those that begin in the same stretch.  Where this gives each core more than
    ``_TASKS_A_CORE`` tasks, whose set-up would outweigh their work, stretches are longer, up
    to ``_TASK_BYTES``.
    """
    archives = materialize(archives, "dealt")
    total = archives.agg(F.sum("length").alias("n")).head()["n"] or 0
    enough = _TASKS_A_CORE * archives.sparkSession.sparkContext.defaultParallelism
    task_bytes = max(task_bytes, min(_TASK_BYTES, -(-total // enough)))
    tasks = max(1, -(-total // task_bytes))
    placed = with_running_total(archives, ["source_path"], "length", "_begin")
    task = F.least(F.floor(F.col("_begin") / task_bytes), F.lit(tasks - 1)).cast("int")
    return placed.repartitionById(tasks, task).drop("_begin")


def wanted_archives(archives: DataFrame, pairs: DataFrame) -> DataFrame:
    """The archives that a side of ``pairs`` names by its address, each once."""
    named = pairs.select(F.explode(F.array("source_url", "prev_source_url")).alias("source_url")).distinct()
    return archives.join(named, "source_url", "left_semi")


def archive_files(unpacked: DataFrame) -> DataFrame:
    """The files of sound archives."""
    return unpacked.where(F.col("file_ord").isNotNull())
