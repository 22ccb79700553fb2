"""Archives written from rows: the inverse of unpacking, for round trips."""

import io
import struct
import sys
import tarfile
import zipfile
import zlib
from itertools import islice

from pyspark import cloudpickle
from pyspark.sql import DataFrame

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUNDLED, BUNDLE_BYTES = 1 << 20, 8 << 20


def pack(releases: DataFrame) -> DataFrame:
    """(keys..., files array<struct<path,content>>) -> (keys..., content), tar.gz and zip in turn.

    Writes archives from rows: the inverse of :func:`unpack`, for round trips.
    """
    keys = [c for c in releases.columns if c != "files"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in releases.select(*keys).schema)
    schema += ", content binary"

    def pack_batches(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            files = batch.column("files")
            flat, size = files.flatten(), pc.list_value_length(files).to_pylist()
            members = zip(_texts(flat.field("path")), _texts(flat.field("content")))
            packed = [(_zip_bytes if i % 2 else _tar_bytes)(list(islice(members, n))) for i, n in enumerate(size)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(packed, pa.binary())], names=[*keys, "content"])

    return releases.mapInArrow(pack_batches, schema)


def _texts(column) -> list:
    """``column.to_pylist()`` of texts; those in plain ASCII are cut out of one long text, which is quicker."""
    import pyarrow as pa

    _, bounds, data = column.buffers() if column.type == pa.string() else (None, None, None)
    if column.null_count or data is None:
        return column.to_pylist()
    bounds = memoryview(bounds).cast("B")[4 * column.offset : 4 * (column.offset + len(column) + 1)].cast("i").tolist()
    begin = bounds[0]
    data = memoryview(data)[begin : bounds[-1]].tobytes()
    if not data.isascii():
        return column.to_pylist()
    text = data.decode()
    return [text[lo - begin : hi - begin] for lo, hi in zip(bounds, islice(bounds, 1, None))]


def land(named: DataFrame, folder: str) -> DataFrame:
    """(file, content) -> one file each below ``folder``, written by the tasks; gives (file, length)."""

    def write_batches(batches):
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(place)
        for batch in batches:
            for file, content in zip(batch["file"], batch["content"]):
                with system.open_output_stream(f"{place}/{file}") as out:
                    out.write(bytes(content))
            yield batch[["file"]].assign(length=[len(c) for c in batch["content"]])

    return named.select("file", "content").mapInPandas(write_batches, "file string, length bigint")


def land_archives(named: DataFrame, folder: str) -> DataFrame:
    """(file, content) -> archives below ``folder``, written by the tasks; gives (file, length).

    Archives of up to ``BUNDLED`` bytes share files, bundles, instead of filling a block of the
    file system and an entry of its listing each; a larger one is a file of its own.  A task
    that is repeated writes the same bundles again.
    """

    def write_batches(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyarrow import fs
        from pyspark import TaskContext

        system, place = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        system.create_dir(place)
        held, size, number, task = [], 0, 0, TaskContext.get().partitionId()

        def write(name, data):
            with system.open_output_stream(f"{place}/{name}") as out:
                out.write(data)

        for batch in batches:
            for file, content in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                if len(content) > BUNDLED:
                    write(file, content)
                    continue
                held.append((file, content))
                size += len(content)
                if size >= BUNDLE_BYTES:
                    write(f"{task:06}-{number:06}.bundle", _bundle_bytes(held))
                    held, size, number = [], 0, number + 1
            length = pc.binary_length(batch.column("content")).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("file"), length], names=["file", "length"])
        if held:
            write(f"{task:06}-{number:06}.bundle", _bundle_bytes(held))

    return named.select("file", "content").mapInArrow(write_batches, "file string, length bigint")


def _bundle_bytes(named) -> bytes:
    return _zip_of([(name.encode(), content, len(content), zlib.crc32(content), 0) for name, content in named])


_OWNER, _TIME = b"0000644\x000000000\x000000000\x00", b"\x0000000000000\x00"
_NO_NAMES = bytes(100) + b"ustar\x0000" + bytes(64) + b"0000000\x00" * 2 + bytes(167)
_FIXED_SUM = sum(_OWNER + _TIME + b" " * 8 + b"0" + _NO_NAMES)


def _tar_header(path: str, size: int) -> bytes:
    name = path.encode()
    if len(name) > 100 or not path.isascii() or size >= 8**11:
        info = tarfile.TarInfo(path)
        info.size = size
        return info.tobuf()
    length = b"%011o" % size
    total = _FIXED_SUM + sum(name) + sum(length)
    return b"".join((name.ljust(100, b"\0"), _OWNER, length, _TIME, b"%06o\x00 0" % total, _NO_NAMES))


def _tar_bytes(files) -> bytes:
    parts, size = [], 0
    for path, content in files:
        data = content.encode()
        parts += (_tar_header(path, len(data)), data, bytes(-len(data) % 512))
        size += sum(map(len, parts[-3:]))
    parts.append(bytes(1024 + -(size + 1024) % tarfile.RECORDSIZE))
    return _deflated(b"".join(parts), 31)


def _deflated(data: bytes, window: int) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, window)
    return packer.compress(data) + packer.flush()


def _zip_bytes(files) -> bytes:
    """Members of some length are deflated, short ones stored."""
    members = []
    for path, content in files:
        data = content.encode()
        packed = _deflated(data, -15) if len(data) > 128 else data
        members.append((path.encode(), packed, len(data), zlib.crc32(data), 8 if len(data) > 128 else 0))
    return _zip_of(members)


def _zip_of(members) -> bytes:
    """A zip of (name, packed bytes, length, checksum, method); Python's own writer where numbers outgrow the format."""
    if len(members) > 0xFFFF or sum(len(m[1]) + 2 * len(m[0]) + 76 for m in members) >= 0xFFFFFFFF or any(m[2] >= 0xFFFFFFFF for m in members):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as archive:
            for name, packed, _, _, method in members:
                archive.writestr(name.decode(), zlib.decompress(packed, -15) if method else packed, zipfile.ZIP_DEFLATED if method else zipfile.ZIP_STORED)
        return buffer.getvalue()
    parts, listing, at = [], [], 0
    for name, packed, length, checksum, method in members:
        flags = 0 if name.isascii() else 0x800
        shared = struct.pack("<HHHHHIIIHH", 20, flags, method, 0, 33, checksum, len(packed), length, len(name), 0)
        parts += (b"PK\x03\x04", shared, name, packed)
        listing += (b"PK\x01\x02\x14\x03", shared, struct.pack("<HHHII", 0, 0, 0, 0o600 << 16, at), name)
        at += 30 + len(name) + len(packed)
    size = sum(map(len, listing))
    end = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, len(members), len(members), size, at, 0)
    return b"".join((*parts, *listing, end))
