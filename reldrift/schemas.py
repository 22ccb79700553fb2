"""Schemas of the tables the operators exchange."""

from pyspark.sql import types as T

_S, _I, _L, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.TimestampType()


def _struct(*fields) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


RELEASE = ("ecosystem", "name", "version")
PAIR = ("ecosystem", "name", "version", "prev_version")

SIGNAL = _struct(
    ("kind", _S), ("description", _S), ("evidence", T.ArrayType(_S)), ("weight", _I),
)
FINDINGS = _struct(
    ("ecosystem", _S), ("name", _S), ("version", _S), ("prev_version", _S),
    ("severity", _I), ("signals", T.ArrayType(SIGNAL)), ("analyzed_at", _TS),
)
WATCHED = _struct(("ecosystem", _S), ("name", _S), ("last_version", _S), ("updated_at", _TS))
SCAN_LOG = _struct(
    ("ecosystem", _S), ("name", _S), ("version", _S), ("prev_version", _S), ("analyzed_at", _TS),
)
# registry documents, one field set covering the six shapes (field names do not clash)
_CORRUPT = ("_corrupt", _S)
NPM_DOC = _struct(
    ("dist-tags", _struct(("latest", _S))),
    ("versions", T.MapType(_S, _struct(("dist", _struct(("tarball", _S)))))),
    _CORRUPT,
)
PYPI_DOC = _struct(
    ("info", _struct(("version", _S))),
    ("releases", T.MapType(_S, T.ArrayType(_struct(("url", _S), ("packagetype", _S))))),
    _CORRUPT,
)
CARGO_DOC = _struct(
    ("crate", _struct(("newest_version", _S))),
    ("versions", T.ArrayType(_struct(("num", _S), ("dl_path", _S)))),
    _CORRUPT,
)
MAVEN_DOC = _struct(
    ("response", _struct(("docs", T.ArrayType(_struct(("v", _S)))))), _CORRUPT,
)
GO_DOC = _struct(("Version", _S), _CORRUPT)
NUGET_DOC = _struct(("versions", T.ArrayType(_S)), _CORRUPT)
