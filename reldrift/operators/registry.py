"""Registry documents: latest version and artifact addresses, six shapes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import patterns as P
from ..functions.binding import let


def _parse(body: Column, schema) -> Column:
    """Permissive parsing; a document that does not fit its schema is marked corrupt."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    return F.from_json(body, schema, options)


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


_SHAPES = {
    "npm": S.NPM_DOC,
    "pypi": S.PYPI_DOC,
    "cargo": S.CARGO_DOC,
    "maven": S.MAVEN_DOC,
    "go": S.GO_DOC,
    "nuget": S.NUGET_DOC,
}

_LATEST = {
    "npm": lambda d: d["dist-tags"]["latest"],
    "pypi": lambda d: d["info"]["version"],
    "cargo": lambda d: d["crate"]["newest_version"],
    "maven": lambda d: F.get(d["response"]["docs"], 0)["v"],
    "go": lambda d: d["Version"],
    # registry order is trusted: the last one listed is the newest
    "nuget": lambda d: F.try_element_at(d["versions"], F.lit(-1)),
}


def _pick(values: dict[str, Column]) -> Column:
    """The value for the row's ecosystem, so a document is parsed in its own shape only."""
    expr = F
    for ecosystem, value in values.items():
        expr = expr.when(F.col("ecosystem") == ecosystem, value)
    return expr


def _outcome(body: Column, ecosystem: str) -> Column:
    latest = _LATEST[ecosystem]
    return let(
        _parse(body, _SHAPES[ecosystem]),
        lambda d: F.struct(
            d["_corrupt"].isNotNull().alias("corrupt"),
            F.when(d["_corrupt"].isNull(), latest(d)).alias("latest"),
        ),
    )


def _with_outcome(docs: DataFrame) -> DataFrame:
    """Add ``_o`` (corrupt, latest).  Generated, so that filters on it do not parse again."""
    outcome = _pick({e: _outcome(F.col("body"), e) for e in _SHAPES})
    return docs.select("*", F.explode(F.array(outcome)).alias("_o"))


def is_module_path(path: Column) -> Column:
    """Whether a Go module path is well formed, by the documented rules for such paths.

    The first element needs a dot and holds only lower-case letters, digits, dots and
    dashes, with no leading dash.  No element is empty, begins or ends with a dot, is a
    reserved file name or ends in a tilde and digits.  A last element v and a number must be
    v2 or later without a leading zero, and a path on gopkg.in ends in a dot and a version.
    """
    shape = path.rlike(r"\A(?!-)(?=[^/]*\.)[a-z0-9.-]+(/[-._~A-Za-z0-9]+)*\z")
    dots = path.rlike(r"(\A|/)\.|\.(/|\z)")
    reserved = path.rlike(r"(?i)(\A|/)(con|com[1-9]|nul|prn|aux|lpt[1-9])(\.[^/]*)?(/|\z)")
    tilde = path.rlike(r"(\A|/)[^/.]*~[0-9]+(\.[^/]*)?(/|\z)")
    hosted = path.startswith("gopkg.in/")
    major = path.rlike(r"/v(0[0-9.]*|1|[0-9]*\.[0-9.]*)\z")
    version = F.when(hosted, path.rlike(r"\.v(0|[1-9][0-9]*)(-unstable)?\z")).otherwise(~major)
    return shape & ~dots & ~reserved & ~tilde & version


def _bad_coordinate() -> Column:
    name = F.col("name")
    return (
        F.when(F.col("ecosystem") == "maven", ~name.contains(":"))
        .when(F.col("ecosystem") == "go", ~is_module_path(name))
        .otherwise(False)
    )


def outcomes(docs: DataFrame) -> DataFrame:
    """Add ``latest``: NULL for a malformed coordinate or document, '' where none is named."""
    latest = F.when(~_bad_coordinate(), F.col("_o.latest"))
    return _with_outcome(docs).withColumn("latest", latest).drop("_o")


def registry_latest(docs: DataFrame) -> DataFrame:
    """Add ``latest``; broken, empty and malformed documents are dropped.

    A package coordinate of the group:artifact kind needs its colon, a module path its form.
    """
    return (
        _with_outcome(docs.where(~_bad_coordinate()))
        .where(F.col("_o.latest") != "")
        .withColumn("latest", F.col("_o.latest"))
        .drop("_o")
    )


def rejected_documents(docs: DataFrame) -> DataFrame:
    """Documents without a usable latest version, with the reason: nothing vanishes silently."""
    reason = (
        F.when(_bad_coordinate(), "bad coordinate")
        .when(F.col("_o.corrupt"), "malformed document")
        .when(F.coalesce(F.col("_o.latest"), F.lit("")) == "", "no latest version")
    )
    return _with_outcome(docs).withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_o")


# --- artifact addresses ------------------------------------------------------


def pick_source_file(files: Column) -> Column:
    """URL of the first source distribution, else of the first file, else ''."""
    source = F.get(F.filter(files, lambda f: f["packagetype"] == "sdist"), 0)["url"]
    has_source = F.exists(files, lambda f: f["packagetype"] == "sdist")
    return _or_empty(F.when(has_source, source).otherwise(F.get(files, 0)["url"]))


def cargo_url(versions: Column, version: Column) -> Column:
    """Download path of the first entry with that number, made absolute; else ''."""
    entry = F.get(F.filter(versions, lambda v: v["num"] == version), 0)
    return _or_empty(
        F.when(entry.isNotNull(), F.concat(F.lit(P.CARGO_BASE), _or_empty(entry["dl_path"])))
    )


def maven_url(coordinate: Column, version: Column) -> Column:
    group = F.regexp_extract(coordinate, r"\A([^:]*):", 1)
    artifact = F.regexp_extract(coordinate, r"\A[^:]*:([\s\S]*)\z", 1)
    path = F.translate(group, ".", "/")
    return F.concat(
        F.lit(P.MAVEN_BASE + "/"), path, F.lit("/"), artifact, F.lit("/"), version,
        F.lit("/"), artifact, F.lit("-"), version, F.lit(".jar"),
    )


def go_url(module: Column, version: Column) -> Column:
    """Upper-case letters of a module path are written as '!' and the lower-case letter."""
    escaped = F.lower(F.regexp_replace(module, "([A-Z])", "!$1"))
    # form encoding turned into path-segment encoding, which leaves $ & + : = @ ~ alone
    encoded = F.url_encode(version)
    for code, char in (
        ("+", "%20"), ("*", "%2A"),
        ("%24", "$"), ("%26", "&"), ("%2B", "+"), ("%3A", ":"), ("%3D", "="), ("%40", "@"), ("%7E", "~"),
    ):
        encoded = F.replace(encoded, F.lit(code), F.lit(char))
    return F.concat(F.lit(P.GO_BASE + "/"), escaped, F.lit("/@v/"), encoded, F.lit(".zip"))


def nuget_url(package: Column, version: Column) -> Column:
    name, number = F.lower(package), F.lower(version)
    return F.concat(
        F.lit(P.NUGET_BASE + "/"), name, F.lit("/"), number, F.lit("/"), name, F.lit("."), number,
        F.lit(".nupkg"),
    )


def _addresses(ecosystem: str) -> Column:
    """Both archive addresses of a row, its document parsed once; '' where it lists none."""
    name, versions = F.col("name"), ("latest", "last_seen")

    def both(address) -> Column:
        return F.struct(*[address(F.col(v)).alias(v) for v in versions])

    if ecosystem == "maven":
        return both(lambda v: maven_url(name, v))
    if ecosystem == "go":
        return both(lambda v: go_url(name, v))
    if ecosystem == "nuget":
        return both(lambda v: nuget_url(name, v))
    listed = {
        "npm": lambda d, v: _or_empty(F.try_element_at(d["versions"], v)["dist"]["tarball"]),
        "pypi": lambda d, v: pick_source_file(F.try_element_at(d["releases"], v)),
        "cargo": lambda d, v: cargo_url(d["versions"], v),
    }[ecosystem]
    document = _parse(F.col("body"), _SHAPES[ecosystem])
    return let(document, lambda d: both(lambda v: listed(d, v)))


def resolve_changes(changed: DataFrame) -> DataFrame:
    """(ecosystem, name, body, latest, last_seen) -> release pairs with both addresses."""
    addresses = _pick({e: _addresses(e) for e in _SHAPES})
    return changed.select(
        "ecosystem", "name", "latest", "last_seen", F.explode(F.array(addresses)).alias("_a")
    ).select(
        "ecosystem",
        "name",
        F.col("latest").alias("version"),
        F.col("_a.latest").alias("source_url"),
        F.col("last_seen").alias("prev_version"),
        F.col("_a.last_seen").alias("prev_source_url"),
    )
