"""File selection by path: which archive members are scanned, and as what language."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _any_of(words) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def _extension_in(path: Column, extensions) -> Column:
    """The text after the last dot is one of the extensions, whatever its case."""
    last = F.lower(F.substring_index(path, ".", -1))
    return last.isin(*extensions) & path.contains(".")


SOURCE_EXTENSIONS = tuple(e for e in P.TEXT_EXTENSIONS if e not in P.DOCUMENT_EXTENSIONS)

# one search for bundles, skipped directories, document names and lockfiles
EXCLUDED = (
    r"\." + _any_of(P.BUNDLE_SUFFIXES) + r"\z"
    r"|(?:\A|/)" + _any_of(P.SKIPPED_DIRECTORIES) + "/"
    r"|(?:\A|[/\\])(?:" + _any_of(P.DOCUMENT_NAME_PREFIXES) + r"[^/\\]*|" + _any_of(P.LOCKFILES) + r")\z"
)


def is_text_file(path: Column) -> Column:
    """True when the lower-cased path ends with a known text extension."""
    return _extension_in(path, P.TEXT_EXTENSIONS)


def is_scannable_file(path: Column) -> Column:
    """True for source and manifest files; documents, lockfiles and bundles are out."""
    return _extension_in(path, SOURCE_EXTENSIONS) & ~F.lower(path).rlike(EXCLUDED)


def file_language(path: Column) -> Column:
    """'c' for C-like comment syntax, 'python', or 'other'."""
    return (
        F.when(_extension_in(path, P.C_STYLE_EXTENSIONS), "c")
        .when(_extension_in(path, P.PYTHON_EXTENSIONS), "python")
        .otherwise("other")
    )
