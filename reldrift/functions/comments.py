"""Comment removal as one regular-expression replacement per file."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .paths import file_language


def strip_c_style(text: Column) -> Column:
    """Drop // and /* */ comments; strings, raw strings and char literals stay."""
    return F.regexp_replace(text, F.lit(P.C_STYLE_COMMENTS), F.lit("$1"))


def strip_python(text: Column) -> Column:
    """Drop # comments and every triple-quoted region; ordinary strings stay."""
    return F.regexp_replace(text, F.lit(P.PYTHON_COMMENTS), F.lit("$1"))


def strip_comments(path: Column, text: Column) -> Column:
    """Remove comments by the language of the path; other files are left alone."""
    language = file_language(path)
    return (
        F.when(language == "c", strip_c_style(text))
        .when(language == "python", strip_python(text))
        .otherwise(text)
    )
