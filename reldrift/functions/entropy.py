"""Longest encoded run, Shannon entropy and the high-entropy predicate."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .binding import let


def longest_encoded_run(text: Column) -> Column:
    """Longest run of bytes >= 0x2B, measured in bytes; the first one wins a tie."""
    runs = F.regexp_extract_all(text, F.lit(P.ENCODED_RUN), F.lit(0))
    ranked = F.transform(
        runs,
        lambda run, i: F.struct(F.octet_length(run).alias("bytes"), (-i).alias("rank"), run.alias("run")),
    )
    return F.coalesce(F.array_max(ranked)["run"], F.lit(""))


def shannon_entropy(text: Column) -> Column:
    """Bits per character: character counts over the byte length of the text.

    With n characters of counts k over B bytes, H = (n*log2(B) - sum(k*log2(k))) / B.
    """
    size = F.octet_length(text).cast("double")
    characters = F.char_length(text)
    return F.when(size == 0, 0.0).otherwise((characters * F.log2(size) - _weighted(text)) / size)


def _k_log_k(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count)).otherwise(0.0)


def _weighted(text: Column) -> Column:
    """sum(k*log2(k)): sorted, equal characters stand side by side, and a run's length is a count."""
    ordered = F.array_join(F.sort_array(F.split(text, "")), "")
    runs = F.regexp_extract_all(ordered, F.lit(r"(?s)(.)\1*+"), F.lit(0))
    return F.aggregate(runs, F.lit(0.0), lambda total, run: total + _k_log_k(F.char_length(run).cast("double")))


# such a run has more than _ENOUGH different characters, hence so many characters, none of them before it
_ENOUGH = int(2 ** P.ENTROPY_THRESHOLD)
_LONG_RUN = r"(?<!%s)%s{%d}" % (P.ENCODED_RUN[:-1], P.ENCODED_RUN[:-1], _ENOUGH + 1)


def is_high_entropy(text: Column) -> Column:
    """Whether the longest run is one of high entropy; runs are only cut out of texts with a run of enough characters."""
    return (
        F.when(F.octet_length(text) <= _ENOUGH, False)
        .when(~text.rlike(_LONG_RUN), False)
        .otherwise(let(longest_encoded_run(text), is_high_entropy_run))
    )


def is_high_entropy_run(run: Column) -> Column:
    """Whether an encoded run has at least 24 bytes and carries more than 5 bits per character.

    A text with d different characters has at most log2(d) bits per character, so the
    sum is only taken over runs with more than 32 of them.  Rounded before the
    comparison: the last digits depend on summation order.
    """
    different = F.size(F.array_distinct(F.split(run, "")))
    return (
        F.when(F.octet_length(run) < P.MIN_RUN_BYTES, False)
        .when(F.octet_length(run) <= _ENOUGH, False)
        .when(different <= _ENOUGH, False)
        .otherwise(F.round(shannon_entropy(run), 9) > P.ENTROPY_THRESHOLD)
    )


def has_nul(text: Column) -> Column:
    """Literals holding U+0000 are data tables, not payloads."""
    return F.contains(text, F.lit("\u0000"))
