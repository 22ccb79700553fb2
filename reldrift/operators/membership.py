"""A filter before an exact join: which rows may have a key of a given set.

The set is kept as a bitmap of fixed size, cut into words of 64 bits.  A key, a 64-bit hash,
picks a word by its upper bits and three bits of it by its lower ones.  The words are a table
of at most 2**(bits - 6) rows whatever is put in, so they are broadcast; neither a plan nor
the driver's program holds them.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BITS = 22  # 2**22 bits: at most 65536 words


def bitmap_of(keys: DataFrame, key: Column, bits: int = BITS) -> DataFrame:
    """(_bitmap_word, _bitmap_set): the bitmap of all values of ``key``; NULL is not put in."""
    known = keys.select(key.alias("_key")).where(F.col("_key").isNotNull())
    marked = known.groupBy(_word(F.col("_key"), bits).alias("_bitmap_word")).agg(F.bit_or(_mask(F.col("_key"))).alias("_bitmap_set"))
    return materialize(marked, "bitmap")


def may_be_in(rows: DataFrame, key: Column, bitmap: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows whose ``key`` was put into the bitmap, and a few others: none if it is empty, more the fuller it is."""
    return rows.join(F.broadcast(bitmap), _held(key, bits), "left_semi")


def cannot_be_in(rows: DataFrame, key: Column, bitmap: DataFrame, bits: int = BITS) -> DataFrame:
    """The rows :func:`may_be_in` leaves out, those without a key among them."""
    return rows.join(F.broadcast(bitmap), _held(key, bits), "left_anti")


def _word(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - (bits - 6))


def _mask(key: Column) -> Column:
    one = F.lit(1).cast("long")
    at = [F.shiftrightunsigned(key, shift).bitwiseAND(F.lit(63).cast("long")).cast("int") for shift in (0, 6, 12)]
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", one, a) for a in at])


def _held(key: Column, bits: int) -> Column:
    return (_word(key, bits) == F.col("_bitmap_word")) & (_mask(key).bitwiseAND(F.col("_bitmap_set")) == _mask(key))
