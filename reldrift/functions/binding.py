"""Name an intermediate value inside one expression."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)
