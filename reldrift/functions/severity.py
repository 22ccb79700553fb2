"""Severity of a summed weight, and its label."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def severity(total_weight: Column) -> Column:
    expr = F
    for bound, level in P.SEVERITY_BOUNDS:
        expr = expr.when(total_weight <= bound, level)
    return expr.otherwise(P.MAX_SEVERITY)


def severity_label(level: Column) -> Column:
    expr = F
    for value, label in P.SEVERITY_LABELS.items():
        expr = expr.when(level == value, label)
    return expr.otherwise("NONE")
