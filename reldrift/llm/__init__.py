"""Operators of a training-data pipeline; nothing outside this package imports it."""

import sys

from pyspark import cloudpickle

# tasks carry this code with them, so executors need no installed package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
