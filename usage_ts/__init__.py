"""Interval records to daily series, client profiles, forecasts and clusters on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
