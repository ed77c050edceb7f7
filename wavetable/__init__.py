"""Spectral analytics on Spark: many scans, many numeric channels, one label."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Task functions travel by value, so executors need NumPy and PyArrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
