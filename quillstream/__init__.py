"""Prose analytics on Spark: outlines, word counts, sentence windows, pluggable scorers, calibration, corpus building."""

import sys

from pyspark import cloudpickle

# Functions for executors are sent by value: executors need the libraries, not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
